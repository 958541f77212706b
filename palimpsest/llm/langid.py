"""Language ID with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors,
each permuted by its place; a document bundles (adds) the vectors of its n-grams; a language's prototype bundles the
normalised vectors of its training documents. The cosine with the prototypes tells the language.

Training takes a bounded sample: at most about `rows_per_lang` labelled rows of each language, chosen by a hash of
the text. Each task sums its part into integers, so that the prototypes don't depend on how rows were dealt.
Prediction is one pass without a shuffle; the model has languages x DIM numbers.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from palimpsest.llm.common import free_name, in_small_batches

DIM = 512
GRAM = 3
#: Word gap, a-z, and classes shared by all other letters by code point.
CLASSES = 40
SEED = 20_240_501
ROWS_PER_LANG = 4000
MOST_LANGS = 4096
UNIT = 1 << 20
#: Distinct n-grams whose vectors are bundled at once.
STEP = 2048
#: Cosine of a text with a language below which it is as unlike as random vectors are (two standard deviations).
NOISE = 2 / DIM**0.5
#: N-grams that a text must have to be told from noise.
GRAMS_TOLD = 40


@functools.cache
def _letters() -> list[np.ndarray]:
    """The random vectors of all classes, permuted for each place of an n-gram, the first place first."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIM))
    return [np.roll(letters, GRAM - 1 - place, axis=1) for place in range(GRAM)]


def gram_vectors(which: np.ndarray) -> np.ndarray:
    """The bound vectors of n-grams given by number."""
    out = np.ones((len(which), DIM), np.int8)
    for place, letters in enumerate(_letters()):
        out *= letters[which // CLASSES ** (GRAM - 1 - place) % CLASSES]
    return out


@functools.cache
def _class_table() -> np.ndarray:
    """Classes of the code points of the basic plane; 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()[0]
            out[i] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (CLASSES - 27)
    return out


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram numbers of the text and how often each occurs; none without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    beyond = points >> 16 != 0
    kinds = _class_table()[np.where(beyond, 0, points)]
    if beyond.any():
        kinds[beyond] = [27 + p % (CLASSES - 27) if chr(p).isalpha() else 0 for p in points[beyond].tolist()]
    kinds = kinds[(kinds > 0) | np.r_[False, kinds[:-1] > 0]] if len(kinds) else kinds  # one gap between words
    if not kinds.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = np.r_[0, kinds, 0] if kinds[-1] else np.r_[0, kinds]
    codes = kinds.astype(np.int64)
    at = codes[: len(codes) - GRAM + 1]
    for k in range(1, GRAM):
        at = at * CLASSES + codes[k : len(codes) - GRAM + 1 + k]
    return np.unique(at, return_counts=True)


def bundle(text: str | None) -> np.ndarray | None:
    """The text's vector, of length 1; None if it has no letter."""
    which, often = grams(text)
    if not len(which):
        return None
    v = np.zeros(DIM, np.float64)
    for a in range(0, len(which), STEP):  # long texts by parts
        v += often[a : a + STEP].astype(np.float32) @ gram_vectors(which[a : a + STEP]).astype(np.float32)
    n = np.sqrt(v @ v)
    return v / n if n else v


def train(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from (text, lang). Rows with a null in either, or no letter, teach nothing.

    What comes to the driver is one vector a language, at most MOST_LANGS of them.
    """
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return [], np.zeros((0, DIM))
    share = F.create_map(*(x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, rows_per_lang / r.n)))))
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                if (v := bundle(text)) is not None:
                    sums.setdefault(lang, np.zeros(DIM, np.int64))[:] += np.rint(v * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [x.tolist() for x in sums.values()]}, pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    parts = in_small_batches(sample).mapInArrow(partial, "lang string, v array<long>")
    total = parts.groupBy("lang").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(DIM))).alias("v")).collect()
    langs = sorted(r.lang for r in total)
    by = {r.lang: np.array(r.v, np.float64) for r in total}
    p = np.array([by[x] / (np.sqrt(by[x] @ by[x]) or 1) for x in langs]).reshape(-1, DIM)
    return langs, p


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default all) with lang_pred and score (cosine, 0 to 1).

    A null text, one without letters, or a model without languages gives `und` and 0. Equal cosines: the first
    language in code point order. Each row is judged by its text alone.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        for b in batches:
            pred, score = [], []
            for t in b[name].to_pylist():
                v = bundle(t)
                if v is None or not langs:
                    pred.append("und")
                    score.append(0.0)
                else:
                    s = prototypes @ v
                    k = int(np.argmax(s))
                    pred.append(langs[k])
                    score.append(float(min(1.0, max(0.0, s[k]))))
            b = b.drop_columns([name])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    name = free_name(docs, "_text")
    frame = docs.select(*keep, F.col("text").alias(name))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != name)
    return in_small_batches(frame).mapInArrow(run, f"{fields + ', ' if fields else ''}lang_pred string, score double")


def keep_known(docs: DataFrame, langs: list[str], prototypes: np.ndarray, least: float = NOISE, grams_told: int = GRAMS_TOLD) -> DataFrame:
    """The rows of docs whose text has letters and a cosine of at least `least` with some language; all of docs' columns.

    A text of fewer n-grams than `grams_told` stays, as its cosine says too little. A null text goes; with a model
    without languages nothing stays. Repeated rows are judged alike. Empty table: no rows.
    """

    @F.pandas_udf(BooleanType())
    def known(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool:
            which, often = grams(t)
            if not len(which) or not langs:
                return False
            return int(often.sum()) < grams_told or float((prototypes @ bundle(t)).max()) >= least

        return pd.Series([one(t) for t in texts], dtype=bool)

    return in_small_batches(docs).where(known("text"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
