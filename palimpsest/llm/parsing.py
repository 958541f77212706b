"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names again, and so on up to one name for the whole text. In each
round runs of a name become one, then deterministic coin tossing (the lowest bit in which a name differs from its left
neighbour, and its value) brings names down to labels below six; a phrase starts at each local minimum. Where phrases
start depends on a few neighbours only, so equal substrings get equal names inside, whatever stands before them.

A fingerprint is the name of the whole text and the smallest names of the phrases of one level (those of about ten
characters), by which two texts' likeness is estimated (bottom-k Jaccard).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import STEP_BYTES, in_small_batches
from palimpsest.llm.shingles import scramble

#: Level whose phrase names make the sketch, and how many of them (32 bits each).
LEVEL = 2
SKETCH = 64
_PHRASE = 64  # longest phrase that has its own power; phrases are shorter by construction
_POWER = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_PHRASE - 1, 0x9E3779B97F4A7C15, np.uint64)])
_BYTE_NAME = scramble(np.arange(1, 257, dtype=np.uint64))
_ONE = np.uint64(1)


def _coins(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """2 * (lowest bit in which x and its left neighbour differ) + that bit of x."""
    differ = x ^ left
    at = np.bitwise_count((differ & -differ) - x.dtype.type(1))
    return (at << 1) | ((x >> at.astype(x.dtype)).astype(np.uint8) & 1)


def _shifted(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Left neighbours; a text's first name has itself with the lowest bit turned."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ x.dtype.type(1)
    return left


def _groups(names: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the groups that begin at starts (sorted, with all of first), and where texts begin among them."""
    length = np.diff(np.r_[starts, len(names)])
    offset = np.arange(len(names)) - np.repeat(starts, length)
    made = np.add.reduceat(names * _POWER[offset % _PHRASE], starts)
    made = np.where(length == 1, names[starts], scramble(made + length.astype(np.uint64)))
    return made, np.searchsorted(starts, first)


def _round(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up."""
    run = np.empty(len(names), bool)
    run[0] = True
    np.not_equal(names[1:], names[:-1], out=run[1:])
    run[first] = True
    if not run.all():
        starts = np.flatnonzero(run)
        length = np.diff(np.r_[starts, len(names)]).astype(np.uint64)
        names = np.where(length == 1, names[starts], scramble(names[starts] + length * np.uint64(0xD6E8FEB86659FD93)))
        first = np.searchsorted(starts, first)
    label = names
    for _ in range(4):
        label = _coins(label, _shifted(label, first))
    low = np.zeros(len(label), bool)
    low[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    low[first[1:] - 1] = False  # a text's last name ends its last phrase
    second = first + 1
    low[second[second < len(low)]] = False  # and its first one is not alone
    low[first] = True
    return _groups(names, np.flatnonzero(low), first)


def parse(texts: list[bytes], level: int = LEVEL) -> tuple[np.ndarray, list[np.ndarray]]:
    """The names of the whole texts, and each text's phrase names at the level (or the last one before its own name)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    roots = np.zeros(len(texts), np.uint64)
    phrases = [np.zeros(0, np.uint64)] * len(texts)
    who = np.flatnonzero(sizes)
    if not len(who):
        return roots, phrases
    names = _BYTE_NAME[np.frombuffer(b"".join(texts), np.uint8)]
    first = np.r_[0, np.cumsum(sizes[who])[:-1]]
    at = 0
    while len(who):
        length = np.diff(np.r_[first, len(names)])
        if at <= level:
            for k, w in enumerate(who.tolist()):
                if at == level or length[k] == 1:
                    phrases[w] = names[first[k] : first[k] + length[k]]
        whole = length == 1
        roots[who[whole]] = names[first[whole]]
        if whole.any():
            names = names[np.repeat(~whole, length)]
            who, length = who[~whole], length[~whole]
            first = np.r_[0, np.cumsum(length)[:-1]] if len(who) else first[:0]
        if len(who):
            names, first = _round(names, first)
            at += 1
    return roots, phrases


def sketches(texts: list[bytes]) -> tuple[list[str], list[np.ndarray]]:
    """Fingerprints as strings, and their sketches (sorted distinct 32-bit values)."""
    roots, phrases = parse(texts)
    small = [np.unique((scramble(p) >> np.uint64(32)).astype(np.uint32))[:SKETCH] for p in phrases]
    return [f"{r:016x}:{s.astype('>u4').tobytes().hex()}" for r, s in zip(roots.tolist(), small, strict=True)], small


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity estimated by two sketches; two empty texts are alike."""
    if not len(a) and not len(b):
        return 1.0
    k = min(SKETCH, max(len(a), len(b)))
    least = np.union1d(a, b)[:k]
    return float(np.isin(least, np.intersect1d(a, b)).mean())


def likeness(x: str, y: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    a, b = (np.frombuffer(bytes.fromhex(s.partition(":")[2]), ">u4").astype(np.uint32) for s in (x, y))
    return alike(a, b)


def _dealt(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, doc_id, text): documents in buckets of consecutive ids, each with the one that follows its last.

    The buckets' bounds and first ids are numbers, a few for each shuffle partition. Only a bucket's first document is
    sent twice, so the texts are shuffled once. The first of all documents follows the last.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.select(F.percentile_approx("_id", F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(20 * buckets)).alias("c")).first().c or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    def bucket_of(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, i.to_numpy(), side="right"))

    least = {r.b: r.i for r in ids.select(F.pandas_udf(bucket_of, "long")("_id").alias("b"), "_id").groupBy("b").agg(F.min("_id").alias("i")).collect()}
    used = sorted(least)
    before = {least[b]: 2 * used[k - 1] + 1 for k, b in enumerate(used)}  # the bucket that also gets this id

    def places(i: pd.Series) -> pd.Series:
        own = 2 * np.searchsorted(cuts, i.to_numpy(), side="right")
        return pd.Series([[o, before[x]] if x in before else [o] for o, x in zip(own.tolist(), i.tolist(), strict=True)])

    at = ids.withColumn("_at", F.explode(F.pandas_udf(places, "array<long>")("_id")))
    return at.select(F.floor(F.col("_at") / 2).alias("bucket"), (F.col("_at") % 2).cast("int").alias("ghost"), "_id", "doc_id", "text")


def _run(batches):
    """Rows sorted by bucket, ghost, id, text; a ghost row stands for the first row after the bucket."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: list[tuple] = []
    size = 0

    def out(rows: list[tuple]):
        """Results of all rows that have a next one in rows and are no ghosts."""
        own = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k + 1][0] == rows[k][0]]
        edited = []
        for k in own:
            text, after = rows[k][3], rows[k + 1][3]
            q = len(text) // 4
            edited.append((text[: len(text) - q] + after[:q]).encode())
        prints, small = sketches([r[3].encode() for r in rows])
        e_prints, e_small = sketches(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in own], pa.int64()),
                pa.array([len(rows[k][3]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
                pa.array([prints[k] for k in own], pa.string()),
                pa.array(e_prints, pa.string()),
                pa.array([alike(small[k], s) for k, s in zip(own, e_small, strict=True)], pa.float64()),
                pa.array([alike(small[k], small[k + 1]) for k in own], pa.float64()),
            ],
            names,
        )

    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in ("bucket", "ghost", "doc_id", "text")), strict=True):
            held.append(row)
            size += len(row[3])
            if size >= STEP_BYTES and len(held) > 1:
                yield from out(held)
                held, size = held[-1:], len(row[3])
    if len(held) > 1:
        yield from out(held)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The next row is by ascending doc_id (null first), then text, where ids repeat; after the last comes the first, so a
    single row is its own next. A null text counts as empty; an empty text's fingerprint has no phrases and is like
    another empty one only. Empty table: empty result.
    """
    dealt = _dealt(in_small_batches(docs))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by ranges, as hashing a few buckets would put several into one partition
    ordered = dealt.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "ghost", "_id", "text").drop("_id")
    return ordered.mapInArrow(_run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
