"""Mixing sources to target weights by balanced (cube method) sampling.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; no target
passes twice its source, the excess goes to the others by weight. A source taken r times gives floor(r) copies of
every document, and the rest by sampling with inclusion probability r - floor(r).

The cube method's flight moves the probabilities of a block's units through the null space of the balancing equations
(words and documents) until all but two are 0 or 1. A unit with a large part of a block's words is decided first, by one
step that all others make up for; what can't be made up for in any draw is told as its lack. Then each step moves the
largest unit that is left, and many smaller ones make up for it by little each, so what stays undecided is small. Blocks are a source's documents by hash, BLOCK at
most on average, so a hot source is many blocks; what they leave (two small units each) forms the next level's blocks,
until one block a source is left, whose last units land by giving up the document, then the word equation.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, checkpointed, free_name, sized

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 1024
SEED = 7
#: Sources are named settings of a mix; their table (about 60 bytes each) is ranked in one task and broadcast.
MOST_SOURCES = 1_000_000
#: A unit with more than this part of the others' words is decided first, in one step.
LARGE = 0.125
_TINY = 1e-9


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, docs, target) from (source, size): water-filling up to twice the source's size."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumn("_fill", MOST * F.col("source_size") / F.col("_w"))
    before = Window.orderBy("_fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("_level", (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0)).cast("double")) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    # the first source in filling order that its share doesn't fill tells the level for it and all after it
    level = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", F.col("_level").alias("level")))).over(everything)["level"]
    return per.withColumn("_at", level).select("source", "source_size", "docs", F.when(F.col("_fill") <= F.col("_at"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("_at") * F.col("_w")).alias("target"))


def flight(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Inclusion probabilities after the flight, all but two at most 0 or 1, and each unit's lack.

    Words and documents keep their expectation, but for what units of LARGE parts lack (see decided()).
    """
    pi, lack = np.where((pi > _TINY) & (pi < 1 - _TINY), pi, np.rint(pi)).astype(float), np.zeros(len(pi))
    at = np.flatnonzero((pi > 0) & (pi < 1))
    at = at[np.argsort(-size[at].astype(float), kind="stable")]
    s, p = size[at].astype(float), pi[at]
    while len(at) > 2 and s[0] > LARGE * s[1:].sum():
        p, lack[at[0]] = decided(s, p, rng.random())
        at, s, p = _open(at, s, p, pi)
    while len(at) > 2:
        u = _direction(s, p)
        if u is None:
            break
        p = _moved(p, u, rng.random())
        at, s, p = _open(at, s, p, pi)
    pi[at] = p
    return pi, lack


def _open(at: np.ndarray, s: np.ndarray, p: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is not yet 0 or 1; the rest is put down in pi."""
    done = (p == 0) | (p == 1)
    pi[at[done]] = p[done]
    return at[~done], s[~done], p[~done]


def decided(s: np.ndarray, p: np.ndarray, chance: float) -> tuple[np.ndarray, float]:
    """p after the first unit is decided in one step, and the words that the others could not make up for.

    The step is along a vector of the null space with which neither way takes a unit beyond 0 or 1: of words and
    documents where there is one, else of words alone. Else, no draw has the words balanced both ways: the others go as
    far as they can, and what they lack (positive: too many words are taken) is at most what they have or have room for
    short of the unit. Then alone the others' expectations move, by the lack's part of their words.
    """
    b, t, q = p[0], p[1:], s[1:]
    low, high = np.maximum(-t / (1 - b), -(1 - t) / b), np.minimum((1 - t) / (1 - b), t / b)
    d = _tilted(q, low, high, -1.0, -s[0])
    if d is None:
        d = _tilted(q, low, high, None, -s[0])
    taken, lack = chance < b, 0.0
    if d is not None:
        t = t + (1 - b) * d if taken else t - b * d
    elif taken:
        need, have = s[0] * (1 - b), q @ t
        t, lack = t * (1 - min(1.0, need / have)), max(0.0, need - have)
    else:
        need, room = s[0] * b, q @ (1 - t)
        t, lack = t + (1 - t) * min(1.0, need / room), min(0.0, room - need)
    return _snapped(np.r_[float(taken), t]), lack


def _tilted(s: np.ndarray, low: np.ndarray, high: np.ndarray, total: float | None, words: float) -> np.ndarray | None:
    """d within low and high with sum `total` (None: any) and d @ s = words, or None. d rises or falls with size."""
    x, wide = (s - s.mean()) / (s.std() or 1.0), high - low

    def at(level: float, slope: float) -> np.ndarray:
        return low + wide * np.clip(level + slope * x, 0.0, 1.0)

    def halved(f, a: float, b: float) -> float:
        for _ in range(60):
            m = (a + b) / 2
            a, b = (m, b) if f(m) < 0 else (a, m)
        return (a + b) / 2

    if total is None:
        d = at(halved(lambda v: at(v, 0.0) @ s - words, 0.0, 1.0), 0.0)
        return d if abs(d @ s - words) <= 1e-9 * abs(words) + 1e-9 else None
    if not low.sum() <= total <= high.sum():
        return None
    ends = np.abs(x).max()

    def level(slope: float) -> float:
        reach = abs(slope) * ends + 1
        return halved(lambda v: at(v, slope).sum() - total, -reach, reach)

    slope = halved(lambda v: at(level(v), v) @ s - words, -50.0, 50.0)
    d = at(level(slope), slope)
    return d if abs(d @ s - words) <= 1e-9 * abs(words) + 1e-9 and abs(d.sum() - total) < 1e-9 else None


def _snapped(q: np.ndarray) -> np.ndarray:
    return np.where(q < _TINY, 0.0, np.where(q > 1 - _TINY, 1.0, q))


def _direction(s: np.ndarray, p: np.ndarray) -> np.ndarray | None:
    """Where units of falling size s can move without a change of their number and words: the first one, the others against it.

    Others move by a line in their size, times what room they have. Where all of them have one size that is not the
    first one's, two of them move against each other.
    """
    u = np.zeros(len(s))
    x = s[1:] - s[-1]
    if not x.any():
        u[-2:] = 1.0, -1.0
        return u if s[0] != s[-1] else np.r_[1.0, -1.0, u[2:] * 0]
    w = p[1:] * (1 - p[1:])
    m0, m1, m2 = w.sum(), w @ x, w @ (x * x)
    k, whole = s[0] - s[-1], m0 * m2 - m1 * m1
    if whole <= 1e-12 * m0 * m2:
        return None
    u[0] = 1.0
    u[1:] = -((m2 - m1 * k) + (m0 * k - m1) * x) / whole * w
    return u


def _moved(p: np.ndarray, u: np.ndarray, chance: float) -> np.ndarray:
    """p after a step along u, forward or back as chance says so that p stays its expectation, until a unit is 0 or 1."""
    up, down = u > 0, u < 0
    on = min(((1 - p[up]) / u[up]).min(initial=math.inf), (-p[down] / u[down]).min(initial=math.inf))
    back = min((p[up] / u[up]).min(initial=math.inf), ((p[down] - 1) / u[down]).min(initial=math.inf))
    return _snapped(p + (on if chance * (on + back) < back else -back) * u)


def land(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Ends the last units: first only the words stay balanced, then the last unit is drawn."""
    pi = pi.copy()
    held = np.flatnonzero((pi > 0) & (pi < 1))
    while len(held) > 1:
        a, b = held[:2]
        u = np.array([size[b], -size[a]], float) if size[a] and size[b] else np.array([1.0, -1.0])
        pi[[a, b]] = _moved(pi[[a, b]], u, rng.random())
        held = held[(pi[held] > 0) & (pi[held] < 1)]
    for i in held:
        pi[i] = float(rng.random() < pi[i])
    return pi


def _flyer(seed: int, level: int, last: bool, columns: list[str]):
    def fly(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, level, zlib.crc32(repr(key[0]).encode()), int(key[1])])
        units = units.sort_values(["size", "doc_id", "unit", "again"], kind="stable", ignore_index=True)
        size = units["size"].to_numpy()
        pi, lack = flight(size, units["pi"].to_numpy(), rng)
        return units.assign(pi=land(size, pi, rng) if last else pi, lack=units["lack"] + lack)[columns]

    return fly


def row_key(df: DataFrame) -> Column:
    """128 bits of hash of all columns of a row, as text. Nulls count."""
    if any("map<" in t for _, t in df.dtypes):
        cells = [F.to_json(F.struct("*"))]
    else:
        cells = [F.array(*(F.col(f"`{c}`").isNull() for c in df.columns)), *(F.col(f"`{c}`") for c in df.columns)]
    return F.concat_ws("", F.lpad(F.hex(F.xxhash64(*cells)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("again"), *cells)), 16, "0"))


def _units(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, unit (a hash of the whole row) and again (0; apart where the whole row repeats)."""
    whole = row_key(docs)
    made = checkpointed(docs.select("doc_id", "source", words(F.col("text")).alias("size"), whole.alias("unit"), F.monotonically_increasing_id().alias("again")))
    twice = checkpointed(made.groupBy("unit").agg(F.count("*").alias("_n")).where("_n > 1").select("unit", F.lit(1).alias("_twice")))
    if twice.isEmpty():
        return made.withColumn("again", F.lit(0).cast("long"))
    joined = made.join(twice, "unit", "left")
    return joined.select("doc_id", "source", "size", "unit", F.when(F.col("_twice") == 1, F.col("again")).otherwise(0).alias("again"))


def _mixed(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, unit, source_size, target, copies, lack."""
    rows = _units(docs)
    per = checkpointed(targets(rows))
    known = per.agg(F.count("*").alias("n"), F.max("docs").alias("most")).first()
    if known.n > MOST_SOURCES:
        raise ValueError(f"{known.n} sources; the mix is made for {MOST_SOURCES} at most")
    times = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)), F.lit(float(MOST)))
    per = per.select(F.col("source").alias("_source"), "source_size", "docs", "target", F.floor(times).alias("base"), (times - F.floor(times)).alias("pi"))
    units = rows.join(F.broadcast(per), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("lack", F.lit(0.0))
    fixed, flying, done = F.col("pi") < _TINY, units.where(F.col("pi") >= _TINY), []
    done.append(units.where(fixed).withColumn("pi", F.lit(0.0)))
    level, most = 0, known.most or 0
    while True:
        # two units a block are left, so the next level has 2 / BLOCK of the units
        blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") * F.lit((2 / BLOCK) ** level) / BLOCK)).cast("long")
        last = most * (2 / BLOCK) ** level <= BLOCK
        block = F.lit(0).cast("long") if last else F.pmod(F.xxhash64(F.lit(level), "unit", "again"), blocks)
        flown = checkpointed(flying.withColumn("block", block).groupBy("source", "block").applyInPandas(_flyer(seed, level, last, flying.columns), flying.schema))
        done.append(flown.where("pi = 0 or pi = 1"))
        if last:
            break
        flying, level = flown.where("pi > 0 and pi < 1"), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "unit", "source_size", "target", (F.col("base") + F.col("pi")).cast("long").alias("copies"), "lack")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies x size) and lack of each row of docs.

    lack is 0 but for a document so large that the others of its block can't make up for it: the words by which its
    source is off on its account (positive: too many are taken).

    A null text has size 0; null sources form one source, the last. Each row is a unit of its own, also where ids or
    whole rows repeat. The draw depends on seed and rows only, so reruns agree (which of several wholly equal rows is
    taken depends on their order too, and makes no difference). Empty tables give empty results; all columns of docs
    tell rows apart and may have any names.
    """
    made = _mixed(docs, seed)
    return made.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "lack")


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it. Empty table: no rows; nulls and repeats as in mix()."""
    often = checkpointed(_mixed(docs, seed).groupBy("unit").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    key, times = free_name(docs, "_unit"), free_name(docs, "_times")
    whole = docs.withColumn(key, row_key(docs))
    taken = often.where("copies > 0").select(F.col("unit").alias(key), F.col("copies").cast("int").alias(times), "rows")
    taken = taken.withColumnRenamed("rows", free_name(docs, "_rows"))
    rows = whole.join(sized(taken, taken.count()), key)
    count = F.col(free_name(docs, "_rows"))

    def repeated(df: DataFrame) -> DataFrame:
        return df.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)

    single = repeated(rows.where(count == 1))
    if often.where("rows > 1 and copies > 0").isEmpty():
        return single
    # wholly equal rows: one of them as often as all are taken
    return single.unionByName(repeated(rows.where(count > 1).dropDuplicates([key])))

