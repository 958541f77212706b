"""Exact nearest vectors by inner product, without meeting blocks that can hold none of them.

Vectors are dealt to the nearest of a few pivots and packed in blocks by their distance from it, so a block is a ring
around a pivot. For a query at distance D from a pivot, no vector of a ring from a to b is nearer than D - b or a - D,
and the nearer two vectors are, of given lengths, the larger their inner product. Queries are packed in the same way.
They first meet the blocks of their own pivot; what they then have bounds what the others must offer, and pairs of blocks
that cannot are told by their numbers alone, before any vector is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.tables import stored

#: Pivots are collected: so many vectors at most, those with the smallest hashes of their ids.
PIVOTS = 64
#: Bounds are widened by this part, so that rounding never rules out a pair.
SLACK = 1e-9
_FOUND = "query_id long, id long, similarity double"


def pivots_of(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(n).select(F.col("embedding").cast("array<double>").alias("v")).collect()
    return np.array([r.v for r in rows])


def rings(vectors: DataFrame, key: str, pivots: np.ndarray, block: int) -> DataFrame:
    """block, pivot, near and far (distances of its rows from the pivot), norm (the largest), low and high (array of the
    least and largest distance from each pivot), ids and x (bytes), stored."""

    def deal(batches):
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            apart = np.linalg.norm(v[:, None, :] - pivots[None, :, :], axis=2)
            at = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("v"), pa.array(at.astype(np.int32)), pa.array(apart[np.arange(len(v)), at])], ["i", "v", "pivot", "apart"])

    dealt = vectors.select(F.col(key).cast("long").alias("i"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(deal, "i long, v array<double>, pivot int, apart double")
    order = ["pivot", "apart", "i"]

    def pack(batches):
        now, ids, rows = None, [], []

        def block_of():
            v = np.array(rows)
            apart = np.linalg.norm(v[:, None, :] - pivots[None, :, :], axis=2)
            own = apart[:, now]
            made = {"pivot": [now], "near": [own.min()], "far": [own.max()], "norm": [np.linalg.norm(v, axis=1).max()], "low": [apart.min(0).tolist()], "high": [apart.max(0).tolist()], "ids": [np.array(ids, "<i8").tobytes()], "x": [v.astype("<f8").tobytes()]}
            return pa.RecordBatch.from_pydict(made, schema=pa.schema([("pivot", pa.int32()), *((c, pa.float64()) for c in ("near", "far", "norm")), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("x", pa.binary())]))

        for b in batches:
            for i, p, v in zip(b.column("i").to_pylist(), b.column("pivot").to_pylist(), b.column("v"), strict=True):
                if rows and (p != now or len(rows) == block):
                    yield block_of()
                    ids, rows = [], []
                now = p
                ids.append(i)
                rows.append(v.values.to_numpy())
        if rows:
            yield block_of()

    packed = dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "pivot int, near double, far double, norm double, low array<double>, high array<double>, ids binary, x binary")
    return stored(packed.withColumn("block", F.monotonically_increasing_id()), "rings")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity): the best k of each pair of blocks for each of its queries; sums go from left to right."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, asked = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], np.frombuffer(r["x"], "<f8").reshape(len(ids), -1)[order]
                w = np.frombuffer(r["q_x"], "<f8").reshape(len(asked), -1)
                total = np.zeros((len(w), len(v)))
                for d in range(v.shape[1]):
                    total += w[:, d][:, None] * v[:, d][None, :]
                top = np.argsort(-total, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(total, top, 1).ravel())], ["query_id", "id", "similarity"])

    found = pairs.select("ids", "x", "q_ids", "q_x").mapInArrow(run, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def bound() -> Column:
    """The largest inner product that a query of block q can have with a vector of a block: by lengths, and by the gap between them."""
    low, high = F.get("q_low", F.col("pivot")), F.get("q_high", F.col("pivot"))
    gap = F.greatest(F.lit(0.0), low - F.col("far"), F.col("near") - high)
    by_gap = (F.col("q_norm") * F.col("q_norm") + F.col("norm") * F.col("norm") - gap * gap) / 2
    largest = F.least(F.col("q_norm") * F.col("norm"), by_gap)
    return largest + SLACK * (1 + F.col("q_norm") * F.col("q_norm") + F.col("norm") * F.col("norm"))


def met(own: DataFrame, asked: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(block, q_block) of other pivots that may offer some query of the block a place among its k.

    first are the best of the queries' own pivots; a query with fewer than k has no bound. The numbers of all pairs of
    blocks are compared (the stated set of queries against all rows), no vector is.
    """
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(float("-inf")).alias("least"))

    def ids(batches):
        for b in batches:
            for q, i in zip(b.column("q_block").to_pylist(), b.column("q_ids").to_pylist(), strict=True):
                own_ids = np.frombuffer(i, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own_ids), q)), pa.array(own_ids)], ["q_block", "query_id"])

    of_query = asked.select("q_block", "q_ids").mapInArrow(ids, "q_block long, query_id long")
    least = of_query.join(least, "query_id", "left").groupBy("q_block").agg(F.min(F.coalesce("least", F.lit(float("-inf")))).alias("least"))
    numbers = asked.select("q_block", "q_pivot", "q_norm", "q_low", "q_high").join(least, "q_block")
    pairs = own.select("block", "pivot", "near", "far", "norm").crossJoin(numbers).where(F.col("pivot") != F.col("q_pivot"))
    return pairs.where(bound() >= F.col("least")).select("block", "q_block")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024, pivots: int = PIVOTS) -> tuple[DataFrame, dict[str, int]]:
    """(query_id, id, similarity, place) as semantic.nearest() gives it, and how many pairs of blocks there are and were met.

    vectors (id, embedding) and queries (query_id, embedding) are of one length, without nulls. Vectors around pivots of
    their own leave most pairs unmet; vectors that are all as far from each other, none.
    """
    at = pivots_of(vectors, pivots)
    if not len(at):
        return vectors.sparkSession.createDataFrame([], f"{_FOUND}, place int"), {"pairs": 0, "met": 0}
    own = rings(vectors, "id", at, block)
    asked = rings(queries, "query_id", at, block)
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns))
    near = own.select("block", "pivot").join(asked.select("q_block", "q_pivot"), F.col("pivot") == F.col("q_pivot")).select("block", "q_block")
    data = own.select("block", "ids", "x"), asked.select("q_block", "q_ids", "q_x")
    first = stored(_best(near.join(data[0], "block").join(data[1], "q_block"), k), "first")
    others = stored(met(own, asked, first, k), "met")
    more = _best(others.join(data[0], "block").join(data[1], "q_block"), k).select("query_id", "id", "similarity")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    both = first.select("query_id", "id", "similarity").unionByName(more)
    counts = {"pairs": own.count() * asked.count(), "met": near.count() + others.count()}
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), counts
