"""Standing searches and usage over streams: extensions, as the batch operators know no streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import lexical
from palimpsest.plans import boolean


def standing_search(rows: DataFrame, cells: Column, queries: dict[str, str]) -> DataFrame:
    """Each arriving row once for each named query that it matches, in the column `query`. No state is kept."""
    index = lexical.indexed(rows, cells)
    hits = F.array(*(F.when(boolean.row_matches(q, F.col("hay"), F.col("segs")), F.lit(n)) for n, q in queries.items()))
    return index.withColumn("query", F.explode(F.filter(hits, lambda n: n.isNotNull()))).drop("hay", "segs")


def usage_windows(log: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of each kind of event in windows of time; events later than `late` are dropped."""
    log = log.withColumn(at, F.col(at).cast("timestamp"))
    return log.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
