"""Places in an order over all rows, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.tables import stored


def placed(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """df with the place of each row (from `start`) in the given order; equal rows are in any order.

    Rows are sorted in ranges and stored; a place is what the ranges before hold and the place within the range. What
    meets all ranges is their counts, one row each.
    """
    row, part, before = f"_{name}_row", f"_{name}_part", f"_{name}_before"
    made = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    kept = stored(made, "placed")
    at = F.shiftright(F.col(row), 33)
    total, offsets = start, []
    for r in kept.groupBy(at.alias("p")).count().orderBy("p").collect():  # a range a row
        offsets.append((r.p, total))
        total += r["count"]
    known = df.sparkSession.createDataFrame(offsets, f"{part} long, {before} long")
    within = F.col(row) - F.shiftleft(at, 33)
    return kept.withColumn(part, at).join(F.broadcast(known), part).withColumn(name, F.col(before) + within).drop(row, part, before)
