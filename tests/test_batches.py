"""Rows that Python tasks are sent at once."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chunks, dictionary

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("made", [
    lambda d: dictionary.extracted(d.withColumn("source", F.lit("Aulete")), "id", html="text"),
    lambda d: chunks.chunked(d, "id"),
])
def test_heavy_rows_come_in_small_batches(spark, made):
    before = spark.conf.get(NAME)
    try:
        spark.conf.unset(NAME)
        rows = made(spark.createDataFrame([(1, "<p>1. abc</p>")], "id long, text string"))
        assert int(spark.conf.get(NAME).removesuffix("b")) <= 2 << 20
        assert rows.count() == 1
    finally:
        spark.conf.set(NAME, before)


def test_alignment_normalises_a_text_once(spark):
    """Not again for each term of the query."""
    from palimpsest.operators import semantic
    from palimpsest.queries import semantics

    made = semantics.QUERIES["sem_alignment"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("text#") < 12
    rows = spark.createDataFrame([("Que *da* Reaux", {"a": "que"}), ("reaux que", {}), (None, None)], "t string, m map<string,string>")
    own = semantic.normalised(rows, F.col("t"), F.col("m"))
    got = own.select(semantic.alignment("que da reaux", F.col("_text"), F.col("_meta")).alias("x"), semantic.alignment("que da reaux", semantic.for_semantic(F.col("t")), semantic.metadata_text(F.col("m"))).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] and got[0].x > got[1].x > 0
