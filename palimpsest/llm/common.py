"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step of a Python operator works on; its arrays have some fifty times as many.
STEP_BYTES = 1 << 19
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends Python tasks no more than ARROW_BYTES at once, whatever a row weighs.

    The default has no such bound, and ten thousand rows with texts take hundreds of MB outside of the heap for each
    task. A smaller setting stays.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    bound = conf.get(name).removesuffix("b")
    if not (bound.isdigit() and int(bound) <= ARROW_BYTES):
        conf.set(name, str(ARROW_BYTES))
    return df


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = ARROW_BYTES):
    """Jobs within send Python tasks no more than `most` bytes at once; the session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


#: Rows of a table of ids and links (100 bytes a row at most) that one partition may hold, and that may be broadcast.
PART_ROWS, BROADCAST_ROWS = 20_000, 500_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of ids and links, to be broadcast if it has no more rows than BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir, which all machines share.

    With a bound of its rows, for tables of ids and links, df is kept in no more partitions than they need, but in one
    for each core at least. Only where the session names no folder (local tests), a temporary one is set.
    """
    context = df.sparkSession.sparkContext
    if rows is not None and (parts := max(-(-rows // PART_ROWS), context.defaultParallelism)) < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(parts)
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """df, which is kept; the shuffle files of plans that led to it, and that nothing else uses, are removed.

    Spark removes them when the driver collects its garbage, which may be long after the disk is full.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def steps(sizes, most: int = STEP_BYTES):
    """Index ranges (start, end) of consecutive items that together have about `most` bytes; one large item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
