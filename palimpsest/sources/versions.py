"""Tables that are replaced as a whole: each writing makes a version of its own, readers see a finished one or none.

A version is a folder; a version is committed when a marker named by its number and its folder is created. Of two writers
that want the same number one fails to claim it, and takes the next. A writer that dies leaves a folder without a marker,
which nobody reads. A reader keeps the folder it has once looked up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKERS, PREFIX = "committed", "commit-"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str, anew: bool = True) -> None:
    """Writes a small file; not anew: fails where it is there."""
    fs, at = _fs(spark, path)
    out = fs.create(at, anew)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _markers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the committed versions, the newest last; names alone are read."""
    fs, at = _fs(spark, f"{path}/{MARKERS}")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n), folder) for name in names if name.startswith(PREFIX) for n, _, folder in [name[len(PREFIX) :].partition("-")])


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest committed version, or None."""
    found = _markers(spark, path)
    return f"{path}/{found[-1][1]}" if found else None


def commit(spark: SparkSession, path: str, folder: str) -> int:
    """Makes the folder (within path) the current version and returns its number.

    A number is taken by the creation of a file of that name, which fails where it is there and which stays; then the
    marker that readers look for is created, whose name says all.
    """
    fs, at = _fs(spark, f"{path}/{MARKERS}")
    fs.mkdirs(at)
    while True:
        n = max([0, *(m[0] for m in _markers(spark, path)), *_taken(spark, path)]) + 1
        if _created(spark, f"{path}/{MARKERS}/claim-{n:010d}", folder):
            write_text(spark, f"{path}/{MARKERS}/{PREFIX}{n:010d}-{folder}", folder)
            return n


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file, or returns false where it is there."""
    fs, at = _fs(spark, path)
    if fs.getUri().getScheme() == "file":  # whose create() looks first and writes then
        try:
            with open(at.toUri().getPath(), "x") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        write_text(spark, path, text, anew=False)
    except Exception:  # noqa: BLE001  file systems tell it in different ways
        if fs.exists(at):
            return False
        raise
    return True


def _taken(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/{MARKERS}")
    return [int(name[6:]) for s in fs.listStatus(at) if (name := s.getPath().getName()).startswith("claim-")] if fs.exists(at) else []


@contextmanager
def writing(spark: SparkSession, path: str) -> Iterator[str]:
    """A new folder to write tables into, committed when the block ends well; else nothing is seen of it."""
    folder = f"version-{uuid.uuid4().hex}"
    yield f"{path}/{folder}"
    commit(spark, path, folder)


def replace(df: DataFrame, path: str) -> None:
    """Writes df as the current version of a table; df may read the version before."""
    with writing(df.sparkSession, path) as folder:
        df.write.parquet(folder)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by replace(); FileNotFoundError without one."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no committed version in {path}")
    return spark.read.parquet(folder)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the newest `keep` committed versions, and tells how many; folders being written stay."""
    old = _markers(spark, path)[: -max(1, keep)]
    for n, folder in old:
        fs, marker = _fs(spark, f"{path}/{MARKERS}/{PREFIX}{n:010d}-{folder}")
        fs.delete(marker, False)  # first, so that no reader finds a version half gone
        fs.delete(_fs(spark, f"{path}/{folder}")[1], True)
    return len(old)


def current_folders(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder) of the current version of each table below a folder, found by the markers' names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{PREFIX}*").load(root).select(F.col("_metadata.file_path").alias("path"))
    parts = F.regexp_extract_all("path", F.lit(rf"^(.*)/{MARKERS}/{PREFIX}(\d+)-(.*)$"), 1)
    name = F.regexp_extract("path", rf"/{MARKERS}/{PREFIX}(\d+)-(.*)$", 2)
    number = F.regexp_extract("path", rf"/{MARKERS}/{PREFIX}(\d+)-", 1).cast("long")
    newest = files.select(F.get(parts, F.lit(0)).alias("path"), name.alias("name"), number.alias("n")).groupBy("path").agg(F.max_by("name", "n").alias("name"))
    return newest.select("path", F.concat_ws("/", "path", "name").alias("folder"))
