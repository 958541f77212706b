"""Tables that a session keeps in the folder that all machines share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: dict[tuple[str, str, str], str] = {}
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share; only local sessions without one get a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-tables-")
    return _LOCAL[context.applicationId]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written once and read from there: what follows doesn't make it again, also after the loss of an executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of ids and short texts that a side of a join may have to be sent to all tasks.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, name: str = "small") -> DataFrame:
    """df, stored, and broadcast where it is joined unless it has more rows than BROADCAST_ROWS, so that the larger side stays where it is."""
    made = stored(df, name)
    return F.broadcast(made) if made.count() <= BROADCAST_ROWS else made


#: Bytes of rows that are sent to a Python task at once.
ARROW_BYTES = 2 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends Python tasks no more than ARROW_BYTES at once, however heavy rows are. A smaller setting stays."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    bound = conf.get(name).removesuffix("b")
    if not (bound.isdigit() and int(bound) <= ARROW_BYTES):
        conf.set(name, str(ARROW_BYTES))
    return df


_STATUS = re.compile(r"path=([^;]+);.*?length=(\d+);.*?modification_time=(\d+)")


def signature(table: DataFrame) -> str:
    """A hash of names, sizes and times of the table's files, as the file system lists them: no job, and no file is opened."""
    spark, files = table.sparkSession, table.inputFiles()
    jvm, conf, told = spark._jvm, spark._jsc.hadoopConfiguration(), set()
    for folder in {f.rpartition("/")[0] for f in files}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        told |= set(_STATUS.findall(jvm.org.apache.commons.lang3.ArrayUtils.toString(path.getFileSystem(conf).listStatus(path))))
    names = {f.rpartition("/")[2] for f in files}
    own = sorted(t for t in told if unquote(t[0].rpartition("/")[2]) in names or t[0].rpartition("/")[2] in names)
    return hashlib.sha256(repr(own).encode()).hexdigest()


def kept(name: str, source: DataFrame, make) -> DataFrame:
    """make(), stored once a session and read from there as long as source's files stay as they are."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, name, signature(source))
    if key not in _KEPT:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])
