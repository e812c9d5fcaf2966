"""Places shared by driver and executors: scratch tables that cut lineage, and scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Folders of single-process sessions without the setting, which can't be changed while Spark runs.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs in one process (tests,
    notebooks) a temporary folder is used instead.
    """
    where = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-lotwise-")
        where = _local[app]
    return where if "://" in where else f"file://{where}" if where.startswith("/") else where


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/lotwise/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The rows survive the loss of any executor, and later joins see plain scans
    of known size.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Delete the folder of a stored table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that went out of use."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


#: Rows of a few numbers each that a join may broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame, weight: Column | None = None) -> DataFrame:
    """Marks a stored table for broadcast if it is small, counted here; else it is shuffled.

    ``weight`` is how many narrow rows a row stands for; 1 if not given.
    """
    size = table.count() if weight is None else table.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_ROWS else table


#: Rows of an Arrow batch that holds texts; some of them are long, and several batches are in memory at once.
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(texts: DataFrame) -> DataFrame:
    """``texts`` unchanged; from now on the session passes at most TEXT_ROWS rows to Python at a time."""
    conf = texts.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= TEXT_ROWS:
        conf.set(_BATCH, str(TEXT_ROWS))
    return texts


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions to ask for where a plan names the number itself."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
