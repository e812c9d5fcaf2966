"""Structured Streaming forms of what is kept up to date: counters, upserts, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the files of a Parquet folder, or over one file; its schema is that of the files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, once, into a table, and read that back."""
    spark = df.sparkSession
    out, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def day_counters(events: DataFrame, when: str, key: str, late: str = "1 day") -> DataFrame:
    """Tumbling day counters by key; a day is emitted when the watermark has passed it."""
    return events.withColumn("_t", F.col(when).cast("timestamp")).withWatermark("_t", late).groupBy(key, F.window("_t", "1 day").alias("w")).agg(F.count("*").alias("used")).select(key, F.col("w.start").alias("day"), "used")


def sessions(events: DataFrame, when: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with no gap longer than ``gap``."""
    return events.withColumn("_t", F.col(when).cast("timestamp")).withWatermark("_t", late).groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each bucket of a table that :func:`upsert_stream` keeps (older than ``before``)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    for version in store.listStatus(root) if store.exists(root) else []:
        name = version.getPath().getName()
        if name.startswith("v") and (before is None or int(name[1:]) < before):
            for folder in store.listStatus(version.getPath()):
                bucket = folder.getPath().getName()
                if bucket.startswith("_bucket="):
                    newest[int(bucket[8:])] = max(newest.get(int(bucket[8:]), -1), int(name[1:]))
    return {b: f"{path}/v{v}/_bucket={b}" for b, v in newest.items()}


def upsert_stream(changes: DataFrame, path: str, key: list[str], newest: str, buckets: int = 16) -> None:
    """Fold a stream of changes into a table: the newest change of a key wins, also over ones that came before it.

    Keys are dealt over ``buckets`` folders. A batch writes a new version of the
    buckets that it changes and leaves the others; a batch that runs again
    writes the same version from the ones before it. Of equally new changes of
    a key the one that compares greatest stays.
    """
    spark = changes.sparkSession
    log = scratch_path(spark, "upsert-log")

    def fold(batch: DataFrame, number: int) -> None:
        dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in dealt.select("_bucket").distinct().collect()]  # at most ``buckets``
        old = [folder for b, folder in _versions(spark, path, number).items() if b in touched]
        if old:
            held = spark.read.schema(batch.schema).parquet(*old)
            dealt = dealt.unionByName(held.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        order = F.struct(newest, F.struct(*batch.columns))
        last = dealt.groupBy("_bucket", *key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*", "_bucket")
        last.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v{number}")

    changes.writeStream.foreachBatch(fold).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`upsert_stream` keeps, as of its last batch."""
    return spark.read.parquet(*sorted(_versions(spark, path).values()))
