"""Streaming: resumable ingestion, duplicate suppression, quota and session windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def first_of_each(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state older than ``late`` is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert_to(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends rows whose key is not at ``path`` yet, one folder per batch.

    A batch that is run again after a failure replaces its own folder, so each row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        new = batch.dropDuplicates([key])
        done = [s.getPath().toString() for s in fs.listStatus(p(path))] if fs.exists(p(path)) else []
        done = [d for d in done if not d.endswith(f"/batch={number}")]
        if done:
            new = new.join(spark.read.parquet(*done).select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Run the stream's available rows into ``path``, each key once, going on where it stopped."""
    return stream.writeStream.foreachBatch(upsert_to(path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    d = rows.withWatermark(time, late) if late else rows
    s = F.session_window(time, gap)
    return d.groupBy(s, *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def quota(calls: DataFrame, seconds: int, max_calls: int, max_tokens: int, per_day: int, by: str = "model_id") -> DataFrame:
    """Calls and tokens in the ``seconds`` up to each call and in its day, and whether it is within its quota.

    ``calls`` has ts (timestamp) and tokens. The rows of one model's minute are what a window holds.
    """
    at = F.unix_micros("ts")
    w = Window.partitionBy(by).orderBy("at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    day = Window.partitionBy(by, F.to_date("ts")).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    d = calls.withColumn("at", at).withColumn("calls_in_window", F.count(F.lit(1)).over(w)).withColumn("tokens_in_window", F.sum("tokens").over(w)).withColumn("calls_in_day", F.count(F.lit(1)).over(day))
    return d.withColumn("allowed", (F.col("calls_in_window") <= max_calls) & (F.col("tokens_in_window") <= max_tokens) & (F.col("calls_in_day") <= per_day)).drop("at")
