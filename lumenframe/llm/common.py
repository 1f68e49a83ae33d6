"""Shared plumbing of the corpus operators: reading tables, written-down results, row packing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import workspace
from ..session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so any store that Spark reads will do."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Most bytes in an Arrow batch handed to Python. Batches are copied several times on both sides, and
#: the default of 64 MB makes a worker as large as its executor's heap.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20)
#: Digests of texts that a task remembers, so that a copy met again is not sent again.
MOST_SEEN = 100_000


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers, unless the session says otherwise."""
    settle(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``workspace.staged`` with small batches for what follows."""
    small_batches(df.sparkSession)
    return workspace.staged(df, tag)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``; at the end of a task its worker, which lives on, hands freed memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(whole, schema)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def sample(rows: DataFrame, key: str, most_rows: int, most_bytes: int) -> Iterator[Row]:
    """Distinct rows by ``key`` and ``text`` (binary), those with the least hash of the key, one after another.

    At most ``most_rows`` rows and ``most_bytes`` bytes of text come to the driver (the first row
    always does), so any size of table gives a like sample. Null keys are like any other.
    """
    d = rows.withColumns({"h_": F.xxhash64(key), "k_": F.col(key), "t_": F.xxhash64("text")})
    order = ["h_", "k_", "t_"]
    least = d.select(*order, F.octet_length("text").alias("n_")).distinct().orderBy(*order).limit(most_rows)
    # The window and the broadcast are over that many rows at most.
    least = least.withColumn("sum_", F.sum("n_").over(Window.orderBy(*order))).withColumn("first_", F.row_number().over(Window.orderBy(*order)) == 1)
    least = least.filter(F.col("first_") | (F.col("sum_") <= most_bytes)).select(F.col("k_").alias("k2_"), F.col("t_").alias("t2_"))
    got = d.join(F.broadcast(least), F.col("k_").eqNullSafe(F.col("k2_")) & (F.col("t_") == F.col("t2_"))).dropDuplicates(["k_", "t_"])
    return got.orderBy(*order).limit(most_rows).select(*rows.columns).toLocalIterator()


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row`` beside the operator's own columns.

    An operator's columns can then never clash with those that the caller's table has.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in extra.items()])


def utf8(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))
