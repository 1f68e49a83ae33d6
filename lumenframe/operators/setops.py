"""Set checks and merges: differences, exact partitions, first-wins and column-wise merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``missing`` from the actual, or ``unexpected`` there."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("kind", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("kind", F.lit("unexpected")))


def partition_check(shards: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: whether shards are disjoint and cover the whole, with the counts."""
    s = shards.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    w = whole.select(key).distinct().withColumn("there", F.lit(True))
    j = s.join(w, key, "full_outer")
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    a = j.agg(n(F.col("n") > 1).alias("overlapping"), n(F.col("n").isNull()).alias("missing"), n(F.col("there").isNull()).alias("foreign"))
    return a.withColumn("exact", (F.col("overlapping") + F.col("missing") + F.col("foreign")) == 0)


def union_disjoint(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of parts, each row with its ``part``; a key in two parts fails the query when it runs."""
    out = None
    for name, d in parts.items():
        d = d.withColumn("part", F.lit(name))
        out = d if out is None else out.unionByName(d)
    n = F.size(F.collect_set("part").over(Window.partitionBy(key)))
    return out.withColumn("ok_", F.when(n > 1, F.raise_error(F.concat(F.lit("in two parts: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).filter("ok_").drop("ok_")


def merge_first(old: DataFrame, new: DataFrame, keys: list[str], order: str, limit: int = 100) -> DataFrame:
    """Old rows, then new rows whose key is not there yet, ``limit`` in all; adds ``position``."""
    rows = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("side", order)
    rows = rows.withColumn("n", F.row_number().over(w)).filter("n = 1")
    rows = rows.orderBy("side", order, *keys).limit(limit)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy().orderBy("side", order, *keys))).drop("n")


def merge_columns(source: DataFrame, edited: DataFrame, key: str, mutable: list[str]) -> DataFrame:
    """Mutable columns from the edited rows, all else from the source; ``discarded`` counts other cells that differ."""
    others = [c for c in source.columns if c not in (key, *mutable)]
    e = edited.select(key, *[F.col(c).alias(f"e_{c}") for c in edited.columns if c != key], F.lit(True).alias("in_e"))
    j = source.join(e, key, "left")
    cells = sum((F.when(F.col("in_e") & ~F.col(c).eqNullSafe(F.col(f"e_{c}")), 1).otherwise(0) for c in others if c in edited.columns), F.lit(0))
    return j.select(key, *[F.when(F.col("in_e"), F.col(f"e_{c}")).otherwise(F.col(c)).alias(c) for c in mutable], *others, cells.alias("discarded"))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def keep_present(rows: DataFrame, listing: DataFrame, path: str = "relative_path") -> DataFrame:
    """Rows whose file is in a listing."""
    return rows.join(listing.select(path).distinct(), path, "left_semi")


def select_groups(rows: DataFrame, names: list, by: str) -> DataFrame:
    """Rows of the named groups, in the order of the names (``place``); a name without rows fails the query when it runs."""
    asked = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names)], f"place int, {by} {rows.schema[by].dataType.simpleString()}")
    j = asked.join(rows.withColumn("there", F.lit(True)), by, "left")
    lost = F.raise_error(F.concat(F.lit("not in the catalog: "), F.col(by).cast("string"))).cast("boolean")
    return j.filter(F.when(F.col("there").isNull(), lost).otherwise(True)).drop("there")


def claimed_counts(rows: DataFrame, claims: DataFrame, by: str) -> DataFrame:
    """Groups whose number of rows is not the claimed one."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("actual"))
    j = claims.join(n, by, "full_outer").select(by, F.coalesce("claimed", F.lit(0)).alias("claimed"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return j.filter("claimed != actual")


def append_new(index: DataFrame, batch: DataFrame, sources: DataFrame, source: str, signature: str) -> DataFrame:
    """Rows that an incremental append adds to an index.

    A source applied with the same signature adds nothing; one with another signature, or a row
    whose id is in the index already, fails the query when it runs.
    """
    known = sources.filter(F.col("source") == source).agg(F.max("signature").alias("known"))
    b = batch.crossJoin(F.broadcast(known))  # one row
    other = F.col("known").isNotNull() & (F.col("known") != signature)
    b = b.filter(F.when(other, F.raise_error(F.lit("the source was applied with another signature")).cast("boolean")).otherwise(F.col("known").isNull())).drop("known")
    held = index.select("keyframe_uid").withColumn("held", F.lit(True))
    b = b.join(held, "keyframe_uid", "left")
    return b.filter(F.when(F.col("held"), F.raise_error(F.concat(F.lit("already indexed: "), F.col("keyframe_uid").cast("string"))).cast("boolean")).otherwise(True)).drop("held")


def incremental_union(batches: dict[str, tuple[str, DataFrame]], whole: DataFrame) -> DataFrame:
    """Snapshot rows of batches (name -> tier and rows), each with ``batch``, ``tier`` and ``searchable``.

    Batches may not share a frame, and every row must be of ``whole`` (keyframe_uid); else the
    query fails when it runs. Rows of the tier ``craft_only`` are never searchable, others if
    they were read.
    """
    rows = union_disjoint({name: d.withColumn("tier", F.lit(tier)) for name, (tier, d) in batches.items()}, "keyframe_uid").withColumnRenamed("part", "batch")
    j = rows.join(whole.select("keyframe_uid", F.lit(True).alias("known")), "keyframe_uid", "left")
    j = j.filter(F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("foreign: "), F.col("keyframe_uid").cast("string"))).cast("boolean")).otherwise(True)).drop("known")
    return j.withColumn("searchable", (F.col("tier") != "craft_only") & (F.col("status") == "success"))
