"""Mixing sources to target weights by systematic sampling (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, staged

#: A word of the size measure: a maximal run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source are numbered within buckets of about this many rows, so a source with a
#: third of all rows is numbered by many tasks.
ROWS_PER_BUCKET = 4096
#: No document is taken more often than this.
MOST_COPIES = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(key: Column) -> Column:
    """A number in [0, 2**32) that depends on the key alone."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(stats: DataFrame) -> DataFrame:
    """Words to take from each source.

    ``stats`` has a row per source (``source``, ``source_size``, ``n_docs``). Sources in code
    point order, null last, weigh 1, 2, 3, repeating. The whole size is shared by weight; a
    target stops at three times its source's size and the excess is shared again. The fixed
    point is a water level: with sources ordered by cap per weight, a source is capped while its
    cap is below the level that the sources from it onward would get. The windows run over the
    aggregate, one row a source, not over documents; sources are kinds of text that someone
    weighs, so the table is small.
    """
    every = Window.partitionBy()
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_cap = every.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    d = (
        stats.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", (1 + (F.col("rank") - 1) % 3).cast("double"))
        .withColumn("cap", (F.lit(MOST_COPIES) * F.col("source_size")).cast("double"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.sum("weight").over(onward) <= F.col("weight") * F.col("left"))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0)))
        .withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every))
    )
    level = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("rest") / F.col("open"))
    return d.select("source", "source_size", "n_docs", F.coalesce(level, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, seed: str = "mix-1", keep_rows: bool = True) -> DataFrame:
    """Number of copies of each document in the mix.

    Every document of a source is expected ``target / source_size`` times. Within its source the
    documents are laid out bucket by bucket, by size within a bucket; the running sum of expected
    copies plus one random offset per source is taken, and a document is emitted once for each
    integer that its step crosses. Sorting by size makes neighbours alike, so the words taken come
    near the target.

    Returns ``row`` (the input row; left out if not ``keep_rows``), ``doc_id``, ``source``,
    ``size``, ``source_size``, ``target``, ``copies`` and ``taken``. One row for each input row.

    Defined cases: a null text has size 0; a null source is a source of its own; null ids sort
    first; documents of size 0 may be drawn but take no words; a source without words has target
    0 and no copies; very long texts are counted whole; equal rows are numbered in any order, which
    cannot be told apart; an empty table gives an empty result; other columns, whatever their
    names, are carried in ``row``.
    """
    sized = packed(
        docs,
        doc_id=F.col("doc_id"),
        source=F.col("source"),
        size=size_of(F.col("text")),
        tie=F.xxhash64("text"),
        spot=_uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
    )
    slim = sized.drop("row")
    if not keep_rows:
        sized = slim = staged(slim, "mix-sizes")
    stats = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    stats = staged(stats.withColumn("n_buckets", F.ceil(F.col("n_docs") / ROWS_PER_BUCKET)), "mix-sources")

    def placed(rows: DataFrame) -> DataFrame:
        s = stats.withColumnRenamed("source", "s")
        return rows.join(s, rows["source"].eqNullSafe(s["s"])).drop("s").withColumn("bucket", F.col("spot") % F.col("n_buckets"))

    counts = placed(slim).groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead")), "mix-buckets")

    rows = placed(sized)
    rows = rows.join(counts, rows["source"].eqNullSafe(counts["s"]) & (rows["bucket"] == counts["b"])).drop("s", "b")
    within = Window.partitionBy("source", "bucket").orderBy("size", F.col("doc_id").asc_nulls_first(), "tie")
    offset = _uniform(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))) / F.lit(4294967296.0)
    each = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("k", (F.col("ahead") + F.row_number().over(within)).cast("double")).withColumn("each", each).withColumn("offset", offset)
    crossed = F.floor(F.col("offset") + F.col("each") * F.col("k")) - F.floor(F.col("offset") + F.col("each") * (F.col("k") - 1))
    rows = rows.withColumn("copies", F.least(F.lit(MOST_COPIES), crossed).cast("int"))
    kept = ["row"] if keep_rows else []
    return rows.select(*kept, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each input row once per copy, its columns followed by ``copy`` (from 1).

    A column of the input that is itself named ``copy`` gives way to the operator's.
    """
    out = mixed.filter(F.col("copies") > 0).select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return out.drop("copy").withColumnRenamed("__copy", "copy")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM s),
w AS (SELECT *, (1 + (rnk - 1) % 3)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap,
        (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM r),
c AS (SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= weight * (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped FROM w),
t AS (SELECT source, source_size, n_docs, ceil(n_docs / 4096.0)::BIGINT AS n_buckets,
        coalesce(CASE WHEN capped THEN cap ELSE weight * (total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0))
          / sum(weight) FILTER (WHERE NOT capped) OVER () END, 0.0) AS target FROM c),
p AS (SELECT d.*, t.source_size, t.target, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % n_buckets AS bucket
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, size, doc_id NULLS FIRST)::DOUBLE AS k,
        coalesce(target / nullif(source_size, 0), 0.0) AS each,
        ('0x' || substr(md5('mix-1' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM p),
n AS (SELECT *, least(3, floor(off + each * k) - floor(off + each * (k - 1)))::BIGINT AS copies FROM k)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM n
"""
