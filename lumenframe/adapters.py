"""Domain views over the driver's tables.

A timeline frame is an event (video = user, shot = event type), a vector's video is its label, a
searchable frame text is a document (video = source), and OCR regions are order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, keyframe_uid, frame_id, pts_time (seconds), shot_id, score."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("keyframe_uid"),
        F.col("event_id").alias("frame_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("pts_time"),
        F.col("event_type").alias("shot_id"),
        F.col("value").alias("score"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyframe_uid, video_id, shot_id, frame_id and three channels: clip (all), sig and eva (halves)."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select(
        F.col("vec_id").alias("keyframe_uid"),
        F.col("label").alias("video_id"),
        F.expr("vec_id div 40").alias("shot_id"),
        F.col("vec_id").alias("frame_id"),
        v.alias("clip"),
        F.slice(v, 1, 32).alias("sig"),
        F.slice(v, 33, 32).alias("eva"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return vectors(spark, sf_dir).filter(F.col("keyframe_uid") % 100 == 0).select(F.col("keyframe_uid").alias("query_id"), "clip", "sig", "eva")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyframe_uid, video_id, text, language: documents as recognised frame texts."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("keyframe_uid"), F.col("source").alias("video_id"), "text", F.col("lang").alias("language"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as OCR regions.

    frame = order, region = line, confidence in [0, 1], text and corrected text from the part's
    name, marks from flags, box from quantities.
    """
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    r = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return r.select(
        F.col("l_orderkey").alias("keyframe_uid"),
        F.col("l_linenumber").alias("region_id"),
        F.expr("o_custkey div 10").alias("video_id"),
        F.col("o_orderpriority").alias("shot_id"),
        F.when(F.col("l_linenumber") == 7, F.lit("")).when(F.col("l_returnflag") == "R", F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("easyocr_text"),
        F.round(F.col("l_discount") * 10, 2).alias("easyocr_confidence"),
        (F.col("l_linestatus") == "F").alias("has_vi_marks"),
        (F.col("l_returnflag") != "N").alias("has_ascii_word"),
        F.when(F.col("l_quantity") > 48, F.lit("")).when(F.col("l_quantity") > 45, F.concat(F.lit("The text is blurry "), "p_name")).when(F.col("l_quantity") < 20, F.col("p_name")).otherwise(F.col("p_type")).alias("vintern_text"),
        F.col("p_name").alias("truth"),
        (F.col("l_quantity") / 50).alias("x"),
        (F.col("l_tax") * 10).alias("y"),
        F.col("l_quantity").alias("size"),
    )


#: The same views for SQL engines, as common table expressions.
SQL_FRAMES = """frames AS (SELECT user_id AS video_id, event_id AS keyframe_uid, event_id AS frame_id, epoch_us(ts) / 1e6::DOUBLE AS pts_time,
  event_type AS shot_id, value AS score FROM events)"""
SQL_VECTORS = """vectors AS (SELECT vec_id AS keyframe_uid, label AS video_id, vec_id // 40 AS shot_id, vec_id AS frame_id, embedding::DOUBLE[] AS clip,
  (embedding::DOUBLE[])[1:32] AS sig, (embedding::DOUBLE[])[33:64] AS eva FROM embeddings),
queries AS (SELECT keyframe_uid AS query_id, clip, sig, eva FROM vectors WHERE keyframe_uid % 100 = 0)"""
SQL_TEXTS = "texts AS (SELECT doc_id AS keyframe_uid, source AS video_id, text, lang AS language FROM documents)"
SQL_REGIONS = """regions AS (SELECT l_orderkey AS keyframe_uid, l_linenumber AS region_id, o_custkey // 10 AS video_id, o_orderpriority AS shot_id,
  CASE WHEN l_linenumber = 7 THEN '' WHEN l_returnflag = 'R' THEN p_name || '?' ELSE p_name END AS easyocr_text,
  round(l_discount * 10, 2) AS easyocr_confidence, l_linestatus = 'F' AS has_vi_marks, l_returnflag <> 'N' AS has_ascii_word,
  CASE WHEN l_quantity > 48 THEN '' WHEN l_quantity > 45 THEN 'The text is blurry ' || p_name WHEN l_quantity < 20 THEN p_name ELSE p_type END AS vintern_text,
  p_name AS truth, l_quantity / 50 AS x, l_tax * 10 AS y, l_quantity AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
