"""Answers read from recognised text, and edits of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NUMBER_CONFIDENCE, TEXT_CONFIDENCE = 0.78, 0.65


def extract(frames: DataFrame, hits: DataFrame, texts: DataFrame, catalog: DataFrame, value_type: str, radius: int = 2, most: int = 20) -> DataFrame:
    """An answer per video from the texts of its evidence.

    ``frames`` are the evidence frames (video_id, keyframe_uid), ``hits`` what a search for the
    question's words found (video_id, keyframe_uid, score). Where a video has hits, the best
    ``most`` are read, those on evidence frames first; else the texts of the evidence frames and
    their neighbours. A number is the one with most digits; a text is the first one read.
    """
    own = frames.select("video_id", "keyframe_uid", F.lit(True).alias("seen")).distinct()
    w = Window.partitionBy("video_id").orderBy(F.coalesce("seen", F.lit(False)).desc(), F.col("score").desc(), "keyframe_uid")
    found = hits.join(own.select("video_id").distinct(), "video_id", "left_semi").join(own, ["video_id", "keyframe_uid"], "left")
    found = found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("video_id", "keyframe_uid", "n")
    left = own.join(hits.select("video_id").distinct(), "video_id", "left_anti")
    line = catalog.join(left.select("video_id").distinct(), "video_id", "left_semi")
    at = Window.partitionBy("video_id").orderBy("pts_time", "frame_id")
    line = line.withColumn("p", F.row_number().over(at)).select("video_id", "keyframe_uid", "p")
    mid = line.join(left, ["video_id", "keyframe_uid"]).select("video_id", F.explode(F.sequence(F.col("p") - radius, F.col("p") + radius)).alias("p")).distinct()
    near = line.join(mid, ["video_id", "p"]).select("video_id", "keyframe_uid", F.col("p").alias("n"))
    read = found.unionByName(near).join(texts.select("keyframe_uid", "text"), "keyframe_uid").filter(F.trim("text") != "")
    listed = read.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("rows"))  # a few rows a video
    rows = F.transform("rows", lambda x: x["text"])
    if value_type == "number":
        out = listed.select("video_id", T.best_number(rows).alias("answer"), F.lit(NUMBER_CONFIDENCE).alias("answer_confidence"))
    else:
        out = listed.select("video_id", F.substring(T.collapse(F.element_at(rows, 1)), 1, 100).alias("answer"), F.lit(TEXT_CONFIDENCE).alias("answer_confidence"))
    return out.filter("answer is not null")


def bulk_valid(rows: DataFrame, event_count: int, most: int = 100) -> DataFrame:
    """Rows that may be added in bulk: no blank, uncertain or unreviewed answers, no sequence of another length."""
    answer = F.lower(F.trim(F.coalesce("answer", F.lit(""))))
    good = F.when(F.col("task") == "QA", ~answer.isin("", "uncertain") & ~F.coalesce("requires_review", F.lit(False))).when(F.col("task") == "TRAKE", F.size("frame_ids") == event_count).otherwise(True)
    return rows.filter(good).orderBy("position").limit(most)


def replace_frame(rows: DataFrame, catalog: DataFrame, index: int, step: int) -> DataFrame:
    """Sequences with the frame at ``index`` (from 0) moved ``step`` places on its video's timeline.

    ``valid`` tells whether the frame is there and the times still rise.
    """
    w = Window.partitionBy("video_id").orderBy("pts_time", "frame_id")
    line = catalog.select("video_id", "frame_id", "pts_time", F.lead("frame_id", step).over(w).alias("other"))
    d = rows.withColumn("old", F.element_at("frame_ids", index + 1))
    d = d.join(line.select("video_id", F.col("frame_id").alias("old"), "other"), ["video_id", "old"], "left")
    d = d.withColumn("frame_ids", F.transform("frame_ids", lambda x, i: F.when(i == index, F.col("other")).otherwise(x)))
    times = d.select("position", "video_id", F.posexplode("frame_ids").alias("p", "frame_id")).join(line.select("video_id", "frame_id", "pts_time"), ["video_id", "frame_id"], "left")
    up = Window.partitionBy("position").orderBy("p")
    ok = times.withColumn("rise", F.coalesce(F.col("pts_time") > F.lag("pts_time").over(up), F.col("p") == 0) & F.col("pts_time").isNotNull())
    ok = ok.groupBy("position").agg(F.bool_and(F.coalesce("rise", F.lit(False))).alias("valid"))
    return d.join(ok, "position", "left").drop("old", "other")


def display_rows(candidates: DataFrame, matched: DataFrame) -> DataFrame:
    """Rows as shown: rank, ids, rounded score and the video's distinct matched scenes."""
    m = matched.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("scene").cast("string"))), " | ").alias("scenes"))
    return candidates.join(m, "video_id", "left").select(F.col("position").alias("rank"), "video_id", "keyframe_uid", F.round("candidate_score", 4).alias("score"), F.coalesce("scenes", F.lit("")).alias("scenes"))
