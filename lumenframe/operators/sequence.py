"""Ordered events: beam search for sequences of frames within a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import best_per_shot


def beam_sequences(moments: DataFrame, n_moments: int, width: int = 8, top_frames: int = 32, decay: float = 0.0) -> DataFrame:
    """Sequences of one frame per moment, strictly later each time, no frame twice.

    ``moments`` has moment (0, 1, ...), video_id, shot_id, keyframe_uid, frame_id, pts_time and
    score. Per video and moment the best frame of each shot counts, ``top_frames`` at most, and
    ``width`` sequences are kept after each moment; so a step joins at most width x top_frames
    rows a video. Ties go to the lesser frame ids.
    """
    best = best_per_shot(moments, ("moment",))
    w = Window.partitionBy("moment", "video_id").orderBy(F.col("score").desc(), "keyframe_uid")
    best = best.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top_frames)
    step = lambda m: best.filter(F.col("moment") == m).select("video_id", F.col("frame_id").alias("f"), F.col("pts_time").alias("t"), F.col("score").alias("s"))
    keep = Window.partitionBy("video_id").orderBy(F.col("total").desc(), "frame_ids")
    beams = step(0).select("video_id", F.array("f").alias("frame_ids"), F.array("t").alias("pts_times"), F.col("s").alias("total"))
    beams = beams.withColumn("n", F.row_number().over(keep)).filter(F.col("n") <= width).drop("n")
    for m in range(1, n_moments):
        j = beams.join(step(m), "video_id").filter((F.col("t") > F.element_at("pts_times", -1)) & ~F.array_contains("frame_ids", F.col("f")))
        gain = F.col("s") * F.exp(-decay * (F.col("t") - F.element_at("pts_times", -1)))
        beams = j.select("video_id", F.array_append("frame_ids", F.col("f")).alias("frame_ids"), F.array_append("pts_times", F.col("t")).alias("pts_times"), (F.col("total") + gain).alias("total"))
        beams = beams.withColumn("n", F.row_number().over(keep)).filter(F.col("n") <= width).drop("n")
    return beams.select("video_id", "frame_ids", "pts_times", "total", (F.col("total") / n_moments).alias("mean"))


def sequence_candidates(beams: DataFrame, videos: DataFrame) -> DataFrame:
    """0.4 of the video's score + 0.6 of the sequence's mean; one row per different sequence."""
    d = beams.join(videos.select("video_id", "video_score"), "video_id").withColumn("score", 0.4 * F.col("video_score") + 0.6 * F.col("mean"))
    w = Window.partitionBy("video_id", "frame_ids").orderBy(F.col("score").desc())
    return d.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
