"""What is wrong with a collection's tables, before a search relies on them; and selections and reports over them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing

READY, UNAVAILABLE, INVALID = "READY", "UNAVAILABLE", "INVALID"


def _state(rows: DataFrame, name: str, *tests: tuple[str, Column]) -> DataFrame:
    """One row: artifact, status, rows and the names of the tests that some row fails, with how many do."""
    bad = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(f"b{i}") for i, (_, c) in enumerate(tests)]
    a = rows.agg(F.count(F.lit(1)).alias("records"), *bad)
    said = [F.when(F.col(f"b{i}") > 0, F.concat(F.lit(f"{n}="), F.col(f"b{i}").cast("string"))) for i, (n, _) in enumerate(tests)]
    detail = F.array_join(F.array_compact(F.array(*said)), ";")
    status = F.when((F.col("records") == 0) | (detail != ""), INVALID).otherwise(READY)
    return a.select(F.lit(name).alias("artifact"), status.alias("status"), "records", F.when(F.col("records") == 0, "empty").otherwise(detail).alias("detail"))


def frames_state(frames: DataFrame) -> DataFrame:
    """Frames must have ids that differ, be one for a video and frame number, and lie on a line of time."""
    again = F.count(F.lit(1)).over(Window.partitionBy("keyframe_uid")) > 1
    twice = F.count(F.lit(1)).over(Window.partitionBy("video_id", "frame_id")) > 1
    d = frames.select("pts_time", F.col("keyframe_uid").isNull().alias("none"), again.alias("again"), twice.alias("twice"))
    return _state(d, "frames", ("null_uid", F.col("none")), ("duplicate_uid", F.col("again")), ("duplicate_frame", F.col("twice")), ("time", F.col("pts_time").isNull() | (F.col("pts_time") < 0)))


def vectors_state(vectors: DataFrame, frames: DataFrame, channel: str, dim: int | None = None, unit: bool = True, name: str | None = None) -> DataFrame:
    """Vectors of a channel must be one for each frame, of one dimension and of unit length."""
    norm = F.sqrt(F.aggregate(F.col(channel).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    v = vectors.select("keyframe_uid", F.size(channel).alias("dim"), norm.alias("norm"), F.lit(True).alias("there"), (F.count(F.lit(1)).over(Window.partitionBy("keyframe_uid")) > 1).alias("again"))
    j = v.join(frames.select("keyframe_uid", F.lit(True).alias("known")).distinct(), "keyframe_uid", "full_outer")
    tests = [("missing", F.col("there").isNull()), ("foreign", F.col("known").isNull()), ("duplicate_uid", F.col("again"))]
    tests += [("dimension", F.col("dim") != dim)] if dim else []
    tests += [("norm", F.abs(F.col("norm") - 1) > 1e-2)] if unit else []
    return _state(j, name or channel, *tests)


def texts_state(texts: DataFrame, frames: DataFrame, name: str) -> DataFrame:
    """Texts must be of frames that are there, and of the video that they name."""
    j = texts.select("keyframe_uid", F.col("video_id").alias("said")).join(frames.select("keyframe_uid", "video_id", F.lit(True).alias("known")).dropDuplicates(["keyframe_uid"]), "keyframe_uid", "left")
    return _state(j, name, ("orphan", F.col("known").isNull()), ("other_video", F.col("known") & (F.col("said") != F.col("video_id"))))


def absent(spark, name: str) -> DataFrame:
    return spark.createDataFrame([(name, UNAVAILABLE, 0, "absent")], "artifact string, status string, records long, detail string")


def inspect(frames: DataFrame, vectors: Mapping[str, DataFrame | None], texts: Mapping[str, DataFrame | None], dims: Mapping[str, int]) -> DataFrame:
    """A row for each table of a collection: READY, UNAVAILABLE (not there) or INVALID, with what is wrong."""
    spark, out = frames.sparkSession, [frames_state(frames)]
    for name, d in vectors.items():
        channels = [] if d is None else [c for c in d.columns if c in ("clip", "sig", "eva", "vector")]
        out += [vectors_state(d, frames, c, dims.get(c), dims.get(c) is not None, c if c != "vector" else name) for c in channels] or [absent(spark, name)]
    out += [absent(spark, n) if d is None else texts_state(d, frames, n) for n, d in texts.items()]
    return reduce(DataFrame.unionByName, out)


def uid_mismatches(catalog: DataFrame) -> DataFrame:
    """Rows whose id is not the one that video, shot and place in the video give."""
    want = hashing.keyframe_uid(F.col("video_id"), F.col("shot_id"), F.col("local_idx"))
    return catalog.withColumn("expected_uid", want).filter(~F.col("keyframe_uid").eqNullSafe(F.col("expected_uid")))


def catalog_audit(catalog: DataFrame) -> DataFrame:
    """One row: rows, videos, least and most frames of a video, wrong and repeated ids."""
    per = catalog.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    a = per.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("videos"), F.min("n").alias("least"), F.max("n").alias("most"))
    wrong = uid_mismatches(catalog).agg(F.count(F.lit(1)).alias("mismatches"))
    again = catalog.groupBy("keyframe_uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("duplicates"))
    return a.crossJoin(wrong).crossJoin(again)  # one row each


def catalog_from_listing(paths: DataFrame, pattern: str = r"([^/]+)/([^/_]+)_([0-9]+)\.jpe?g$") -> DataFrame:
    """A catalog from image paths ``<video>/<shot>_<n>.jpg``: ``local_idx`` from 0 in a video by shot and number, and the id. Other files are left out."""
    part = lambda i: F.regexp_extract("path", pattern, i)
    d = paths.filter(F.col("path").rlike(pattern)).select(part(1).alias("video_id"), part(2).alias("shot_id"), part(3).cast("int").alias("file_idx"), F.col("path").alias("source_image"))
    d = d.withColumn("local_idx", F.row_number().over(Window.partitionBy("video_id").orderBy("shot_id", "file_idx")) - 1)
    return d.withColumn("keyframe_uid", hashing.keyframe_uid(F.col("video_id"), F.col("shot_id"), F.col("local_idx")))


def stem_mismatches(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files whose stem is no video of the inventory, videos without a file, and stems of several files."""
    f = files.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    j = f.join(inventory.select(F.col("video_id").alias("stem"), F.lit(True).alias("known")).distinct(), "stem", "full_outer")
    reason = F.when(F.col("known").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return j.select("stem", reason.alias("reason")).filter("reason is not null")


def diagnostics(videos: DataFrame, candidates: DataFrame, channels: list[str], top: int = 5) -> DataFrame:
    """A report row for each case: its first videos and its candidates, with their channel scores; a case without candidates failed."""
    w = Window.partitionBy("case").orderBy(F.col("video_score").desc(), "video_id")
    best = videos.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top).groupBy("case").agg(F.array_sort(F.collect_list(F.struct("n", "video_id", F.col("video_score").alias("score")))).alias("top_videos"))
    scores = F.struct(*[F.col(c) for c in channels]).alias("channel_scores")
    rows = candidates.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("position", "video_id", "keyframe_uid", "score", scores))).alias("candidates"))  # a result list
    d = best.join(rows, "case", "full_outer")
    return d.select("case", F.when(F.size("candidates") > 0, "PASS").otherwise("FAIL").alias("status"), F.transform("top_videos", lambda x: F.struct(x["video_id"].alias("video_id"), x["score"].alias("score"))).alias("top_videos"), "candidates")
