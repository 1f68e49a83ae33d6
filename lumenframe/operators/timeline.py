"""Order within a video: positions, neighbours, intervals, samples and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import staged

def _order(*by: str):
    return Window.partitionBy(*by).orderBy("pts_time", "frame_id")


def positions(frames: DataFrame) -> DataFrame:
    """``position`` from 0 by time within the video."""
    return frames.withColumn("position", F.row_number().over(_order("video_id")) - 1)


def neighbours(frames: DataFrame, radius: int = 2) -> DataFrame:
    """Each frame with its neighbours within ``radius`` positions, those of its shot first."""
    w = _order("video_id").rowsBetween(-radius, radius)
    p = positions(frames)
    near = F.collect_list(F.struct("position", "keyframe_uid", "shot_id")).over(w)
    p = p.withColumn("near", F.filter(near, lambda x: x["keyframe_uid"] != F.col("keyframe_uid")))
    same = F.transform("near", lambda x: F.struct((x["shot_id"] != F.col("shot_id")).alias("other"), x["position"].alias("position"), x["keyframe_uid"].alias("keyframe_uid")))
    return p.withColumn("neighbours", F.transform(F.array_sort(same), lambda x: x["keyframe_uid"])).drop("near")


def boost(frames: DataFrame, scores: DataFrame, weight: float = 0.15, radius: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """fused + weight * mean of the two best neighbour scores; a neighbour without a score counts 0.

    ``frames`` is the catalogue (all frames, not only candidates), so gaps are seen. Only the
    videos that have candidates are read into the window.
    """
    videos = scores.join(frames.select("keyframe_uid", "video_id"), "keyframe_uid").select(*keys, "video_id").distinct()
    d = frames.join(videos, "video_id").join(scores, [*keys, "keyframe_uid"], "left")
    w = Window.partitionBy(*keys, "video_id").orderBy("pts_time", "frame_id")
    around = [F.coalesce(F.lag("fused", -r).over(w), F.lit(0.0)) for r in range(-radius, radius + 1) if r]
    known = [F.lag("keyframe_uid", -r).over(w).isNotNull() for r in range(-radius, radius + 1) if r]
    near = F.filter(F.array(*[F.when(k, v) for k, v in zip(known, around, strict=True)]), lambda x: x.isNotNull())
    best = F.slice(F.sort_array(near, asc=False), 1, 2)
    mean = F.when(F.size(best) == 0, 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best))
    d = d.withColumn("neighbour_support", mean).filter(F.col("fused").isNotNull())
    return d.select(*keys, "video_id", "shot_id", "keyframe_uid", "frame_id", "pts_time", "fused", "neighbour_support", (F.col("fused") + weight * F.col("neighbour_support")).alias("boosted"))


def gaps(shots: DataFrame, frame_count: DataFrame) -> DataFrame:
    """Ranges of a video that no shot covers, before, between and after its shots."""
    w = Window.partitionBy("video_id").orderBy("start_frame")
    d = shots.withColumn("from", F.coalesce(F.lag("end_frame").over(w) + 1, F.lit(0)))
    inner = d.filter(F.col("from") < F.col("start_frame")).select("video_id", F.col("from").alias("start_frame"), (F.col("start_frame") - 1).alias("end_frame"))
    last = shots.groupBy("video_id").agg(F.max("end_frame").alias("e")).join(frame_count, "video_id")
    tail = last.filter(F.col("e") + 1 < F.col("frame_count")).select("video_id", (F.col("e") + 1).alias("start_frame"), (F.col("frame_count") - 1).alias("end_frame"))
    return inner.unionByName(tail)


def order_violations(frames: DataFrame) -> DataFrame:
    """Frames whose time is before that of the frame with the next lower id."""
    w = Window.partitionBy("video_id").orderBy("frame_id")
    return frames.withColumn("previous", F.lag("pts_time").over(w)).filter(F.col("pts_time") < F.col("previous"))


def overlaps(shots: DataFrame) -> DataFrame:
    """Shots that start at or before the end of an earlier one."""
    w = Window.partitionBy("video_id").orderBy("start_frame", "end_frame").rowsBetween(Window.unboundedPreceding, -1)
    return shots.withColumn("reached", F.max("end_frame").over(w)).filter(F.col("start_frame") <= F.col("reached"))


def exclude(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """Frames that lie in no excluded range of their video."""
    r = ranges.select(F.col("video_id").alias("v"), "start_frame", "end_frame")
    return frames.join(r, (frames["video_id"] == r["v"]) & frames["frame_id"].between(F.col("start_frame"), F.col("end_frame")), "left_anti")


def nearest_frame(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """For each segment the frame of its video that serves it: inside it and nearest its start, else nearest its start.

    An as-of join: frames and segments lie on one line of time, and each segment takes the last
    frame before its start and the first one from there on, carried along the line in two ordered
    passes; no segment meets all frames of its video.
    """
    f = frames.groupBy("video_id", "pts_time").agg(F.min("keyframe_uid").alias("keyframe_uid"))
    f = f.select("video_id", F.col("pts_time").alias("at"), F.struct(F.col("pts_time").alias("t"), "keyframe_uid").alias("frame"), F.lit(1).alias("kind"), F.lit(None).cast(segments.schema["segment_id"].dataType).alias("segment_id"), F.lit(None).cast("double").alias("end_time"))
    s = segments.select("video_id", F.col("start_time").cast("double").alias("at"), F.lit(None).cast(f.schema["frame"].dataType).alias("frame"), F.lit(0).alias("kind"), "segment_id", F.col("end_time").cast("double").alias("end_time"))
    line = f.unionByName(s)
    before = Window.partitionBy("video_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("video_id").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = line.withColumn("prev", F.last("frame", ignorenulls=True).over(before)).withColumn("next", F.last("frame", ignorenulls=True).over(after))
    d = d.filter("kind = 0").filter(F.col("prev").isNotNull() | F.col("next").isNotNull())
    inside = F.coalesce(F.col("next.t") <= F.col("end_time"), F.lit(False))
    earlier = F.coalesce(F.col("at") - F.col("prev.t") <= F.col("next.t") - F.col("at"), F.col("next").isNull())
    chosen = F.when(inside, F.col("next")).when(earlier, F.col("prev")).otherwise(F.col("next"))
    return d.select("video_id", "segment_id", chosen["keyframe_uid"].alias("keyframe_uid"), inside.alias("inside"))


def rank_over_all(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rank`` from 1 over the whole table: ordered by ranges, numbered in each, and moved on by the rows of the ranges ahead.

    The ordered rows are written down, so both passes see the same ranges.
    """
    d = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    n = d.groupBy("range_").agg(F.count(F.lit(1)).alias("n"))
    ahead = n.select("range_", F.coalesce(F.sum("n").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a range
    w = Window.partitionBy("range_").orderBy(*order)
    return d.join(ahead, "range_").withColumn("rank", F.col("ahead") + F.row_number().over(w)).drop("range_", "ahead")


def representatives(shots: DataFrame) -> DataFrame:
    """First, middle and last frame of each shot, without repeats, with ``local_idx`` running over the video."""
    ids = F.array_distinct(F.array("start_frame", F.expr("(start_frame + end_frame) div 2"), F.col("end_frame")))
    d = shots.select("video_id", "shot_id", "start_frame", F.posexplode(ids.cast("array<long>")).alias("p", "frame_id"))
    w = Window.partitionBy("video_id").orderBy("start_frame", "p")
    return d.select("video_id", "shot_id", "frame_id", (F.row_number().over(w) - 1).alias("local_idx"))


def evenly_spaced(rows: DataFrame, k: int, by: list[str], order: list[str]) -> DataFrame:
    """``k`` rows of each group at evenly spaced places: round half to even of i (n - 1) / (k - 1)."""
    w = Window.partitionBy(*by)
    d = rows.withColumn("at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    want = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(max(k - 1, 1))).cast("int"))
    return d.filter((F.col("n") <= k) | F.array_contains(want, F.col("at"))).drop("n")


def shard(rows: DataFrame, n: int, order: list[str], by: list[str]) -> DataFrame:
    """Round robin: row i of each group goes to shard i mod n."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("shard", F.pmod(F.row_number().over(w) - 1, F.lit(n)))


def pages(rows: DataFrame, size: int, by: list[str], order: list[str]) -> DataFrame:
    """``page`` from 0 of ``size`` rows each within a group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("page", F.floor((F.row_number().over(w) - 1) / size))


def hash_order(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def stratified(rows: DataFrame, seed: str, strata: list[str], per_stratum: int, total: int) -> DataFrame:
    """Seeded sample of each video: strata in turn, up to ``per_stratum`` rows of unused frames each, then filled up to ``total``.

    Rows have video_id, frame, id and stratum; order is by hash of the id. One row per frame.
    """
    d = rows.withColumn("h", hash_order(seed, F.col("id")))
    taken = None
    first = Window.partitionBy("video_id", "frame").orderBy("h", "id")
    for s in [*strata, None]:
        left = d if s is None else d.filter(F.col("stratum") == s)
        if taken is not None:
            left = left.join(taken.select("video_id", "frame"), ["video_id", "frame"], "left_anti")
        left = left.withColumn("f", F.row_number().over(first)).filter("f = 1")
        w = Window.partitionBy("video_id").orderBy("h", "id")
        left = left.withColumn("k", F.row_number().over(w))
        if s is None:
            have = taken.groupBy("video_id").agg(F.count(F.lit(1)).alias("have"))
            left = left.join(have, "video_id", "left").filter(F.col("k") <= total - F.coalesce("have", F.lit(0))).drop("have")
        else:
            left = left.filter(F.col("k") <= per_stratum)
        left = left.select("video_id", "frame", "id", F.lit(s or "fill").alias("drawn_as"))
        taken = left if taken is None else taken.unionByName(left)
    return taken
