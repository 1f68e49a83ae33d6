"""Keyframe quality: blur, near-duplicates within a shot, and parity of manifests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assess(items: DataFrame, blur: float | None, distance: int | None) -> DataFrame:
    """Which frames of each shot are kept: the sharp ones, without near copies of kept ones.

    ``items`` has video_id, shot_id, local_idx, keyframe_uid, variance and phash (hex). If all
    frames of a shot are blurred its sharpest stays (ties: the first). Whether a frame is a near
    copy depends on the decisions before it, so each shot's few frames are folded in order.
    """
    bits = F.conv("phash", 16, -10).cast("long")
    row = F.struct("local_idx", "keyframe_uid", "variance", bits.alias("h"))
    d = items.groupBy("video_id", "shot_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # frames of one shot
    sharp = F.filter("rows", lambda x: x["variance"] >= F.lit(blur)) if blur is not None else F.col("rows")
    best = F.array_max(F.transform("rows", lambda x: F.struct(x["variance"].alias("v"), (-x["local_idx"]).alias("i"), x.alias("x"))))["x"]
    d = d.withColumn("sharp", sharp).withColumn("fallback", F.size("sharp") == 0).withColumn("use", F.when(F.size("sharp") == 0, F.array(best)).otherwise(F.col("sharp")))
    if distance is None:
        d = d.withColumn("seen", F.transform("use", lambda x: F.struct(x["keyframe_uid"].alias("uid"), x["h"].alias("h"), F.lit(None).cast("long").alias("of"))))
    else:
        kept = lambda acc: F.filter(acc, lambda y: y["of"].isNull())
        nearest = lambda acc, x: F.array_min(F.transform(kept(acc), lambda y, i: F.struct(F.bit_count(y["h"].bitwiseXOR(x["h"])).alias("d"), i.alias("i"), y["uid"].alias("uid"))))
        step = lambda acc, x: F.array_append(acc, F.struct(x["keyframe_uid"].alias("uid"), x["h"].alias("h"), F.when(nearest(acc, x)["d"] <= distance, nearest(acc, x)["uid"]).alias("of")))
        d = d.withColumn("seen", F.aggregate("use", F.array().cast("array<struct<uid:bigint,h:bigint,of:bigint>>"), step))
    d = d.select("video_id", "shot_id", "fallback", "seen", F.explode("rows").alias("r"))
    mine = F.try_element_at(F.filter("seen", lambda y: y["uid"] == F.col("r.keyframe_uid")), F.lit(1))
    d = d.withColumn("mine", mine)
    reason = F.when(F.col("mine").isNull(), "blur").when(F.col("mine.of").isNotNull(), "near_duplicate").when(F.col("fallback"), "kept_best_blur_fallback").otherwise("kept")
    return d.select("video_id", "shot_id", F.col("r.local_idx").alias("local_idx"), F.col("r.keyframe_uid").alias("keyframe_uid"), reason.alias("reason"), F.col("mine.of").alias("duplicate_of")).withColumn("kept", F.col("reason").startswith("kept"))


def excluded_fraction(ranges: DataFrame, frame_count: DataFrame, warn: float = 0.01) -> DataFrame:
    """Excluded frames of each video, their share, and whether it is above the warning line."""
    a = ranges.groupBy("video_id").agg(F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("excluded"))
    d = frame_count.join(a, "video_id", "left").fillna(0, ["excluded"])
    return d.withColumn("fraction", F.try_divide("excluded", "frame_count")).withColumn("warn", F.coalesce(F.col("fraction") > warn, F.lit(False)))


def first_mismatch(a: DataFrame, b: DataFrame, value: str, by: list[str], pos: str = "pos") -> DataFrame:
    """The first place where two manifests differ, a row per differing group."""
    j = a.select(*by, pos, F.col(value).alias("left")).join(b.select(*by, pos, F.col(value).alias("right")), [*by, pos], "full_outer")
    return j.filter(~F.col("left").eqNullSafe(F.col("right"))).groupBy(*by).agg(F.min(pos).alias(pos), F.min_by("left", pos).alias("left"), F.min_by("right", pos).alias("right"), F.count(F.lit(1)).alias("differences"))


def strict_join(plan: DataFrame, quality: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Rows of both sides by key with a verdict: ok, missing, extra or mismatch of the columns ``same``."""
    q = quality.select(key, *[F.col(c).alias(f"q_{c}") for c in same], *[c for c in quality.columns if c not in (key, *same)], F.lit(True).alias("in_q"))
    p = plan.select(*plan.columns, F.lit(True).alias("in_p"))
    j = p.join(q, key, "full_outer")
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"q_{c}"))
    verdict = F.when(F.col("in_p").isNull(), "extra").when(F.col("in_q").isNull(), "missing").when(~equal, "mismatch").otherwise("ok")
    return j.withColumn("verdict", verdict).drop("in_p", "in_q", *[f"q_{c}" for c in same])


def middle(a: Column, b: Column) -> Column:
    return F.floor((a + b) / 2)


def sharpness(grey: np.ndarray) -> float:
    """Variance of the Laplacian (four neighbours, borders mirrored without the edge)."""
    g = np.pad(grey.astype(np.float64), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def perceptual_hash(grey: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine coefficients of the image at 32 x 32 are above their median."""
    rows, cols = (np.linspace(0, n, 33).astype(int) for n in grey.shape)
    small = np.array([[grey[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)])
    k = np.arange(32)
    basis = np.cos((2 * k[None, :] + 1) * k[:8, None] * np.pi / 64)
    low = np.round((basis @ small @ basis.T).ravel(), 6)
    return f"{int(''.join('1' if x > np.median(low) else '0' for x in low), 2):016x}"


def image_metrics(images: DataFrame) -> DataFrame:
    """keyframe_uid, variance and phash of grey images (``pixels`` binary, row by row, ``width``, ``height``).

    An image under 2 x 2 or of another size than it says gives nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, w, h in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if p is None or min(w or 0, h or 0) < 2 or len(p) != w * h:
                    out.append((None, None))
                    continue
                grey = np.frombuffer(p, np.uint8).reshape(h, w)
                out.append((sharpness(grey), perceptual_hash(grey)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v for v, _ in out], pa.float64()), pa.array([x for _, x in out], pa.string())], names=["keyframe_uid", "variance", "phash"])

    return images.select(F.col("keyframe_uid").cast("long").alias("keyframe_uid"), "pixels", F.col("width").cast("int"), F.col("height").cast("int")).mapInArrow(run, "keyframe_uid long, variance double, phash string")
