"""What is left for a paid reader: flattening, paging, cost, budgets and repeated overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T

PAGE, SHEET = 18, 12
#: Planning costs: tokens per sheet, request and region, prices per million tokens, and reserve (fixed values).
IMAGE_TOKENS, PROMPT_REQUEST, PROMPT_REGION, OUTPUT_REQUEST, OUTPUT_REGION = 256, 160, 8, 20, 48
STANDARD, BATCH = (0.10, 0.40), (0.05, 0.20)
RESERVE, VND, BUDGET = 0.15, 26300, 400_000
BIN, CORNER_X, TOP_Y, CORNER_W, CORNER_H, SHORT = 0.05, 0.75, 0.30, 0.25, 0.20, 16
TINY_LENGTH, TINY_AREA, BOTTOM_Y, BOTTOM_W = 3, 0.015, 0.62, 0.18


def requests(residuals: DataFrame, page: int = PAGE) -> DataFrame:
    """One request per shot: its regions in order, in pages of ``page``, with a stable id.

    A list is as long as a shot's residual regions.
    """
    r = residuals.groupBy("video_id", "shot_id").agg(F.array_sort(F.collect_list(F.struct("keyframe_uid", "region_id"))).alias("rs"))
    n = F.size("rs")
    r = r.withColumn("pages", F.transform(F.sequence(F.lit(0), F.floor((n - 1) / page).cast("int")), lambda i: F.slice("rs", i * page + 1, page)))
    return r.select(hashing.request_id(F.col("video_id").cast("string"), F.col("shot_id").cast("string")).alias("request_id"), "video_id", "shot_id", n.alias("regions"), F.size("pages").alias("n_pages"), "pages")


def partition_violations(residuals: DataFrame, paged: DataFrame) -> DataFrame:
    """Regions that requests miss or hold twice: requests must part the residuals exactly."""
    held = paged.select("video_id", "shot_id", F.explode(F.flatten("pages")).alias("r")).select("r.keyframe_uid", "r.region_id")
    a = residuals.select("keyframe_uid", "region_id", F.lit(1).alias("want"), F.lit(0).alias("have"))
    b = held.select("keyframe_uid", "region_id", F.lit(0).alias("want"), F.lit(1).alias("have"))
    return a.unionByName(b).groupBy("keyframe_uid", "region_id").agg(F.sum("want").alias("want"), F.sum("have").alias("have")).filter("want != 1 or have != 1")


def planning_cost(regions: Column, n_requests: Column, sheets: Column, price: tuple[float, float]) -> Column:
    """Estimated cost in VND with the retry reserve, rounded up."""
    tokens_in = sheets * IMAGE_TOKENS + n_requests * PROMPT_REQUEST + regions * PROMPT_REGION
    tokens_out = n_requests * OUTPUT_REQUEST + regions * OUTPUT_REGION
    usd = tokens_in / 1_000_000 * price[0] + tokens_out / 1_000_000 * price[1]
    return F.ceil(usd * (1 + RESERVE) * VND).cast("long")


def preflight(residuals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and planned cost of residuals, in all or by groups."""
    shots = requests(residuals).select("video_id", "shot_id", "n_pages")
    r = residuals.groupBy(*(by or []), "video_id", "shot_id").agg(F.count(F.lit(1)).alias("regions"), F.countDistinct("keyframe_uid").alias("frames")).join(shots, ["video_id", "shot_id"])
    a = r.groupBy(*(by or [])).agg(F.sum("regions").alias("regions"), F.sum("frames").alias("frames"), F.count(F.lit(1)).alias("requests"), F.sum("n_pages").alias("sheets"))
    for name, price in (("standard", STANDARD), ("batch", BATCH)):
        a = a.withColumn(f"{name}_vnd", planning_cost(F.col("regions"), F.col("requests"), F.col("sheets"), price))
    return a.withColumn("within_budget", F.col("standard_vnd") <= BUDGET)


def reason_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("regions"))


def priority(visual: Column, regions: Column, perspective: Column, least_area: Column) -> Column:
    area = F.when(least_area.isNull(), 0.0).otherwise(F.least(F.lit(15.0), 0.003 / F.greatest(least_area, F.lit(1e-9))))
    return F.round(visual * 100 + F.least(F.lit(20), regions * 2) + perspective * 10 + area, 6)


def select_within_budget(candidates: DataFrame, request_cap: int, frame_cap: int) -> DataFrame:
    """Whole shots by their greatest priority up to the request cap, frames up to the frame cap.

    The shot at which the frame cap is met is taken in part. ``candidates`` has video_id,
    shot_id, keyframe_uid and priority. Only the shots up to the request cap, which the budget
    pays for, are put in order; all others overflow.
    """
    shots = candidates.groupBy("video_id", "shot_id").agg(F.max("priority").alias("top"), F.count(F.lit(1)).alias("n"))
    shots = shots.orderBy(F.col("top").desc(), "video_id", "shot_id").limit(request_cap)
    w = Window.partitionBy().orderBy(F.col("top").desc(), "video_id", "shot_id")
    shots = shots.withColumn("order", F.row_number().over(w)).withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    d = candidates.join(shots.select("video_id", "shot_id", "order", "before"), ["video_id", "shot_id"], "left")
    k = Window.partitionBy("video_id", "shot_id").orderBy(F.col("priority").desc(), "keyframe_uid")
    d = d.withColumn("k", F.row_number().over(k))
    paid = F.col("order").isNotNull() & (F.col("before") + F.col("k") <= frame_cap)
    return d.withColumn("route", F.when(paid, "paid").otherwise("overflow")).drop("order", "before", "k")


def ledger(usage: DataFrame, frame_cap: int, budget_vnd: float) -> DataFrame:
    """Running totals of an ordered ledger and whether each entry is still allowed."""
    w = Window.partitionBy("model_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = usage
    for c in ("frames", "prompt_tokens", "output_tokens"):
        d = d.withColumn(f"total_{c}", F.sum(c).over(w))
    vnd = (F.col("total_prompt_tokens") * 0.125 + F.col("total_output_tokens") * 0.75) / 1e6 * VND * (1 + RESERVE)
    return d.withColumn("total_vnd", F.round(vnd, 6)).withColumn("allowed", (F.col("total_frames") <= frame_cap) & (F.col("total_vnd") <= budget_vnd + 1e-6))


def box(points: Column) -> Column:
    """Edges, centre and size of a quad of 8 numbers on [0, 1]; anything else fails."""
    xs = F.filter(points, lambda v, i: i % 2 == 0)
    ys = F.filter(points, lambda v, i: i % 2 == 1)
    bad = (F.size(points) != 8) | F.exists(points, lambda v: (v < 0) | (v > 1) | v.isNull())
    left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    good = F.struct(left.alias("left"), right.alias("right"), top.alias("top"), bottom.alias("bottom"), ((left + right) / 2).alias("cx"), ((top + bottom) / 2).alias("cy"), (right - left).alias("w"), (bottom - top).alias("h"))
    return F.when(bad, F.raise_error(F.lit("a box must have 8 numbers on [0, 1]")).cast("struct<left:double,right:double,top:double,bottom:double,cx:double,cy:double,w:double,h:double>")).otherwise(good)


def overlay_group(b: Column, text: Column) -> Column:
    """Group and reason of a region that may be an overlay; the group is null if it is not."""
    norm = T.signature(F.coalesce(text, F.lit("")))
    bins = lambda v: F.floor((v + 1e-12) / BIN).cast("string")
    where = F.concat_ws(":", bins(b["cx"]), bins(b["cy"]), bins(b["w"]), bins(b["h"]))
    some, n = norm != "", F.length(norm)
    bottom = (b["top"] >= BOTTOM_Y) & (b["w"] >= BOTTOM_W)
    corner = (b["cx"] >= CORNER_X) & (b["cy"] <= TOP_Y) & (b["w"] <= CORNER_W) & (b["h"] <= CORNER_H) & (n <= SHORT)
    tiny = (n <= TINY_LENGTH) & (b["w"] * b["h"] <= TINY_AREA)
    group = F.when(some & ~bottom & corner, F.concat(F.lit("top_corner:"), where)).when(some & ~bottom & tiny, F.concat(F.lit("tiny:"), norm, F.lit(":"), where))
    reason = F.when(some & bottom, "protected_bottom_subtitle_or_ticker").when(some & corner, "stable_top_corner_short_overlay").when(some & tiny, "stable_tiny_glyph_or_noise")
    return F.struct(group.alias("group_id"), reason.alias("reason"))


def overlay_groups(regions: DataFrame, frames_of: DataFrame, min_frames: int = 20, min_fraction: float = 0.05) -> DataFrame:
    """Groups that stand on enough frames of their video, with their most frequent texts (8 at most)."""
    g = regions.filter("group_id is not null")
    a = g.groupBy("video_id", "group_id").agg(F.countDistinct("keyframe_uid").alias("frames"))
    q = a.join(frames_of, "video_id").withColumn("required", F.greatest(F.lit(min_frames), F.ceil(F.col("video_frames") * min_fraction)))
    q = q.filter(F.col("frames") >= F.col("required"))
    texts = g.groupBy("video_id", "group_id", "text").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("video_id", "group_id").orderBy(F.col("n").desc(), "text")
    top = texts.withColumn("k", F.row_number().over(w)).filter("k <= 8").groupBy("video_id", "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text", "n"))), lambda x: F.concat(x["text"], F.lit("="), x["n"].cast("string"))), "|").alias("common"))
    return q.join(top, ["video_id", "group_id"])


def suppress_overlays(regions: DataFrame, groups: DataFrame) -> DataFrame:
    """Marks regions of qualified groups; no text is changed."""
    keys = groups.select("video_id", "group_id", F.lit(True).alias("hit"))
    return regions.join(keys, ["video_id", "group_id"], "left").withColumn("suppress", F.coalesce("hit", F.lit(False))).drop("hit")
