"""Score fusion: normalisation, smooth rank fusion, query and channel combination."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ETA, BETA = 60.0, 40.0
#: Weight of the second best query, of the neighbours, and of channels by what is there.
SECOND_BEST, NEIGHBOUR = 0.1, 0.15
WEIGHTS = {("visual",): (1.0,), ("visual", "ocr"): (0.55, 0.45), ("visual", "asr"): (0.55, 0.45), ("visual", "ocr", "asr"): (0.5, 0.25, 0.25)}


def minmax(value: Column, *by: str) -> Column:
    """Values of a group on [0, 1]; all 1 where the range is next to nothing. NaN and infinity fail."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("a score is not finite")).cast("double")).otherwise(value)
    return F.when(hi - lo <= 1e-12, 1.0).otherwise((checked - lo) / (hi - lo))


def minmax_all(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``minmax`` over all rows: the bounds are one row, added up task by task, and not a window that takes all rows to one."""
    x, lo, hi = F.col(column), F.col("lo_"), F.col("hi_")
    bounds = rows.agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"))
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("a score is not finite")).cast("double")).otherwise(x)
    return rows.crossJoin(F.broadcast(bounds)).withColumn(out, F.when(hi - lo <= 1e-12, 1.0).otherwise((checked - lo) / (hi - lo))).drop("lo_", "hi_")


def smooth_rank(score: Column, references: Column) -> Column:
    """0.5 + the sum of logistic steps over the reference scores, added in their order."""
    step = lambda r: 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(BETA) * (r - score)))))
    return F.lit(0.5) + F.aggregate(references, F.lit(0.0), lambda s, r: s + step(r))


def references(hits: DataFrame, name: str) -> DataFrame:
    """The scores of each query's direct hits, greatest first: k values a query."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias(name))


def fuse_channels(scored: DataFrame, refs: dict[str, DataFrame]) -> DataFrame:
    """Smooth reciprocal rank fusion of the channels in ``refs``, normalised within each query."""
    d = scored
    for c, r in refs.items():
        d = d.join(r.withColumnRenamed(r.columns[1], f"ref_{c}"), "query_id")
    total = sum((1 / (ETA + smooth_rank(F.col(c), F.col(f"ref_{c}"))) for c in refs), F.lit(0.0))
    d = d.withColumn("srrf", total)
    return d.select("query_id", "keyframe_uid", *refs, "srrf", minmax(F.col("srrf"), "query_id").alias("fused"))


def combine_queries(per_query: DataFrame) -> DataFrame:
    """An id's best score over queries plus a tenth of its second best, normalised.

    The two best are kept by a bounded aggregate; a query without the id counts 0.
    """
    best = per_query.groupBy("keyframe_uid").agg(F.max("fused").alias("first"), F.max_by("query_id", F.struct("fused", -F.col("query_id"))).alias("best_query"))
    rest = per_query.join(best, "keyframe_uid").filter(F.col("query_id") != F.col("best_query")).groupBy("keyframe_uid").agg(F.max("fused").alias("second"))
    d = best.join(rest, "keyframe_uid", "left").withColumn("raw", F.col("first") + SECOND_BEST * F.coalesce("second", F.lit(0.0)))
    return minmax_all(d, "raw", "score").select("keyframe_uid", "best_query", "score")


def fuse_modalities(channels: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Weighted sum of normalised channels over the union of their ids.

    Absent or empty channels are left out and the weights shared anew; a missing id counts 0; if
    no weight is left the visual channel stands alone.
    """
    # Bounds and number of rows of a channel in one pass: two of three things that are needed of it.
    bounds = {c: d.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first() for c, d in channels.items()}
    live = {c: d for c, d in channels.items() if bounds[c]["n"]}
    use = {c: max(weights.get(c, 0.0), 0.0) for c in live}
    if sum(use.values()) <= 0:
        use = {c: 1.0 for c in live if c == "visual"}
    total = sum(use.values())
    rows = None
    for c, w in use.items():
        lo, hi = bounds[c]["lo"], bounds[c]["hi"]
        if not math.isfinite(hi) or not math.isfinite(lo):
            raise ValueError(f"a score of {c} is not finite")
        norm = F.lit(1.0) if hi - lo <= 1e-12 else (F.col("score") - lo) / (hi - lo)
        part = live[c].select("keyframe_uid", (F.lit(w / total) * norm).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return next(iter(channels.values())).select("keyframe_uid", F.lit(0.0).alias("fused")).limit(0)
    return minmax_all(rows.groupBy("keyframe_uid").agg(F.sum("part").alias("raw")), "raw", "fused").select("keyframe_uid", "fused")


def default_weights(names: tuple[str, ...]) -> dict[str, float]:
    return dict(zip(names, WEIGHTS[names], strict=True))


def merge_anchors(evidence: DataFrame, anchors: DataFrame, bonus: float = 0.15, per_shot: int = 3, most: int = 100) -> DataFrame:
    """Raise frames by supporting anchors (same frame, else same shot), never lower them; add new anchors.

    At most ``per_shot`` rows a shot and ``most`` in all, best first.
    """
    own = anchors.groupBy("keyframe_uid").agg(F.max("score").alias("own"))
    shots = anchors.groupBy("video_id", "shot_id").agg(F.max("score").alias("near"))
    e = evidence.join(own, "keyframe_uid", "left").join(shots, ["video_id", "shot_id"], "left")
    support = F.coalesce("own", "near", F.lit(0.0))
    e = e.select("video_id", "shot_id", "keyframe_uid", F.greatest("score", F.least(F.lit(1.0), F.col("score") + bonus * support)).alias("score"))
    new = anchors.join(evidence.select("keyframe_uid"), "keyframe_uid", "left_anti").groupBy("video_id", "shot_id", "keyframe_uid").agg(F.max("score").alias("score"))
    d = e.unionByName(new)
    w = Window.partitionBy("video_id", "shot_id").orderBy(F.col("score").desc(), "keyframe_uid")
    d = d.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_shot).drop("n")
    return d.orderBy(F.col("score").desc(), "keyframe_uid").limit(most)


def valid_verdicts(payloads: DataFrame, allowed: DataFrame) -> DataFrame:
    """Verifier payloads made safe: known frames only, each once and in order; scores on [0, 1]; no blank scenes.

    ``payloads`` has video_id, must_score and should_score (text), ranked_frame_ids and scene_matches
    (text arrays); ``allowed`` video_id and frame_id. Values that are no numbers count 0 or are left out.
    """
    own = allowed.groupBy("video_id").agg(F.collect_set(F.col("frame_id").cast("long")).alias("own"))  # the frames shown to the verifier
    ids = F.transform(F.coalesce("ranked_frame_ids", F.array().cast("array<string>")), lambda x: x.try_cast("long"))
    on_scale = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))))
    scenes = F.filter(F.transform(F.coalesce("scene_matches", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    ranked = F.array_distinct(F.filter(ids, lambda x: F.array_contains(F.coalesce("own", F.array().cast("array<bigint>")), x)))
    return payloads.join(own, "video_id", "left").select("video_id", on_scale("must_score").alias("must_score"), on_scale("should_score").alias("should_score"), ranked.alias("ranked_frame_ids"), scenes.alias("scene_matches"))


def rerank_frames(frames: DataFrame, verdicts: DataFrame, base: float = 0.7, share: float = 0.3) -> DataFrame:
    """Frames that a verdict lists get 0.7 of their score and 0.3 of their place in the list, 1 for the first to 0 for the last; others keep theirs."""
    listed = verdicts.select("video_id", F.size("ranked_frame_ids").alias("n"), F.posexplode("ranked_frame_ids").alias("place", "frame_id"))
    place = 1 - F.col("place") / F.greatest(F.lit(1), F.col("n") - 1)
    d = frames.join(listed, ["video_id", "frame_id"], "left").withColumn("vlm_score", place)
    return d.withColumn("score", F.when(F.col("vlm_score").isNull(), F.col("score")).otherwise(base * F.col("score") + share * F.col("vlm_score"))).drop("place", "n")


def verified(hypotheses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Video scores with verdicts: 0.7 of the base score, 0.2 of the musts and 0.1 of the wishes; without a verdict a video keeps its own."""
    d = hypotheses.join(verdicts.select("video_id", "must_score", "should_score"), "video_id", "left")
    base = F.coalesce(F.nullif(F.col("base_video_score"), F.lit(0.0)), F.col("video_score"))
    return d.withColumn("video_score", F.when(F.col("must_score").isNull(), F.col("video_score")).otherwise(0.7 * base + 0.2 * F.col("must_score") + 0.1 * F.col("should_score"))).drop("must_score", "should_score")


def rerank(hypotheses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Blend verifier verdicts (video_id, vlm_score, position, n) into video scores.

    0.7 of the base score, 0.2 of the verdict and 0.1 of its rank score; a video without a verdict keeps its own.
    """
    base = F.coalesce(F.nullif(F.col("base_video_score"), F.lit(0.0)), F.col("video_score"))
    rank_score = 1 - F.col("position") / F.greatest(F.lit(1), F.col("n") - 1)
    d = hypotheses.join(verdicts, "video_id", "left")
    value = F.when(F.col("vlm_score").isNull(), F.col("video_score")).otherwise(0.7 * base + 0.2 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("vlm_score"))) + 0.1 * rank_score)
    return d.select("video_id", value.alias("video_score"))
