"""Coverage, gates and accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_confidence(confidence: Column, text: Column) -> Column:
    """Aggregate: mean confidence weighted by visible characters, on [0, 1]; null without text.

    The sum is rounded to six places, so it does not depend on the order of its terms.
    """
    weight = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    return F.try_divide(F.round(F.sum(c * weight), 6), F.sum(weight))


def summary(records: DataFrame, expected: DataFrame, max_error: float = 0.02) -> DataFrame:
    """One row: expected, records, each status, duplicates, missing, foreign, coverage, error rate and the gate.

    ``records`` has keyframe_uid and status, ``expected`` keyframe_uid.
    """
    r = records.groupBy("keyframe_uid").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("success", "no_text", "error")])
    e = expected.select("keyframe_uid", F.lit(True).alias("asked")).distinct()
    j = r.join(e, "keyframe_uid", "full_outer").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("asked", F.lit(False)).alias("asked"), *[F.coalesce(s, F.lit(0)).alias(s) for s in ("success", "no_text", "error")])
    one = lambda c, n: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n)
    a = j.agg(one(F.col("asked"), "expected"), one(F.col("n"), "records"), one(F.col("success"), "success"), one(F.col("no_text"), "no_text"), one(F.col("error"), "error"), one(F.greatest(F.col("n") - 1, F.lit(0)), "duplicates"), one(F.col("asked") & (F.col("n") == 0), "missing"), one(~F.col("asked"), "foreign"))
    a = a.withColumn("coverage", F.try_divide(F.col("expected") - F.col("missing"), F.col("expected"))).withColumn("error_rate", F.try_divide("error", "records"))
    gate = (F.col("missing") == 0) & (F.col("foreign") == 0) & (F.col("duplicates") == 0) & (F.coalesce("error_rate", F.lit(0.0)) <= max_error)
    return a.withColumn("gate", F.when(gate, "PASS").otherwise("FAIL"))


def reading_state(required: Column, completed: Column, residual: Column) -> Column:
    return F.when(required == 0, "not_required").when(completed == 0, "not_run").when(completed < required, "partial").when(residual > 0, "complete_with_residual").otherwise("complete")


def by_group(regions: DataFrame, by: list[str]) -> DataFrame:
    """Second readings required, done, accepted, left over and pending, and the state, by video or batch."""
    n = lambda c: F.sum(c.cast("long"))
    done = F.col("routed") & F.col("has_result")
    a = regions.groupBy(*by).agg(n(F.col("routed")).alias("required"), n(done).alias("completed"), n(done & (F.size("rejection") == 0)).alias("accepted"), n(done & (F.size("rejection") > 0)).alias("residual"))
    if "final_engine" in regions.columns:
        e = regions.groupBy(*by, F.coalesce("final_engine", F.lit("none")).alias("e")).agg(F.count(F.lit(1)).alias("c"))
        e = e.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "c")))).alias("engines"))
        a = a.join(e, by)
    return a.withColumn("pending", F.col("required") - F.col("completed")).withColumn("state", reading_state(F.col("required"), F.col("completed"), F.col("residual")))


def batch_report(regions: DataFrame, by: str) -> DataFrame:
    """Frames, regions, overrides, what is left and the requests for it, by batch and over all (a row without a batch).

    ``regions`` has final_engine, residual, and the shot's requests of 18 regions are counted. One
    pass: a grouping by batch and shot gives the pages, and a rollup of it the rest.
    """
    r = regions.groupBy(by, "video_id", "shot_id").agg(F.collect_set("keyframe_uid").alias("f"), F.count(F.lit(1)).alias("regions"), F.count_if(F.col("final_engine") == "vintern").alias("overrides"), F.count_if(F.col("residual")).alias("residual"), F.collect_set(F.when(F.col("residual"), F.col("keyframe_uid"))).alias("g"))
    r = r.select(by, F.size("f").alias("frames"), "regions", "overrides", "residual", F.size("g").alias("residual_frames"), F.ceil(F.col("residual") / 18).alias("requests"))
    return r.rollup(by).agg(*[F.sum(c).cast("long").alias(c) for c in ("frames", "regions", "overrides", "residual", "residual_frames", "requests")])


def config_metrics(results: DataFrame, min_recall: float = 0.98, min_frame_recall: float = 0.99) -> DataFrame:
    """Recall, false positives and speed of each detector setting, and whether it may be chosen.

    ``results`` has config_id, has_text, gt_regions, missed, region_count and latency per frame
    and setting. A rate without a denominator is null.
    """
    n = lambda c: F.sum(c.cast("long"))
    a = results.groupBy("config_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("gt_regions").alias("truth"), F.sum("missed").alias("missed"), n(F.col("has_text")).alias("text_frames"), n(F.col("has_text") & (F.col("region_count") > 0)).alias("found_frames"), n(~F.col("has_text")).alias("empty_frames"), n(~F.col("has_text") & (F.col("region_count") > 0)).alias("fp_frames"), F.sum("region_count").alias("regions"), F.sum("latency").alias("latency"))
    a = a.withColumn("region_recall", F.try_divide(F.col("truth") - F.col("missed"), F.col("truth"))).withColumn("frame_recall", F.try_divide("found_frames", "text_frames")).withColumn("fp_rate", F.try_divide("fp_frames", "empty_frames")).withColumn("regions_per_frame", F.col("regions") / F.col("frames"))
    ok = (F.col("region_recall") >= min_recall) & (F.col("frame_recall") >= min_frame_recall)
    return a.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def choose_config(metrics: DataFrame, fallback: str) -> DataFrame:
    """The lightest eligible setting: fewest regions a frame, false positives, seconds, then name; else ``fallback``."""
    key = F.when(F.col("eligible"), F.struct("regions_per_frame", "fp_frames", "latency", "config_id"))
    best = F.min(key)["config_id"]
    return metrics.agg(F.coalesce(best, F.lit(fallback)).alias("selected"), F.when(best.isNull(), "KEEP_CURRENT").otherwise("PASS").alias("decision"))


def grid_gaps(results: DataFrame) -> DataFrame:
    """Frames and settings that have no result: the grid must be full."""
    configs = results.select("config_id").distinct()
    return results.select("keyframe_uid").distinct().crossJoin(configs).join(results.select("keyframe_uid", "config_id"), ["keyframe_uid", "config_id"], "left_anti")


def nearest_percentile(rows: DataFrame, by: list[str], column: str, f: float) -> DataFrame:
    """``nearest`` of each group: the value at the half-even rounded place (n - 1) f of its sorted values.

    Values are counted first, so the window runs over distinct values and not over rows. Nulls
    are left out.
    """
    c = rows.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("nearest")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    c = c.withColumn("upto", F.sum("c").over(w.orderBy("nearest"))).withColumn("place", F.bround((F.sum("c").over(w) - 1) * F.lit(f)))
    return c.filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place"))).select(*by, "nearest")


def sliced_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """Eligible, labelled and correct rows and their accuracy (null without labels); ``label`` is a word for true or false."""
    word = F.lower(F.trim(F.col("label").cast("string")))
    mark = F.when(word.isin("1", "true", "yes", "y", "correct"), True).when(word.isin("0", "false", "no", "n", "wrong"), False)
    a = rows.withColumn("mark", mark).groupBy(*by).agg(F.count(F.lit(1)).alias("eligible"), F.count("mark").alias("labelled"), F.sum(F.coalesce("mark", F.lit(False)).cast("long")).alias("correct"))
    return a.withColumn("accuracy", F.try_divide("correct", "labelled"))


def line_recall(text: Column, expected: Column) -> Column:
    """Share of the expected lines that a text contains; null without lines."""
    hits = F.filter(expected, lambda x: F.contains(text, x))
    return F.when(F.size(expected) > 0, F.size(hits) / F.size(expected))


def readiness(criteria: DataFrame) -> DataFrame:
    """A video is ready if every criterion holds; null counts as no."""
    return criteria.groupBy("video_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ready"), F.array_sort(F.collect_set(F.when(~F.coalesce("ok", F.lit(False)), F.col("criterion")))).alias("missing"))


def fan_out(regions: DataFrame, most: float = 0.40) -> DataFrame:
    a = regions.agg(F.count(F.lit(1)).alias("regions"), F.sum(F.col("routed").cast("long")).alias("candidates"))
    a = a.withColumn("fraction", F.try_divide("candidates", "regions"))
    return a.withColumn("status", F.when(F.col("fraction") <= most, "PASS").otherwise("FAIL"))
