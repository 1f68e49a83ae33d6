"""Routing of recognised regions, guards on a second reader's output, and its calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

HARD, CEILING = 0.40, 0.60
NOISY_RATIO, NOISY_LENGTH = 0.34, 3
#: What a reader says when it explains instead of reading (fixed values).
LEAKS = (
    "i don't understand",
    "i do not understand",
    "this is a blurry image",
    "the image is blurry",
    "the text is blurry",
    "chữ bị che khuất",
    "chữ trong ảnh",
    "nội dung trong ảnh",
    "không thể đọc",
    "không đọc được",
    "từ đó tôi sẽ",
    "hãy chép lại",
    "chép lại nguyên văn",
)
LENGTH_BOUNDS = (4.0, 12.0, 32.0)
MARGIN_BOUNDS = (0.5, 0.8, 0.95)
LOGPROB_BOUNDS = (-1.0, -0.5, -0.1)
MIN_SUPPORT = 20


def _reasons(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests]))


def region_reasons(text: Column, confidence: Column, marks: Column, ascii_word: Column) -> Column:
    """Why a region goes to the second reader; an empty array if it does not. A null confidence is 0."""
    t = F.trim(F.coalesce(text, F.lit("")))
    c = F.coalesce(confidence, F.lit(0.0))
    some, middle = t != "", (c >= HARD) & (c < CEILING)
    noisy = (T.visible_length(t) >= NOISY_LENGTH) & (T.noise_ratio(t) >= NOISY_RATIO)
    return _reasons(
        (~some, "empty_text"),
        (some & (c < HARD), "confidence_lt_0_40"),
        (some & middle & marks & ascii_word, "region_mixed_0_40_to_0_60"),
        (some & middle & (F.contains(t, F.lit("?")) | F.contains(t, F.lit("�"))), "ambiguous_glyph_0_40_to_0_60"),
        (some & middle & noisy, "noisy_text_0_40_to_0_60"),
    )


def output_reasons(easy: Column, output: Column) -> Column:
    """Why a second reading is refused: empty, an explanation, far too long, or noise."""
    o = F.trim(F.coalesce(output, F.lit("")))
    norm = T.collapse(F.lower(o))
    leak = F.exists(F.array(*map(F.lit, LEAKS)), lambda m: F.contains(norm, m))
    some = o != ""
    return _reasons(
        (~some, "empty_output"),
        (some & leak, "prompt_or_explanation_leak"),
        (some & (T.visible_length(o) > length_limit(easy)), "gross_length_expansion"),
        (some & (T.noise_ratio(o) >= 0.5) & (T.visible_length(o) >= 4), "noisy_output"),
    )


def length_limit(easy: Column) -> Column:
    return F.greatest(F.lit(96), T.visible_length(F.coalesce(easy, F.lit(""))) * 8 + 48)


def interval_label(value: Column, bounds: tuple[float, ...], prefix: str) -> Column:
    """The interval that a value falls in, closed above."""
    out, lower = None, "neg_inf"
    for b in bounds:
        label = F.lit(f"{prefix}_{lower}_to_{b:g}")
        out = F.when(value <= b, label) if out is None else out.when(value <= b, label)
        lower = f"{b:g}"
    return out.otherwise(F.lit(f"{prefix}_gt_{lower}"))


def buckets(easy: Column, output: Column, logprob: Column | None = None) -> Column:
    """Buckets of a reading from fine over structural to global."""
    length, limit = T.visible_length(F.coalesce(output, F.lit(""))), length_limit(easy)
    a = interval_label(length.cast("double"), LENGTH_BOUNDS, "len")
    b = interval_label((limit - length) / limit, MARGIN_BOUNDS, "margin")
    c = F.lit("logprob_unavailable") if logprob is None else F.when(logprob.isNull(), "logprob_unavailable").otherwise(interval_label(logprob, LOGPROB_BOUNDS, "logprob"))
    return F.array(F.concat(F.lit("fine:"), a, F.lit("|"), b, F.lit("|"), c), F.concat(F.lit("structural:"), a, F.lit("|"), b), F.lit("global"))


def fit_calibration(examples: DataFrame) -> DataFrame:
    """Support, correct readings and accuracy of every bucket; ``examples`` has buckets and correct."""
    e = examples.select(F.explode("buckets").alias("bucket"), "correct")
    a = e.groupBy("bucket").agg(F.count(F.lit(1)).alias("support"), F.sum(F.col("correct").cast("long")).alias("correct"))
    return a.withColumn("accuracy", F.col("correct") / F.col("support"))


def calibrated(rows: DataFrame, table: DataFrame, min_support: int = MIN_SUPPORT, allow_global: bool = False) -> DataFrame:
    """The accuracy of the finest bucket with enough support; null if none has it.

    The table has a row per bucket, at most a few dozen (the product of the interval counts).
    """
    usable = table.filter((F.col("bucket") == "global") if allow_global else F.lit(False)).unionByName(table.filter((F.col("bucket") != "global") & (F.col("support") >= min_support)))
    listed = usable.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("support", "correct", "accuracy")))).alias("m"))
    d = rows.crossJoin(F.broadcast(listed))  # one row: the whole table
    chosen = F.try_element_at(F.filter("buckets", lambda b: F.map_contains_key("m", b)), F.lit(1))
    d = d.withColumn("bucket", chosen).withColumn("b", F.try_element_at("m", F.col("bucket")))
    return d.withColumn("bucket_support", F.col("b.support")).withColumn("calibrated", F.col("b.accuracy")).drop("m", "b")


def overrides(rows: DataFrame) -> DataFrame:
    """Which reading of each region stands, and why.

    ``rows`` has routed, has_result, rejection (array), calibrated, and both readings. The second
    reading stands only if it passes its guard and its calibrated confidence is strictly higher.
    """
    c = F.coalesce("easyocr_confidence", F.lit(0.0))
    reason = (
        F.when(~F.col("routed"), "not_routed")
        .when(~F.col("has_result"), "missing_result")
        .when(F.size("rejection") > 0, "output_guard_rejected")
        .when(F.col("calibrated").isNull(), "insufficient_bucket_support")
        .when(F.col("calibrated") > c, "calibrated_confidence_strictly_greater")
        .otherwise("calibrated_confidence_not_greater")
    )
    d = rows.withColumn("decision", reason)
    won = F.col("decision") == "calibrated_confidence_strictly_greater"
    return (
        d.withColumn("final_text", F.when(won, F.trim("vintern_text")).otherwise(F.trim("easyocr_text")))
        .withColumn("final_confidence", F.when(won, F.col("calibrated")).otherwise(c))
        .withColumn("final_engine", F.when(won, "vintern").otherwise("easyocr"))
        .withColumn("residual", F.col("routed") & ~won)
    )


def override_violations(rows: DataFrame) -> DataFrame:
    """Rows of ``overrides`` that break its rule: proved anew from the inputs, for an audit."""
    c = F.coalesce("easyocr_confidence", F.lit(0.0))
    should = F.col("routed") & F.col("has_result") & (F.size("rejection") == 0) & F.coalesce(F.col("calibrated") > c, F.lit(False))
    is_ = F.col("final_engine") == "vintern"
    return rows.filter((should != is_) | (F.col("residual") != (F.col("routed") & ~should)) | (is_ & (F.col("final_confidence") != F.col("calibrated"))))


def review_route(text: Column, routed: Column, has_result: Column, residual: Column) -> Column:
    """Where a region goes for review; null while its second reading is still missing."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "no_text_control").when(~routed, "easyocr_pass").when(~has_result, F.lit(None)).when(residual, "gemini_residual").otherwise("vintern_pass")


def stratum(text: Column, confidence: Column, reasons: Column) -> Column:
    """Five strata of routed regions for a review sample. A null confidence is 0."""
    c = F.coalesce(confidence, F.lit(0.0))
    mixed = F.array_contains(reasons, "region_mixed_0_40_to_0_60")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty_text").when(c < 0.30, "confidence_lt_0_30").when(c < HARD, "confidence_0_30_to_0_40").when(mixed, "mixed_0_40_to_0_60").otherwise("glyph_or_noise_0_40_to_0_60")


def label_join(labels: DataFrame, regions: DataFrame, results: DataFrame) -> DataFrame:
    """Ground truth beside regions and their second readings (candidate_id), with a verdict.

    ``labels`` has candidate_id, keyframe_uid and truth, ``regions`` candidate_id, keyframe_uid and
    easyocr_text, ``results`` candidate_id and vintern_text. The verdict is ``ok``, or names what
    is missing or whose frame is another; a guarded reading counts as wrong.
    """
    r = regions.select("candidate_id", F.col("keyframe_uid").alias("region_uid"), "easyocr_text")
    j = labels.join(r, "candidate_id", "left").join(results.select("candidate_id", "vintern_text", F.lit(True).alias("read")), "candidate_id", "left")
    verdict = F.when(F.col("region_uid").isNull(), "missing_region").when(F.col("read").isNull(), "missing_result").when(F.col("region_uid") != F.col("keyframe_uid"), "other_frame").otherwise("ok")
    right = (T.collapse(F.lower("vintern_text")) == T.collapse(F.lower("truth"))) & (F.size(output_reasons(F.col("easyocr_text"), F.col("vintern_text"))) == 0)
    return j.select("candidate_id", "keyframe_uid", verdict.alias("verdict"), F.when(verdict == "ok", F.coalesce(right, F.lit(False))).alias("correct"))


def reuse_is_safe(source: Column, cosine: Column, layout: Column, ssim: Column, phash: Column, least: float = 0.98, most: int = 2) -> Column:
    """All four likenesses must be known and pass."""
    return F.coalesce(source.isNotNull() & (cosine >= least) & (layout >= least) & (ssim >= least) & (phash <= most), F.lit(False))


def reuse_violations(rows: DataFrame) -> DataFrame:
    """Rows that reuse a source which is not there, has no text, or is of another video or shot."""
    s = rows.select(F.col("keyframe_uid").alias("s_uid"), F.col("video_id").alias("s_video"), F.col("shot_id").alias("s_shot"), F.col("status").alias("s_status"))
    j = rows.filter("reuse_source_uid is not null").join(s, F.col("reuse_source_uid") == F.col("s_uid"), "left")
    good = (F.col("s_status") == "text_detected") & (F.col("s_video") == F.col("video_id")) & (F.col("s_shot") == F.col("shot_id"))
    return j.filter(~F.coalesce(good, F.lit(False))).select(*rows.columns)
