"""Checks that rows must pass: each returns the violations, with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Answers that are no answers (fixed values).
PLACEHOLDERS = ("uncertain", "unknown", "n/a", "none")


def _named(*tests) -> object:
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))


def submission_violations(rows: DataFrame, catalog: DataFrame, event_count: int = 0) -> DataFrame:
    """Reasons against rows of a submission (query_name, task, video_id, frame_ids, answer, requires_review).

    Frames must be in the catalog (video_id, frame_id, pts_time); answers must have 1 to 100
    characters, be no placeholder and need no review; sequences must have ``event_count`` frames
    in strictly rising time; a query has 1 to 100 rows, all different. Rows without a reason are
    not returned.
    """
    keys = rows.select("video_id", "frame_ids").distinct()
    f = keys.select("video_id", "frame_ids", F.posexplode("frame_ids").alias("p", "frame_id")).join(catalog.select("video_id", "frame_id", "pts_time"), ["video_id", "frame_id"], "left")
    t = f.groupBy("video_id", "frame_ids").agg(F.count_if(F.col("pts_time").isNull()).alias("unknown"), F.transform(F.array_sort(F.collect_list(F.struct("p", "pts_time"))), lambda x: x["pts_time"]).alias("times"))
    t = t.withColumnsRenamed({"video_id": "v_", "frame_ids": "f_"})
    rising = F.forall(F.sequence(F.lit(2), F.greatest(F.size("times"), F.lit(2))), lambda i: (F.size("times") < 2) | (F.element_at("times", i) > F.element_at("times", i - 1)))
    # Rows of one key are alike in all that is told of them, so it does not matter which is the copy.
    same = Window.partitionBy("query_name", "video_id", "frame_ids", "answer").orderBy("query_name")
    d = rows.join(t, rows["video_id"].eqNullSafe(t["v_"]) & rows["frame_ids"].eqNullSafe(t["f_"]), "left").withColumn("copy", F.row_number().over(same)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("query_name")))
    qa, seq = F.col("task") == "QA", F.col("task") == "TRAKE"
    answer = F.trim(F.coalesce("answer", F.lit("")))
    reasons = _named(
        (F.coalesce(F.col("unknown"), F.lit(0)) > 0, "unknown_frame"),
        (~F.col("video_id").cast("string").rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$"), "unsafe_video_id"),
        (qa & ((answer == "") | (F.length("answer") > 100)), "answer_length"),
        (qa & F.lower(answer).isin(*PLACEHOLDERS), "placeholder_answer"),
        (qa & F.coalesce("requires_review", F.lit(False)), "needs_review"),
        (seq & (F.size("frame_ids") != event_count), "event_count"),
        (seq & (F.col("unknown") == 0) & ~rising, "not_rising"),
        (F.col("copy") > 1, "duplicate"),
        (F.col("size") > 100, "too_many"),
    )
    return d.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(*rows.columns, "reasons")


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def foreign_violations(rows: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return rows.join(parent.select(key).distinct(), key, "left_anti")


def attempt_violations(attempts: DataFrame) -> DataFrame:
    """Frames whose reading attempts break the state machine.

    ``attempts``: keyframe_uid, seq, engine (easyocr, vintern, gemini), outcome (success,
    no_text, rejected, error) and error_code. An error has a code and nothing else has one; an engine
    is tried only after the one before it was rejected or failed; nothing follows a success.
    """
    w = Window.partitionBy("keyframe_uid").orderBy("seq")
    rank = lambda c: F.when(F.col(c) == "easyocr", 0).when(F.col(c) == "vintern", 1).when(F.col(c) == "gemini", 2)
    d = attempts.withColumn("before", F.lag("outcome").over(w)).withColumn("prior", F.lag("engine").over(w))
    reasons = _named(
        ((F.col("outcome") == "error") != F.col("error_code").isNotNull(), "error_code"),
        (F.col("before").isin("success", "no_text"), "after_terminal"),
        (F.col("prior").isNull() & (F.col("engine") != "easyocr"), "first_engine"),
        (F.col("prior").isNotNull() & (rank("engine") - rank("prior") > 1), "skipped_engine"),
        (F.col("prior").isNotNull() & (rank("engine") < rank("prior")), "engine_order"),
    )
    return d.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(*attempts.columns, "reasons")


def shard_gate(shards: DataFrame, max_error: float = 0.02) -> DataFrame:
    """Shards whose counts do not add up, or that claim to be complete and are not."""
    reasons = _named(
        (F.col("success") + F.col("no_text") + F.col("error") != F.col("records"), "counts"),
        (F.col("complete") & (F.col("records") != F.col("expected")), "incomplete"),
        (F.col("complete") & (F.col("error") > F.col("records") * max_error), "errors"),
    )
    return shards.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def detector_violations(rows: DataFrame) -> DataFrame:
    """Detector rows whose status and measures do not fit: text has regions and areas, no text has none, an error has a code."""
    text, none, error = (F.col("status") == s for s in ("text_detected", "no_text", "error"))
    reasons = _named(
        (text & ~F.coalesce((F.col("region_count") > 0) & F.col("min_area").isNotNull(), F.lit(False)), "text_without_regions"),
        (none & ((F.col("region_count") != 0) | F.col("min_area").isNotNull()), "regions_without_text"),
        (error != F.col("error_code").isNotNull(), "error_code"),
        (~(text | none | error), "status"),
    )
    return rows.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
