"""Region routing, calibration, residuals, overlays and coverage over order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import SQL_REGIONS, regions, table
from ..operators import coverage, residuals, routing
from ..workspace import staged
from . import query

KEY = ["keyframe_uid", "region_id"]

#: One row a frame and line: lines that share both are folded to the least values.
SQL_BASE = f"""{SQL_REGIONS},
base AS (SELECT keyframe_uid, region_id, any_value(video_id) AS video_id, any_value(shot_id) AS shot_id, min(easyocr_text) AS easyocr_text, min(easyocr_confidence) AS easyocr_confidence, bool_and(has_vi_marks) AS has_vi_marks, bool_and(has_ascii_word) AS has_ascii_word,
  min(vintern_text) AS vintern_text, min(truth) AS truth, min(x) AS x, min(y) AS y, min(size) AS size FROM regions GROUP BY ALL),
routed0 AS (SELECT *, list_filter([CASE WHEN trim(easyocr_text) = '' THEN 'empty_text' END, CASE WHEN trim(easyocr_text) <> '' AND easyocr_confidence < 0.4 THEN 'confidence_lt_0_40' END,
  CASE WHEN trim(easyocr_text) <> '' AND easyocr_confidence >= 0.4 AND easyocr_confidence < 0.6 AND has_vi_marks AND has_ascii_word THEN 'region_mixed_0_40_to_0_60' END,
  CASE WHEN trim(easyocr_text) <> '' AND easyocr_confidence >= 0.4 AND easyocr_confidence < 0.6 AND contains(easyocr_text, '?') THEN 'ambiguous_glyph_0_40_to_0_60' END], lambda z: z IS NOT NULL) AS reasons FROM base),
rt AS (SELECT *, len(reasons) > 0 AS routed, len(reasons) > 0 AND size < 49.5 AS has_result,
  list_filter([CASE WHEN trim(vintern_text) = '' THEN 'empty_output' END, CASE WHEN contains(lower(vintern_text), 'the text is blurry') THEN 'prompt_or_explanation_leak' END], lambda z: z IS NOT NULL) AS rejection FROM routed0)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)
    agg = [F.any_value("video_id").alias("video_id"), F.any_value("shot_id").alias("shot_id")]
    agg += [F.min(c).alias(c) for c in ("easyocr_text", "easyocr_confidence", "vintern_text", "truth", "x", "y", "size")]
    agg += [F.bool_and(c).alias(c) for c in ("has_vi_marks", "has_ascii_word")]
    return r.groupBy(*KEY).agg(*agg)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    reasons = routing.region_reasons(F.col("easyocr_text"), F.col("easyocr_confidence"), F.col("has_vi_marks"), F.col("has_ascii_word"))
    b = b.withColumn("reasons", reasons).withColumn("routed", F.size("reasons") > 0)
    return b.withColumn("has_result", F.col("routed") & (F.col("size") < 49.5)).withColumn("rejection", routing.output_reasons(F.col("easyocr_text"), F.col("vintern_text")))


@query(f"WITH {SQL_BASE} SELECT keyframe_uid, region_id, array_to_string(reasons, '|') AS reasons FROM rt")
def region_router_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select(*KEY, F.array_join("reasons", "|").alias("reasons"))


@query(f"WITH {SQL_BASE} SELECT keyframe_uid, region_id, array_to_string(rejection, '|') AS rejection FROM rt")
def output_guard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select(*KEY, F.array_join("rejection", "|").alias("rejection"))


@query(f"WITH {SQL_BASE}, e AS (SELECT unnest(reasons) AS reason FROM rt) SELECT reason, count(*) AS regions FROM e GROUP BY reason")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals.reason_histogram(routed(spark, sf_dir))


@query(f"WITH {SQL_BASE} SELECT count(*) AS regions, sum(routed::INT)::BIGINT AS candidates, round(sum(routed::INT) / count(*), 6) AS fraction, CASE WHEN sum(routed::INT) / count(*) <= 0.4 THEN 'PASS' ELSE 'FAIL' END AS status FROM rt")
def router_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.fan_out(routed(spark, sf_dir)).withColumn("fraction", F.round("fraction", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity IS NOT NULL AND l_discount >= 0.05 AND l_tax >= 0.02 AND l_quantity >= 10 AND l_linenumber <= 4 AS safe FROM lineitem")
def reuse_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    safe = routing.reuse_is_safe(F.col("l_orderkey"), F.col("l_discount") / 0.05 * 0.98, F.when(F.col("l_tax") >= 0.02, 1.0).otherwise(0.0), F.when(F.col("l_quantity") >= 10, 0.99).otherwise(0.5), F.col("l_linenumber") - 2)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", safe.alias("safe"))


SIGNALS = """sig AS (SELECT *, length(regexp_replace(vintern_text, '\\s', '', 'g')) AS olen, greatest(96, length(regexp_replace(easyocr_text, '\\s', '', 'g')) * 8 + 48) AS lim FROM rt),
lab AS (SELECT *, CASE WHEN olen <= 4 THEN 'len_neg_inf_to_4' WHEN olen <= 12 THEN 'len_4_to_12' WHEN olen <= 32 THEN 'len_12_to_32' ELSE 'len_gt_32' END AS lb,
  CASE WHEN (lim - olen) / lim <= 0.5 THEN 'margin_neg_inf_to_0.5' WHEN (lim - olen) / lim <= 0.8 THEN 'margin_0.5_to_0.8' WHEN (lim - olen) / lim <= 0.95 THEN 'margin_0.8_to_0.95' ELSE 'margin_gt_0.95' END AS mb FROM sig),
bk AS (SELECT *, ['fine:' || lb || '|' || mb || '|logprob_unavailable', 'structural:' || lb || '|' || mb, 'global'] AS buckets, lower(vintern_text) = lower(truth) AS correct FROM lab),
cal AS (SELECT bucket, count(*) AS support, sum(correct::INT)::BIGINT AS correct FROM (SELECT unnest(buckets) AS bucket, correct FROM bk WHERE keyframe_uid % 5 = 0) GROUP BY bucket),
dec0 AS (SELECT bk.*, f.support AS fs, f.correct / f.support AS fa, s.support AS ss, s.correct / s.support AS sa FROM bk LEFT JOIN cal f ON f.bucket = buckets[1] AND f.support >= 20 LEFT JOIN cal s ON s.bucket = buckets[2] AND s.support >= 20),
dec1 AS (SELECT *, CASE WHEN fs IS NOT NULL THEN buckets[1] WHEN ss IS NOT NULL THEN buckets[2] END AS bucket, coalesce(fs, ss) AS bucket_support, coalesce(fa, sa) AS calibrated FROM dec0),
dec2 AS (SELECT *, CASE WHEN NOT routed THEN 'not_routed' WHEN NOT has_result THEN 'missing_result' WHEN len(rejection) > 0 THEN 'output_guard_rejected' WHEN calibrated IS NULL THEN 'insufficient_bucket_support' WHEN calibrated > easyocr_confidence THEN 'calibrated_confidence_strictly_greater' ELSE 'calibrated_confidence_not_greater' END AS decision FROM dec1),
fin AS (SELECT *, decision = 'calibrated_confidence_strictly_greater' AS won, routed AND decision <> 'calibrated_confidence_strictly_greater' AS residual FROM dec2)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written down: the table and the rows that are looked up in it both come from here."""
    return staged(_unstaged(spark, sf_dir), "examples")


def _unstaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).withColumn("buckets", routing.buckets(F.col("easyocr_text"), F.col("vintern_text"))).withColumn("correct", F.lower("vintern_text") == F.lower("truth"))


def _table(examples: DataFrame) -> DataFrame:
    return routing.fit_calibration(examples.filter("keyframe_uid % 5 = 0"))


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir)
    return routing.overrides(routing.calibrated(e, _table(e)))


@query(f"WITH {SQL_BASE}, {SIGNALS} SELECT bucket, support, correct, round(correct / support, 6) AS accuracy FROM cal")
def calibration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(_unstaged(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {SQL_BASE}, {SIGNALS} SELECT keyframe_uid, region_id, bucket, bucket_support, round(calibrated, 6) AS calibrated FROM dec1")
def calibration_backoff_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir)
    c = routing.calibrated(e, _table(e))
    return c.select(*KEY, "bucket", "bucket_support", F.round("calibrated", 6).alias("calibrated"))


@query(f"WITH {SQL_BASE}, {SIGNALS} SELECT keyframe_uid, region_id, decision, CASE WHEN won THEN trim(vintern_text) ELSE trim(easyocr_text) END AS final_text, round(CASE WHEN won THEN calibrated ELSE easyocr_confidence END, 6) AS final_confidence, CASE WHEN won THEN 'vintern' ELSE 'easyocr' END AS final_engine, residual FROM fin")
def override_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir).select(*KEY, "decision", "final_text", F.round("final_confidence", 6).alias("final_confidence"), "final_engine", "residual")


@query(f"WITH {SQL_BASE}, {SIGNALS} SELECT keyframe_uid, region_id FROM fin WHERE keyframe_uid % 97 = 0 OR (keyframe_uid % 89 = 0 AND won)")
def override_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit finds the rows that were tampered with, and no other: another engine, or another confidence."""
    f, k = _final(spark, sf_dir), F.col("keyframe_uid")
    f = f.withColumn("final_confidence", F.when(k % 89 == 0, F.col("final_confidence") + 0.5).otherwise(F.col("final_confidence")))
    other = F.when(F.col("final_engine") == "vintern", "easyocr").otherwise("vintern")
    return routing.override_violations(f.withColumn("final_engine", F.when(k % 97 == 0, other).otherwise(F.col("final_engine")))).select(*KEY)


@query(f"WITH {SQL_BASE}, {SIGNALS} SELECT keyframe_uid, region_id, CASE WHEN trim(easyocr_text) = '' THEN 'no_text_control' WHEN NOT routed THEN 'easyocr_pass' WHEN NOT has_result THEN NULL WHEN residual THEN 'gemini_residual' ELSE 'vintern_pass' END AS route, CASE WHEN trim(easyocr_text) = '' THEN 'empty_text' WHEN easyocr_confidence < 0.3 THEN 'confidence_lt_0_30' WHEN easyocr_confidence < 0.4 THEN 'confidence_0_30_to_0_40' WHEN list_contains(reasons, 'region_mixed_0_40_to_0_60') THEN 'mixed_0_40_to_0_60' ELSE 'glyph_or_noise_0_40_to_0_60' END AS stratum FROM fin")
def review_route_and_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = routing.review_route(F.col("easyocr_text"), F.col("routed"), F.col("has_result"), F.col("residual"))
    return _final(spark, sf_dir).select(*KEY, route.alias("route"), routing.stratum(F.col("easyocr_text"), F.col("easyocr_confidence"), F.col("reasons")).alias("stratum"))


REQUESTS = "req AS (SELECT video_id, shot_id, count(*) AS regions, count(DISTINCT keyframe_uid) AS frames, ceil(count(*) / 18.0)::BIGINT AS n_pages FROM fin WHERE residual GROUP BY ALL)"


@query(f"WITH {SQL_BASE}, {SIGNALS}, {REQUESTS} SELECT substr(sha256(video_id::VARCHAR || '|' || shot_id), 1, 24) AS request_id, video_id, shot_id, regions, n_pages FROM req")
def residual_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residuals.requests(_final(spark, sf_dir).filter("residual"))
    return r.select("request_id", "video_id", "shot_id", F.col("regions").cast("long").alias("regions"), F.col("n_pages").cast("long").alias("n_pages"))


@query(f"WITH {SQL_BASE}, {SIGNALS} SELECT keyframe_uid, region_id, 1::BIGINT AS want, CASE WHEN video_id % 7 = 0 THEN 0 ELSE 2 END::BIGINT AS have FROM fin WHERE residual AND (video_id % 7 = 0 OR video_id % 7 = 1)")
def residual_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that were lost or sent twice leave regions that are not held just once; all others part exactly."""
    r = staged(_final(spark, sf_dir).filter("residual"), "residuals")
    q = residuals.requests(r).filter("video_id % 7 != 0")
    return residuals.partition_violations(r, q.unionByName(q.filter("video_id % 7 = 1"))).select(*KEY, F.col("want").cast("long").alias("want"), F.col("have").cast("long").alias("have"))


_VND = "ceil(((n_sheets * 256 + requests * 160 + regions * 8) / 1000000.0::DOUBLE * {a}::DOUBLE + (requests * 20 + regions * 48) / 1000000.0::DOUBLE * {b}::DOUBLE) * 1.15::DOUBLE * 26300)::BIGINT"


@query(f"WITH {SQL_BASE}, {SIGNALS}, {REQUESTS}, a AS (SELECT sum(regions)::BIGINT AS regions, sum(frames)::BIGINT AS frames, count(*) AS requests, sum(n_pages)::BIGINT AS n_sheets FROM req) SELECT regions, frames, requests, n_sheets AS sheets, {_VND.format(a='0.1', b='0.4')} AS standard_vnd, {_VND.format(a='0.05', b='0.2')} AS batch_vnd, {_VND.format(a='0.1', b='0.4')} <= 400000 AS within_budget FROM a")
def preflight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = residuals.preflight(_final(spark, sf_dir).filter("residual"))
    return p.withColumn("sheets", F.col("sheets").cast("long"))


CAND = "cd AS (SELECT video_id, shot_id, keyframe_uid, round(max(size) + least(20, count(*) * 2) + max(x) * 10 + least(15.0, 0.003 / greatest(min(y), 1e-9)), 6) AS priority FROM base GROUP BY ALL)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = base(spark, sf_dir).groupBy("video_id", "shot_id", "keyframe_uid").agg(F.max("size").alias("v"), F.count(F.lit(1)).alias("n"), F.max("x").alias("p"), F.min("y").alias("a"))
    return g.select("video_id", "shot_id", "keyframe_uid", residuals.priority(F.col("v") / 100, F.col("n"), F.col("p"), F.col("a")).alias("priority"))


@query(f"""WITH {SQL_BASE}, {CAND}, sh AS (SELECT video_id, shot_id, max(priority) AS top, count(*) AS n FROM cd GROUP BY ALL), so AS (SELECT *, row_number() OVER w AS ord, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) - n AS bef FROM sh WINDOW w AS (ORDER BY top DESC, video_id, shot_id)),
k AS (SELECT cd.*, ord, bef, row_number() OVER (PARTITION BY cd.video_id, cd.shot_id ORDER BY priority DESC, keyframe_uid) AS k FROM cd JOIN so USING (video_id, shot_id)) SELECT keyframe_uid, priority, CASE WHEN ord <= 200 AND bef + k <= 500 THEN 'paid' ELSE 'overflow' END AS route FROM k""")
def budget_group_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals.select_within_budget(_candidates(spark, sf_dir), 200, 500).select("keyframe_uid", "priority", "route")


@query("""WITH u AS (SELECT c_mktsegment AS model_id, c_custkey AS seq, c_custkey % 9 AS frames, 200 + c_custkey % 50 AS p, 60::BIGINT AS o FROM customer), t AS (SELECT *, sum(frames) OVER w AS tf, sum(p) OVER w AS tp, sum(o) OVER w AS tot FROM u WINDOW w AS (PARTITION BY model_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT model_id, seq, tf::BIGINT AS total_frames, round((tp * 0.125::DOUBLE + tot * 0.75::DOUBLE) / 1e6 * 26300 * 1.15::DOUBLE, 2) AS total_vnd, tf <= 1000 AND (tp * 0.125::DOUBLE + tot * 0.75::DOUBLE) / 1e6 * 26300 * 1.15::DOUBLE <= 500 AS allowed FROM t""")
def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    u = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model_id"), k.alias("seq"), (k % 9).alias("frames"), (200 + k % 50).alias("prompt_tokens"), F.lit(60).cast("long").alias("output_tokens"))
    return residuals.ledger(u, 1000, 500.0).select("model_id", "seq", "total_frames", F.round("total_vnd", 2).alias("total_vnd"), "allowed")


OVERLAY = """bx AS (SELECT keyframe_uid, region_id, keyframe_uid % 20 AS video_id, easyocr_text AS text, least(1.0, x) AS l, least(1.0, x + 0.1) AS r, least(1.0, y / 2) AS t, least(1.0, y / 2 + 0.05) AS b FROM base),
gm AS (SELECT *, (l + r) / 2 AS cx, (t + b) / 2 AS cy, r - l AS w, b - t AS h, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS nrm FROM bx),
og AS (SELECT *, CASE WHEN nrm <> '' AND NOT (t >= 0.62 AND w >= 0.18) AND cx >= 0.75 AND cy <= 0.3 AND w <= 0.25 AND h <= 0.2 AND length(nrm) <= 16 THEN 'top_corner:' || floor((cx + 1e-12) / 0.05::DOUBLE)::BIGINT || ':' || floor((cy + 1e-12) / 0.05::DOUBLE)::BIGINT || ':' || floor((w + 1e-12) / 0.05::DOUBLE)::BIGINT || ':' || floor((h + 1e-12) / 0.05::DOUBLE)::BIGINT
  WHEN nrm <> '' AND NOT (t >= 0.62 AND w >= 0.18) AND length(nrm) <= 3 AND w * h <= 0.015 THEN 'tiny' END AS group_id FROM gm),
vf AS (SELECT video_id, count(DISTINCT keyframe_uid) AS video_frames FROM bx GROUP BY video_id),
oq AS (SELECT video_id, group_id, count(DISTINCT keyframe_uid) AS frames, greatest(5, ceil(any_value(video_frames) * 0.005::DOUBLE)::BIGINT) AS required FROM og JOIN vf USING (video_id) WHERE group_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT keyframe_uid) >= greatest(5, ceil(any_value(video_frames) * 0.005::DOUBLE)::BIGINT))"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1.0)
    b = base(spark, sf_dir).withColumn("l", F.least(one, "x")).withColumn("r", F.least(one, F.col("x") + 0.1)).withColumn("t", F.least(one, F.col("y") / 2)).withColumn("b", F.least(one, F.col("y") / 2 + 0.05))
    b = b.withColumn("box", residuals.box(F.array("l", "t", "r", "t", "r", "b", "l", "b")))
    b = b.withColumn("g", residuals.overlay_group(F.col("box"), F.col("easyocr_text")))
    return b.select(*KEY, (F.col("keyframe_uid") % 20).alias("video_id"), F.col("easyocr_text").alias("text"), "g.group_id", "g.reason")


@query(f"WITH {SQL_BASE}, {OVERLAY}, tc AS (SELECT video_id, group_id, text, count(*) AS n FROM og WHERE group_id IS NOT NULL GROUP BY video_id, group_id, text), tx AS (SELECT *, row_number() OVER (PARTITION BY video_id, group_id ORDER BY n DESC, text) AS k FROM tc) SELECT video_id, group_id, frames, required, string_agg(text || '=' || n, '|' ORDER BY k) AS common FROM oq JOIN tx USING (video_id, group_id) WHERE k <= 8 GROUP BY video_id, group_id, frames, required")
def overlay_qualified_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    n = b.groupBy("video_id").agg(F.countDistinct("keyframe_uid").alias("video_frames"))
    return residuals.overlay_groups(b, n, 5, 0.005).select("video_id", "group_id", "frames", F.col("required").cast("long").alias("required"), "common")


@query(f"WITH {SQL_BASE}, {OVERLAY} SELECT keyframe_uid, region_id, oq.group_id IS NOT NULL AS suppress FROM og LEFT JOIN oq USING (video_id, group_id)")
def overlay_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    n = b.groupBy("video_id").agg(F.countDistinct("keyframe_uid").alias("video_frames"))
    return residuals.suppress_overlays(b, residuals.overlay_groups(b, n, 5, 0.005)).select(*KEY, "suppress")


@query(f"WITH {SQL_BASE} SELECT keyframe_uid, round(sum(greatest(0, least(1, easyocr_confidence)) * length(regexp_replace(easyocr_text, '\\s', '', 'g'))) / nullif(sum(length(regexp_replace(easyocr_text, '\\s', '', 'g'))), 0), 9) AS confidence, string_agg(easyocr_text, chr(10) ORDER BY region_id) AS detected_text FROM base GROUP BY keyframe_uid")
def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_id", "easyocr_text"))), lambda x: x["easyocr_text"]), "\n")
    return b.groupBy("keyframe_uid").agg(F.round(coverage.weighted_confidence(F.col("easyocr_confidence"), F.col("easyocr_text")), 9).alias("confidence"), text.alias("detected_text"))


@query("""WITH r AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'no_text' ELSE 'error' END AS s FROM lineitem), g AS (SELECT k, count(*) AS n, sum((s = 'success')::INT) AS a, sum((s = 'no_text')::INT) AS b, sum((s = 'error')::INT) AS c FROM r GROUP BY k), j AS (SELECT coalesce(n, 0) AS n, o_orderkey IS NOT NULL AS asked, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM g FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 9) o ON k = o_orderkey)
SELECT sum(asked::INT)::BIGINT AS expected, sum(n)::BIGINT AS records, sum(a)::BIGINT AS success, sum(b)::BIGINT AS no_text, sum(c)::BIGINT AS error, sum(greatest(n - 1, 0))::BIGINT AS duplicates, sum((asked AND n = 0)::INT)::BIGINT AS missing, sum((NOT asked)::INT)::BIGINT AS foreign_rows, 'FAIL' AS gate FROM j""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "N", "no_text").otherwise("error")
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("keyframe_uid"), status.alias("status"))
    e = table(spark, sf_dir, "orders").filter("o_orderkey % 10 != 9").select(F.col("o_orderkey").alias("keyframe_uid"))
    return coverage.summary(r, e).withColumnRenamed("foreign", "foreign_rows").drop("coverage", "error_rate")


_COVER = "sum(routed::INT)::BIGINT AS required, sum(has_result::INT)::BIGINT AS completed, sum((has_result AND len(rejection) = 0)::INT)::BIGINT AS accepted, sum((has_result AND len(rejection) > 0)::INT)::BIGINT AS residual, sum((routed AND NOT has_result)::INT)::BIGINT AS pending"
_STATE = "CASE WHEN required = 0 THEN 'not_required' WHEN completed = 0 THEN 'not_run' WHEN completed < required THEN 'partial' WHEN residual > 0 THEN 'complete_with_residual' ELSE 'complete' END AS state"


@query(f"WITH {SQL_BASE}, c AS (SELECT video_id, {_COVER} FROM rt GROUP BY video_id) SELECT *, {_STATE} FROM c")
def coverage_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.by_group(routed(spark, sf_dir), ["video_id"])


@query(f"WITH {SQL_BASE}, c AS (SELECT shot_id AS batch, {_COVER} FROM rt GROUP BY ROLLUP (shot_id)) SELECT *, {_STATE} FROM c")
def batch_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each batch, and of all as the row without a batch."""
    r = staged(routed(spark, sf_dir).select(F.col("shot_id").alias("batch"), "routed", "has_result", "rejection"), "routed")
    every = coverage.by_group(r.withColumn("batch", F.lit(None).cast("string")), ["batch"])
    return coverage.by_group(r, ["batch"]).unionByName(every)


GATE_A = """gr AS (SELECT l_orderkey AS k, 'cfg' || (l_linenumber % 3) AS config_id, bool_or(l_returnflag <> 'N') AS has_text, count(*) AS gt, sum((l_quantity < 2)::INT) AS missed, count(*) + l_linenumber % 3 AS rc, sum(l_tax) AS lat FROM lineitem GROUP BY l_orderkey, l_linenumber % 3),
gm AS (SELECT config_id, count(*) AS frames, sum(gt)::BIGINT AS truth, sum(missed)::BIGINT AS missed, sum(has_text::INT) AS tf, sum((has_text AND rc > 0)::INT) AS ff, sum((NOT has_text)::INT) AS ef, sum((NOT has_text AND rc > 0)::INT)::BIGINT AS fp, sum(rc) AS rc, sum(lat) AS lat FROM gr GROUP BY config_id)"""


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("keyframe_uid"), n.alias("n"))
    g = li.agg(F.bool_or(F.col("l_returnflag") != "N").alias("has_text"), F.count(F.lit(1)).alias("gt_regions"), F.sum((F.col("l_quantity") < 2).cast("long")).alias("missed"), F.sum("l_tax").alias("latency"))
    return g.withColumn("region_count", F.col("gt_regions") + F.col("n")).withColumn("config_id", F.concat(F.lit("cfg"), F.col("n").cast("string"))).drop("n")


@query(f"WITH {GATE_A} SELECT config_id, frames, round((truth - missed) / truth, 6) AS region_recall, round(ff / tf, 6) AS frame_recall, round(fp / ef, 6) AS fp_rate, round(rc / frames, 6) AS regions_per_frame, (truth - missed) / truth >= 0.95 AND ff / tf >= 0.99 AS eligible FROM gm")
def config_threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = coverage.config_metrics(_gate(spark, sf_dir), 0.95)
    return m.select("config_id", "frames", *[F.round(c, 6).alias(c) for c in ("region_recall", "frame_recall", "fp_rate", "regions_per_frame")], "eligible")


@query(f"WITH {GATE_A}, e AS (SELECT *, (truth - missed) / truth >= 0.95 AND ff / tf >= 0.99 AS ok FROM gm) SELECT coalesce((SELECT config_id FROM e WHERE ok ORDER BY rc / frames, fp, round(lat, 6), config_id LIMIT 1), 'cfg0') AS selected, CASE WHEN (SELECT bool_or(ok) FROM e) THEN 'PASS' ELSE 'KEEP_CURRENT' END AS decision")
def config_threshold_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.choose_config(coverage.config_metrics(_gate(spark, sf_dir), 0.95), "cfg0")


@query(f"WITH {GATE_A} SELECT count(*) AS gaps FROM (SELECT DISTINCT k FROM gr) a CROSS JOIN (SELECT DISTINCT config_id FROM gr) b WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.k = a.k AND gr.config_id = b.config_id)")
def config_grid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.grid_gaps(_gate(spark, sf_dir)).agg(F.count(F.lit(1)).alias("gaps"))


@query("WITH s AS (SELECT l_returnflag AS flag, list(l_quantity ORDER BY l_quantity) AS xs, quantile_cont(l_quantity, 0.9) AS linear FROM lineitem GROUP BY ALL) SELECT flag, xs[round_even((len(xs) - 1) * 0.9::DOUBLE, 0)::BIGINT + 1] AS nearest, round(linear, 6) AS linear FROM s")
def percentile_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    li = li.select(F.col("l_returnflag").alias("flag"), "l_quantity")
    linear = li.groupBy("flag").agg(F.round(F.percentile("l_quantity", 0.9), 6).alias("linear"))
    return coverage.nearest_percentile(li, ["flag"], "l_quantity", 0.9).join(linear, "flag")


@query("SELECT source, count(*) AS eligible, count(quality) AS labelled, coalesce(sum(quality), 0)::BIGINT AS correct, round(sum(quality) / nullif(count(quality), 0), 6) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def sliced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return coverage.sliced_accuracy(d.withColumn("label", F.col("quality")), ["source"]).withColumn("accuracy", F.round("accuracy", 6))


@query("WITH c AS (SELECT c_nationkey AS video_id, c_mktsegment AS criterion, bool_and(c_acctbal > -990) AS ok FROM customer GROUP BY ALL) SELECT video_id, bool_and(ok) AS ready, coalesce(string_agg(criterion, ',' ORDER BY criterion) FILTER (WHERE NOT ok), '') AS missing FROM c GROUP BY video_id")
def publishing_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("video_id"), F.col("c_mktsegment").alias("criterion")).agg(F.bool_and(F.col("c_acctbal") > -990).alias("ok"))
    return coverage.readiness(c).withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {SQL_BASE}, {SIGNALS}, g AS (SELECT shot_id AS batch, video_id, count(DISTINCT keyframe_uid) AS frames, count(*) AS regions, sum(won::INT) AS overrides, sum(residual::INT) AS residual, count(DISTINCT keyframe_uid) FILTER (WHERE residual) AS residual_frames, ceil(sum(residual::INT) / 18.0) AS requests FROM fin GROUP BY shot_id, video_id) SELECT batch, sum(frames)::BIGINT AS frames, sum(regions)::BIGINT AS regions, sum(overrides)::BIGINT AS overrides, sum(residual)::BIGINT AS residual, sum(residual_frames)::BIGINT AS residual_frames, sum(requests)::BIGINT AS requests FROM g GROUP BY ROLLUP (batch)")
def batch_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, regions, overrides and what is left for the paid reader, by batch and in all."""
    return coverage.batch_report(_final(spark, sf_dir).withColumn("batch", F.col("shot_id")), "batch")


@query("SELECT l_returnflag, l_linestatus, count(*) AS regions, count(DISTINCT l_orderkey) AS frames, round(avg(l_tax) FILTER (WHERE l_quantity > 5), 6) AS latency FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all lines, the mean latency over successful ones alone."""
    li = table(spark, sf_dir, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("regions"), F.countDistinct("l_orderkey").alias("frames"), F.round(F.avg(F.when(F.col("l_quantity") > 5, F.col("l_tax"))), 6).alias("latency"))


@query()
def approx_distinct_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("frames"))
