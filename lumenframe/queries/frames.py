"""Timelines, keyframe quality, sets and validation over the events and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import SQL_FRAMES, frames, table
from ..functions import hashing
from ..operators import answers, quality, routing, setops, timeline, validation
from ..streaming import ingest
from . import query

#: Shots: each order's lines as a video with one shot per line of 10 to 59 frames, with gaps.
SQL_SHOTS = """shots AS (SELECT l_orderkey AS video_id, l_linenumber AS shot_id, l_linenumber * 100::BIGINT AS start_frame, l_linenumber * 100 + 9 + l_quantity::BIGINT + CASE WHEN l_returnflag = 'R' THEN 60 ELSE 0 END AS end_frame
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS dup FROM lineitem) WHERE dup = 1),
counts AS (SELECT video_id, max(shot_id) * 100 + 200 AS frame_count FROM shots GROUP BY video_id)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    li = table(spark, sf_dir, "lineitem").withColumn("dup", F.row_number().over(w)).filter("dup = 1")
    start = F.col("l_linenumber").cast("long") * 100
    return li.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("shot_id"), start.alias("start_frame"), (start + 9 + F.col("l_quantity").cast("long") + F.when(F.col("l_returnflag") == "R", 60).otherwise(0)).alias("end_frame"))


def counts(s: DataFrame) -> DataFrame:
    return s.groupBy("video_id").agg((F.max("shot_id") * 100 + 200).cast("long").alias("frame_count"))


@query(f"""WITH {SQL_SHOTS}, l AS (SELECT *, coalesce(lag(end_frame) OVER (PARTITION BY video_id ORDER BY start_frame) + 1, 0) AS f FROM shots)
SELECT video_id, f AS start_frame, start_frame - 1 AS end_frame FROM l WHERE f < start_frame
UNION ALL SELECT c.video_id, e + 1, frame_count - 1 FROM (SELECT video_id, max(end_frame) AS e FROM shots GROUP BY video_id) m JOIN counts c ON c.video_id = m.video_id WHERE e + 1 < frame_count""")
def gap_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    return timeline.gaps(s, counts(s))


@query(f"WITH {SQL_SHOTS}, l AS (SELECT *, max(end_frame) OVER (PARTITION BY video_id ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM shots) SELECT video_id, shot_id FROM l WHERE start_frame <= r")
def shot_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.overlaps(shots(spark, sf_dir)).select("video_id", "shot_id")


@query(f"WITH {SQL_FRAMES}, s AS (SELECT * REPLACE (CASE WHEN frame_id % 50 = 0 THEN pts_time - 864000 ELSE pts_time END AS pts_time) FROM frames), l AS (SELECT *, lag(pts_time) OVER (PARTITION BY video_id ORDER BY frame_id) AS p FROM s) SELECT video_id, frame_id FROM l WHERE pts_time < p")
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that were moved ten days back, where one of their video comes before them."""
    f = frames(spark, sf_dir)
    f = f.withColumn("pts_time", F.when(F.col("frame_id") % 50 == 0, F.col("pts_time") - 864000).otherwise(F.col("pts_time")))
    return timeline.order_violations(f).select("video_id", "frame_id")


EXCLUDED = "ranges AS (SELECT c_custkey % 150 AS video_id, c_custkey * 5 AS start_frame, c_custkey * 5 + 40 AS end_frame FROM customer)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select((k % 150).alias("video_id"), (k * 5).alias("start_frame"), (k * 5 + 40).alias("end_frame"))


@query(f"WITH {SQL_FRAMES}, {EXCLUDED} SELECT keyframe_uid FROM frames f WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.video_id = f.video_id AND f.frame_id BETWEEN start_frame AND end_frame)")
def interval_exclusion_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.exclude(frames(spark, sf_dir), _ranges(spark, sf_dir)).select("keyframe_uid")


@query(f"WITH {SQL_FRAMES}, {EXCLUDED}, e AS (SELECT video_id, sum(end_frame - start_frame + 1)::BIGINT AS excluded FROM ranges GROUP BY video_id), c AS (SELECT video_id, count(*) * 100 AS frame_count FROM frames GROUP BY video_id) SELECT video_id, coalesce(excluded, 0) AS excluded, round(coalesce(excluded, 0) / frame_count, 4) AS fraction, coalesce(excluded, 0) / frame_count > 0.01 AS warn FROM c LEFT JOIN e USING (video_id)")
def exclusion_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames(spark, sf_dir).groupBy("video_id").agg((F.count(F.lit(1)) * 100).alias("frame_count"))
    return quality.excluded_fraction(_ranges(spark, sf_dir), c).select("video_id", "excluded", F.round("fraction", 4).alias("fraction"), "warn")


@query("""WITH seg AS (SELECT conv_id AS video_id, turn AS segment_id, 1704067200 + turn * 3600.0::DOUBLE AS s, 1704067200 + turn * 3600.0::DOUBLE + 1800 AS e FROM conversations), f AS (SELECT user_id AS video_id, event_id AS keyframe_uid, epoch_us(ts) / 1e6::DOUBLE AS t FROM events),
r AS (SELECT seg.*, keyframe_uid, t BETWEEN s AND e AS inside, row_number() OVER (PARTITION BY seg.video_id, segment_id ORDER BY NOT (t BETWEEN s AND e), abs(t - s), t, keyframe_uid) AS n FROM seg JOIN f USING (video_id)) SELECT video_id, segment_id, keyframe_uid, inside FROM r WHERE n = 1""")
def asof_segment_nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    start = F.lit(1704067200) + F.col("turn") * 3600.0
    seg = c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("segment_id"), start.alias("start_time"), (start + 1800).alias("end_time"))
    return timeline.nearest_frame(seg, frames(spark, sf_dir))


@query(f"WITH {SQL_SHOTS}, p AS (SELECT video_id, shot_id, start_frame, unnest(list_distinct([start_frame, (start_frame + end_frame) // 2, end_frame])) AS frame_id FROM shots) SELECT video_id, shot_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY start_frame, frame_id) - 1 AS local_idx FROM p")
def keyframe_begin_mid_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = timeline.representatives(shots(spark, sf_dir))
    return r.select("video_id", "shot_id", "frame_id", F.col("local_idx").cast("long").alias("local_idx"))


QUALITY = """q AS (SELECT l_orderkey AS video_id, l_returnflag AS shot_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS local_idx, l_quantity AS variance, (l_partkey % 64)::BIGINT AS h FROM lineitem)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = table(spark, sf_dir, "lineitem").withColumn("local_idx", F.row_number().over(w))
    return li.select(F.col("l_orderkey").alias("video_id"), F.col("l_returnflag").alias("shot_id"), "local_idx", (F.col("l_orderkey") * 100 + F.col("local_idx")).alias("keyframe_uid"), F.col("l_quantity").alias("variance"), F.lower(F.hex((F.col("l_partkey") % 64).cast("long"))).alias("phash"))


@query(f"""WITH RECURSIVE {QUALITY}, i AS (SELECT *, video_id * 100 + local_idx AS uid, variance >= 20 AS sharp, count(*) FILTER (WHERE variance >= 20) OVER (PARTITION BY video_id, shot_id) = 0 AS fb, row_number() OVER (PARTITION BY video_id, shot_id ORDER BY variance DESC, local_idx) AS best FROM q),
u AS (SELECT *, row_number() OVER (PARTITION BY video_id, shot_id ORDER BY local_idx) AS n FROM i WHERE sharp OR (fb AND best = 1)),
f AS (SELECT video_id, shot_id, n, uid, NULL::BIGINT AS dup, [{{'uid': uid, 'h': h}}] AS kept FROM u WHERE n = 1
  UNION ALL SELECT u.video_id, u.shot_id, u.n, u.uid, d.dup, CASE WHEN d.dup IS NULL THEN list_append(f.kept, {{'uid': u.uid, 'h': u.h}}) ELSE f.kept END
  FROM f JOIN u ON u.video_id = f.video_id AND u.shot_id = f.shot_id AND u.n = f.n + 1,
  LATERAL (SELECT CASE WHEN list_min(list_transform(f.kept, lambda k, j: {{'d': bit_count(xor(k.h, u.h)), 'j': j, 'uid': k.uid}})).d <= 1 THEN list_min(list_transform(f.kept, lambda k, j: {{'d': bit_count(xor(k.h, u.h)), 'j': j, 'uid': k.uid}})).uid END AS dup) d)
SELECT i.uid AS keyframe_uid, CASE WHEN f.uid IS NULL THEN 'blur' WHEN dup IS NOT NULL THEN 'near_duplicate' WHEN fb THEN 'kept_best_blur_fallback' ELSE 'kept' END AS reason, dup AS duplicate_of FROM i LEFT JOIN f ON f.uid = i.uid""")
def keyframe_quality_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_items(spark, sf_dir), 20.0, 1).select("keyframe_uid", "reason", "duplicate_of")


@query("SELECT a.l_orderkey, a.l_linenumber, bit_count(xor(a.l_partkey, a.l_suppkey))::INT AS distance FROM lineitem a")
def phash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", hashing.hamming(F.hex("l_partkey"), F.hex("l_suppkey")).alias("distance"))


@query()
def uid_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = timeline.positions(frames(spark, sf_dir))
    return f.select("keyframe_uid", hashing.keyframe_uid(F.col("video_id").cast("string"), F.col("shot_id"), F.col("position")).alias("uid"))


@query("SELECT user_id AS video_id, sha256(array_to_string(list_sort(list(DISTINCT event_id)), chr(10)) || chr(10)) AS set_sha256, sha256(array_to_string(list(event_id ORDER BY ts, event_id), chr(10)) || chr(10)) AS sequence_sha256 FROM events GROUP BY user_id")
def uid_set_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.groupBy("video_id").agg(hashing.set_digest(F.col("keyframe_uid")).alias("set_sha256"), hashing.sequence_digest(F.struct("pts_time", "keyframe_uid"), F.col("keyframe_uid")).alias("sequence_sha256"))


@query(f"WITH {SQL_FRAMES}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts_time, frame_id) - 1 AS plc, count(*) OVER (PARTITION BY video_id) AS n FROM frames), w AS (SELECT n, list_transform(range(0, 7), lambda i: round_even(i * (n - 1) / 6.0::DOUBLE, 0)::BIGINT) AS want FROM (SELECT DISTINCT n FROM p)) SELECT keyframe_uid, plc AS place FROM p JOIN w USING (n) WHERE n <= 7 OR list_contains(want, plc)")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeline.evenly_spaced(frames(spark, sf_dir), 7, ["video_id"], ["pts_time", "frame_id"])
    return s.select("keyframe_uid", F.col("at").cast("long").alias("place"))


@query("SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4 AS shard FROM customer")
def round_robin_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeline.shard(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), 4, ["c_custkey"], ["c_nationkey"])
    return s.select("c_custkey", F.col("shard").cast("long").alias("shard"))


STRATA = ["AUTOMOBILE", "BUILDING", "FURNITURE"]


@query("""WITH r AS (SELECT c_nationkey AS video_id, c_custkey // 2 AS frame, c_custkey AS id, c_mktsegment AS stratum, sha256('seed-1|' || c_custkey) AS h FROM customer),
a0 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY h, id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY h, id) AS f FROM r WHERE stratum = 'AUTOMOBILE') WHERE f = 1),
t0 AS (SELECT video_id, frame, id, 'AUTOMOBILE' AS drawn_as FROM a0 WHERE k <= 3),
a1 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY h, id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY h, id) AS f FROM r WHERE stratum = 'BUILDING' AND (video_id, frame) NOT IN (SELECT (video_id, frame) FROM t0)) WHERE f = 1),
t1 AS (SELECT * FROM t0 UNION ALL SELECT video_id, frame, id, 'BUILDING' FROM a1 WHERE k <= 3),
a2 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY h, id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY h, id) AS f FROM r WHERE stratum = 'FURNITURE' AND (video_id, frame) NOT IN (SELECT (video_id, frame) FROM t1)) WHERE f = 1),
t2 AS (SELECT * FROM t1 UNION ALL SELECT video_id, frame, id, 'FURNITURE' FROM a2 WHERE k <= 3),
a3 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY h, id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY h, id) AS f FROM r WHERE (video_id, frame) NOT IN (SELECT (video_id, frame) FROM t2)) WHERE f = 1),
hv AS (SELECT video_id, count(*) AS c FROM t2 GROUP BY video_id)
SELECT id, drawn_as FROM t2 UNION ALL SELECT id, 'fill' FROM a3 LEFT JOIN hv USING (video_id) WHERE k <= 12 - coalesce(c, 0)""")
def stratified_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    r = c.select(F.col("c_nationkey").alias("video_id"), F.expr("c_custkey div 2").alias("frame"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"))
    return timeline.stratified(r, "seed-1", STRATA, 3, 12).select("id", "drawn_as")


@query("""WITH o AS (SELECT c_nationkey AS q, c_custkey % 500 AS k, c_custkey AS pos, 0 AS side FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_nationkey, c_custkey % 500, c_custkey, 1 FROM customer),
d AS (SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY side, pos) AS n FROM o)
SELECT q, k, row_number() OVER (ORDER BY side, pos, q, k) AS position FROM d WHERE n = 1 ORDER BY side, pos, q, k LIMIT 100""")
def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("q"), (F.col("c_custkey") % 500).alias("k"), F.col("c_custkey").alias("pos"), "c_acctbal")
    m = setops.merge_first(rows.filter("c_acctbal > 9000").drop("c_acctbal"), rows.drop("c_acctbal"), ["q", "k"], "pos")
    return m.select("q", "k", F.col("position").cast("long").alias("position"))


@query("WITH l AS (SELECT CASE WHEN l_quantity > 49 THEN l_partkey + 10000000 ELSE l_partkey END AS k FROM lineitem WHERE l_quantity > 47) SELECT k AS part, 'missing' AS kind FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT k FROM l) UNION ALL SELECT k, 'unexpected' FROM (SELECT k FROM l EXCEPT SELECT p_partkey FROM part)")
def set_diff_missing_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without a large line are missing; those of the largest lines have got another number."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    key = F.when(F.col("l_quantity") > 49, F.col("l_partkey") + 10_000_000).otherwise(F.col("l_partkey"))
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 47").select(key.alias("part"))
    return setops.difference(p, li, "part")


@query("SELECT DISTINCT l_suppkey AS supp FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("supp"))
    return a.intersect(table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("supp")))


@query("SELECT 0::BIGINT AS overlapping, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS missing, 0::BIGINT AS foreign_keys, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) = 0 AS exact FROM orders")
def partition_exact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    parts = setops.union_disjoint({s: o.filter(F.col("o_orderstatus") == s).select("o_orderkey") for s in ("O", "F")}, "o_orderkey")
    return setops.partition_check(parts, o, "o_orderkey").withColumnRenamed("foreign", "foreign_keys")


@query("SELECT c_custkey, c_name || '!' AS c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS discarded FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, c_mktsegment, 0 FROM customer WHERE c_custkey % 2 = 1")
def columnwise_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited rows give the name; an edited segment is discarded and counted."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    e = c.filter("c_custkey % 2 = 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, "edited").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return setops.merge_columns(c, e, "c_custkey", ["c_name"])


@query("SELECT coalesce(n_nationkey, k) AS nation, 10::BIGINT AS claimed, coalesce(actual, 0) AS actual FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS actual FROM customer GROUP BY 1) ON k = n_nationkey WHERE coalesce(actual, 0) <> 10")
def claimed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.lit(10).cast("long").alias("claimed"))
    return setops.claimed_counts(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), claims, "nation")


@query("SELECT vec_id AS keyframe_uid FROM embeddings WHERE vec_id >= 400")
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of new vectors beside an index that holds the first 400."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("keyframe_uid"))
    known = spark.createDataFrame([("first", "s1")], "source string, signature string")
    return setops.append_new(e.filter("keyframe_uid < 400"), e.filter("keyframe_uid >= 400"), known, "second", "s2")


@query("SELECT a.o_orderkey, CASE WHEN a.o_orderkey % 50 = 0 THEN 'missing' WHEN a.o_orderkey % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM orders a")
def strict_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    q = o.filter("o_orderkey % 50 != 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "?").otherwise(F.col("o_orderstatus")))
    return quality.strict_join(o, q, "o_orderkey", ["o_orderstatus"]).select("o_orderkey", "verdict")


@query("WITH a AS (SELECT l_orderkey AS v, l_linenumber AS pos, max(l_quantity) AS x FROM lineitem GROUP BY ALL), b AS (SELECT v, pos, CASE WHEN (v + pos) % 11 = 0 THEN x + 1 ELSE x END AS x FROM a WHERE pos < 6) SELECT v AS video_id, min(pos) AS pos, count(*) AS differences FROM (SELECT a.v, a.pos FROM a LEFT JOIN b USING (v, pos) WHERE a.x IS DISTINCT FROM b.x) GROUP BY v")
def manifest_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("pos")).agg(F.max("l_quantity").alias("x"))
    b = a.filter("pos < 6").withColumn("x", F.when((F.col("video_id") + F.col("pos")) % 11 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return quality.first_mismatch(a, b, "x", ["video_id"]).select("video_id", "pos", "differences")


@query(f"""WITH {SQL_FRAMES}, r AS (SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN 'KIS' WHEN 1 THEN 'QA' ELSE 'TRAKE' END AS task, user_id AS video_id,
 CASE WHEN event_id % 3 < 2 THEN CASE WHEN event_id % 10 = 0 THEN [event_id + 10000000] ELSE [event_id] END ELSE [event_id, event_id] END AS ids, CASE WHEN event_id % 9 = 1 THEN 'Uncertain' WHEN event_id % 9 = 4 THEN ' ' ELSE 'x' END AS answer FROM events)
SELECT k, array_to_string(list_filter([CASE WHEN task <> 'TRAKE' AND k % 10 = 0 THEN 'unknown_frame' END, CASE WHEN task = 'QA' AND trim(answer) = '' THEN 'answer_length' END, CASE WHEN task = 'QA' AND answer = 'Uncertain' THEN 'placeholder_answer' END, CASE WHEN task = 'TRAKE' THEN 'not_rising' END], lambda x: x IS NOT NULL), '|') AS reasons
FROM r WHERE (task <> 'TRAKE' AND k % 10 = 0) OR (task = 'QA' AND answer <> 'x') OR task = 'TRAKE'""")
def submission_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = frames(spark, sf_dir), F.col("keyframe_uid")
    one = F.when(k % 10 == 0, F.array(k + 10_000_000)).otherwise(F.array(k))
    r = e.select(k.alias("k"), F.concat(F.lit("q"), k.cast("string")).alias("query_name"), F.when(k % 3 == 0, "KIS").when(k % 3 == 1, "QA").otherwise("TRAKE").alias("task"), "video_id", F.when(k % 3 < 2, one).otherwise(F.array(k, k)).alias("frame_ids"), F.when(k % 9 == 1, "Uncertain").when(k % 9 == 4, " ").otherwise("x").alias("answer"), F.lit(False).alias("requires_review"))
    return validation.submission_violations(r, e, 2).select("k", F.array_join("reasons", "|").alias("reasons"))


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.unique_violations(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def foreign_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return validation.foreign_violations(table(spark, sf_dir, "lineitem"), p, "l_partkey").select("l_orderkey", "l_linenumber")


ATTEMPTS = """a AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, CASE l_linenumber % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS e, CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'rejected' ELSE 'error' END AS o, l_linestatus = 'F' AS coded FROM lineitem)"""


@query(f"""WITH {ATTEMPTS}, b AS (SELECT *, lag(o) OVER w AS po, lag(e) OVER w AS pe FROM a WINDOW w AS (PARTITION BY k ORDER BY seq))
SELECT k AS keyframe_uid, seq, array_to_string(list_filter([CASE WHEN (o = 'error') <> coded THEN 'error_code' END, CASE WHEN po = 'success' THEN 'after_terminal' END, CASE WHEN pe IS NULL AND e <> 0 THEN 'first_engine' END, CASE WHEN e - pe > 1 THEN 'skipped_engine' END, CASE WHEN e < pe THEN 'engine_order' END], lambda x: x IS NOT NULL), '|') AS reasons
FROM b WHERE (o = 'error') <> coded OR po = 'success' OR (pe IS NULL AND e <> 0) OR e - pe > 1 OR e < pe""")
def attempt_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(w))
    n = F.col("l_linenumber") % 3
    a = li.select(F.col("l_orderkey").alias("keyframe_uid"), "seq", F.when(n == 1, "easyocr").when(n == 2, "vintern").otherwise("gemini").alias("engine"), F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "N", "rejected").otherwise("error").alias("outcome"), F.when(F.col("l_linestatus") == "F", "E1").alias("error_code"))
    return validation.attempt_violations(a).select("keyframe_uid", F.col("seq").cast("long").alias("seq"), F.array_join("reasons", "|").alias("reasons"))


@query("SELECT event_type AS model_id, event_id, count(*) OVER w AS calls_in_window, (sum(value::BIGINT) OVER w)::BIGINT AS tokens_in_window, count(*) OVER d AS calls_in_day, count(*) OVER w <= 4 AND sum(value::BIGINT) OVER w <= 100 AND count(*) OVER d <= 40 AS allowed FROM (SELECT event_id, event_type, epoch_us(ts) AS t_us, ts::DATE AS day, floor(value) AS value FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY t_us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), d AS (PARTITION BY event_type, day ORDER BY t_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def quota_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("model_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("tokens"))
    q = ingest.quota(e, 3600, 4, 100, 40)
    return q.select("model_id", "event_id", "calls_in_window", F.col("tokens_in_window").cast("long").alias("tokens_in_window"), "calls_in_day", "allowed")


@query("""WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true) AS new FROM events), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM l)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS end_us, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = ingest.sessions(e, "ts", "2 hours", ["user_id"])
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    t = ingest.tumbling(e, "ts", "1 hour", ["event_type"], "value")
    return t.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {SQL_FRAMES} SELECT video_id, min(c) AS least, max(c) AS most FROM (SELECT video_id, shot_id, count(*) AS c FROM frames GROUP BY ALL) GROUP BY video_id")
def keyframes_per_shot_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames(spark, sf_dir).groupBy("video_id", "shot_id").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("video_id").agg(F.min("c").alias("least"), F.max("c").alias("most"))


@query(f"WITH {SQL_FRAMES} SELECT keyframe_uid, ntile(4) OVER w AS quarter, lag(keyframe_uid) OVER w AS before, lead(keyframe_uid) OVER w AS after, round(percent_rank() OVER w, 6) AS share FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY pts_time, frame_id)")
def ntile_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("pts_time", "frame_id")
    return frames(spark, sf_dir).select("keyframe_uid", F.ntile(4).over(w).cast("long").alias("quarter"), F.lag("keyframe_uid").over(w).alias("before"), F.lead("keyframe_uid").over(w).alias("after"), F.round(F.percent_rank().over(w), 6).alias("share"))


@query("SELECT l_orderkey, seq FROM (SELECT l_orderkey, l_linestatus, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, first(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS src FROM lineitem) WHERE seq > 1 AND src <> 'A'")
def reuse_source_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that reuse the reading of their order's first line, which must have text."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(w).cast("long"))
    status = F.when(F.col("l_returnflag") == "A", "text_detected").otherwise("no_text")
    r = li.select("l_orderkey", "seq", (F.col("l_orderkey") * 100 + F.col("seq")).alias("keyframe_uid"), F.col("l_orderkey").alias("video_id"), F.lit("s").alias("shot_id"), status.alias("status"), F.when(F.col("seq") > 1, F.col("l_orderkey") * 100 + 1).alias("reuse_source_uid"))
    return routing.reuse_violations(r).select("l_orderkey", "seq")


@query("SELECT n_nationkey, array_to_string(list_filter([CASE WHEN n_nationkey % 4 = 1 THEN 'counts' END, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 5 = 0 THEN 'incomplete' END, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey > 20 THEN 'errors' END], lambda x: x IS NOT NULL), '|') AS reasons FROM nation WHERE n_nationkey % 4 = 1 OR (n_nationkey % 3 = 0 AND (n_nationkey % 5 = 0 OR n_nationkey > 20))")
def shard_gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    err = F.when(k > 20, 50).otherwise(0)
    s = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(1000).alias("records"), err.alias("error"), F.lit(100).alias("no_text"), (900 - err + F.when(k % 4 == 1, 1).otherwise(0)).alias("success"), F.when(k % 5 == 0, 1001).otherwise(1000).alias("expected"), (k % 3 == 0).alias("complete"))
    return validation.shard_gate(s).select("n_nationkey", F.array_join("reasons", "|").alias("reasons"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'text_without_regions' WHEN s_suppkey % 4 = 1 THEN 'regions_without_text' WHEN s_suppkey % 4 = 2 THEN 'error_code' END AS reasons FROM supplier WHERE s_suppkey % 4 < 3")
def detector_state_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey") % 4
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(n == 0, "text_detected").when(n == 1, "no_text").when(n == 2, "error").otherwise("no_text").alias("status"), F.when(n == 1, 2).otherwise(0).alias("region_count"), F.lit(None).cast("double").alias("min_area"), F.lit(None).cast("string").alias("error_code"))
    return validation.detector_violations(s).select("s_suppkey", F.array_join("reasons", "|").alias("reasons"))


@query("SELECT event_id AS position FROM events WHERE CASE event_id % 3 WHEN 1 THEN event_type <> 'error' ELSE event_id % 2 = 0 END ORDER BY event_id LIMIT 100".replace("ELSE event_id % 2 = 0", "WHEN 2 THEN event_id % 2 = 0 ELSE true"))
def bulk_add_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows that may be added in bulk: an uncertain answer or a short sequence may not."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    r = e.select(k.alias("position"), F.when(k % 3 == 0, "KIS").when(k % 3 == 1, "QA").otherwise("TRAKE").alias("task"), F.when(F.col("event_type") == "error", " Uncertain").otherwise("x").alias("answer"), F.lit(False).alias("requires_review"), F.when(k % 2 == 0, F.array(k, k + 1)).otherwise(F.array(k)).alias("frame_ids"))
    return answers.bulk_valid(r, 2).select("position")


@query(f"WITH {SQL_FRAMES}, l AS (SELECT *, row_number() OVER w AS n, lead(frame_id, 1) OVER w AS b, lead(frame_id, 2) OVER w AS c FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY pts_time, frame_id)) SELECT video_id AS position, frame_id || ',' || c AS frame_ids, true AS valid FROM l WHERE n = 1 AND c IS NOT NULL")
def replace_with_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video's first two frames as a sequence, its second frame moved one place on."""
    f = timeline.positions(frames(spark, sf_dir))
    two = f.filter("position < 2").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("position", "frame_id"))).alias("r"))
    rows = two.filter(F.size("r") == 2).select(F.col("video_id").alias("position"), "video_id", F.transform("r", lambda x: x["frame_id"]).alias("frame_ids"))
    out = answers.replace_frame(rows, f, 1, 1).filter("valid")
    return out.select("position", F.array_join(F.col("frame_ids").cast("array<string>"), ",").alias("frame_ids"), "valid")


@query("SELECT o_orderstatus AS batch, CASE o_orderstatus WHEN 'P' THEN 'craft_only' ELSE 'easyocr' END AS tier, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW') AS searchable FROM orders GROUP BY o_orderstatus")
def incremental_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("keyframe_uid"), "o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "no_text").otherwise("success").alias("status"))
    parts = {s: ("craft_only" if s == "P" else "easyocr", o.filter(F.col("o_orderstatus") == s).drop("o_orderstatus")) for s in ("O", "F", "P")}
    u = setops.incremental_union(parts, o)
    return u.groupBy("batch", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("searchable").cast("long")).alias("searchable"))


@query(f"""WITH {SQL_FRAMES}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts_time, frame_id) AS n FROM frames), t AS (SELECT video_id, n, p.keyframe_uid, props AS text FROM p JOIN events ON event_id = keyframe_uid WHERE n <= 3),
x AS (SELECT video_id, unnest(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?')) AS v, n FROM t) SELECT video_id, arg_max(v, (length(regexp_replace(v, '\\D', '', 'g')), -n, v)) AS answer, 0.78::DOUBLE AS answer_confidence FROM x GROUP BY video_id""")
def answer_from_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number read from the first frame of each video and its neighbours, as no search hit it."""
    f = timeline.positions(frames(spark, sf_dir))
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("keyframe_uid"), F.col("props").alias("text"))
    none = f.select("video_id", "keyframe_uid", "score").limit(0)
    return answers.extract(f.filter("position = 0").select("video_id", "keyframe_uid"), none, t, f, "number")
