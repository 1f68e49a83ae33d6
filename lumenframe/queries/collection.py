"""Collections written and read back, their inspection, plans as rows, and submissions."""

from __future__ import annotations

import json
import uuid
import zipfile
from io import BytesIO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..adapters import SQL_FRAMES, frames, table, texts, vectors
from ..functions import hashing
from ..functions import text as T
from ..operators import answers, artifacts, fusion, plan_rows, routing, setops, text_search, timeline
from ..plans.engine import Encoders
from ..plans.planner import PlannerChain, from_old_form, repair, rule_plan
from ..sources import readers, writers
from ..sources.drafts import Drafts
from ..streaming import ingest
from ..workspace import work_root
from . import query


def _aside(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


SQL_CATALOG = f"""{SQL_FRAMES}, cat AS (SELECT 'V' || video_id AS video_id, (row_number() OVER (PARTITION BY video_id ORDER BY pts_time, frame_id) - 1)::INT AS local_idx, frame_id::INT AS frame_id, pts_time, shot_id, CASE WHEN frame_id % 3 = 0 THEN 'w' || frame_id END AS window_id, keyframe_uid FROM frames)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = timeline.positions(frames(spark, sf_dir))
    k = F.col("frame_id")
    return f.select(F.concat(F.lit("V"), F.col("video_id").cast("string")).alias("video_id"), F.col("position").cast("int").alias("local_idx"), k.cast("int").alias("frame_id"), "pts_time", "shot_id", F.when(k % 3 == 0, F.concat(F.lit("w"), k.cast("string"))).alias("window_id"), "keyframe_uid")


@query(f"WITH {SQL_CATALOG} SELECT * FROM cat")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog as sorted CSV with its state, read back with header and types held to."""
    path = _aside(spark, "catalog")
    writers.publish_catalog(_catalog(spark, sf_dir), path)
    return readers.read_catalog(spark, f"{path}/frames")


@query(f"WITH {SQL_CATALOG} SELECT 'video_frame' AS key, count(*) AS n FROM cat WHERE frame_id % 40 = 0 UNION ALL SELECT 'keyframe_uid', count(*) FROM cat WHERE frame_id % 40 = 0 UNION ALL SELECT 'video_local', count(*) FROM cat WHERE frame_id % 40 = 0 UNION ALL SELECT 'positive_uid', count(*) FILTER (WHERE frame_id % 55 = 0) + count(*) FILTER (WHERE keyframe_uid <= 0) + count(*) FILTER (WHERE keyframe_uid <= 0 AND frame_id % 40 = 0) FROM cat")
def catalog_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were doubled break all keys, and turned ids are found."""
    c = _catalog(spark, sf_dir)
    doubled = c.unionByName(c.filter("frame_id % 40 = 0"))
    turned = c.filter("frame_id % 55 = 0").withColumn("keyframe_uid", -F.col("keyframe_uid")).withColumn("video_id", F.lit("other")).withColumn("local_idx", -F.col("frame_id"))
    return readers.catalog_violations(doubled.unionByName(turned)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_CATALOG}, p AS (SELECT video_id, count(*) AS n FROM cat GROUP BY video_id) SELECT (SELECT sum(n)::BIGINT FROM p) AS records, (SELECT count(*) FROM p) AS videos, (SELECT min(n) FROM p) AS least, (SELECT max(n) FROM p) AS most, (SELECT count(*) FROM cat WHERE frame_id % 10 = 0) AS mismatches, 0::BIGINT AS duplicates")
def uid_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids recomputed from video, shot and place; every tenth frame has another."""
    c = _catalog(spark, sf_dir)
    uid = hashing.keyframe_uid(F.col("video_id"), F.col("shot_id"), F.col("local_idx"))
    return artifacts.catalog_audit(c.withColumn("keyframe_uid", uid + F.when(F.col("frame_id") % 10 == 0, 1).otherwise(0)))


@query(f"WITH {SQL_CATALOG} SELECT video_id, shot_id, (row_number() OVER (PARTITION BY video_id ORDER BY shot_id, frame_id) - 1) AS local_idx, frame_id AS file_idx, 'k/' || video_id || '/' || shot_id || '_' || frame_id || '.jpg' AS source_image, true AS own_uid FROM cat")
def catalog_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog made from a listing of images, other files left out; its ids pass the audit."""
    c = _catalog(spark, sf_dir)
    path = F.concat(F.lit("k/"), "video_id", F.lit("/"), "shot_id", F.lit("_"), F.col("frame_id").cast("string"))
    listing = c.select(F.explode(F.array(F.concat(path, F.lit(".jpg")), F.concat(path, F.lit(".txt")))).alias("path"))
    d = artifacts.catalog_from_listing(listing)
    uid = hashing.keyframe_uid(F.col("video_id"), F.col("shot_id"), F.col("local_idx"))
    return d.select("video_id", "shot_id", F.col("local_idx").cast("long").alias("local_idx"), "file_idx", "source_image", (F.col("keyframe_uid") == uid).alias("own_uid"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE event_type END AS kind FROM events")
def json_lines_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines appended twice, rewritten once, and read back."""
    e, path = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind")), _aside(spark, "lines")
    writers.append_lines(e.filter("id % 2 = 0"), path)
    writers.append_lines(e.filter("id % 2 = 1"), path)
    first = readers.read_json_lines(spark, path, "id long, kind string")
    writers.rewrite_lines(first.withColumn("kind", F.when(F.col("id") % 2 == 0, "new").otherwise(F.col("kind"))), path)
    return readers.read_json_lines(spark, path, "id long, kind string")


SQL_SHOTS = "so AS (SELECT o_custkey AS video, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), sh AS (SELECT 'V' || video AS video, 's' || lpad(n::VARCHAR, 6, '0') AS shot_id, n * 100 AS start_frame, n * 100 + 60 + CASE WHEN o_orderkey % 9 = 0 THEN 50 ELSE 0 END AS end_frame FROM so)"


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("n"))
    start = F.col("n") * 100
    return o.select(F.concat(F.lit("V"), F.col("o_custkey").cast("string")).alias("manifest_video_id"), T.padded_id("s", F.col("n")).alias("shot_id"), start.alias("start_frame"), (start + 60 + F.when(F.col("o_orderkey") % 9 == 0, 50).otherwise(0)).alias("end_frame"))


@query(f"WITH {SQL_SHOTS}, l AS (SELECT *, max(end_frame) OVER (PARTITION BY video ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sh) SELECT video AS manifest_video_id, shot_id, start_frame, end_frame, coalesce(start_frame <= r, false) AS overlaps FROM l")
def shot_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of shots written a video a line, read back by version, and checked anew."""
    path = _aside(spark, "shots")
    writers.publish_manifests(_shots(spark, sf_dir), path, "shots", ["start_frame"], 2)
    back = readers.read_manifest(spark, path, "shots", schemas.SHOTS.replace(" ", ":").replace(",:", ","), 2, lines=True)
    bad = readers.shot_violations(back).filter("reason = 'overlap'").select("manifest_video_id", "shot_id", F.lit(True).alias("overlaps"))
    return back.join(bad, ["manifest_video_id", "shot_id"], "left").fillna(False, ["overlaps"])


_MANIFEST = "SELECT video_id AS manifest_video_id, local_idx, '{}' AS reason FROM {} WHERE {}"
_DOUBLED = "frame_id % 77 = 0"


@query(f"WITH {SQL_CATALOG}, lg AS (SELECT *, lag(frame_id) OVER (PARTITION BY video_id ORDER BY local_idx) AS p FROM cat) " + " UNION ALL ".join(_MANIFEST.format(*x) for x in (
    ("other_video", "cat", "frame_id % 30 = 0"), ("other_video", "cat", f"frame_id % 30 = 0 AND {_DOUBLED}"), ("duplicate_uid", "cat", _DOUBLED), ("duplicate_uid", "cat", _DOUBLED), ("not_rising", "lg", "frame_id <= p"), ("not_rising", "cat", _DOUBLED))))
def plan_manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned keyframes under another video's name, and rows that are there twice, which then do not rise."""
    c = _catalog(spark, sf_dir).withColumn("manifest_video_id", F.col("video_id"))
    c = c.withColumn("video_id", F.when(F.col("frame_id") % 30 == 0, "other").otherwise(F.col("video_id")))
    return readers.plan_violations(c.unionByName(c.filter("frame_id % 77 = 0")))


@query("SELECT c_custkey AS keyframe_uid, CASE c_custkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'no_text' ELSE 'error' END AS status, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || c_mktsegment END AS detected_text, CASE WHEN c_custkey % 3 = 0 THEN 'vi' END AS language, CASE WHEN c_custkey % 3 = 0 THEN 0.5::DOUBLE END AS confidence FROM customer")
def envelope_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of readings to snapshot rows: what was read only where reading succeeded."""
    k = F.col("c_custkey")
    status = F.when(k % 3 == 0, "success").when(k % 3 == 1, "no_text").otherwise("error")
    result = F.struct(F.array("c_name", "c_mktsegment").alias("detected_text"), F.lit("vi").alias("language"), F.lit(0.5).alias("confidence"))
    e = table(spark, sf_dir, "customer").select(F.lit("v").alias("video_id"), k.alias("keyframe_uid"), F.lit(0).alias("frame_id"), status.alias("status"), F.lit("easyocr").alias("engine"), result.alias("result"))
    return readers.snapshot_from_envelopes(e).select("keyframe_uid", "status", "detected_text", "language", "confidence")


SQL_GATE = """rg AS (SELECT l_orderkey AS k, l_linenumber AS n, any_value(CASE WHEN l_linenumber % 4 = 0 THEN ' ' ELSE l_shipdate::DATE::VARCHAR END) AS t FROM lineitem GROUP BY ALL),
gt AS (SELECT k, list(t ORDER BY n) AS ts, list(n ORDER BY n) AS ns, list_filter(list(struct_pack(t := t, c := n / 10.0::DOUBLE, n := n) ORDER BY n), lambda x: trim(x.t) <> '') AS good FROM rg GROUP BY k),
fr AS (SELECT k, good, ns, CASE WHEN k % 5 = 0 THEN 'no_text' ELSE 'text_detected' END AS st FROM gt)"""


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames with a region a line: of a repeated line the first text in the order of files and rows."""
    t = F.when(F.col("l_linenumber") % 4 == 0, " ").otherwise(F.to_date("l_shipdate").cast("string"))
    n = F.col("l_linenumber")
    at = F.when(t.isNotNull(), F.struct("_metadata.file_path", "_metadata.row_index"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", n.alias("n")).agg(F.min_by(t, at).alias("t"))
    n = F.col("n")
    region = F.struct("n", F.col("t").alias("easyocr_text"), (n / 10).alias("easyocr_confidence"), (n == 1).alias("has_vi_marks"), (n == 2).alias("has_ascii_word"), F.upper("t").alias("final_text"), (n / 20).alias("final_confidence"), F.when(n == 3, "vintern").otherwise("easyocr").alias("final_engine"))
    f = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    k = F.col("l_orderkey")
    return f.select(F.lit("v").alias("video_id"), k.alias("keyframe_uid"), F.lit(0).alias("frame_id"), F.when(k % 5 == 0, "no_text").otherwise("text_detected").alias("status"), (k % 7 == 0).alias("frame_mixed_candidate"), "regions")


_GATE = """SELECT k AS keyframe_uid, CASE WHEN st = 'no_text' THEN st WHEN len(good) > 0 THEN 'success' ELSE 'error' END AS status, {engine} AS engine, CASE WHEN st <> 'no_text' AND len(good) > 0 THEN list_reduce(list_transform(good, lambda x: trim(x.t)), lambda a, b: a || chr(10) || b) END AS detected_text,
CASE WHEN st <> 'no_text' AND len(good) > 0 THEN CASE WHEN k % 7 = 0 OR (list_contains(ns, 1) AND list_contains(ns, 2)) THEN 'mixed' WHEN list_contains(ns, 1) THEN 'vi' ELSE 'en' END END AS language, CASE WHEN st <> 'no_text' AND len(good) > 0 THEN round(list_sum(list_transform(good, lambda x: x.c)) / len(good) / {half}::DOUBLE, 9) END AS confidence FROM fr"""


@query(f"WITH {SQL_GATE} " + _GATE.format(engine="'easyocr'", half=1))
def gate_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = readers.snapshot_from_regions(_gate(spark, sf_dir))
    return s.select("keyframe_uid", "status", "engine", "detected_text", "language", F.round("confidence", 9).alias("confidence"))


@query(f"WITH {SQL_GATE} " + _GATE.format(engine="CASE WHEN list_contains(ns, 3) THEN 'vintern' ELSE 'easyocr' END", half=2))
def gate_snapshot_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the final readings; the engine is the second one's if any of its readings stands."""
    s = readers.snapshot_from_regions(_gate(spark, sf_dir), "final_text", "final_confidence")
    return s.select("keyframe_uid", "status", "engine", "detected_text", "language", F.round("confidence", 9).alias("confidence"))


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("keyframe_uid", F.col("clip").cast("array<float>").alias("vector"))
    return v.withColumn("shard", F.concat(F.lit("shard-"), F.expr("keyframe_uid div 100").cast("string")))


@query("SELECT vec_id AS keyframe_uid, 'shard-' || vec_id // 100 AS shard, (vec_id % 100)::INT AS position, round(embedding[1]::DOUBLE + 2 * embedding[64]::DOUBLE, 5) AS mark FROM embeddings")
def npy_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as array files of a hundred, and back."""
    back = readers.npy_vectors(writers.npy_shards(_sharded(spark, sf_dir)))
    v = F.col("vector").cast("array<double>")
    return back.select("keyframe_uid", "shard", "position", F.round(F.element_at(v, 1) + 2 * F.element_at(v, 64), 5).alias("mark"))


@query("SELECT vec_id AS keyframe_uid, CASE WHEN vec_id % 20 = 0 THEN 'missing' WHEN vec_id % 21 = 0 THEN 'dimension' ELSE 'norm' END AS reason FROM embeddings WHERE vec_id % 20 = 0 OR vec_id % 21 = 0 OR vec_id % 22 = 0 UNION ALL SELECT 1000000000, 'foreign'")
def vector_shard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards published apart and read together; what was left out, cut, stretched or added is found."""
    path, s, k = _aside(spark, "vectors"), _sharded(spark, sf_dir), F.col("keyframe_uid")
    v = F.when(k % 21 == 0, F.slice("vector", 1, 63)).when(k % 22 == 0, F.transform("vector", lambda x: x * 2)).otherwise(F.col("vector"))
    s = s.filter(k % 20 != 0).withColumn("vector", v.cast("array<float>"))
    writers.publish_vectors(s.filter("keyframe_uid % 2 = 0").drop("shard"), path, "even")
    odd = s.filter("keyframe_uid % 2 = 1").drop("shard")
    writers.publish_vectors(odd.unionByName(odd.limit(1).withColumn("keyframe_uid", F.lit(1_000_000_000).cast("long"))), path, "odd")
    stored = spark.read.schema(f"{schemas.VECTORS}, shard string").parquet(path)
    found = readers.vector_violations(stored, vectors(spark, sf_dir).select("keyframe_uid"), 64)
    return found.filter("keyframe_uid < 1000000000 or reason = 'foreign'")


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT 'frames' AS artifact, 'READY' AS status, n AS records, '' AS detail FROM n UNION ALL SELECT 'clip', 'INVALID', n, 'missing=' || (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) FROM n UNION ALL SELECT 'sig', 'READY', n, '' FROM n UNION ALL SELECT 'ocr', 'INVALID', (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS records, 'other_video=' || (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id % 3 = 0) UNION ALL SELECT 'asr', 'UNAVAILABLE', 0, 'absent'")
def artifact_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a registry finds: vectors that lack frames, texts of another video, a table that is not there."""
    v = vectors(spark, sf_dir)
    f = v.select(F.col("video_id").cast("string").alias("video_id"), "shot_id", "keyframe_uid", "frame_id", F.col("frame_id").cast("double").alias("pts_time"))
    o = texts(spark, sf_dir).select("keyframe_uid", "text").join(f.select("keyframe_uid", "video_id"), "keyframe_uid")
    o = o.withColumn("video_id", F.when(F.col("keyframe_uid") % 3 == 0, "none").otherwise(F.col("video_id")))
    states = [artifacts.frames_state(f), artifacts.vectors_state(v.filter("keyframe_uid % 7 != 0"), f, "clip", 64), artifacts.vectors_state(v, f, "sig", 32, unit=False), artifacts.texts_state(o, f, "ocr"), artifacts.absent(spark, "asr")]
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out


@query("SELECT 'q-' || c_custkey || '-' || CASE c_custkey % 3 WHEN 0 THEN 'kis' WHEN 1 THEN 'QA' ELSE 'trake' END AS query_name, CASE c_custkey % 3 WHEN 0 THEN 'KIS' WHEN 1 THEN 'QA' ELSE 'TRAKE' END AS task, CASE WHEN c_custkey % 3 = 2 THEN 2 + c_custkey % 2 ELSE 0 END AS event_count FROM customer")
def query_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query files: task by name, and events that are numbered without a gap in any order."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("q-"), k.cast("string"), F.lit("-"), F.when(k % 3 == 0, "kis").when(k % 3 == 1, "QA").otherwise("trake"), F.lit(".txt"))
    text = F.when(k % 3 == 2, F.concat(F.lit("Cooking\nE2: fry\nE1 cut"), F.when(k % 2 == 1, "\nE3- eat").otherwise(""))).otherwise(F.col("c_name"))
    d = readers.query_specs(table(spark, sf_dir, "customer").select(name.alias("file"), text.alias("raw_query")))
    return d.select("query_name", "task", F.col("event_count").cast("long").alias("event_count"))


@query("SELECT 'V' || p_partkey AS stem, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 6 = 0 THEN 'repeated' END AS reason FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 6 = 0 UNION ALL SELECT 'X' || p_partkey, 'unexpected' FROM part WHERE p_partkey % 50 = 1")
def stem_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing held against an inventory."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.concat(F.lit("V"), k.cast("string")).alias("stem"))
    listing = p.filter(k % 5 != 0).unionByName(p.filter((k % 6 == 0) & (k % 5 != 0))).select("stem")
    listing = listing.unionByName(p.filter(k % 50 == 1).select(F.concat(F.lit("X"), k.cast("string")).alias("stem")))
    return artifacts.stem_mismatches(listing, p.select(F.col("stem").alias("video_id")))


@query("SELECT 'V' || p_partkey AS video_id, p_size AS width, CASE WHEN p_partkey % 2 = 0 THEN 30000 / 1001.0::DOUBLE ELSE 25.0 END AS fps, p_retailprice AS duration, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE round(p_retailprice * CASE WHEN p_partkey % 2 = 0 THEN 30000 / 1001.0::DOUBLE ELSE 25.0 END)::BIGINT END AS frame_count, p_partkey % 5 = 0 AS has_audio FROM part")
def media_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe output: rates as fractions, and what is missing taken from the container or reckoned."""
    k = F.col("p_partkey")
    rates = F.when(k % 2 == 0, '"avg_frame_rate":"30000/1001","r_frame_rate":"0/0"').otherwise('"avg_frame_rate":"0/0","r_frame_rate":"25"')
    frames_ = F.when(k % 3 == 0, F.concat(F.lit(',"nb_frames":"'), k.cast("string"), F.lit('"'))).otherwise("")
    sound = F.when(k % 5 == 0, '{"codec_type":"audio"},').otherwise("")
    probe = F.concat(F.lit('{"streams":['), sound, F.lit('{"codec_type":"video","width":'), F.col("p_size").cast("string"), F.lit(","), rates, frames_, F.lit('}],"format":{"duration":"'), F.col("p_retailprice").cast("string"), F.lit('"}}'))
    d = table(spark, sf_dir, "part").select(F.concat(F.lit("V"), k.cast("string")).alias("video_id"), F.lit("x").alias("relative_path"), probe.alias("probe"))
    return readers.probe_rows(d).select("video_id", "width", "fps", "duration", "frame_count", "has_audio")


@query("SELECT sha256(p_name) AS sha256, 'f' || p_partkey || '.bin' AS name, CASE WHEN p_partkey % 4 = 0 THEN 'changed' ELSE 'same' END AS kept FROM part")
def checksum_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum lines parsed, and held against the digests of what is there."""
    p = table(spark, sf_dir, "part").select(F.sha2("p_name", 256).alias("have"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".bin")).alias("name"), (F.col("p_partkey") % 4 == 0).alias("touched"))
    listed = readers.checksums(p.select(F.concat("have", F.lit("  "), "name").alias("value")))
    there = p.select("name", F.when(F.col("touched"), F.sha2("name", 256)).otherwise(F.col("have")).alias("have"))
    return listed.join(there, "name").select("sha256", "name", F.when(F.col("have") == F.col("sha256"), "same").otherwise("changed").alias("kept"))


@query("SELECT unnest(['all', 'none', 'some', 'other']) AS remote, unnest(['complete', 'missing', 'partial', 'foreign']) AS state")
def remote_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remote listing beside what should be there."""
    want = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.sha2("p_name", 256).alias("sha256"))
    cases = {"all": want, "none": want.limit(0), "some": want.filter("name != 'f1'"), "other": want.withColumn("sha256", F.when(F.col("name") == "f1", "0" * 64).otherwise(F.col("sha256")))}
    out = None
    for name, remote in cases.items():
        d = readers.remote_state(want, remote).select(F.lit(name).alias("remote"), "state")
        out = d if out is None else out.unionByName(d)
    return out


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir)
    k = F.col("keyframe_uid")
    ok = k % 10 != 0
    return d.select("video_id", "keyframe_uid", F.lit(0).alias("frame_id"), F.when(ok, "success").otherwise("no_text").alias("status"), F.lit("easyocr").alias("engine"), F.when(ok, F.col("text")).alias("detected_text"), F.when(ok, F.col("language")).alias("language"), F.when(ok, 0.5).alias("confidence"))


@query("SELECT doc_id AS keyframe_uid, CASE WHEN doc_id % 10 <> 0 THEN 'success' ELSE 'no_text' END AS status, md5(CASE WHEN doc_id % 10 <> 0 THEN text END) AS text_md5, true AS same_name FROM documents")
def snapshot_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot named by its content: the same rows in another order get the same name elsewhere."""
    s, a, b = _snapshot(spark, sf_dir), _aside(spark, "snapshot"), _aside(spark, "snapshot")
    first, second = writers.publish_snapshot(s, a, "20260101T000000Z"), writers.publish_snapshot(s.repartition(5, "detected_text"), b, "20260101T000000Z")
    back = spark.read.schema(schemas.SNAPSHOT).parquet(f"{a}/{first}")
    return back.select("keyframe_uid", "status", F.md5("detected_text").alias("text_md5"), F.lit(first == second).alias("same_name"))


@query("WITH d AS (SELECT doc_id, regexp_extract_all(translate(lower(translate(text, '" + T.FOLD_FROM + "', '" + T.FOLD_TO + "')), '" + T.FOLD_FROM + "', '" + T.FOLD_TO + "'), '[\\p{L}\\p{N}]+') AS terms FROM documents WHERE doc_id % 10 <> 0) SELECT doc_id AS keyframe_uid, len(terms) AS n_terms, term, count(*) AS frequency, 0::BIGINT AS lost FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY doc_id, terms, term")
def postings_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of a snapshot's texts, probed with the longest term of each."""
    s = _snapshot(spark, sf_dir)
    p = writers.build_postings(s)
    lost = writers.probe_postings(p, s).agg(F.count(F.lit(1)).alias("lost"))
    return p.crossJoin(lost).select("keyframe_uid", F.col("n_terms").cast("long").alias("n_terms"), "term", "frequency", "lost")  # one row


@query()
def fts_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``fts_cascade`` over postings written by term; tests hold both against each other."""
    d, path = texts(spark, sf_dir), _aside(spark, "postings")
    text_search.postings(d).repartitionByRange("term").sortWithinPartitions("term").write.parquet(path)
    r = d.select(F.size(T.index_terms(F.col("text"))).alias("n")).agg(F.count(F.lit(1)).alias("c"), F.avg("n").alias("m")).first()
    return text_search.search(d, ["of the", "anhe"], 50, index=spark.read.parquet(path), sizes=(r["c"], r["m"])).select("keyframe_uid", F.round("score", 9).alias("score"))


_QUOTED = "CASE WHEN regexp_matches(v, '[\",\\r\\n]') OR v = '' THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END"


@query(f"WITH v AS (SELECT event_id, user_id, 'say \"' || event_type || '\", ' || event_id AS v FROM events) SELECT event_id AS position, 'V' || user_id || ',' || event_id || ',' || {_QUOTED} AS line FROM v")
def submission_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an answered submission: quotes only where they are needed."""
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("event_id").alias("position"), F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("video_id"), F.col("event_id").alias("frame_id"), F.concat(F.lit('say "'), "event_type", F.lit('", '), F.col("event_id").cast("string")).alias("answer"))
    return writers.submission_lines(r, "QA")


def _drafts(spark: SparkSession, sf_dir: str) -> tuple[Drafts, DataFrame]:
    """Drafts of three queries, with the nations as videos."""
    rows = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey").collect()]  # 25 rows
    d = Drafts(spark, {"k-kis": ("KIS", 0), "q-qa": ("QA", 0), "t-trake": ("TRAKE", 2)})
    d.replace("k-kis", [{"video_id": f"V{n}", "frame_ids": [n]} for n in rows])
    d.replace("q-qa", [{"video_id": f"V{n}", "frame_ids": [n], "answer": f"a, {n}"} for n in rows if n % 2])
    d.merge("q-qa", [{"video_id": f"V{n}", "frame_ids": [n], "answer": f"a, {n}"} for n in rows if n % 3 == 0])
    d.replace("t-trake", [{"video_id": f"V{n}", "frame_ids": [n, n + 1]} for n in rows])
    d.move("t-trake", len(rows) - 1, 0)
    d.remove("k-kis", 3)
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("V"), F.col("n_nationkey").cast("string")).alias("video_id"), F.col("n_nationkey").cast("long").alias("k"))
    return d, n.select("video_id", F.explode(F.array("k", F.col("k") + 1)).alias("frame_id")).withColumn("pts_time", F.col("frame_id").cast("double"))


SQL_DRAFTS = """dr AS (SELECT 'k-kis' AS query_name, row_number() OVER (ORDER BY n_nationkey) AS position, 'V' || n_nationkey || ',' || n_nationkey AS line FROM nation WHERE n_nationkey <> 3
UNION ALL SELECT 'q-qa', row_number() OVER (ORDER BY n_nationkey % 2 = 0, n_nationkey), 'V' || n_nationkey || ',' || n_nationkey || ',"a, ' || n_nationkey || '"' FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 3 = 0
UNION ALL SELECT 't-trake', row_number() OVER (ORDER BY n_nationkey <> (SELECT max(n_nationkey) FROM nation), n_nationkey), 'V' || n_nationkey || ',' || n_nationkey || ',' || n_nationkey + 1 FROM nation)"""


@query(f"WITH {SQL_DRAFTS} SELECT query_name, position, line FROM dr")
def submission_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts checked, packed and opened again."""
    d, catalog = _drafts(spark, sf_dir)
    lines = []
    with zipfile.ZipFile(BytesIO(d.export(catalog))) as z:
        for name in z.namelist():
            lines += [(name.removesuffix(".csv"), i, x) for i, x in enumerate(z.read(name).decode().splitlines(), 1)]
    return spark.createDataFrame(lines, "query_name string, position long, line string")


@query(f"WITH {SQL_DRAFTS} SELECT query_name, count(*) AS n FROM dr GROUP BY query_name")
def drafts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts saved and loaded."""
    path = _aside(spark, "drafts")
    _drafts(spark, sf_dir)[0].save(path)
    back = Drafts.load(spark, path)
    return spark.createDataFrame([(n, len(r)) for n, r in back.rows.items()], "query_name string, n long")


@query("WITH v AS (SELECT c_nationkey AS c, 'V' || c_custkey AS video_id, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, 'V' || c_custkey) AS n FROM customer) SELECT 'case-' || c AS \"case\", 'PASS' AS status, string_agg(video_id, ',' ORDER BY n) FILTER (WHERE n <= 5) AS top_videos, count(*) AS candidates, round(max(c_acctbal), 4) AS best FROM v GROUP BY c UNION ALL SELECT 'none', 'FAIL', 'V0', 0, NULL")
def diagnostics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a case, written as JSON lines and read back; a case without candidates failed."""
    c = table(spark, sf_dir, "customer")
    case = F.concat(F.lit("case-"), F.col("c_nationkey").cast("string"))
    rows = c.select(case.alias("case"), F.concat(F.lit("V"), F.col("c_custkey").cast("string")).alias("video_id"), F.col("c_acctbal").alias("video_score"), F.col("c_custkey").alias("keyframe_uid"), F.col("c_custkey").alias("position"), F.col("c_acctbal").alias("score"), F.lit(0.5).alias("clip"))
    videos = rows.select("case", "video_id", "video_score").unionByName(spark.createDataFrame([("none", "V0", 0.0)], "case string, video_id string, video_score double"))
    path = _aside(spark, "report")
    writers.append_lines(artifacts.diagnostics(videos, rows, ["clip"]), path)
    back = readers.read_json_lines(spark, path, "case string, status string, top_videos array<struct<video_id:string,score:double>>, candidates array<struct<position:bigint,score:double,channel_scores:struct<clip:double>>>")
    return back.select("case", "status", F.array_join("top_videos.video_id", ",").alias("top_videos"), F.coalesce(F.size("candidates"), F.lit(0)).cast("long").alias("candidates"), F.round(F.array_max("candidates.score"), 4).alias("best")).withColumn("candidates", F.greatest("candidates", F.lit(0)))


# Plans as rows

SQL_UNITS = """un AS (SELECT o_custkey AS k, list(struct_pack(id := 'u' || o_orderkey, role := CASE o_orderkey % 3 WHEN 0 THEN 'VIDEO_LOCATOR' WHEN 1 THEN 'TARGET_MOMENT' ELSE 'ORDERED_EVENT' END, txt := o_orderpriority, ocr := o_orderkey % 2 = 0) ORDER BY o_orderkey) AS u FROM orders GROUP BY o_custkey)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    role = F.when(k % 3 == 0, "VIDEO_LOCATOR").when(k % 3 == 1, "TARGET_MOMENT").otherwise("ORDERED_EVENT")
    text = F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))
    u = F.struct(k.alias("o"), F.concat(F.lit("u"), k.cast("string")).alias("unit_id"), F.array(role).alias("roles"), text.alias("text"), F.when(k % 2 == 0, F.array(F.lit("visual"), F.lit("ocr"))).otherwise(F.array(F.lit("visual"))).alias("modalities"), F.array("o_orderstatus", F.lit(" ")).alias("literals"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(u)).alias("units"))


@query(f"WITH {SQL_UNITS} SELECT k, array_to_string(list_transform(list_filter(u, lambda x: x.role <> 'ORDERED_EVENT'), lambda x: x.id), ',') AS chosen, array_to_string(list_transform(list_reverse(u), lambda x: x.id), ',') AS turned FROM un")
def plan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by role, and in the order of a list of ids that also names one that is not there."""
    d = _units(spark, sf_dir)
    ids = F.concat(F.array(F.lit("none")), F.reverse(F.transform("units", lambda u: u["unit_id"])))
    join = lambda c: F.array_join(F.transform(c, lambda u: u["unit_id"]), ",")
    return d.select("k", join(plan_rows.units_with_roles(F.col("units"), "VIDEO_LOCATOR", "TARGET_MOMENT")).alias("chosen"), join(plan_rows.ordered_units(F.col("units"), ids)).alias("turned"))


_FIRST = "list_transform(list_sort(list_transform(list_distinct({l}), lambda x: {{'p': list_position({l}, x), 'x': x}})), lambda y: y.x)"


@query(f"WITH {SQL_UNITS}, t AS (SELECT k, ['whole'] || list_transform(u, lambda x: x.txt) AS l, list_transform(list_filter(u, lambda x: x.ocr), lambda x: x.id) AS o, u FROM un), li AS (SELECT o_custkey AS k, list(o_orderstatus ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS s FROM orders GROUP BY o_custkey), j AS (SELECT k, l, ['plan'] || coalesce(s, []) AS s FROM t JOIN li USING (k)) SELECT k, array_to_string({_FIRST.format(l='l')}, '|') AS texts, array_to_string({_FIRST.format(l='s')}, '|') AS literals FROM j")
def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct search texts, the whole first, and the literals of units that are read."""
    d = _units(spark, sf_dir)
    t = plan_rows.distinct_texts(F.array(F.lit("whole"), F.lit(" ")), F.transform("units", lambda u: u["text"]))
    return d.select("k", F.array_join(t, "|").alias("texts"), F.array_join(plan_rows.literals(F.array(F.lit("plan")), F.col("units"), "ocr"), "|").alias("literals"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'VIDEO_LOCATOR,TARGET_MOMENT' WHEN 1 THEN 'ANSWER_EVIDENCE' WHEN 2 THEN 'ORDERED_EVENT' ELSE '' END AS roles, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'fallback' END AS span, c_custkey % 3 = 0 AS grounded FROM customer")
def plan_roles_and_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role names as planners write them, and spans that are in the query or not."""
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, F.array(F.lit("video"), F.lit(" Target "), F.lit("LOCATOR"))).when(k % 4 == 1, F.array(F.lit("evidence"), F.lit("answer"))).when(k % 4 == 2, F.array(F.lit("trake_event"), F.lit("x"))).otherwise(F.array(F.lit("nonsense")))
    raw = F.concat(F.lit("Find\n "), F.upper("c_name"), F.lit(" now"))
    g = plan_rows.grounded_span(raw, F.when(k % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit("  "))).otherwise("not there"), F.lit(" fallback "))
    d = table(spark, sf_dir, "customer").select("c_custkey", F.array_join(plan_rows.normal_roles(said), ",").alias("roles"), g.alias("g"))
    return d.select("c_custkey", "roles", "g.span", "g.grounded")


def _raw() -> Column:
    k = F.col("c_custkey")
    return F.concat(F.lit("A man walks. Then he reads the sign \""), "c_name", F.lit("\". "), F.when(k % 2 == 0, "How many cars?").otherwise("Who is it?"), F.lit(" Tell."))


@query("SELECT c_custkey, 'A man walks.|he reads the sign \"' || c_name || '\".|' || CASE WHEN c_custkey % 2 = 0 THEN 'How many cars?' ELSE 'Who is it?' END || '|Tell.' AS scenes, c_name AS visible, 0.45::DOUBLE AS ocr_weight, CASE WHEN c_custkey % 2 = 0 THEN 'How many cars?' ELSE 'Who is it?' END AS question, CASE WHEN c_custkey % 2 = 0 THEN 'number' ELSE 'person' END AS value_type, 'ocr' AS answer_source, 'unit-4' AS targets, 'VIDEO_LOCATOR,TARGET_MOMENT,ANSWER_EVIDENCE' AS roles, 'visual,ocr' AS modalities, c_name AS literals FROM customer")
def rule_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by rules of questions about what a sign says."""
    c = table(spark, sf_dir, "customer").select("c_custkey", _raw().alias("raw"))
    p = plan_rows.planned(c, lambda raw: rule_plan(raw, "QA"), ["raw"], "c_custkey")
    last, join = F.element_at("units", -1), lambda x: F.array_join(x, ",")
    return p.select("c_custkey", F.array_join(F.transform("units", lambda u: u["text"]), "|").alias("scenes"), join("visible").alias("visible"), "ocr_weight", "question", "value_type", "answer_source", join("targets").alias("targets"), join(last["roles"]).alias("roles"), join(last["modalities"]).alias("modalities"), join(last["literals"]).alias("literals"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 END AS units, CASE c_custkey % 3 WHEN 0 THEN 'Cooking|cut it|fry ' || c_name WHEN 1 THEN 'a car|' || c_name END AS texts, CASE c_custkey % 3 WHEN 0 THEN 'event-1,event-2' WHEN 1 THEN 'event-1,event-2' END AS events, CASE WHEN c_custkey % 3 = 2 THEN 'a TRAKE plan needs two ordered events' END AS error FROM customer")
def event_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by rules of sequences: numbered events with a lead, scenes, and one event, which is refused."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Cooking\nE1: cut\n it.\nE2 fry "), "c_name")).when(k % 3 == 1, F.concat(F.lit("a car\n"), "c_name")).otherwise(F.col("c_name"))
    p = plan_rows.planned(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), lambda x: rule_plan(x, "TRAKE"), ["raw"], "c_custkey")
    return p.select("c_custkey", F.when(F.col("units").isNotNull(), F.size("units")).cast("long").alias("units"), F.array_join(F.transform("units", lambda u: u["text"]), "|").alias("texts"), F.array_join("events", ",").alias("events"), "error")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'VIDEO_LOCATOR,TARGET_MOMENT' ELSE 'VIDEO_LOCATOR' END AS first_roles, CASE WHEN c_custkey % 4 = 0 THEN 'u1' ELSE 'u2' END AS targets, c_name AS literals, c_custkey % 5 <> 0 AS kept_span, 1 + (c_custkey % 5 = 0)::INT AS warnings, 'visual,ocr' AS modalities FROM customer")
def provider_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's plans made good: roles by alias, invented literals and spans out, targets by role, no negative wishes."""
    k = F.col("c_custkey")
    unit = lambda i, roles, span: F.struct(F.lit(i).alias("unit_id"), F.lit("a man").alias("retrieval_query_en"), roles.alias("roles"), span.alias("description_original"), F.array(F.lit("OCR"), F.lit("smell")).alias("modalities"), F.array("c_name", F.lit("invented")).alias("known_text_literals"))
    first = unit("u1", F.when(k % 4 == 0, "target").otherwise("video"), F.when(k % 5 == 0, "not there").otherwise("a MAN  walks"))
    second = unit("u2", F.when(k % 4 == 0, "event").otherwise("Target"), F.lit("the sign"))
    payload = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(first, second).alias("query_units"), F.array(F.lit("u1"), F.lit("u9")).alias("submission_target_ids"), F.lit("no rain").alias("negative_constraints"))), F.lit("\n```"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("a man walks. The sign \""), "c_name", F.lit("\".")).alias("raw"), payload.alias("payload"))
    p = plan_rows.planned(c, lambda raw, said: repair(said, raw, "KIS"), ["raw", "payload"], "c_custkey")
    u, v = F.element_at("units", 1), F.element_at("units", 2)
    return p.select("c_custkey", F.array_join(F.array_union(F.array(F.lit("VIDEO_LOCATOR")), u["roles"]), ",").alias("first_roles"), F.array_join("targets", ",").alias("targets"), F.array_join(v["literals"], ",").alias("literals"), (u["source"] == "a MAN walks").alias("kept_span"), "warnings", F.array_join(u["modalities"], ",").alias("modalities"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'event-1,event-2' ELSE '' END AS events, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'unit-' || least(3, 1 + c_custkey % 5) END AS targets, CASE WHEN c_custkey % 2 = 1 THEN c_name || '?' END AS question FROM customer")
def old_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of the older form: moments as events, the anchor scene as the target of a question."""
    k = F.col("c_custkey")
    old = F.when(k % 2 == 0, F.to_json(F.struct(F.lit("q").alias("raw_query"), F.array("c_name", F.lit(" "), F.lit("b")).alias("ordered_moments")))).otherwise(F.to_json(F.struct(F.lit("q").alias("raw_query"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("scenes"), (k % 5).alias("anchor_moment_index"), F.concat("c_name", F.lit("?")).alias("question"))))
    c = table(spark, sf_dir, "customer").select("c_custkey", old.alias("old"), F.when(k % 2 == 0, "TRAKE").otherwise("QA").alias("task"))
    p = plan_rows.planned(c, lambda x, task: from_old_form(json.loads(x), task), ["old", "task"], "c_custkey")
    return p.select("c_custkey", F.array_join("events", ",").alias("events"), F.array_join("targets", ",").alias("targets"), "question")


def _refusing(raw: str, task: str) -> str:
    if "#0" in raw:
        raise TimeoutError
    return json.dumps({"query_units": [{"unit_id": "p", "retrieval_query_en": "p", "roles": ["target"], "description_original": raw}]})


@query("SELECT c_custkey, CASE WHEN c_name LIKE '%#0%' THEN 'rule' ELSE 'model' END AS provider, c_custkey % 2 = 0 AS edited FROM customer")
def planner_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain whose provider fails for some queries, and an operator's edit of half of the plans."""

    def make(raw: str, edit: str):
        p = PlannerChain([("model", _refusing)]).plan(raw, "KIS")
        return p.edited(context="edited") if edit == "y" else p

    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("raw"), F.when(F.col("c_custkey") % 2 == 0, "y").otherwise("n").alias("edit"))
    return plan_rows.planned(c, make, ["raw", "edit"], "c_custkey").select("c_custkey", "provider", (F.col("context") == "edited").alias("edited"))


# Rows that a reviewer or a verifier works on


@query(f"WITH {SQL_FRAMES}, c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, keyframe_uid) AS n FROM frames WHERE frame_id % 3 <> 0) SELECT n AS rank, video_id, keyframe_uid, round(score, 4) AS score, coalesce((SELECT string_agg(DISTINCT shot_id, ' | ' ORDER BY shot_id) FROM frames f WHERE f.video_id = c.video_id AND f.frame_id % 2 = 0), '') AS scenes FROM c")
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose image is there, as they are shown."""
    f = frames(spark, sf_dir).withColumn("relative_path", F.concat(F.col("frame_id").cast("string"), F.lit(".jpg")))
    there = f.filter("frame_id % 3 != 0").select("relative_path")
    w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "keyframe_uid")
    c = setops.keep_present(f, there).withColumn("position", F.row_number().over(w)).withColumn("candidate_score", F.col("score"))
    return answers.display_rows(c, f.filter("frame_id % 2 = 0").select("video_id", F.col("shot_id").alias("scene"))).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT CASE c_nationkey WHEN 3 THEN 1 WHEN 7 THEN 0 ELSE 2 END AS place, c_custkey FROM customer WHERE c_nationkey IN (3, 7, 11)")
def selection_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the asked groups, in the order asked for."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return setops.select_groups(c, [7, 3, 11], "c_nationkey").select("place", "c_custkey")


@query("SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_region' WHEN o_orderkey % 7 = 0 THEN 'missing_result' WHEN o_orderkey % 11 = 0 THEN 'other_frame' ELSE 'ok' END AS verdict, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_orderkey % 2 = 0 END AS correct FROM orders")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth beside regions and readings; what is missing or of another frame is named."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("candidate_id"), F.col("o_custkey").alias("keyframe_uid"), F.col("o_orderpriority").alias("text"))
    c = F.col("candidate_id")
    regions = o.filter(c % 5 != 0).select("candidate_id", (F.col("keyframe_uid") + F.when(c % 11 == 0, 1).otherwise(0)).alias("keyframe_uid"), F.col("text").alias("easyocr_text"))
    results = o.filter(c % 7 != 0).select("candidate_id", F.when(c % 2 == 0, F.concat(F.lit(" "), F.lower("text"))).otherwise("The text is blurry").alias("vintern_text"))
    truth = o.select("candidate_id", "keyframe_uid", F.when(c % 2 == 0, F.concat(F.lit(" "), "text")).otherwise("The text is blurry").alias("truth"))
    return routing.label_join(truth, regions, results).select("candidate_id", "verdict", "correct")


@query("SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) <@ ['F', 'O'] AS subset FROM orders GROUP BY o_custkey")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return o.select("o_custkey", setops.is_subset(F.col("s"), F.array(F.lit("O"), F.lit("F"))).alias("subset"))


@query("SELECT event_id, 's' || lpad(event_id::VARCHAR, 6, '0') AS shot, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN strftime(date_trunc('second', ts), '%Y%m%dT%H%M%SZ') ELSE strftime(date_trunc('second', ts) - INTERVAL 7 HOUR, '%Y%m%dT%H%M%SZ') END AS utc, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || '|b' END AS listed FROM events")
def id_time_and_list_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded ids, times that must name a zone, and JSON lists that may be one text."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k % 3 == 0, iso).when(k % 3 == 1, F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("+07:00")))
    value = F.when(k % 2 == 0, F.concat(F.lit('" '), "event_type", F.lit('"'))).otherwise(F.concat(F.lit('["'), "event_type", F.lit('", " b ", "", "b"]')))
    return e.select("event_id", T.padded_id("s", k).alias("shot"), T.compact_utc(T.zoned_time(said)).alias("utc"), F.array_join(T.json_texts(value), "|").alias("listed"))


SQL_VERDICT = f"""{SQL_FRAMES}, pl AS (SELECT video_id, list(frame_id ORDER BY frame_id DESC) FILTER (WHERE frame_id % 2 = 0) AS ids, CASE WHEN video_id % 3 = 0 THEN 1.0 WHEN video_id % 3 = 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS must FROM frames GROUP BY video_id)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, sf_dir)
    said = F.transform(F.sort_array(F.collect_list("frame_id"), asc=False), lambda x: x.cast("string"))
    p = f.groupBy("video_id").agg(F.concat(F.array(F.lit("x"), F.lit("-5")), said, F.array(F.max("frame_id").cast("string"))).alias("ranked_frame_ids"))
    v = F.col("video_id")
    p = p.select("video_id", F.when(v % 3 == 0, "7").when(v % 3 == 1, "0.25").otherwise("none").alias("must_score"), F.lit("NaN").alias("should_score"), "ranked_frame_ids", F.array(F.lit(" a "), F.lit(" ")).alias("scene_matches"))
    return f, fusion.valid_verdicts(p, f.filter("frame_id % 2 = 0"))


@query(f"WITH {SQL_VERDICT} SELECT video_id, must AS must_score, 0.0::DOUBLE AS should_score, coalesce(array_to_string(ids, ','), '') AS ranked, 'a' AS scenes FROM pl")
def verifier_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a verifier: frames it was not shown, repeats and odd numbers go."""
    v = _verdicts(spark, sf_dir)[1]
    return v.select("video_id", "must_score", "should_score", F.array_join(F.col("ranked_frame_ids").cast("array<string>"), ",").alias("ranked"), F.array_join("scene_matches", ",").alias("scenes"))


@query(f"WITH {SQL_VERDICT}, r AS (SELECT f.*, ids, list_position(ids, frame_id) - 1 AS p FROM frames f JOIN pl USING (video_id)) SELECT keyframe_uid, round(CASE WHEN frame_id % 2 = 0 THEN 0.7 * score + 0.3 * (1 - p / greatest(1, len(ids) - 1)) ELSE score END, 6) AS score FROM r")
def verifier_frame_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed frames move by their place in the verifier's list, others keep their score."""
    f, v = _verdicts(spark, sf_dir)
    return fusion.rerank_frames(f, v).select("keyframe_uid", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_VERDICT} SELECT video_id, round(CASE WHEN video_id % 4 = 0 THEN 0.5 ELSE 0.7 * CASE WHEN video_id % 5 = 0 THEN 0.5 ELSE 0.9 END + 0.2 * must END, 6) AS video_score FROM pl")
def verifier_video_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video scores with verdicts; where verification failed, or no base score is known, the video's own stands."""
    v = _verdicts(spark, sf_dir)[1]
    k = F.col("video_id")
    h = v.select("video_id", F.lit(0.5).alias("video_score"), F.when(k % 5 == 0, 0.0).otherwise(0.9).alias("base_video_score"))
    return fusion.verified(h, v.filter(k % 4 != 0)).select("video_id", F.round("video_score", 6).alias("video_score"))


@query("SELECT count(*) AS asked, count(DISTINCT c_mktsegment) AS coded FROM customer")
def encoder_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are coded once for each channel and revision, however often they are asked for."""
    asked = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).collect()  # a few segments
    calls: list[str] = []

    def code(texts_: list[str]) -> list[list[float]]:
        calls.extend(texts_)
        return [[float(len(t))] for t in texts_]

    e = Encoders({"clip": code})
    for r in asked:
        for _ in range(2):
            e.encode("clip", [r["c_mktsegment"]])
    return spark.createDataFrame([(sum(r["n"] for r in asked), len(calls))], "asked long, coded long")


@query("SELECT event_id, event_type FROM events")
def stream_ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in two deliveries which overlap, taken in by three runs: each is there once."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    src, out, state = (_aside(spark, x) for x in ("arrivals", "taken", "state"))
    run = lambda: ingest.ingest(ingest.read_stream(spark, src, "event_id long, event_type string"), out, state, "event_id").awaitTermination()
    e.filter("event_id % 3 != 0").write.parquet(src)
    run()
    e.filter("event_id % 3 != 1").write.mode("append").parquet(src)
    run()
    run()
    return spark.read.parquet(out).select("event_id", "event_type")
