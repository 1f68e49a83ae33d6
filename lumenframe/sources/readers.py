"""Readers: catalogs, JSON lines, manifests, recognised frames, vectors, bundles, listings, checksums."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .. import schemas
from ..functions import text as T


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A frame catalog in CSV. The header must be the schema's and every value of its type; a null is empty."""
    header = spark.read.text(path).filter(F.col("value") != "").groupBy(F.input_file_name()).agg(F.first("value").alias("h")).select("h").distinct()
    want = ",".join(c.split()[0] for c in schemas.FRAMES.split(", "))
    for r in header.limit(2).collect():
        if r["h"] != want:
            raise ValueError(f"the header is not {want}")
    return spark.read.schema(schemas.FRAMES).options(header=True, enforceSchema=False, mode="FAILFAST", nullValue="").csv(path)


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """Keys of a catalog that are not unique, by key, and ids that are not positive."""
    out = None
    for name, keys in (("keyframe_uid", ["keyframe_uid"]), ("video_frame", ["video_id", "frame_id"]), ("video_local", ["video_id", "local_idx"])):
        d = catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(name).alias("key"), F.to_json(F.struct(*keys)).alias("value"))
        out = d if out is None else out.unionByName(d)
    return out.unionByName(catalog.filter("keyframe_uid <= 0").select(F.lit("positive_uid").alias("key"), F.col("keyframe_uid").cast("string").alias("value")))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a line that is no object of the schema fails the query with its text."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = ~F.col("value").rlike(r"^\s*\{") | F.try_parse_json("value").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200))).cast("boolean")).otherwise(True)
    return lines.filter(checked).select(row.alias("r")).select("r.*")


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """File and text of the lines that are no JSON objects."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").filter(F.trim("value") != "")
    return lines.filter(~F.col("value").rlike(r"^\s*\{") | F.try_parse_json("value").isNull())


def read_manifest(spark: SparkSession, path: str, field: str, item: str, version: int, lines: bool = False) -> DataFrame:
    """Items of JSON manifests ``{schema_version, <field>: [...]}``, a file each or a line each; another version fails the query."""
    m = spark.read.schema(f"schema_version int, video_id string, {field} array<struct<{item}>>").option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    right = F.coalesce(F.col("schema_version") == version, F.lit(False))
    m = m.filter(F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none"))) ).cast("boolean")))
    return m.select(F.col("video_id").alias("manifest_video_id"), F.explode(field).alias("x")).select("manifest_video_id", "x.*")


def plan_violations(items: DataFrame) -> DataFrame:
    """Manifests of keyframes (manifest_video_id and FRAMES) whose parts do not fit: rows of another video, repeated ids, frames that do not rise."""
    w = Window.partitionBy("manifest_video_id").orderBy("local_idx")
    d = items.withColumn("rises", F.coalesce(F.col("frame_id") > F.lag("frame_id").over(w), F.lit(True))).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("manifest_video_id", "keyframe_uid")))
    tests = [(~F.col("video_id").eqNullSafe(F.col("manifest_video_id")), "other_video"), (F.col("same") > 1, "duplicate_uid"), (~F.col("rises"), "not_rising")]
    reasons = F.array_compact(F.array(*[F.when(t, n) for t, n in tests]))
    return d.select("manifest_video_id", "local_idx", F.explode(reasons).alias("reason"))


def shot_violations(shots: DataFrame) -> DataFrame:
    """Manifests of shots (manifest_video_id and SHOTS) with turned ranges, overlaps, or ids that do not count from ``s000001``."""
    w = Window.partitionBy("manifest_video_id").orderBy("start_frame", "shot_id")
    d = shots.withColumn("n", F.row_number().over(w)).withColumn("reached", F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    tests = [(F.col("end_frame") < F.col("start_frame"), "range"), (F.col("start_frame") <= F.col("reached"), "overlap"), (F.col("shot_id") != T.padded_id("s", F.col("n")), "numbering")]
    reasons = F.array_compact(F.array(*[F.when(t, n) for t, n in tests]))
    return d.select("manifest_video_id", "shot_id", F.explode(reasons).alias("reason"))


def snapshot_from_envelopes(envelopes: DataFrame) -> DataFrame:
    """Snapshot rows: text, language and confidence only of successful readings."""
    ok = F.col("status") == "success"
    return envelopes.select("video_id", "keyframe_uid", "frame_id", "status", "engine", F.when(ok, F.concat_ws("\n", "result.detected_text")).alias("detected_text"), F.when(ok, F.col("result.language")).alias("language"), F.when(ok, F.col("result.confidence")).alias("confidence"))


def snapshot_from_regions(frames: DataFrame, text: str = "easyocr_text", confidence: str = "easyocr_confidence") -> DataFrame:
    """Snapshot rows of frames with regions, of the first reading or of the final one.

    A frame that claims text and has none is an error. Confidence is weighted by visible
    characters; the engine is vintern if any final reading is.
    """
    some = F.filter("regions", lambda r: F.trim(F.coalesce(r[text], F.lit(""))) != "")
    status = F.when((F.col("status") == "text_detected") & (F.size(some) > 0), "success").when(F.col("status") == "text_detected", "error").otherwise(F.col("status"))
    total = lambda f: F.aggregate(some, F.lit(0.0), lambda a, r: a + f(r))
    weight = lambda r: T.visible_length(r[text]).cast("double")
    mean = F.try_divide(total(lambda r: weight(r) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r[confidence], F.lit(0.0))))), total(weight))
    ok = status == "success"
    said = F.col("frame_mixed_candidate") if "frame_mixed_candidate" in frames.columns else None
    language = T.frame_language(F.exists("regions", lambda r: F.coalesce(r["has_vi_marks"], F.lit(False))), F.exists("regions", lambda r: F.coalesce(r["has_ascii_word"], F.lit(False))), said)
    engine = F.when(F.exists("regions", lambda r: F.coalesce(r["final_engine"] == "vintern", F.lit(False))), "vintern").otherwise("easyocr") if text == "final_text" else F.lit("easyocr")
    return frames.select("video_id", "keyframe_uid", "frame_id", status.alias("status"), engine.alias("engine"), F.when(ok, F.array_join(F.transform(some, lambda r: F.trim(r[text])), "\n")).alias("detected_text"), F.when(ok, language).alias("language"), F.when(ok, mean).alias("confidence"))


def read_npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of ``.npy`` shards: ``shard-<n>.uids.npy`` beside ``shard-<n>.vectors.npy`` (two-dimensional); see ``npy_vectors``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return npy_vectors(files.select("path", "content"))


def npy_vectors(files: DataFrame) -> DataFrame:
    """Vectors of shard files (path, content): shard, position, keyframe_uid and vector (float).

    A shard whose parts differ in length, or lacks one, fails the query. A shard is read whole by
    one task, as it was written.
    """
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select(F.regexp_extract(name, r"^(.*)\.(?:uids|vectors)\.npy$", 1).alias("shard"), F.regexp_extract(name, r"\.(uids|vectors)\.npy$", 1).alias("kind"), "content")
    both = parts.groupBy("shard").agg(F.max(F.when(F.col("kind") == "uids", F.col("content"))).alias("u"), F.max(F.when(F.col("kind") == "vectors", F.col("content"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, u, v in zip(*(b.column(i) for i in range(3)), strict=True):
                if not u.is_valid or not v.is_valid:
                    raise ValueError(f"shard {shard} lacks a part")
                uids, m = (np.load(io.BytesIO(x.as_py()), allow_pickle=False) for x in (u, v))
                if m.ndim != 2 or len(uids) != len(m):
                    raise ValueError(f"shard {shard} has {len(uids)} ids and vectors of shape {m.shape}")
                m = m.astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(m), pa.string()), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(uids.astype(np.int64)), flat], names=["shard", "position", "keyframe_uid", "vector"])

    return both.mapInArrow(run, f"shard string, position int, {schemas.VECTORS}")


def shard_gaps(shards: DataFrame) -> DataFrame:
    """Numbers between 0 and the greatest that no shard ``shard-<n>`` has."""
    n = shards.select(F.regexp_extract("shard", r"([0-9]+)$", 1).cast("long").alias("n")).distinct()
    w = Window.orderBy("n")  # a row a shard
    d = n.select("n", F.coalesce(F.lag("n").over(w), F.lit(-1)).alias("before"))
    return d.filter("n > before + 1").select(F.explode(F.sequence(F.col("before") + 1, F.col("n") - 1)).alias("shard"))


def vector_violations(vectors: DataFrame, catalog: DataFrame, dim: int) -> DataFrame:
    """Vectors of another dimension, without a catalog row, twice there, or not of unit length; catalog rows without a vector."""
    size = F.size("vector")
    norm = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    v = vectors.select("keyframe_uid", size.alias("dim"), norm.alias("norm"))
    j = v.join(catalog.select(F.col("keyframe_uid").alias("c")), F.col("keyframe_uid") == F.col("c"), "full_outer")
    reason = F.when(F.col("keyframe_uid").isNull(), "missing").when(F.col("c").isNull(), "foreign").when(F.col("dim") != dim, "dimension").when(F.abs(F.col("norm") - 1) > 1e-2, "norm")
    out = j.select(F.coalesce("keyframe_uid", "c").alias("keyframe_uid"), reason.alias("reason")).filter("reason is not null")
    return out.unionByName(v.groupBy("keyframe_uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("keyframe_uid", F.lit("duplicate").alias("reason")))


def read_query_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a folder of ``.txt`` files or of a ``.zip`` with them at its root, in natural order; see ``query_specs``."""
    if path.endswith(".zip"):
        rows = []
        for f in spark.read.format("binaryFile").load(path).select("content").toLocalIterator():
            with zipfile.ZipFile(io.BytesIO(bytes(f["content"]))) as z:
                rows += [(n, z.read(n).decode("utf-8-sig")) for n in z.namelist() if "/" not in n and n.endswith(".txt")]
        d = spark.createDataFrame(rows, "file string, raw_query string")
    else:
        d = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw_query"))
    return query_specs(d).orderBy(T.natural_key(F.col("query_name")))


def query_specs(files: DataFrame) -> DataFrame:
    """Queries of text files (file, raw_query): query_name, raw_query, task and event_count.

    The task is the name's suffix; a TRAKE query counts its events, whose numbers must be 1 to the
    greatest, in any order. A name without a task, a repeated name and a gap fail the query.
    """
    name = F.regexp_replace("file", r"(?i)\.txt$", "")
    task = F.upper(F.regexp_extract(name, r"(?i)-(kis|qa|trake)$", 1))
    d = files.select(name.alias("query_name"), F.trim("raw_query").alias("raw_query"), F.when(task == "", F.raise_error(F.concat(F.lit("no task in name: "), name))).otherwise(task).alias("task"))
    again = F.count(F.lit(1)).over(Window.partitionBy("query_name")) > 1
    d = d.withColumn("again", again).filter(F.when(F.col("again"), F.raise_error(F.concat(F.lit("a name is there twice: "), F.col("query_name"))).cast("boolean")).otherwise(True)).drop("again")
    events = T.events(F.col("raw_query"))
    numbers = F.transform(events, lambda e: e["n"])
    n = F.when(F.col("task") == "TRAKE", F.when(T.contiguous(events), F.array_max(numbers)).otherwise(F.raise_error(F.concat(F.lit("events are not numbered without a gap: "), F.col("query_name"))).cast("int"))).otherwise(0)
    return d.withColumn("event_count", n)


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files under a folder by extension, with stem and size; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    d = files.select("path", "length", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"))
    return d.filter(F.col("extension").isin(*extensions)).orderBy("path")


def probe_rows(probes: DataFrame) -> DataFrame:
    """Inventory rows from probe output (video_id, relative_path, probe JSON).

    Rates are ``a/b``; the length falls back from the stream to the container, the number of
    frames to length times rate.
    """
    schema = "streams array<struct<codec_type:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,duration:string>>, format struct<duration:string>"
    p = probes.withColumn("j", F.from_json("probe", schema))
    v = F.try_element_at(F.filter("j.streams", lambda s: s["codec_type"] == "video"), F.lit(1))
    p = p.withColumn("v", v)

    def rate(c):
        parts = F.split(c, "/")
        return F.try_divide(parts[0].try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)))

    fps = F.coalesce(F.nullif(rate(F.col("v.avg_frame_rate")), F.lit(0.0)), F.nullif(rate(F.col("v.r_frame_rate")), F.lit(0.0)))
    length = F.coalesce(F.col("v.duration").try_cast("double"), F.col("j.format.duration").try_cast("double"))
    audio = F.exists("j.streams", lambda s: s["codec_type"] == "audio")
    out = p.select("video_id", "relative_path", "v.width", "v.height", fps.alias("fps"), length.alias("duration"), F.coalesce(F.col("v.nb_frames").try_cast("long"), F.round(length * fps).cast("long")).alias("frame_count"), audio.alias("has_audio"))
    return out.to(T_.StructType.fromDDL(schemas.INVENTORY))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``checksums`` of a file."""
    return checksums(spark.read.text(path))


def checksums(lines: DataFrame) -> DataFrame:
    """sha256 and name of ``<64 hex>  <name>`` lines (value); a line of another form fails the query."""
    d = lines.filter(F.col("value") != "")
    good = F.col("value").rlike(r"^[0-9a-f]{64}  [^/\s][^\s]*$")
    d = d.filter(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not a checksum line: "), F.col("value"))).cast("boolean")))
    return d.select(F.substring("value", 1, 64).alias("sha256"), F.substr("value", F.lit(67)).alias("name"))


def remote_state(expected: DataFrame, remote: DataFrame) -> DataFrame:
    """One row: missing, complete, partial or foreign, from the names and digests of a remote listing."""
    j = expected.select("name", F.col("sha256").alias("want")).join(remote.select("name", F.col("sha256").alias("have")), "name", "full_outer")
    a = j.agg(F.count_if(F.col("want") == F.col("have")).alias("same"), F.count("want").alias("n"), F.count_if(F.col("want").isNull()).alias("extra"), F.count_if(F.col("have").isNotNull() & (F.col("want") != F.col("have"))).alias("changed"))
    return a.select(F.when((F.col("extra") > 0) | (F.col("changed") > 0), "foreign").when(F.col("same") == 0, "missing").when(F.col("same") == F.col("n"), "complete").otherwise("partial").alias("state"))
