"""Writers: catalogs, snapshots, postings, vector shards, submissions."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import hashing
from ..functions import text as T


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write beside ``path`` and rename into place; an existing ``path`` is refused."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if fs.exists(p(path)):
        raise FileExistsError(path)
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(aside)
    fs.mkdirs(p(path).getParent())
    if not fs.rename(p(aside), p(path)):
        fs.delete(p(aside), True)
        raise FileExistsError(path)


def publish_catalog(frames: DataFrame, path: str) -> dict:
    """A sorted CSV catalog, then its state (rows and digest): data first, state last."""
    spark = frames.sparkSession
    d = frames.select(*[c.split()[0] for c in schemas.FRAMES.split(", ")])
    publish(d.repartitionByRange("video_id", "local_idx").sortWithinPartitions("video_id", "local_idx"), f"{path}/frames", "csv", header=True)
    r = d.agg(F.count(F.lit(1)).alias("rows"), hashing.combine_digest(F.col("keyframe_uid")).cast("string").alias("uid_digest")).first()
    state = {"rows": r["rows"], "uid_digest": r["uid_digest"]}
    publish(spark.createDataFrame([(r["rows"], r["uid_digest"])], "rows long, uid_digest string").coalesce(1), f"{path}/state", "json")
    return state


def publish_manifests(items: DataFrame, path: str, field: str, order: list[str], version: int, by: str = "manifest_video_id") -> None:
    """A JSON manifest a line for each video, ``{schema_version, video_id, <field>: [...]}`` with the items in order; an existing path is refused."""
    rest = [c for c in items.columns if c != by]
    listed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("item"))))  # a video's items
    m = items.groupBy(by).agg(listed.alias("l")).select(F.lit(version).alias("schema_version"), F.col(by).alias("video_id"), F.transform("l", lambda x: x["item"]).alias(field))
    publish(m, path, "json")


def append_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in new files beside those at ``path``."""
    rows.write.mode("append").json(path)


def rewrite_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in place of what is at ``path``: written aside, and moved there once they are whole."""
    spark = rows.sparkSession
    fs, p = _fs(spark, path)
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.json(aside)
    fs.delete(p(path), True)
    if not fs.rename(p(aside), p(path)):
        raise RuntimeError(f"{aside} could not be moved to {path}")


def publish_snapshot(records: DataFrame, root: str, created: str) -> str:
    """An immutable snapshot folder named by time and content; returns its name.

    ``created`` is a UTC time as ``yyyyMMddTHHmmssZ``. Equal rows give an equal digest whatever
    their order.
    """
    rows = records.select(*[c.split()[0] for c in schemas.SNAPSHOT.split(", ")])
    digest = rows.agg(F.sum(F.conv(F.substring(F.md5(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})), 1, 14), 16, 10).cast("decimal(20,0)")).cast("string").alias("d"), F.count(F.lit(1)).alias("n")).first()
    name = f"ocr-snapshot-{created}-{hashlib.sha256(f'{digest['d']}:{digest['n']}'.encode()).hexdigest()[:12]}"
    publish(rows.repartitionByRange("video_id", "keyframe_uid").sortWithinPartitions("video_id", "keyframe_uid"), f"{root}/{name}")
    return name


def build_postings(snapshot: DataFrame) -> DataFrame:
    """Term postings of successful rows: term, keyframe_uid, video_id, frequency, n_terms."""
    d = snapshot.filter("status = 'success'").select("keyframe_uid", "video_id", T.index_terms(F.col("detected_text")).alias("terms"))
    return d.select("keyframe_uid", "video_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).groupBy("term", "keyframe_uid", "video_id", "n_terms").agg(F.count(F.lit(1)).alias("frequency"))


def probe_postings(postings: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows whose longest term does not lead back to them: empty for a sound index."""
    d = snapshot.filter("status = 'success'").select("keyframe_uid", T.index_terms(F.col("detected_text")).alias("terms"))
    longest = F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    d = d.select("keyframe_uid", longest.alias("term")).filter("term is not null")
    return d.join(postings.select("keyframe_uid", "term"), ["keyframe_uid", "term"], "left_anti")


def publish_vectors(vectors: DataFrame, path: str, shard: str) -> None:
    """One shard of vectors as a folder of its own; a shard that is there is refused."""
    publish(vectors, f"{path}/shard={shard}")


def npy_shards(vectors: DataFrame) -> DataFrame:
    """Shard files (path, content) of rows of shard, keyframe_uid and vector, as ``.npy``; a shard is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for kind, values in (("uids", np.array([r["keyframe_uid"] for r in rows], np.int64)), ("vectors", np.array([r["vector"] for r in rows], np.float32))):
                    out = io.BytesIO()
                    np.save(out, values)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{shard}.{kind}.npy"], pa.string()), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    listed = vectors.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("keyframe_uid", "vector"))).alias("rows"))
    return listed.mapInArrow(run, "path string, content binary")


def submission_lines(rows: DataFrame, task: str) -> DataFrame:
    """The lines of one query's CSV in order (``position``): no header, quotes only where needed."""
    need = lambda c: F.when(c.rlike('[",\r\n]') | (c == ""), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cols = [need(F.col(c).cast("string")) for c in schemas.SUBMISSION[task] if c != "frame_ids"]
    if task == "TRAKE":
        cols.append(F.array_join(F.col("frame_ids").cast("array<string>"), ","))
    return rows.select("position", F.concat_ws(",", *cols).alias("line"))


def submission_zip(drafts: dict[str, DataFrame]) -> bytes:
    """A ZIP with ``<query>.csv`` per query (``submission_lines``), opened again and compared.

    A query has 100 rows at most, so a draft is fetched whole.
    """
    files = {}
    for name, d in drafts.items():
        lines = [r["line"] for r in d.orderBy("position").limit(101).collect()]
        if not 1 <= len(lines) <= 100:
            raise ValueError(f"{name} must have 1 to 100 rows")
        files[f"{name}.csv"] = "".join(f"{x}\n" for x in lines).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, data in sorted(files.items()):
            z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), data)
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if {n: z.read(n) for n in z.namelist()} != files:
            raise RuntimeError("the archive does not hold what was written")
    return data
