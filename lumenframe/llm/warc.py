"""WARC captures: reading records, and resolving not-modified revisits to earlier responses."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed

#: Headers of a 304 that replace those of the stored response; the rest describe the 304 itself.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Width of the time buckets, in seconds: a URI's captures are matched bucket by bucket.
BUCKET_SECONDS = 86_400
RECORD = "record_id string, record_type string, target_uri string, ts timestamp, status int, headers array<struct<name:string,value:string>>, payload_digest string, payload binary, error string"


def _headers(block: bytes) -> list[dict[str, str]]:
    out: list[dict[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1]["value"] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append({"name": name.strip().lower(), "value": value.strip()})
    return out


def _plain(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file that is plain or made of gzip members, piece by piece."""
    if data[:2] != b"\x1f\x8b":
        for lo in range(0, len(data), piece):
            yield data[lo : lo + piece]
        return
    at, d = 0, zlib.decompressobj(31)
    while at < len(data):
        rest = data[at : at + piece]
        at += len(rest)
        while rest:
            out = d.decompress(rest, piece)
            if out:
                yield out
            rest = d.unconsumed_tail
            if d.eof:
                # What follows a member is another one, or is left alone.
                at -= len(d.unused_data)
                if data[at : at + 2] != b"\x1f\x8b":
                    return
                d, rest = zlib.decompressobj(31), b""


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, one at a time. A damaged rest gives one row with ``error`` set."""
    pieces, buf, at, broken = _plain(data), bytearray(), 0, False

    def need(n: int) -> bool:
        nonlocal broken
        while len(buf) < n:
            try:
                more = next(pieces, None)
            except zlib.error:
                broken = True
                return False
            if more is None:
                return False
            buf.extend(more)
        return True

    def drop(n: int) -> None:
        nonlocal at
        del buf[:n]
        at += n

    while True:
        while need(2) and buf.startswith(b"\r\n"):
            drop(2)
        if not need(5):
            if buf.strip() or broken:
                yield {"error": f"no record at byte {at}"}
            return
        end, seen = -1, 0
        while buf.startswith(b"WARC/"):
            end = buf.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(buf)
            if end >= 0 or not need(seen + 1):
                break
        if end < 0:
            yield {"error": f"no record at byte {at}"}
            return
        fields = {h["name"]: h["value"] for h in _headers(bytes(buf[:end]).partition(b"\r\n")[2])}
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit()) or not need(end + 4 + int(size)):
            yield {"error": f"a record at byte {at} is cut short"}
            return
        body = bytes(buf[end + 4 : end + 4 + int(size)])
        drop(end + 4 + int(size))
        row = {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "payload_digest": fields.get("warc-payload-digest"), "payload": body, "headers": [], "status": None}
        if body.startswith(b"HTTP/") and fields.get("warc-type") in ("response", "revisit"):
            head, _, row["payload"] = body.partition(b"\r\n\r\n")
            first, _, rest = head.partition(b"\r\n")
            code = first.split()[1:2]
            row["status"] = int(code[0]) if code and code[0].isdigit() else None
            row["headers"] = _headers(rest)
        yield row


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path`` (plain or gzip, a file up to 2 GB), columns ``RECORD``.

    A task holds the stored bytes of a file and one record of it; gzip is undone piece by piece.
    """
    out = T.StructType.fromDDL(RECORD)
    fields = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(T.StructType([*out.fields[:3], T.StructField("ts", T.StringType()), *out.fields[4:]]))
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for r in parse_warc(content.as_py()):
                    r["ts"] = r.pop("date", None)
                    rows.append({k: r.get(k) for k in fields})
                    size += len(rows[-1]["payload"] or b"")
                    if len(rows) == 256 or size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    raw = T.StructType([*out.fields[:3], T.StructField("ts", T.StringType()), *out.fields[4:]])
    got = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, raw)
    return got.withColumn("ts", F.try_to_timestamp("ts")).select(*fields)


def canonical(uri: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without closing slashes, and the
    sorted query without ``utm_`` parameters; scheme and fragment are dropped. Null without ``://``."""
    rest = F.regexp_replace(F.substr(uri, F.instr(uri, "://") + 3), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.startswith(x, F.lit("utm_"))))
    query = F.array_join(params, "&")
    return F.when(F.instr(uri, "://") > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _lower(headers: Column) -> Column:
    pairs = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    return F.coalesce(F.filter(pairs, lambda h: h["name"].isNotNull()), F.array().cast("array<struct<name:string,value:string>>"))


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(F.filter(headers, lambda h: h["name"] == name), F.lit(1))["value"]


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Join each revisit to the latest full response of its canonical URL before it.

    ``records`` has ``record_id``, ``record_type``, ``target_uri``, ``ts``, ``status``,
    ``headers`` (name and value pairs) and ``payload_digest``. A full response is a ``response``
    of status 200. Times are cut in buckets: the latest response of each bucket is carried over a
    URL's buckets, and within a bucket the latest one before a revisit is taken. So a URL with a
    great share of all captures is spread over its buckets, and only a row per bucket meets.

    Returns one row per revisit: ``row``, ``uri``, ``response_id``, ``outcome``, ``status``,
    ``payload_digest`` and ``headers``. The outcome is

    * ``resolved``: the entity tags (compared weakly), else the modification dates, else the
      digests are there on both sides and agree; status, digest and headers are the response's,
      with the permitted headers of the revisit in place of its own,
    * ``mismatch``: that pair differs; nothing is taken over,
    * ``unchecked``: no pair is there on both sides; nothing is taken over,
    * ``missing``: no earlier response; also for a revisit without URL or time.

    Two responses at one time: the greater record id counts. Repeated revisits each give a row.
    A response at the very time of a revisit is not earlier. Long URLs and header lists are taken
    whole. An empty table gives an empty result. Other columns, whatever their names, are carried
    in ``row``.
    """
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.lower(F.col("record_type"))
    rows = packed(
        records,
        uri=canonical(F.col("target_uri")),
        at=time,
        full=F.coalesce((kind == "response") & (F.col("status") == 200), F.lit(False)),
        revisit=F.coalesce(kind == "revisit", F.lit(False)),
        rid=F.col("record_id"),
        h=_lower(F.col("headers")),
        digest=F.col("payload_digest"),
    )
    lost = rows.filter(F.col("revisit") & (F.col("uri").isNull() | F.col("at").isNull()))
    rows = rows.filter((F.col("full") | F.col("revisit")) & F.col("uri").isNotNull() & F.col("at").isNotNull())
    rows = rows.withColumn("bucket", F.floor(F.col("at") / (bucket_seconds * 1_000_000)))
    found = F.when(F.col("full"), F.struct("at", F.coalesce("rid", F.lit("")).alias("id"), "h", "digest", F.col("rid").alias("rid")))
    rows = rows.withColumn("found", found)
    # Only what matching needs goes on for responses; the input row does for revisits.
    rows = rows.withColumn("row", F.when(F.col("revisit"), F.col("row"))).drop("full")
    last = rows.groupBy("uri", "bucket").agg(F.max("found").alias("latest"))
    over = Window.partitionBy("uri").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("uri", "bucket", F.max("latest").over(over).alias("carried"))
    rows = rows.join(carried, ["uri", "bucket"])
    earlier = Window.partitionBy("uri", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("best", F.coalesce(F.max("found").over(earlier), F.col("carried"))).filter("revisit")
    rows = rows.select("row", "uri", "h", "digest", "best").unionByName(lost.select("row", "uri", "h", "digest").withColumn("best", F.lit(None).cast(rows.schema["best"].dataType)))

    tag = lambda c: F.regexp_replace(_header(c, "etag"), "^W/", "")
    theirs = F.col("best.h")
    pairs = [(tag(F.col("h")), tag(theirs)), (_header(F.col("h"), "last-modified"), _header(theirs, "last-modified")), (F.col("digest"), F.col("best.digest"))]
    agree = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in pairs])
    outcome = F.when(F.col("best").isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    rows = rows.withColumn("outcome", outcome)
    new = F.filter("h", lambda x: x["name"].isin(*PERMITTED))
    kept = F.filter(theirs, lambda x: ~F.array_contains(F.transform(new, lambda y: y["name"]), x["name"]))
    good = F.col("outcome") == "resolved"
    return rows.select(
        "row",
        "uri",
        F.col("best.rid").alias("response_id"),
        "outcome",
        F.when(good, F.lit(200)).alias("status"),
        F.when(good, F.col("best.digest")).alias("payload_digest"),
        F.when(good, F.array_sort(F.concat(kept, new))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A capture history for the ``pages`` table: a full response for each page, and a revisit of it.

    Page n is fetched n minutes after the epoch and asked for again 50000 seconds later under a variant of
    its URL. Every fifth page has changed its entity tag by then; every third revisit of the rest
    has only a modification date and every third only a digest. A null page id gives records
    without id, time or validators of their own; a null url gives records without URL, whose
    revisit is ``missing``; null html is the empty body.
    """
    n = F.col("page_id")
    digest = F.concat(F.lit("md5:"), F.md5(F.coalesce("html", F.lit(""))))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    etag, day = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"')), F.concat(F.lit("day "), (n / 1440).cast("long").cast("string"))
    first = F.struct(
        F.concat(F.lit("r"), n.cast("string")).alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), F.timestamp_seconds(n * 60).alias("ts"), F.lit(200).alias("status"),
        F.array(pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), pair("ETag", etag), pair("Last-Modified", day), pair("Date", n.cast("string"))).alias("headers"),
        digest.alias("payload_digest"),
    )
    told = F.when(n % 5 == 0, F.array(pair("ETag", F.lit('"changed"')))).when(n % 3 == 0, F.array(pair("Last-Modified", day))).when(n % 3 == 1, F.array(pair("ETag", F.concat(F.lit("W/"), etag)))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    again = F.struct(
        F.concat(F.lit("v"), n.cast("string")).alias("record_id"), F.lit("revisit").alias("record_type"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("target_uri"), F.timestamp_seconds(n * 60 + 50_000).alias("ts"), F.lit(304).alias("status"),
        F.concat(told, F.array(pair("Date", (n + 1).cast("string")), pair("Content-Length", F.lit("0")), pair("Cache-Control", F.lit("max-age=60")))).alias("headers"),
        F.when((n % 5 != 0) & (n % 3 == 2), digest).alias("payload_digest"),
    )
    return pages.select(F.explode(F.array(first, again)).alias("r")).select("r.*")


SQL = r"""
WITH p AS (SELECT page_id AS n, url, coalesce(html, '') AS html, regexp_replace(substr(url, instr(url, '://') + 3), '#.*$', '') AS rest FROM pages),
c AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&'), ''), '') END AS uri,
  'md5:' || md5(html) AS digest, '"' || substr(md5(html), 1, 12) || '"' AS etag, 'day ' || (n // 1440) AS day FROM p),
v AS (SELECT *, n * 60 + 50000 AS t FROM c),
b AS (SELECT v.n, v.uri, v.t, max(c.n) AS m FROM v LEFT JOIN c ON c.uri = v.uri AND c.n * 60 < v.t GROUP BY v.n, v.uri, v.t),
j AS (SELECT b.n, b.uri, b.m, v.digest AS vd, v.etag AS ve, v.day AS vday, c.digest, c.etag, c.day, strlen(c.html) AS len
  FROM b JOIN v ON b.n = v.n LEFT JOIN c ON c.n = b.m),
o AS (SELECT *, CASE WHEN m IS NULL THEN 'missing' WHEN n % 5 = 0 THEN 'mismatch'
    WHEN n % 3 = 0 THEN CASE WHEN vday = day THEN 'resolved' ELSE 'mismatch' END
    WHEN n % 3 = 1 THEN CASE WHEN ve = etag THEN 'resolved' ELSE 'mismatch' END
    WHEN vd = digest THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT 'v' || n AS revisit_id, uri, 'r' || m AS response_id, outcome, CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60|content-length: ' || len || '|content-type: text/html|date: ' || (n + 1)
    || '|etag: ' || CASE WHEN n % 3 = 1 THEN 'W/' || ve ELSE etag END || '|last-modified: ' || CASE WHEN n % 3 = 0 THEN vday ELSE day END END AS headers
FROM o
"""
