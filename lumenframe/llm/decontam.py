"""Benchmark decontamination: a prefix-filtered join of item windows against documents."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_SEEN, mapped, packed, staged, utf8

#: Words of a window; a shorter item is one window as it is.
WINDOW = 10
#: Words of a shingle, the token of the prefix filter; a shorter window is one shingle.
SHINGLE = 3
#: Bits of the filter of shingles a key, and at most: 16 MB, whatever the size of the benchmark. A
#: fuller filter lets more documents' shingles through to the join, which drops them.
BITS_A_KEY, MOST_BITS = 64, 1 << 27
#: Windows, candidates or counts in a batch that a task hands on.
ROWS = 4096

#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes from 0x80, and turns the rest to blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_INSIDE = np.frombuffer(_FOLD, np.uint8) != 32
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def word_counts(texts: pa.Array) -> pa.Array:
    """How many ``words`` each text has, counted where they begin and without making them."""
    t = texts.cast(pa.large_binary()).fill_null(b"")
    cuts = np.frombuffer(t.buffers()[1] or bytes(8), np.int64)[t.offset : t.offset + len(t) + 1]
    inside = _INSIDE[np.frombuffer(t.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]]
    cuts = cuts - cuts[0]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = cuts[:-1][cuts[:-1] < cuts[1:]]
    begins[first] = inside[first]  # a word does not go on into the next text
    return pa.array(np.diff(np.searchsorted(np.flatnonzero(begins), cuts)), pa.int64())


def shingles(ws: Sequence[bytes], q: int) -> np.ndarray:
    """Hashes of the shingles of ``q`` words, in text order."""
    n = len(ws) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(zlib.crc32, ws), np.uint64, len(ws))
    h = np.full(n, q, np.uint64)
    for i in range(q):
        h = (h ^ w[i : i + n]) * _STEP
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


@dataclass
class Filter:
    """A Bloom filter of shingles, two bits each; it lets all of its keys through and few others."""

    bits: np.ndarray
    size: int

    def has(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` of what may be a key."""
        at = np.flatnonzero(self._bit(h & np.uint64(self.size - 1)))
        return at[self._bit((h[at] >> np.uint64(36)) & np.uint64(self.size - 1))]

    def _bit(self, p: np.ndarray) -> np.ndarray:
        return (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _filter(keys: DataFrame, most_bits: int) -> Filter:
    """The filter of column ``h`` (distinct). Its bitmap is made by the executors, 4 KB a row."""
    size = 1 << 15
    wanted = keys.count() * BITS_A_KEY
    while size < min(wanted, most_bits):
        size *= 2
    both = F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 36).bitwiseAND(F.lit(size - 1)))
    place = keys.select(F.explode(F.transform(both, lambda x: x + 1)).alias("p"))
    rows = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bits = np.zeros(size >> 3, np.uint8)
    for r in rows.toLocalIterator():  # at most MOST_BITS / 32768 rows
        at = (r["b"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["m"], np.uint8)
    return Filter(bits, size)


def _windows(benchmark: DataFrame) -> DataFrame:
    """``item``, ``window`` (MD5 of its words), ``n``, ``words`` and ``grams`` (its shingles in order) of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = words(text.as_py())
                n = min(WINDOW, len(ws))
                q = min(SHINGLE, n)
                grams = shingles(ws, q).view(np.int64) if n else np.zeros(0, np.int64)
                for lo in range(0, len(ws) - n + 1 if n else 0, ROWS):
                    at = range(lo, min(lo + ROWS, len(ws) - n + 1))
                    own = [b" ".join(ws[i : i + n]) for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(at), pa.string()), pa.array([hashlib.md5(x).digest() for x in own], pa.binary()), pa.array([n] * len(at), pa.int32()), pa.array(own, pa.binary()), pa.array([grams[i : i + n - q + 1] for i in at], pa.list_(pa.int64()))], names=["item", "window", "n", "words", "grams"])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    return mapped(benchmark.select(item.alias("item"), utf8().alias("text")), run, "item string, window binary, n int, words binary, grams array<long>")


def _occurrences(docs: DataFrame, sizes: list[int], known: Filter) -> DataFrame:
    """``h`` and ``n``: how often the shingles that pass the filter occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, pick = [], 0, shared.value.has

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for b in batches:
            for x in b.column(0):
                ws = words(x.as_py())
                for q in sizes:
                    h = shingles(ws, q)
                    held.append(h[pick(h)])
                    size += len(held[-1])
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
        yield flush()

    rows = mapped(docs.select(utf8().alias("text")), run, "h long, n long")
    return rows.groupBy("h").agg(F.sum("n").alias("n"))


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """For each window its rarest shingle ``h`` and the shingle's ``offset`` in words: containment of all needs this one."""
    grams = windows.select("window", F.posexplode("grams").alias("offset", "h"))
    best = grams.join(counts, "h", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("b"))
    return windows.select("window", "n", "words").join(best.select("window", "b.h", "b.offset"), "window")


def _candidates(docs: DataFrame, sizes: list[int], wanted: Filter) -> DataFrame:
    """Where a window's rarest shingle may lie in a text: ``key`` (MD5 of the text), ``h``, the
    word ``at`` which, the words around it (``near``) and how many of these are ahead of it.

    A copy of a text that a task has met before is not looked at again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick, done, out = shared.value.has, set(), []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "h", "at", "ahead", "near"])

        for b in batches:
            for x in b.column(0):
                text = x.as_py()
                key = hashlib.md5(text).digest()
                if key in done:
                    continue
                if len(done) > MOST_SEEN:
                    done.clear()
                done.add(key)
                ws = words(text)
                for q in sizes:
                    h = shingles(ws, q)
                    for i, v in zip((at := pick(h)).tolist(), h[at].view(np.int64).tolist(), strict=True):
                        lo = max(0, i - WINDOW + 1)
                        out.append((key, v, i, i - lo, b" ".join(ws[lo : i + WINDOW])))
                        if len(out) == ROWS:
                            yield batch()
                            out = []
        yield batch()

    return mapped(docs.select(utf8().alias("text")), run, "key binary, h long, at int, ahead int, near binary")


def _verified(candidates: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``key``, ``first``, ``last`` (words, ``last`` excluded) and ``window`` of all occurrences of windows.

    Candidates meet the windows of their shingle; length and position tell where the window would
    lie, and its words are compared one by one.
    """
    met = candidates.join(prefixes, "h").filter("ahead >= offset").select("key", "window", (F.col("at") - F.col("offset")).alias("first"), "n", (F.col("ahead") - F.col("offset")).alias("skip"), "near", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            skip, n = b.column(4).to_pylist(), b.column(3).to_pylist()
            ok = [near.as_py().split()[s : s + k] == want.as_py().split() for s, k, near, want in zip(skip, n, b.column(5), b.column(6), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok, pa.bool_())) for i in range(4)], names=["key", "window", "first", "n"])

    rows = mapped(met, run, "key binary, window binary, first int, n int")
    return rows.select("key", "window", "first", (F.col("first") + F.col("n")).alias("last")).distinct()


def _findings(hits: DataFrame, items: DataFrame) -> DataFrame:
    """``k`` (MD5 of a text), ``hit`` (words inside occurrences) and ``ids`` (items, sorted).

    Both lists are of one text: spans, of which it has fewer than words, and the ids that the
    result names anyway.
    """
    spans = hits.select("key", "first", "last").distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("s"))
    none = F.struct(F.lit(0).alias("far"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["far"], x["last"]).alias("far"), (a["n"] + F.greatest(x["last"] - F.greatest(x["first"], a["far"]), F.lit(0))).alias("n"))
    words_hit = F.aggregate("s", none, step, lambda a: a["n"])
    # Written down, so that this join is a stage of its own and a very common window can be split.
    named = staged(hits.select("key", "window").distinct().join(items, "window").select("key", "item"), "leak-items")
    ids = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    return spans.select("key", words_hit.alias("hit")).join(ids, "key").select(F.col("key").alias("k"), "hit", "ids")


def contamination(docs: DataFrame, benchmark: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Words of each document that lie inside a window of any benchmark item.

    The windows' shingles are counted over all documents in one pass; a second one sends each
    place where a window's rarest shingle occurs, with the words around it, to a join with the
    windows, which compares them word by word. A filter of bounded size keeps all other places at
    home. The documents come last, with a join to what was found in texts of their MD5; that
    table has a row per contaminated text, and the planner broadcasts it where it is small. Their
    words are counted in Python, as a regular expression in the JVM takes several times as long.

    Returns ``row`` (the input row), ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted),
    ``n_items``, ``items_sha256`` and ``contaminated``, one row for each input row.

    Defined cases: a null or empty text has no words and no hits; an item without words has no
    window; a null item id counts as ``null``; items that share an id count once; an empty
    benchmark leaves all documents clean, an empty table of documents gives an empty result;
    repeated documents are judged alike; very long texts are read whole; other columns of the
    documents, whatever their names, are carried in ``row``.
    """
    windows = staged(_windows(benchmark), "leak-windows")
    items = windows.select("window", "item").distinct()
    sizes = sorted(r["q"] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("q")).distinct().collect())  # 1, 2 or 3
    p = packed(docs, key=F.unhex(F.md5(utf8())), n_words=F.arrow_udf(word_counts, "long")(utf8()))
    if sizes:
        windows = staged(windows.groupBy("window").agg(*[F.first(c).alias(c) for c in ("n", "words", "grams")]), "leak-distinct")
        known = _filter(windows.select(F.explode("grams").alias("h")).distinct(), most_bits)
        prefixes = staged(_prefixes(windows, _occurrences(docs, sizes, known)), "leak-prefixes")
        wanted = _filter(prefixes.select("h").distinct(), most_bits)
        hits = staged(_verified(_candidates(docs, sizes, wanted), prefixes), "leak-hits")
        found = staged(_findings(hits, items), "leak-found")
        p = p.join(found, p["key"] == found["k"], "left")
    else:
        p = p.withColumns({"hit": F.lit(0).cast("long"), "ids": F.array().cast("array<string>")})
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return p.select("row", "n_words", hit.alias("n_hit"), ids.alias("items"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL = r"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wi AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dk AS (SELECT rid, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
  FROM dw, (SELECT DISTINCT n FROM wi) AS l, unnest(range(1, len(w) - n + 2)) AS u(p)),
hit AS (SELECT rid, item_id, p, dk.n FROM dk JOIN wi ON dk.n = wi.n AND dk.k = wi.k),
nh AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rid, p, n FROM hit), unnest(range(p, p + n)) AS u(q) GROUP BY rid),
ni AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid)
"""
