"""Near-duplicate classes by order MinHash, verified by banded alignment of words."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_SEEN, mapped, packed, staged, utf8
from .components import components

#: Words of a shingle, and sketches of a text, each of two shingles in text order.
WORDS, SKETCHES = 5, 28
#: A text of fewer shingles also has as many sketches of one shingle: an edit spoils most of its pairs.
SHORT = 20
#: Least similarity of a link: 1 - edit distance in words / words of the longer text.
SIMILARITY = 0.8
#: Bins of a text's word counts, and members of a block where a bucket is settled pair by pair: by counts, and by alignment.
BINS, BLOCK, ALIGNED_BLOCK = 64, 1000, 128

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_ODD = (np.random.default_rng(20).integers(0, 1 << 63, SKETCHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(ws: Sequence[bytes]) -> np.ndarray:
    """Hashes of the five-word shingles in text order, each made distinct by its number of earlier occurrences."""
    crc = zlib.crc32
    w = np.array([crc(x) for x in ws], np.uint64)
    n = len(w) - WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(WORDS):
        h = h * np.uint64(0x100000001B3 * 2 + 1) + w[i : i + n]
    h = _scramble(h)
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(same, 0, place))
        h[order] += (place - start).astype(np.uint64) * _MIX
    return h


def sketches(ws: Sequence[bytes]) -> list[int]:
    """``SKETCHES`` order-min-hashes: of the two least shingles under a hash, the pair in text order.

    Short texts have sketches of the least shingle alone beside them.
    """
    h = shingles(ws)
    out: list[int] = []
    if not len(h):
        return out
    short = len(h) < SHORT
    for i, odd in enumerate(_ODD):
        x = _scramble(h * odd)
        a = int(x.argmin())
        first = x[a]
        if len(x) > 1:
            x[a] = np.uint64(0xFFFFFFFFFFFFFFFF)
            b = int(x.argmin())
            pair = (int(first), int(x[b])) if a < b else (int(x[b]), int(first))
        else:
            pair = (int(first), 0)
        out.append(((pair[0] * 0x9E3779B97F4A7C15 + pair[1]) * 0xD6E8FEB86659FD93 + i) % (1 << 64) - (1 << 63))
        if short:
            out.append((int(first) * 0xD6E8FEB86659FD93 + SKETCHES + i) % (1 << 64) - (1 << 63))
    return out


def _masks(p: Sequence) -> dict:
    out: dict = {}
    bit = 1
    for x in p:
        out[x] = out.get(x, 0) | bit
        bit <<= 1
    return out


def _distance(p: Sequence, t: Sequence) -> int:
    """Edit distance, a column of the table as one number (Myers 1999)."""
    if not p:
        return len(t)
    full, top, masks = (1 << len(p)) - 1, 1 << (len(p) - 1), _masks(p)
    vp, vn, d = full, 0, len(p)
    for c in t:
        x = masks.get(c, 0)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        d += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1 | 1) & full, (hn << 1) & full
        vp, vn = hn | (full & ~(d0 | hp)), d0 & hp
    return d


def within(p: Sequence, t: Sequence, most: int) -> bool:
    """Whether the edit distance is at most ``most``, by alignment in a band of that half-width.

    The band's column is one number whose window moves down a row with each word (Hyyro 2003).
    The distance is followed along the band's lower edge to the last row, then along that row.
    """
    if abs(len(p) - len(t)) > most:
        return False
    lo = 0
    for a, b in zip(p, t, strict=False):
        if a != b:
            break
        lo += 1
    p, t = p[lo:], t[lo:]
    hi = 0
    for a, b in zip(reversed(p), reversed(t), strict=False):
        if a != b:
            break
        hi += 1
    p, t = p[: len(p) - hi], t[: len(t) - hi]
    m, n, k = len(p), len(t), most
    if max(m, n) <= k:
        return True
    if min(m, n) <= k:
        return _distance(p, t) <= k
    width = 2 * k + 1
    full, top, masks = (1 << width) - 1, 1 << (width - 1), _masks(p)
    vp, vn, d = full ^ ((1 << k) - 1), 0, k
    edge = top
    for j, c in enumerate(t):
        x = masks.get(c, 0)
        x = ((x >> (j - k)) if j >= k else (x << (k - j))) & full
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        d0 &= full
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        if j < m - k:
            d += not d0 & top
            if d > 2 * k + n - m:
                return False
        else:
            edge >>= 1
            d += bool(hp & edge) - bool(hn & edge)
            if d > k + n - 1 - j:
                return False
        half = d0 >> 1
        vp, vn = hn | (full & ~(half | hp)), half & hp
    return d <= k


def most_edits(n: int, m: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * max(n, m) + 1e-9)


def _key(text: bytes, ws: list[bytes]) -> bytes:
    """Equal for texts of equal words; a text without words is keyed by its bytes."""
    return hashlib.md5(b" ".join(ws) if ws else b"\0" + text).digest()


def _keyed(p: DataFrame) -> DataFrame:
    """``p`` (ending in ``text``, binary) with ``key`` in place of the text."""
    others = p.columns[:-1]
    out = T.StructType([*(p.schema[c] for c in others), T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(t, words(t)) for t in (x.as_py() for x in b.column(len(others)))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), pa.array(keys, pa.binary())], names=[*others, "key"])

    return mapped(p, run, out)


def _sketched(docs: DataFrame) -> DataFrame:
    """A row per distinct word sequence: ``key``, ``doc_id`` (least), ``n``, ``bands``, ``packed`` (compressed words)."""
    out = T.StructType.fromDDL("doc_id long, key binary, n int, bands array<long>, packed binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        done: set[bytes] = set()
        for b in batches:
            keys, sizes, bands, texts = [], [], [], []
            for x in b.column(1):
                t = x.as_py()
                ws = words(t)
                keys.append(_key(t, ws))
                # A copy met before in this task brings only its id.
                again = keys[-1] in done
                done.add(keys[-1])
                sizes.append(len(ws))
                bands.append(None if again else sketches(ws))
                texts.append(None if again or len(ws) < WORDS else pack(b" ".join(ws)))
            if len(done) > MOST_SEEN:
                done.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(texts, pa.binary())], names=out.fieldNames())

    rows = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), run, out)
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), one("n"), one("bands"), one("packed"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) with ``ok``: whether the alignment reaches the similarity."""
    t = texts.select("key", "packed")
    rows = pairs.join(t.withColumnsRenamed({"key": "a", "packed": "pa"}), "a").join(t.withColumnsRenamed({"key": "b", "packed": "pb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        split = functools.lru_cache(64)(lambda z: unpack(z).split())
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, t = unpack(x.as_py()).split(), split(y.as_py())
                ok.append(within(p, t, most_edits(len(p), len(t), similarity)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return mapped(rows.select("a", "b", "pa", "pb"), run, "a binary, b binary, ok boolean")


def _stars(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links found by joining each bucket as a star.

    Each member meets one member of its bucket, the hub, so the pairs grow with the members.
    Members that do not match their hub meet the bucket's other end, and then the hub of finer
    buckets, of two sketches at once, formed by such members alone.
    """
    seen = None
    for bucket, pick in (("bucket", F.min), ("bucket", F.max), ("finer", F.min)):
        ends = members.groupBy(bucket).agg(pick(F.struct("key", "size")).alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        met = members.join(ends.select(bucket, "hub"), bucket).filter(F.col("key") != F.col("hub.key"))
        near = F.abs(F.col("size") - F.col("hub.size")) <= F.floor((1 - similarity) * F.greatest("size", "hub.size") + 1e-9)
        met = staged(met.select("key", "size", "bucket", "finer", F.col("hub.key").alias("hub"), near.alias("near")), "dup-met")
        pairs = met.filter("near").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
        tried = staged(_verified(pairs, texts, similarity), "dup-tried")
        seen = tried if seen is None else seen.unionByName(tried)
        good = tried.filter("ok")
        left = met.join(good, (met["key"] == good["a"]) & (met["hub"] == good["b"]), "left_anti")
        members = left.select("key", "size", "bucket", "finer").distinct()
    return seen.filter("ok").select("a", "b")


def _bag(ws: Sequence[bytes]) -> bytes:
    """A text's word counts in ``BINS`` bins by hash."""
    bins = np.array([zlib.crc32(x) % BINS for x in ws], np.int64)
    return np.minimum(np.bincount(bins, minlength=BINS), 32767).astype("<i2").tobytes()


def _bagged(texts: DataFrame) -> DataFrame:
    """``key``, ``bands`` and ``bag`` of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_bag(unpack(x.as_py()).split()) for x in b.column(2)], pa.binary())], names=["key", "bands", "bag"])

    return mapped(texts.select("key", "bands", "packed"), run, "key binary, bands array<long>, bag binary")


def likely(size: np.ndarray, root: np.ndarray, side: np.ndarray, bag: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of different roots and sides that counts of words allow to be similar.

    An edit takes one word from a bin at most and adds one to a bin at most, so no pair that the
    alignment would accept is left out. Side -1 is other than any.
    """
    order = np.argsort(size, kind="stable")
    n, root, side, bag = size[order].astype(np.int64), root[order], side[order], bag[order]
    total, most = bag.sum(1, dtype=np.int64), np.floor((1 - similarity) * n + 1e-9).astype(np.int64)
    left, right = [], []
    for lo in range(0, len(n), 64):
        i = np.arange(lo, min(lo + 64, len(n)))
        j = np.arange(lo, np.searchsorted(n - most, n[i[-1]], "right"))
        # The longer text, j, says how many edits there may be.
        ok = (j > i[:, None]) & (root[i][:, None] != root[j]) & ((side[i][:, None] != side[j]) | (side[j] < 0)) & (n[j] - n[i][:, None] <= most[j])
        x, y = np.nonzero(ok)
        for at in range(0, len(x), 1 << 15):
            a, b = i[x[at : at + (1 << 15)]], j[y[at : at + (1 << 15)]]
            more = np.maximum(bag[a] - bag[b], 0).sum(1, dtype=np.int64)
            fit = (more <= most[b]) & (more - total[a] + total[b] <= most[b])
            left.append(order[a[fit]])
            right.append(order[b[fit]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Members of buckets in pairs of blocks, ``lo`` and ``hi``: each two members meet in one cell.

    ``side`` tells the blocks of a cell apart, and is -1 where it is one block with itself.
    """
    c = staged(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")), "dup-sizes")
    g = F.ceil(F.col("c") / block)
    d = members.join(c, "bucket").withColumn("i", F.pmod(F.xxhash64("key", "bucket"), g)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), g - 1)))
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    side = F.when(lo == hi, -1).when(F.col("i") == lo, 0).otherwise(1).cast("int")
    return d.select(*members.columns, lo.alias("lo"), hi.alias("hi"), side.alias("side"))


def own_pairs(x: np.ndarray, y: np.ndarray, bands: list[frozenset], bucket: int) -> np.ndarray:
    """Which pairs belong to this bucket: it is the least that the two share, so each pair belongs to one."""
    return np.array([min(bands[i] & bands[j]) == bucket for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)


def _settled(texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links between members of a bucket that the stars left in different components.

    All pairs of such members are compared by their counts of words, in blocks of ``BLOCK``, and
    only the members of pairs that may be similar go on. These are aligned in smaller blocks: a
    pair in the least bucket that it shares, and none whose members are linked there already. No
    pair is a row; a cell sends its members, or fewer links than it has members.
    """
    named = texts.filter(F.size("bands") > 0).join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.xxhash64(F.coalesce("root", "key")))
    own = named.select("key", "n", "root", F.explode("bands").alias("bucket"))
    mixed = own.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("bucket")
    members = staged(own.join(mixed, "bucket"), "dup-open")
    bags = staged(_bagged(texts.join(members.select("key").distinct(), "key", "left_semi")), "dup-bags")
    d = _dealt(members, BLOCK).join(bags, "key")
    cells = d.groupBy("bucket", "lo", "hi").agg(F.collect_list(F.struct("key", "n", "root", "side", "bag", "bands")).alias("m")).select("bucket", "m")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, root, side = (np.array([r[c] for r in m], np.int64) for c in ("n", "root", "side"))
                x, y = likely(n, root, side, np.frombuffer(b"".join(r["bag"] for r in m), "<i2").reshape(-1, BINS), similarity)
                mine = own_pairs(x, y, [frozenset(r["bands"]) for r in m], bucket)
                found = np.unique(np.concatenate([x[mine], y[mine]]))
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(found), pa.int64()), pa.array([m[i]["key"] for i in found], pa.binary())], names=["bucket", "key"])

    chosen = staged(mapped(cells, compared, "bucket long, key binary").distinct(), "dup-likely")
    info = named.join(chosen.select("key").distinct(), "key", "left_semi").select("key", "root", "bands", "packed")
    d = _dealt(chosen, ALIGNED_BLOCK).join(info, "key")
    cells = d.groupBy("bucket", "lo", "hi").agg(F.collect_list(F.struct("key", "root", "side", "bands", "packed")).alias("m")).select("bucket", "m")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for bucket, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = [unpack(r["packed"]).split() for r in m]
                n, (root, side) = np.array([len(w) for w in ws], np.int64), (np.array([r[c] for r in m], np.int64) for c in ("root", "side"))
                x, y = likely(n, root, side, np.frombuffer(b"".join(map(_bag, ws)), "<i2").reshape(-1, BINS), similarity)
                mine = own_pairs(x, y, [frozenset(r["bands"]) for r in m], bucket)
                links = _linked(ws, root, x[mine].tolist(), y[mine].tolist(), similarity)
                yield pa.RecordBatch.from_arrays([pa.array([m[i]["key"] for i, _ in links], pa.binary()), pa.array([m[j]["key"] for _, j in links], pa.binary())], names=["a", "b"])

    return staged(mapped(cells, aligned, "a binary, b binary"), "dup-settled")


def _linked(ws: list[list[bytes]], root: np.ndarray, x: list[int], y: list[int], similarity: float) -> list[tuple[int, int]]:
    """Of the pairs those that are similar, without what follows from others: the components are the same."""
    up = {r: r for r in root.tolist()}

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    out = []
    for i, j in zip(x, y, strict=True):
        a, b = find(int(root[i])), find(int(root[j]))
        if a != b and within(ws[i], ws[j], most_edits(len(ws[i]), len(ws[j]), similarity)):
            up[a] = b
            out.append((i, j))
    return out


def links(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (``a``, ``b``) between distinct texts; their components are those of all similar pairs with a common sketch.

    Texts that share a sketch form a bucket. Stars link most of its members at a cost that grows
    with the members; of the rest all pairs in different components are settled.
    """
    n = F.size("bands")
    own = F.explode(F.transform("bands", lambda x, i: F.struct(x.alias("bucket"), F.xxhash64(x, F.element_at("bands", ((i + 1) % n + 1).cast("int"))).alias("finer"))))
    members = texts.filter(n > 0).select("key", F.col("n").alias("size"), own.alias("e")).select("key", "size", "e.bucket", "e.finer")
    roots = staged(components(_stars(members, texts, similarity)), "dup-stars")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_settled(texts, roots, similarity))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``key``, ``class_id`` and ``top`` of each distinct text.

    ``class_id`` is the least doc_id of the class and ``top`` marks the text that has it.
    """
    texts = staged(_sketched(docs), "dup-texts")
    comps = staged(components(links(texts, similarity)), "dup-components")
    d = texts.select("key", "doc_id").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    d = staged(d, "dup-roots")
    # Written down, so that the join back has plain exchanges and a very large class can be split.
    least = staged(d.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")), "dup-least")
    return staged(d.join(least, "root").select("key", F.col("first.doc_id").alias("class_id"), (F.col("key") == F.col("first.key")).alias("top")), "dup-classes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``row``, ``class_id`` and ``top`` of each document; documents of one class are near copies.

    Texts of the same words (A-Z and a-z alike, all but letters and digits parting words) are of
    one class. Different texts are linked if an alignment of their words has a similarity of 0.8,
    and classes are the connected components of links. Candidates come from order MinHash with
    shingles of five words, so texts without a common shingle are no candidates, and texts of
    fewer words have exact copies only.

    Defined cases: null is the empty text; texts without words are alike only if their bytes
    are; null ids come last, and a class of null ids has a null ``class_id``; repeated rows are
    of one class; long texts are aligned whole; an empty table gives an empty result. Ids are whole
    numbers, or texts of such; other columns, whatever their names, are carried in ``row``.
    """
    rows = _keyed(packed(docs, text=utf8()))
    return rows.join(classes(docs, similarity), "key").select("row", "key", "class_id", "top")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The document with the least doc_id of each class, with the columns of ``docs``."""
    tops = classes(docs, similarity).filter("top").select(F.col("key").alias("k"), "class_id")
    p = packed(docs, tie=F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), id=F.col("doc_id"), text=utf8())
    rows = _keyed(p)
    rows = rows.join(tops, (rows["key"] == tops["k"]) & rows["id"].eqNullSafe(tops["class_id"]))
    # Rows that share id and words: the one with the least hash, combined before the shuffle.
    best = rows.groupBy("key").agg(F.min_by("row", "tie").alias("row"))
    return best.select("row.*")
