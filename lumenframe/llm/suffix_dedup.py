"""Removal of repeated passages by maximal repeats of an enhanced suffix array.

A suffix array of a whole corpus cannot be sorted in one place, and a suffix matters here only up
to the length of a window (200 bytes). So the corpus is cut into groups that can be sorted apart:

* Each window has an anchor, the 32-byte string in it with the least hash (the leftmost of equal
  ones). The anchor depends on the window's bytes alone, so equal windows have equal anchors.
  Starts in a row whose windows have one anchor form a run; there is a run per 85 bytes or so.
* A run whose anchor occurs nowhere else repeats nothing. Runs of one anchor that are alike in all
  their bytes repeat each other whole. Both are told by hashes, without any text.
* What is left are the runs at the edges of repeats. Their bytes are gathered by anchor, and an
  enhanced suffix array (suffixes and common prefix lengths) is built of them. A stack scan walks
  its tree of common-prefix intervals; intervals of at least 200 bytes that cannot be extended to
  the left are maximal repeats, and all their occurrences are covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_SEEN, mapped, packed, staged, utf8

WINDOW, ANCHOR = 200, 32
#: Text hashed at a time; a longer text is taken in pieces that overlap by a window.
PIECE = 1 << 20
#: Distinct runs of an anchor that are sorted together. A larger group is dealt out by the hash of
#: each window instead, so no task holds it.
MOST_SORTED = 2000

_RNG = np.random.default_rng(3)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = [np.uint64(int(x) | 1) for x in _RNG.integers(1 << 40, 1 << 62, 5)]
_FAR = [np.uint64(int(x) | 1) for x in _RNG.integers(1 << 40, 1 << 62, 16)]
_PLACE = (1 << 24) - 1


def _anchors(buf: np.ndarray) -> np.ndarray:
    """Hash of the 32-byte string at each position."""
    h = _BYTE[buf]
    for k in range(5):
        n = 1 << k
        h = h[:-n] * _STEP[k] + h[n:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(33))


def runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the texts that lie at ``starts`` to ``ends`` in ``buf``.

    Returns text number, first and last window start (places in ``buf``) and the anchor's hash.
    """
    none = np.zeros(0, np.int64)
    wide = window - ANCHOR + 1
    if len(buf) < window:
        return none, none, none, np.zeros(0, np.uint64)
    h = _anchors(buf)
    # High bits of the hash over the place: the least is the anchor, the leftmost of equal ones.
    rank = (((h >> np.uint64(25)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)).astype(np.int64)
    n = len(rank)
    pad = -n % wide
    blocks = np.concatenate([rank, np.full(pad, np.iinfo(np.int64).max)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - wide + 1], ahead[wide - 1 : n])
    place = least & _PLACE
    doc = np.searchsorted(starts, np.arange(len(place)), side="right") - 1
    ok = np.arange(len(place)) + window <= ends[doc]
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return doc[a], a, b, h[place[a]]


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """Texts joined to pieces: the bytes, and for each text its number, place in the piece and offset in the text."""
    buf, number, at, offset, size = [], [], [], [], 0
    for k, t in enumerate(texts):
        for lo in range(0, max(len(t) - window + 1, 0), PIECE):
            part = t[lo : lo + PIECE + window - 1]
            if size and size + len(part) > PIECE + window:
                yield b"".join(buf), number, at, offset
                buf, number, at, offset, size = [], [], [], [], 0
            buf.append(part)
            number.append(k)
            at.append(size)
            offset.append(lo)
            size += len(part)
    if size:
        yield b"".join(buf), number, at, offset


RUN = "key binary, anchor long, content long, first int, last int"


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """The runs of each distinct text of a task (columns ``RUN``); ``key`` is the text's MD5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() for x in b.column(0)]
            keys = [hashlib.md5(t).digest() for t in texts]
            for data, number, at, offset in _pieces(texts, window):
                starts = np.array(at, np.int64)
                ends = np.append(starts[1:], len(data))
                doc, a, z, h = runs(np.frombuffer(data, np.uint8), starts, ends, window)
                view, of = memoryview(data), xxhash.xxh3_64_intdigest
                content = np.array([of(view[i:j]) for i, j in zip(a.tolist(), (z + window).tolist(), strict=True)], np.uint64)
                shift = np.array(offset, np.int64) - starts
                own = [keys[number[d]] for d in doc.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), pa.array((a + shift[doc]).astype(np.int32)), pa.array((z + shift[doc]).astype(np.int32))], names=["key", "anchor", "content", "first", "last"])

    return mapped(docs.select(utf8().alias("text")), run, RUN)


def repeated_starts(buf: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The starts whose window has the hash of another's: all others are alone in the suffix array."""
    h = _BYTE[buf]
    total, size, done = np.zeros(max(len(buf) - window + 1, 0), np.uint64), 1, 0
    for step in range(window.bit_length()):
        if window >> step & 1:
            total = total * _FAR[step] + h[done : done + len(total)]
            done += size
        if size * 2 <= window:
            h = h[:-size] * _FAR[step + 8] + h[size:]
        size *= 2
    _, place, count = np.unique(total[starts], return_inverse=True, return_counts=True)
    return starts[count[place] > 1]


def suffix_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``buf[start:end]`` and the common prefix length of each with the one before.

    ``ends`` has the end of each suffix. Suffixes are as long as a run's bytes at most.
    """
    data = buf.tobytes()
    suffixes = [data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
    starts, sizes = starts[order], (ends - starts)[order]
    common = np.zeros(len(order), np.int64)
    wide = np.arange(int(sizes.max(initial=0)))
    for lo in range(1, len(order), 16384):
        hi = min(lo + 16384, len(order))
        rows = buf[np.minimum(starts[lo - 1 : hi, None] + wide, len(buf) - 1)]
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), len(wide))
        common[lo:hi] = np.minimum(first, np.minimum(sizes[lo:hi], sizes[lo - 1 : hi - 1]))
    return order, common


def maximal_repeats(common: np.ndarray, before: np.ndarray, shortest: int) -> Iterator[tuple[int, int, int]]:
    """Maximal repeats as (length, first, end): the suffixes first to end of the array are all its occurrences.

    A stack scan of the common prefix lengths. ``before`` has, for each suffix in order, the byte to its left, or -1 where there is none
    (such a suffix differs from all others). An interval of the array whose suffixes share a
    prefix of at least ``shortest`` is a repeat; it is maximal if not all have the same byte to
    the left. Each stack entry is (length, first suffix, left byte shared by all so far or None).
    """
    stack: list[list] = []
    n = len(common)
    lcp = common.tolist()
    lefts = before.tolist()
    i = 1
    hot = np.append(np.flatnonzero(common >= shortest), n)
    while i <= n:
        here = lcp[i] if i < n else 0
        if here < shortest and not stack:
            i = int(hot[np.searchsorted(hot, i)])  # nothing before the next long common prefix
            if i >= n:
                return
            here = lcp[i]
        begin, left = i - 1, lefts[i - 1]
        while stack and stack[-1][0] > here:
            length, lo, shared = stack.pop()
            shared = shared if shared == left and left >= 0 else None
            if shared is None:
                yield length, lo, i
            begin, left = lo, -1 if shared is None else shared
        if here >= shortest:
            if stack and stack[-1][0] == here:
                top = stack[-1]
                top[2] = top[2] if top[2] == left and left >= 0 else -1
            else:
                stack.append([here, begin, left])
        i += 1


def covered_starts(contents: list[bytes], lefts: list[int], window: int) -> list[np.ndarray]:
    """Ranges of each run's bytes that maximal repeats of its group cover (rows of first, end).

    ``contents`` are the bytes of runs, ``lefts`` the byte before each (-1: none, or it belongs
    to another run).
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(b"".join(contents), np.uint8)
    # Only suffixes that still have a whole window are places where a repeat can start.
    count = sizes - window + 1
    own = np.repeat(np.arange(len(sizes)), count)
    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + at[:-1][own]
    starts = repeated_starts(buf, starts, window)
    own = np.searchsorted(at, starts, side="right") - 1
    order, common = suffix_array(buf, starts, at[own + 1])
    places, own = starts[order], own[order]
    before = np.where(places == at[own], np.array(lefts)[own], buf[np.maximum(places - 1, 0)].astype(np.int64))
    reach = np.zeros(len(places), np.int64)
    for length, lo, hi in maximal_repeats(common, before, window):
        np.maximum(reach[lo:hi], length, out=reach[lo:hi])
    hit = np.flatnonzero(reach)
    hit = hit[np.lexsort((places[hit], own[hit]))]
    spans = np.stack([places[hit] - at[own[hit]], places[hit] - at[own[hit]] + reach[hit]], 1)
    edge = np.searchsorted(own[hit], np.arange(len(contents) + 1))
    return [merge(spans[edge[k] : edge[k + 1]]) for k in range(len(contents))]


def merge(spans: np.ndarray) -> np.ndarray:
    """Union of ranges (first, end), touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    s = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    far = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > far[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return np.stack([s[new, 0], far[last]], 1)


def _texts(docs: DataFrame) -> DataFrame:
    """``key`` and the compressed ``packed`` text, one row for each text and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, done = zstandard.ZstdCompressor(3).compress, set()
        for b in batches:
            keys, out = [], []
            for x in b.column(0):
                t = x.as_py()
                k = hashlib.md5(t).digest()
                if k not in done:
                    done.add(k)
                    keys.append(k)
                    out.append(pack(t))
            if len(done) > MOST_SEEN:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["key", "packed"])

    return mapped(docs.select(utf8().alias("text")), run, "key binary, packed binary")


def _cut_out(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """Adds ``body`` (binary) to runs, from the texts they lie in.

    The runs of one text come to one row; they take less room than the text itself, a row of the input.
    """
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "copies", "group", "first", "last")).alias("runs"))
    # One copy of a text goes on, however many tasks have met it, and the join needs no further exchange.
    rows = _texts(docs).dropDuplicates(["key"]).join(by_text, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for key, z, rs in zip(b.column(0), b.column(1), b.column(2), strict=True):
                t, rs = unpack(z.as_py()), rs.as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key.as_py()] * len(rs), pa.binary()),
                        *(pa.array([r[c] for r in rs], pa.int64()) for c in ("anchor", "content", "copies", "group")),
                        pa.array([r["first"] for r in rs], pa.int32()),
                        pa.array([t[r["first"] : r["last"] + window] for r in rs], pa.binary()),
                    ],
                    names=["key", "anchor", "content", "copies", "group", "first", "body"],
                )

    return mapped(rows.select("key", "packed", "runs"), run, "key binary, anchor long, content long, copies long, group long, first int, body binary")


def _sorted_groups(bodies: DataFrame, window: int) -> DataFrame:
    """Covered ranges of single runs, by suffix arrays of whole groups."""

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        # Bytes to the left of a run belong to windows of another anchor, so a repeat cannot be extended there.
        got = covered_starts([r[4] for r in rows], [-1] * len(rows), window)
        for r, spans in zip(rows, got, strict=True):
            if r[2] == 1:
                for a, z in spans.tolist():
                    yield r[0], r[3] + a, r[3] + z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = list(solve(block))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=["key", "lo", "hi"])

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if size > PIECE // 2 and r[1] != block[-1][1]:
                    yield flush()
                    block, size = [], 0
                block.append(r)
                size += len(r[4])
        if block:
            yield flush()

    spread = bodies.select("key", "anchor", "copies", "first", "body").repartition("anchor").sortWithinPartitions("anchor")
    return mapped(spread, run, "key binary, lo int, hi int")


def _hashed_groups(bodies: DataFrame, window: int) -> DataFrame:
    """Covered ranges of single runs of very large groups: windows are dealt out by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh3_128_digest
        for b in batches:
            for key, copies, first, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n = len(body) - window + 1
                yield pa.RecordBatch.from_arrays([pa.array([key if copies == 1 else None] * n, pa.binary()), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array([of(body[i : i + window]) for i in range(n)], pa.binary())], names=["key", "lo", "window"])

    windows = mapped(bodies.select("key", "copies", "first", "body"), run, "key binary, lo int, window binary")
    windows = staged(windows, "rep-windows")
    shared = staged(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window"), "rep-shared")
    got = windows.filter("key is not null").join(shared, "window")
    return got.select("key", "lo", (F.col("lo") + window).alias("hi"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key`` (MD5 of a text) and ``spans``: the ranges (binary, pairs of int32) that repeats cover.

    Texts that occur more than once are covered whole and not listed here; see ``remove_repeats``.
    """
    run_rows = staged(_runs(docs, window), "rep-runs")
    anchors = run_rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("c"), F.max("content").alias("d"))
    # Written down, so the join has plain exchanges on both sides and a hot anchor can be split.
    anchors = staged(anchors.filter("n > 1").select("anchor", (F.col("c") != F.col("d")).alias("mixed")), "rep-anchors")
    again = staged(run_rows.join(anchors, "anchor"), "rep-again")
    whole = again.filter("not mixed")
    mixed = again.filter("mixed")
    kinds = mixed.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "first", "last")).alias("one"))
    kinds = staged(kinds, "rep-kinds")
    alike = kinds.filter("copies > 1").select("anchor", "content")
    # Written down, so that this join is a stage of its own and the copies of a very common run can be split.
    copied = staged(mixed.join(alike, ["anchor", "content"]).select("key", "first", "last"), "rep-copied")
    whole = whole.select("key", "first", "last").unionByName(copied)
    groups = staged(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("group")), "rep-groups")
    wanted = kinds.join(groups, "anchor").select("anchor", "content", "copies", "group", "one.*")
    bodies = staged(_cut_out(wanted, docs, window), "rep-bodies")
    parts = whole.select("key", F.col("first").alias("lo"), (F.col("last") + window).cast("int").alias("hi"))
    parts = parts.unionByName(_sorted_groups(bodies.filter(F.col("group") <= MOST_SORTED), window)).unionByName(_hashed_groups(bodies.filter(F.col("group") > MOST_SORTED), window))
    return parts.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # ranges of one text, at most one a byte


def remove_repeats(docs: DataFrame, window: int = WINDOW, kept_as: str | None = "binary") -> DataFrame:
    """Remove each byte covered by a string of ``window`` bytes that also starts anywhere else.

    Returns ``row``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (the
    remaining bytes as ``binary``, or as ``string`` without what a cut has left of a character;
    left out for None) and ``kept_sha256`` (of the bytes), one row for each input row. Strings are
    judged on the input, and all occurrences go.

    Defined cases: null is the empty text; a text shorter than the window stays, even if it is a
    copy; a longer text that occurs twice goes whole; repeats may overlap within one text;
    nothing else than the text is looked at, so null or repeated ids do no harm; long texts are
    read whole, in pieces; an empty table gives an empty result; other columns, whatever their
    names, are carried in ``row``.
    """
    spans = repeated_spans(docs, window)
    p = packed(docs, text=utf8())
    p = p.withColumn("key", F.unhex(F.md5("text")))
    out = T.StructType([p.schema["row"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long" + (f", kept {kept_as}" if kept_as else "") + ", kept_sha256 string")])
    forms = {"binary": lambda k: pa.array(k, pa.binary()), "string": lambda k: pa.array([whole_characters(x) for x in k], pa.string())}
    form = [forms[kept_as]] if kept_as else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, count, kept = [], [], [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                t, s = t.as_py(), s.values if s.is_valid else None
                ranges = merge(np.stack([s.field(0).to_numpy(), s.field(1).to_numpy()], 1).astype(np.int64)) if s is not None else np.zeros((0, 2), np.int64)
                edges = [0, *ranges.ravel().tolist(), len(t)]
                size.append(len(t))
                gone.append(int((ranges[:, 1] - ranges[:, 0]).sum()))
                count.append(len(ranges))
                kept.append(b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, count)), *(f(kept) for f in form), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=out.fieldNames())

    spans = spans.withColumnRenamed("key", "k")
    return mapped(p.join(spans, p["key"] == spans["k"], "left").select("row", "text", "spans"), run, out)


def whole_characters(kept: bytes) -> str:
    """The kept bytes as text, without what a cut has left of a character."""
    return kept.decode("utf-8", "ignore")
