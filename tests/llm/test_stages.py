"""The corpus operators against brute force, on small hand-made tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import components, decontam, langid, media_avi, mixing, order_minhash, suffix_dedup, token_rollup, toxicity, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3)


def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns that clash."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x", "", "", 1), (3, long, "de", None, 9), (3, long, "de", None, 9), (4, "\0 \n\t", "en", "a", 3)]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit(1) for c in ("size", "copies", "copy", "row", "key", "score", "spans", "content", "host", "verdict", "items", "k", "s", "bucket", "target")})


# Mixing


def shares(sizes):
    """Targets by handing out the excess round after round."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    weight = {k: 1 + i % 3 for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in capped]
        rest = total - sum(capped.values())
        got = {k: rest * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if got[k] > 3 * sizes[k]]
        if not over:
            return capped | got
        capped |= {k: 3.0 * sizes[k] for k in over}


def test_targets_and_copies(spark):
    rng = random.Random(1)
    rows, sizes = [], Counter()
    for i in range(4000):
        s = rng.choice(["b", "a", None, "é", "z", "tiny"]) if i % 50 else "tiny"
        s = "a" if s == "tiny" and i % 50 else s
        n = rng.choice([0, 1, 3, 40, 200])
        rows.append((i, " ".join(["w"] * n), s))
        sizes[s] += n
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d, keep_rows=False).collect()
    want, taken = shares(sizes), Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == 4000
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 400 for s in want)
    again = mixing.mix(d.repartition(7), keep_rows=False).collect()
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in again}


def test_many_buckets_number_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 64)
    d = spark.createDataFrame([(i, "w " * (i % 40), "ab"[i % 3 == 0]) for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(d, keep_rows=False).groupBy("source", "target").agg(F.sum("taken").alias("t"), F.count("*").alias("n"), F.sum("copies").alias("c")).collect()
    assert all(abs(r["t"] - r["target"]) < 0.05 * r["target"] for r in got) and sum(r["n"] for r in got) == 2000


def test_emit_repeats_rows(spark):
    d = mixing.mix(docs(spark, ["a b"] * 10))
    out = mixing.emit(d)
    assert out.count() == 10 and out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "copy"]


# Repeated passages


def covered(texts, window):
    seen, out = defaultdict(list), [bytearray(len(t)) for t in texts]
    for k, t in enumerate(texts):
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]].append((k, i))
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                out[k][i : i + window] = b"\1" * window
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, texts = [text(60) for _ in range(3)], []
    for _ in range(40):
        t = text(rng.randint(0, 120))
        if rng.random() < 0.5:
            c = rng.choice(common)
            cut = rng.randint(0, 40)
            t += c[cut:] + text(rng.randint(0, 30)) + (c if rng.random() < 0.2 else "")
        texts.append(t)
    return [*texts, texts[3], texts[3], None, "", "z" * 500, "z" * 199, "y" * 200, "y" * 200, "ab" * 150]


@pytest.mark.parametrize(("seed", "most_sorted"), [(1, 2000), (2, 1), (3, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, most_sorted):
    monkeypatch.setattr(suffix_dedup, "MOST_SORTED", most_sorted)
    texts = passages(seed)
    raw = [(t or "").encode() for t in texts]
    want = covered(raw, suffix_dedup.WINDOW)
    got = {r["i"]: r for r in suffix_dedup.remove_repeats(docs(spark, texts)).select("row.doc_id", "*").withColumnRenamed("doc_id", "i").collect()}
    for k, t in enumerate(raw):
        kept = bytes(b for b, c in zip(t, want[k], strict=True) if not c)
        runs = sum(1 for i, c in enumerate(want[k]) if c and (not i or not want[k][i - 1]))
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(want[k]), runs, hashlib.sha256(kept).hexdigest()), k


def test_runs_do_not_depend_on_pieces(monkeypatch):
    t = [x.encode() for x in passages(4) if x]
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    seen = [set() for _ in t]
    for data, number, at, offset in suffix_dedup._pieces(t, 200):
        starts = np.array(at)
        d, a, z, _ = suffix_dedup.runs(np.frombuffer(data, np.uint8), starts, np.append(starts[1:], len(data)))
        for k, i, j in zip(d, a, z, strict=True):
            seen[number[k]] |= set(range(i - at[k] + offset[k], j - at[k] + offset[k] + 1))
    assert [len(s) for s in seen] == [max(len(x) - 199, 0) for x in t]


def test_maximal_repeats_of_a_known_string():
    buf = np.frombuffer(b"xabcyabcz", np.uint8)
    starts = np.arange(9)
    order, common = suffix_dedup.suffix_array(buf, starts, np.full(9, 9))
    before = np.where(order > 0, buf[order - 1].astype(np.int64), -1)
    got = {(n, tuple(sorted(order[i:j].tolist()))) for n, i, j in suffix_dedup.maximal_repeats(common, before, 1)}
    assert got == {(3, (1, 5))}


def test_cut_characters_go_whole():
    assert [suffix_dedup.whole_characters(b) for b in ("aé".encode()[:2], "é".encode())] == ["a", "é"]


# WARC


def test_warc_file_and_revisits(spark, tmp_path):
    import gzip

    def record(kind, uri, date, block, i):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    ok = b'HTTP/1.1 200 OK\r\nETag: "1"\r\nContent-Type: text/html\r\nDate: old\r\n\r\nbody'
    same = b'HTTP/1.1 304 Not Modified\r\nETag: W/"1"\r\nDate: new\r\nContent-Length: 0\r\n\r\n'
    data = record("response", "http://www.A.com/x/", "2020-01-01T00:00:00Z", ok, 1) + record("revisit", "https://a.com/x?utm_source=y#z", "2020-02-01T00:00:00Z", same, 2) + record("revisit", "https://a.com/q", "2020-02-01T00:00:00Z", same, 3)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(data[i : i + 90]) for i in range(0, len(data), 90)))
    (tmp_path / "b.warc").write_bytes(data + b"WARC/1.1\r\ncut")
    r = warc.read_warc(spark, str(tmp_path))
    assert r.count() == 7 and r.filter("error is not null").count() == 1
    assert bytes(r.filter("record_type = 'response'").first()["payload"]) == b"body"
    got = {x["id"]: x for x in warc.resolve_revisits(r.filter("error is null").dropDuplicates(["record_id"])).select(F.col("row.record_id").alias("id"), "*").collect()}
    assert got["<2>"]["outcome"] == "resolved" and got["<3>"]["outcome"] == "missing"
    assert {h["name"]: h["value"] for h in got["<2>"]["headers"]} == {"etag": 'W/"1"', "content-type": "text/html", "date": "new"}


def test_as_of_is_strict_and_spans_buckets(spark):
    h = [("ETag", '"a"')]
    rows = [("r1", "response", "http://a/", 0, 200, h, None), ("r2", "response", "http://a/", 10, 200, h, None), ("r3", "response", "http://a/", 10, 200, [("etag", '"b"')], None), ("v0", "revisit", "http://a/", 0, 304, h, None), ("v1", "revisit", "http://a/", 10, 304, h, None), ("v2", "revisit", "http://a/", 999_999, 304, h, None), ("v3", "revisit", None, 5, 304, None, None), ("v4", "revisit", "http://a/", None, 304, h, None), ("v5", "revisit", "http://a/", 5, 304, None, None), ("x", None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, ts long, status int, headers array<struct<name:string,value:string>>, payload_digest string")
    d = d.withColumn("ts", F.timestamp_seconds("ts"))
    for bucket in (1, 7, 86_400):
        got = {r["i"]: (r["response_id"], r["outcome"]) for r in warc.resolve_revisits(d, bucket).select(F.col("row.record_id").alias("i"), "*").collect()}
        assert got == {"v0": (None, "missing"), "v1": ("r1", "resolved"), "v2": ("r3", "mismatch"), "v3": (None, "missing"), "v4": (None, "missing"), "v5": ("r1", "unchecked")}
    assert warc.resolve_revisits(d.limit(0)).count() == 0


# Media


@pytest.mark.parametrize("n", [192, 768, 960, 192 * 50])
def test_payload_round_trip(n):
    payload = np.random.default_rng(n).bytes(n)
    assert media_avi.read_media(media_avi.encode_avi(payload))["payload"] == payload


def test_generic_decoder_agrees(monkeypatch):
    frame = media_avi.parse_avi(media_avi.encode_avi(bytes(range(256)) * 3))["frames"][0]
    fast = media_avi.decode_frame(frame)
    monkeypatch.setattr(media_avi, "_unpack", lambda coded: None)
    slow = media_avi.decode_frame(frame)
    assert slow["raw"] is None and all((fast["blocks"][c] == slow["blocks"][c]).all() for c in (1, 2, 3))


def test_index_and_walk_agree():
    data = media_avi.encode_avi(b"abc" * 64 * 9)
    assert media_avi.parse_avi(data)["frames"] == media_avi.parse_avi(data.replace(b"idx1", b"JUNK"))["frames"]


def test_shots_cut_where_the_level_changes():
    h = np.zeros((20, 16), int)
    h[:7, 2] = h[7:15, 9] = h[15:, 4] = 100
    assert media_avi.shots(h) == [(0, 6), (7, 14), (15, 19)]
    assert media_avi.shots(h[:0]) == [] and media_avi.shots(h[:5]) == [(0, 4)]


def test_clips_of_files(spark):
    files = spark.createDataFrame([(1, bytearray(media_avi.encode_avi(b"q" * 192 * 9))), (2, None), (3, bytearray(b"junk"))], "id int, content binary")
    got = {r["row"]["id"]: r for r in media_avi.clips(files).collect()}
    assert got[1]["clip"]["end_s"] == pytest.approx(0.6) and got[2]["error"] and got[3]["clip"] is None


def test_stored_texts(spark):
    got = {r["row"]["doc_id"]: r for r in media_avi.store_texts(docs(spark, ["é" * 96, "", None])).collect()}
    assert got[0]["payload_sha256"] == hashlib.sha256("é".encode() * 96).hexdigest()
    assert got[1]["payload_bytes"] == 192 and got[1]["media_sha256"] == got[2]["media_sha256"]
    assert got[2]["tail_crc32"] == zlib.crc32(b" " * 16)


def other_jpeg(spark, samples):
    """A grey image as written by another encoder, that of the Java runtime, and as its decoder reads it."""
    jvm, gate = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    tall, wide = samples.shape
    image = jvm.java.awt.image.BufferedImage(wide, tall, 10)
    flat = gate.new_array(jvm.int, tall * wide)
    for i, v in enumerate(samples.ravel().tolist()):
        flat[i] = v
    image.getRaster().setSamples(0, 0, wide, tall, 0, flat)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data))).getRaster().getSamples(0, 0, wide, tall, 0, gate.new_array(jvm.int, tall * wide))
    return data, np.array(list(back)).reshape(tall, wide)


def without(data, marker):
    """A JPEG without its segments of one kind."""
    at, out = 2, data[:2]
    while data[at + 1] != 0xDA:
        n = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        out += b"" if data[at + 1] == marker else data[at : at + n]
        at += n
    return out + data[at:]


def test_frames_of_another_encoder(spark):
    x, y = np.meshgrid(np.arange(32), np.arange(16))
    data, back = other_jpeg(spark, ((x * 7 + y * 5) % 200 + (x > 16) * 40).astype(int))
    for frame in (data, without(data, 0xC4)):
        d = media_avi.decode_frame(frame)
        got = media_avi.luma(d).reshape(2, 4, 8, 8).transpose(0, 2, 1, 3).reshape(16, 32)
        assert d["size"] == (32, 16) and np.abs(got.astype(int) - back).max() <= 1
    with pytest.raises(ValueError, match="without a scan"):
        media_avi.decode_frame(b"\xff\xd8\xff\xd9")


def test_several_segments_and_rec_lists(spark):
    import struct

    data = media_avi.encode_avi(b"abc" * 64 * 40)
    frames = media_avi.parse_avi(data)["frames"]
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    more = b"".join(chunk(b"00dc", f) for f in frames[:3])
    second = chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + chunk(b"LIST", b"rec " + more) + chunk(b"00dc", frames[3])))
    assert media_avi.parse_avi(data + second)["frames"] == frames + frames[:4]
    # The same by a super index in the stream's header.
    whole = data + second
    where, at = [], 0
    while (at := whole.find(b"00dc", at + 1)) >= 0:
        if whole[at + 8 : at + 10] == b"\xff\xd8":
            where.append((at + 8, struct.unpack_from("<I", whole, at + 4)[0]))
    entries = lambda shift: b"".join(struct.pack("<II", a + shift, n) for a, n in where)
    head = data.index(b"strh") - 12
    size = 8 + 24 + 16
    ix = len(whole) + size

    def with_index():
        sup = chunk(b"indx", struct.pack("<HBBI4sIII", 4, 0, 0, 1, b"00dc", 0, 0, 0) + struct.pack("<QII", ix, 0, len(where)))
        body = whole[: head + 12] + sup + whole[head + 12 :]
        grow = lambda b, p: b[:p] + struct.pack("<I", struct.unpack_from("<I", b, p)[0] + size) + b[p + 4 :]
        for p in (4, data.index(b"hdrl") - 4, data.index(b"strl") - 4):
            body = grow(body, p)
        return body + chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(where), b"00dc", 0, 0) + entries(size))

    assert media_avi.parse_avi(with_index())["frames"] == frames + frames[:4]


def test_features_equal_plain_ones(spark):
    rng = random.Random(16)
    t = ("a" * 5000 + "".join(rng.choice("bcdé") for _ in range(9000))).encode()
    n, size, sha, crc, media_bytes, media_sha, feature = media_avi.digest(t)
    payload = t + b" " * (-len(t) % 192)
    assert (n, size, sha, crc) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    data = media_avi.encode_avi(payload)
    assert (media_bytes, media_sha) == (len(data), hashlib.sha256(data).hexdigest())
    # Levels by a plain inverse transform of each first component, 4 units a frame.
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    a = [np.sqrt(1 / 8) if k == 0 else 0.5 for k in range(8)]
    whole = payload + b" " * (-len(payload) % 768)
    total = count = 0
    for at in range(0, len(whole), 192):
        c = np.zeros((8, 8))
        for (r, k), b in zip(order, whole[at : at + 64], strict=True):
            c[r, k] = b if b >= 128 else b - 255
        basis = np.array([[a[k] * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
        level = np.clip(np.rint(basis.T @ c @ basis + 128), 0, 255).astype(int) >> 4
        total, count = total + level.sum(), count + 64
    assert f"frames={len(whole) // 768};" in feature and f"level={total / count:.3f}" in feature.replace(feature.split("level=")[1].split(";")[0], f"{float(feature.split('level=')[1].split(';')[0]):.3f}")


# URLs


def test_hosts_paths_and_stated_rules(spark):
    urls = [None, "", "a.com/x", "HTTP://WWW.Example.COM/en/7?x", "http://com/en/1", "http://xcom/en/1", "http://a.example.net/de/81#f", "http://b.net/de/8", "http://a.org", "x://Ä.ORG?/es/", "://://"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = {r["row"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(d, none).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[4] == ("com", "/en/1", "com/en/", "block") and got[5][2] is None
    assert got[6] == ("a.example.net", "/de/81", "example.net/de/8", "block")
    assert got[7] == ("b.net", "/de/8", "net/de/", "allow")
    assert got[8] == ("a.org", "", None, "allow") and got[9][:2] == ("Ä.org", "") and got[10][0] == ":"


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(3)
    rows = [(f"http://{rng.choice(['a', 'b', 'c'])}.com/{rng.choice(['x', 'y'])}?{rng.choice(['k', 'm'])}=1",) for _ in range(300)]
    rows = [(u, ("a.com/x" in u and rng.random() < 0.9) or rng.random() < 0.1) for (u,) in rows]
    d = spark.createDataFrame(rows, "url string, blocked boolean")
    got = {tuple(sorted(r["antecedent"])): round(r["confidence"], 9) for r in url_rules.mine(d, 0.02, 0.6).collect()}
    items = [(set(r["t"]), r["blocked"]) for r in d.select(url_rules.tokens_of(F.col("url")).alias("t"), "blocked").collect()]
    every, base = sorted(set().union(*(t for t, _ in items))), sum(b for _, b in items) / len(items)
    want = {}
    for n in range(1, len(every) + 1):
        for c in combinations(every, n):
            hit = [b for t, b in items if set(c) <= t]
            if sum(hit) >= 0.02 * len(items) - 1e-9 and hit and sum(hit) / len(hit) >= 0.6 and sum(hit) / len(hit) > base:
                want[c] = round(sum(hit) / len(hit), 9)
        if n > 6:
            break
    assert got == want and got
    v = {r["row"]["url"]: r["verdict"] for r in url_rules.judge(d, d, (), min_support=0.02).collect()}
    for u, t in d.select("url", url_rules.tokens_of(F.col("url")).alias("t")).distinct().collect():
        assert v[u] == ("block" if any(set(c) <= set(t) for c in want) else "allow")


# Near duplicates


def test_band_alignment_equals_the_table():
    rng = random.Random(5)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 20))]
        b = [x if rng.random() < 0.8 else rng.randint(0, 3) for x in a if rng.random() < 0.9] + [1] * rng.randint(0, 2)
        d = table(a, b)
        assert all(order_minhash.within(a, b, k) == (d <= k) for k in range(9))


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(300, 300 + i) for i in range(1, 60)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts, group = [], []
    for g in range(25):
        base = [word() for _ in range(rng.randint(40, 300))]
        for c in range(4):
            w = [x if rng.random() > 0.015 * (c > 0) else word() for x in base]
            texts.append(" ".join(w).upper() if c == 2 else ",  ".join(w))
            group.append(g)
    texts += ["one two", "ONE, two", "", None, "!!", "?"]
    got = {r["row"]["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(100)] == [4 * g for g in group]
    assert got[101] == 100 and got[103] == got[102] == 102 and got[104] == 104 and got[105] == 105
    kept = order_minhash.keep_one(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def grouped(spark, texts):
    got = {r["row"]["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs(spark, [" ".join(t) for t in texts])).collect()}
    return [got[i] for i in range(len(texts))]


def altered(words, places, mark):
    return [f"{mark}{i}" if i in places else x for i, x in enumerate(words)]


def test_chain_over_a_hub_is_one_class(spark):
    # h is the start of a and of b and has all their common shingles, so it is in each of their buckets.
    for seed in range(40):
        a = [f"w{seed}x{i}" for i in range(100)]
        h, b = a[:82], altered(a, range(82, 100, 5), "b") + ["c", "d", "e", "f"]
        if order_minhash._key(b"", [x.encode() for x in h]) < min(order_minhash._key(b"", [x.encode() for x in t]) for t in (a, b)):
            assert grouped(spark, [h, a, b]) == [0, 0, 0]
            break
    else:
        raise AssertionError("no seed has h as its hub")


def test_near_pairs_in_a_bucket_of_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 7, raising=False)
    monkeypatch.setattr(order_minhash, "ALIGNED_BLOCK", 3, raising=False)
    passage = [f"p{i}" for i in range(70)]
    texts = [passage + [f"o{k}x{i}" for i in range(60)] for k in range(40)]
    for k in range(6):
        pair = passage + [f"n{k}x{i}" for i in range(30)]
        texts += [pair, altered(pair, range(70, 100, 2), f"m{k}x")]
    assert grouped(spark, texts) == list(range(40)) + [40 + 2 * (i // 2) for i in range(12)]


def test_counts_of_words_rule_out_no_similar_pair():
    rng = random.Random(8)
    texts = [[b"%d" % rng.randint(0, 30) for _ in range(rng.randint(5, 40))] for _ in range(60)]
    texts += [[x for x in t if rng.random() < 0.93] + [b"y"] * rng.randint(0, 3) for t in texts * 3]
    n = np.array([len(t) for t in texts])
    bag = np.frombuffer(b"".join(order_minhash._bag(t) for t in texts), "<i2").reshape(len(texts), -1)
    root, side = np.arange(len(texts)) % 7, np.full(len(texts), -1)
    got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in order_minhash.likely(n, root, side, bag)), strict=True)}
    near = {(i, j) for i in range(len(texts)) for j in range(i) if root[i] != root[j] and order_minhash.within(texts[i], texts[j], order_minhash.most_edits(n[i], n[j]))}
    assert near and {(j, i) for i, j in near} <= got


def test_recall_in_one_very_large_bucket(spark, monkeypatch):
    """Of all pairs of five-word-shingle similarity 0.8 or more, in texts that all share a passage."""
    monkeypatch.setattr(order_minhash, "BLOCK", 50)
    monkeypatch.setattr(order_minhash, "ALIGNED_BLOCK", 20)
    rng = random.Random(17)
    passage, texts = [f"p{i}" for i in range(60)], []
    for k in range(60):
        base = passage + [f"t{k}x{i}" for i in range(100)]
        texts += [base] + [altered(base, rng.sample(range(160), rng.randint(1, 3)), f"e{k}v{v}x") for v in range(2)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = grouped(spark, texts)
    assert len(near) > 100 and sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near)
    assert all(got[i] // 3 == i // 3 for i in range(len(texts)))


def test_keep_one_keeps_one_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h"), (None, "g h"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in order_minhash.keep_one(d).collect()) == [0, 1]


# Language


def test_language_fusion(spark):
    rng = random.Random(8)
    make = {"aa": "abcd", "bb": "wxyz"}
    text = lambda lang, n: " ".join("".join(rng.choice(make[lang]) for _ in range(5)) for _ in range(n))
    rows = [(i, text(lang, 30), lang, f"h{lang}", 0) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(900, "123 456", None, "hbb", 0), (901, "99", "AA-us", "none", 0), (902, text("aa", 40), "bb", "hbb", 0), (903, None, "qq", None, 0)]
    d = spark.createDataFrame(rows, DOCS)
    model = langid.train(d.filter("doc_id < 100"))
    got = {r["row"]["doc_id"]: r for r in langid.identify(d, model, F.col("lang"), F.col("source"), F.lit(None).cast("string")).collect()}
    assert all(got[i]["predicted"] == lang and not got[i]["rejected"] for i, lang in enumerate(["aa", "bb"] * 60))
    assert got[900]["rejected"] and got[900]["best"] == "bb"
    assert got[901]["predicted"] == "aa" and got[902]["predicted"] == "aa" and got[903]["predicted"] == "und"
    none = langid.identify(d, langid.train(d.limit(0)), F.col("lang"), F.col("source"), F.lit(None).cast("string"))
    assert none.filter("rejected").count() == d.count()


def test_unseen_languages_and_noise_are_rejected(spark):
    rng = random.Random(11)
    make = {"aa": "abcdefgh", "bb": "stuvwxyz"}
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, text(make[lang], 60), lang, "h", 0) for i, lang in enumerate(["aa", "aa", "bb"] * 40)]
    odd = ["これは日本語の文章です。私は毎日学校に行きます。", "Съешь же ещё этих мягких французских булок", text("ijklmnopqr", 60)]
    rows += [(900 + i, t, lang, "h", 0) for i, (t, lang) in enumerate([(t, lang) for t in odd for lang in (None, "aa")])]
    d = spark.createDataFrame(rows, DOCS)
    got = {r["row"]["doc_id"]: r for r in langid.identify(d, langid.train(d.filter("doc_id < 100")), F.col("lang"), F.col("source"), F.lit(None).cast("string")).collect()}
    assert all(got[i]["predicted"] == lang for i, lang in enumerate(["aa", "aa", "bb"] * 40))
    assert all(got[900 + i]["rejected"] and got[900 + i]["predicted"] == "und" for i in range(6))


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 1 << 20])
def test_trigrams_do_not_depend_on_pieces(piece):
    for t in ("", "a", "Ab", " a  b ", "ab1cd,,é f", "1 2", "x" * 9 + " "):
        norm = " ".join(["", *"".join(c.lower() if c.isalpha() else " " for c in t).split(), ""]).encode() if t.strip("12 ") else b""
        want = [(((norm[i] * 961 + norm[i + 1]) * 961 + norm[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(norm) - 2)]
        assert [int(x) for p in langid.trigrams(t.encode(), piece) for x in p] == want, t


def weighed(model, docs):
    """Plain fusion of (text, places, declared) by document; places are (host, suffix) pairs."""
    n = len(model.langs)
    marks, texts = defaultdict(lambda: np.zeros(n)), []
    told, corpus = {x: np.full(n, 0.5) for x in model.langs}, np.ones(n)
    for text, places, said in docs:
        ll, k = model.score(text.encode())
        ll = np.array(ll)
        odd = k > 0 and ll.max() < -min(k, 100) * np.log(1 << 16) + np.log(langid.UNKNOWN)
        soft = np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum() if k and not odd else np.full(n, 1 / n)
        texts.append((ll, k, odd))
        corpus += soft
        for p in set(places):
            marks[p] += soft
        for x in set(said) & set(told):
            told[x] += soft
    corpus /= corpus.sum()
    told = {x: np.log(v / sum(told.values())) for x, v in told.items()}
    by_suffix = defaultdict(lambda: np.zeros(n))
    for (_, suffix), v in marks.items():
        by_suffix[suffix] += v
    smooth = lambda own, prior: (own + 20 * prior) / (own.sum() + 20)
    for (ll, k, odd), (_, places, said) in zip(texts, docs, strict=True):
        logs = ll + np.log(corpus)
        for p in set(places):
            logs = logs + np.log(smooth(marks[p], smooth(by_suffix[p[1]], corpus)) / corpus)
        for x in set(said) & set(told):
            logs = logs + told[x]
        post = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        silent = not k and not set(said) & set(told)
        yield model.langs[int(post.argmax())], float(post.max()), bool(silent or odd or post.max() < 0.5)


def mixed_corpus(seed):
    rng = random.Random(seed)
    make = {"aa": "abcdefg", "bb": "defghij", "cc": "ghijkab"}
    rows = []
    for i in range(120):
        lang = rng.choice(sorted(make))
        t = " ".join("".join(rng.choice(make[lang]) for _ in range(4)) for _ in range(rng.choice([0, 1, 2, 30])))
        rows.append((i, rng.choice([t, t, t, t + " 12", "12 !"]), rng.choice([lang, lang, "bb", "zz", None]), rng.choice(["h1", "h2", None])))
    return [*rows, (500, None, None, None), (501, "Ѐж" * 40, "aa", "h1"), rows[3], rows[3]]


def test_language_equals_plain_fusion(spark):
    rows = mixed_corpus(12)
    d = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    model = langid.train(d)
    assert model.langs == ["aa", "bb", "cc", "zz"]
    got = langid.identify(d, model, F.col("lang"), F.col("source"), F.lit("x")).select("row.doc_id", "best", "posterior", "rejected").collect()
    want = {r[0]: w for r, w in zip(rows, weighed(model, [(t or "", [(s, "x")], [x] if x else []) for _, t, x, s in rows]), strict=True)}
    assert len(got) == len(rows)
    for r in got:
        best, posterior, rejected = want[r["doc_id"]]
        assert r["posterior"] == pytest.approx(posterior, abs=1e-9) and r["rejected"] == rejected and (r["best"] == best or posterior < 0.5 + 1e-9), r


def test_language_by_pages_equals_plain_fusion(spark):
    rows, rng = mixed_corpus(13), random.Random(14)
    pages = [(rng.choice([*range(100), 777, None]), rng.choice(["aa", "BB-x", "", "q!"]), rng.choice(["p.com", "q.com", "r.org"])) for _ in range(150)]
    pages = [(i, x, h, h[-3:]) for i, x, h in pages + pages[:9]]
    d = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    model = langid.train(d)
    seen, said = defaultdict(list), defaultdict(list)
    for i, x, h, s in pages:
        seen[i].append((h, s))
        said[i].append(x.lower()[:2])
    whole = [(t or "", seen[i] or ([("source:" + s, None)] if s else []), said[i]) for i, t, _, s in rows]
    got = langid.identify_by_pages(langid.text_scores(d, model), model, spark.createDataFrame(pages, "doc_id long, declared string, host string, suffix string")).select("row.doc_id", "best", "posterior", "rejected").collect()
    lone = [k for k, r in enumerate(rows) if not seen[r[0]] and r[3] is None]
    whole = [(t, [(None, None)] if k in lone else p, x) for k, (t, p, x) in enumerate(whole)]
    want = {r[0]: w for r, w in zip(rows, weighed(model, whole), strict=True)}
    for r in got:
        best, posterior, rejected = want[r["doc_id"]]
        assert r["posterior"] == pytest.approx(posterior, abs=1e-9) and r["rejected"] == rejected and (r["best"] == best or posterior < 0.5 + 1e-9), r
    bare = langid.identify_by_pages(langid.text_scores(d, model), model, spark.createDataFrame([], "doc_id long, declared string, host string, suffix string"))
    assert bare.count() == len(got) == len(rows)


def test_page_evidence(spark):
    p = spark.createDataFrame([(2, "http://X.org/en/7?x", '<html class="a" lang=en-GB>'), (1, "http://y.com/7.html", "<html>"), (1, "http://y.com/7.html", None), (3, None, None), (4, "http://z.net/", "x")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in langid.page_evidence(p).collect()) == [(7, "", "y.com", "com"), (7, "", "y.com", "com"), (7, "en-GB", "x.org", "org")]


# Toxicity


def test_toxicity_learns_misspellings(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("lmnorstaei") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(1600):
        bad = i % 4 == 0
        w = [word() for _ in range(60)]
        for _ in range(3 * bad):
            w.insert(rng.randint(0, 60), "worthless" if i % 8 else "worthlezz")
        rows.append((i, " ".join(w), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")))
    s = {r["row"]["doc_id"]: r["score"] for r in toxicity.score_texts(d, m).collect()}
    out = [i for i in s if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((s[i] >= 0.3) == (i % 4 == 0) for i in out) >= 0.97 * len(out)
    unseen = spark.createDataFrame([(0, " ".join(word() for _ in range(60)) + " worthlesss worthlesz worthlets"), (1, " ".join(word() for _ in range(62))), (2, None)], "doc_id long, text string")
    u = {r["row"]["doc_id"]: r["score"] for r in toxicity.score_texts(unseen, m).collect()}
    assert u[0] > 0.3 > u[1] and 0 <= u[2] <= 1
    assert 0 <= toxicity.fit([], np.zeros(0)).bias[1] + 20


def test_long_words_count_whole(monkeypatch):
    rng = random.Random(10)
    table = np.array([rng.gauss(0, 1) for _ in range(toxicity.BUCKETS)], np.float32)
    word = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(100)).encode()
    w = b"<" + word + b">"
    own = [w, *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))]
    want = np.mean([table[zlib.crc32(x) % toxicity.BUCKETS] for x in own], dtype=np.float64)
    for piece in (7, 298, 302, 4096):
        monkeypatch.setattr(toxicity, "PIECE", piece, raising=False)
        assert toxicity.Scorer(table, 0.0).score(word) == pytest.approx(1 / (1 + np.exp(-want)))
        cols, vals, _ = toxicity._bags([word])
        assert float(vals @ table[cols]) == pytest.approx(want, abs=1e-5)


def test_scores_equal_plain_averages(spark):
    rng = random.Random(15)
    texts = [" ".join(rng.choice(["good", "baad", "bad!", "Ünï", "a", "xy-zz"]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "?!", "w" * 9000]
    model = toxicity.fit([(t or "").encode() for t in texts], np.array([int("bad" in (t or "")) for t in texts]))
    share = toxicity.GAIN * (model.embedding.astype(np.float64) @ (model.weights[:, 1] - model.weights[:, 0]).astype(np.float64))

    def plain(text):
        z = float(model.bias[1] - model.bias[0])
        ws = toxicity.words(text.encode())
        for w in ws:
            m = b"<" + w + b">"
            own = [m, *(m[i : i + n] for n in (3, 4, 5) for i in range(len(m) - n + 1))]
            z += sum(share[zlib.crc32(x) % toxicity.BUCKETS] for x in own) / len(own) / len(ws)
        return 1 / (1 + np.exp(-z))

    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score_texts(docs(spark, texts), model).collect()}
    assert all(got[i] == pytest.approx(plain(t or ""), abs=1e-5) for i, t in enumerate(texts))


# Benchmark passages


@pytest.mark.parametrize("filler", [0, 4000])
def test_contamination_equals_brute_force(spark, filler):
    # With filler the benchmark is larger than the filter, which then lets much else through.
    rng = random.Random(10)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.5 else "".join(rng.choice("abcé") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 30, 3, 1, 2, 10, 9, 0, 14])]
    items += [(20, items[1][1]), (None, "solo zeta"), (8, "other words"), (21, None), (30, " ".join(f"f{i}" for i in range(filler)))]
    texts = []
    for _ in range(80):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            w = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, 3)
            t = t + " " + " ".join(w[cut:]).upper() + "! " + t[:20]
        texts.append(t)
    texts += [None, "", "!!", "Zeta solo zeta"]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["row"]["doc_id"]: r for r in decontam.contamination(docs(spark, texts), b, 1 << 15 if filler else decontam.MOST_BITS).collect()}
    win = defaultdict(set)
    for i, t in items:
        w = decontam.words((t or "").encode())
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            win[tuple(w[k : k + n])].add("null" if i is None else str(i))
    for d, t in enumerate(texts):
        w, hit, found = decontam.words((t or "").encode()), set(), set()
        for p in range(len(w)):
            for n in range(1, 11):
                if tuple(w[p : p + n]) in win and p + n <= len(w):
                    hit |= set(range(p, p + n))
                    found |= win[tuple(w[p : p + n])]
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)), d
    assert decontam.contamination(docs(spark, texts), b.limit(0)).filter("contaminated").count() == 0


def test_words_are_counted_without_a_regular_expression(spark, capsys):
    texts = [None, "", "a", "b", "!", " ab-c ", "Ünï_Zwölf 中文、x", "\x7fa\x80b{c", "é", "9" * 5000, "a b\n" * 3000, ""]
    d = docs(spark, texts)
    got = decontam.contamination(d, spark.createDataFrame([(1, "zzz zzz")], "item_id long, text string")).select("row.doc_id", "n_words")
    assert dict(got.collect()) == {i: len(decontam.words((t or "").encode())) for i, t in enumerate(texts)}
    got.explain()
    assert "regexp_count" not in capsys.readouterr().out
    rng = random.Random(16)
    for _ in range(200):
        some = pa.array([None if rng.random() < 0.2 else bytes(rng.choices(b"aZ09 \n\xc3\xa9\x7f{-", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9))], pa.binary())
        for part in (some, some[2:], some[1:4]):
            assert decontam.word_counts(part).to_pylist() == [len(decontam.words(x)) for x in part.to_pylist()]


def test_a_full_filter_lets_all_through():
    h = decontam.shingles([b"%d" % i for i in range(500)], 3)
    assert len(decontam.Filter(np.full(4096, 255, np.uint8), 1 << 15).has(h)) == 498
    assert not len(decontam.Filter(np.zeros(4096, np.uint8), 1 << 15).has(h))


# Token counts


def test_rollup_is_idempotent_and_signed(spark, tmp_path):
    r = token_rollup.Rollup(spark, str(tmp_path / "rollup"))
    a = spark.createDataFrame([("insert", "s", "en", "two words"), ("insert", "s", None, None), ("insert", None, "en", "x")], "op string, source string, lang string, text string")
    assert r.commit("b1", a) and not r.commit("b1", a)
    old = spark.createDataFrame([("delete", None, "en", "x", None, None, None), ("revise", "t", "en", "one", "s", "en", "two words")], "op string, source string, lang string, text string, old_source string, old_lang string, old_text string")
    assert r.commit("b2", old)
    want = {("s", None, "bytes-1", 1, 0), ("s", None, "words-1", 1, 0), ("t", "en", "bytes-1", 1, 3), ("t", "en", "words-1", 1, 1)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want and not r.commit("b1", a) and not r.commit("b2", old)
    assert r.commit("b3", a.limit(1))
    r.compact()
    assert r.totals().filter("source = 's' and lang = 'en'").count() == 2
    with pytest.raises(Exception, match="unknown op"):
        r.commit("b4", a.withColumn("op", F.lit("?")))
    assert not r.commit("b3", a) and token_rollup.Rollup(spark, str(tmp_path / "new")).totals().count() == 0


def test_published_tokenizers_count(spark):
    try:
        import public_tokenizers as P
    except ImportError:
        pytest.skip("no tokenizer files here")
    count = token_rollup.bpe_tokens(P.path("byte_bpe_50k.json"))
    a = spark.createDataFrame([("insert", "s", "en", "Hello world"), ("insert", "s", "en", None)], "op string, source string, lang string, text string")
    assert token_rollup.deltas(a, {"bpe": count}).first()["n_tokens"] == 2


# Odd input


def test_odd_rows_do_no_harm(spark):
    d = odd(spark)
    n = d.count()
    assert mixing.mix(d).count() == n and mixing.emit(mixing.mix(d)).count() >= 0
    assert suffix_dedup.remove_repeats(d).count() == n
    assert order_minhash.near_duplicates(d).count() == n and order_minhash.keep_one(d).count() == 4
    assert langid.identify(d, langid.train(d), F.col("lang"), F.col("source"), F.lit(None).cast("string")).count() == n
    assert media_avi.store_texts(d).count() == n
    m = toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score_texts(d, m).count() == n
    b = spark.createDataFrame([(None, None), (1, "word1 word2 word3")], "item_id long, text string")
    assert decontam.contamination(d, b).filter("contaminated").count() == 2
    assert token_rollup.deltas(d.withColumn("op", F.lit("insert"))).agg(F.sum("n_docs")).first()[0] == 2 * n
    p = d.withColumn("url", F.col("text")).withColumn("page_id", F.col("doc_id"))
    assert url_rules.judge(p, p.select("url", F.lit(True).alias("blocked"))).count() == n


def test_odd_rows_by_value(spark):
    d, long = odd(spark), " ".join(f"word{i % 977}" for i in range(30_000))
    size = len(long)
    of = lambda df, *cols: sorted((tuple(r) for r in df.select("row.doc_id", *cols).collect()), key=str)
    twice = lambda *rows: sorted((x for r in rows for x in [r] * (2 if r[0] in (1, 3) else 1)), key=str)
    assert of(suffix_dedup.remove_repeats(d), "n_bytes", "n_removed", "n_spans") == twice((None, 0, 0, 0), (1, 0, 0, 0), (2, 1, 0, 0), (3, size, size, 1), (4, 4, 0, 0))
    assert of(order_minhash.near_duplicates(d), "class_id") == twice((None, 1), (1, 1), (2, 2), (3, 3), (4, 4))
    assert of(mixing.mix(d).drop("doc_id"), "size", "source_size") == twice((None, 0, 60_000), (1, 0, 1), (2, 1, 1), (3, 30_000, 60_000), (4, 1, 1))
    got = of(media_avi.store_texts(d), "n_bytes", "payload_bytes", "tail_crc32")
    blank, tail = zlib.crc32(b" " * 16), (long + " " * (-size % 192)).encode()[-16:]
    assert got == twice((None, 0, 192, blank), (1, 0, 192, blank), (2, 1, 192, blank), (3, size, size + -size % 192, zlib.crc32(tail)), (4, 4, 192, blank))
    b = spark.createDataFrame([(None, None), (1, "word1 word2 word3")], "item_id long, text string")
    assert of(decontam.contamination(d, b), "n_words", "n_hit", "n_items") == twice((None, 0, 0, 0), (1, 0, 0, 0), (2, 1, 0, 0), (3, 30_000, 3 * 31, 1), (4, 0, 0, 0))
    m = toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic")))
    assert len({r["score"] for r in toxicity.score_texts(d, m).collect()}) == 1
    p = spark.createDataFrame([(None, None, None), (1, "http://a/", None), (1, "http://a/", None)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("row", "uri", "ts", "digest", "bucket")})
    assert sorted((r["uri"] or "", r["outcome"]) for r in warc.resolve_revisits(warc.captures(p)).collect()) == [("", "missing"), ("a", "resolved"), ("a", "resolved")]
    r = warc.captures(p.limit(0))
    assert warc.resolve_revisits(r.withColumns({c: F.lit(1) for c in ("row", "uri", "best", "outcome", "h")})).count() == 0
    f = spark.createDataFrame([(bytearray(media_avi.encode_avi(b"q" * 192)),)] * 2, "content binary").withColumns({c: F.lit(1) for c in ("row", "clip", "clips", "error")})
    assert [r["clip"]["last_frame"] for r in media_avi.clips(f).collect()] == [0, 0]


def test_empty_tables(spark):
    d = docs(spark, [])
    none = d.select("doc_id", F.lit(1).alias("toxic"))
    assert mixing.mix(d).count() == suffix_dedup.remove_repeats(d).count() == order_minhash.near_duplicates(d).count() == order_minhash.keep_one(d).count() == 0
    assert toxicity.score_texts(d, toxicity.train(d, none)).count() == media_avi.store_texts(d).count() == 0
    assert langid.identify(d, langid.train(d), F.col("lang"), F.col("source"), F.lit(None).cast("string")).count() == 0
    assert url_rules.judge(d.withColumn("url", F.col("text")), d.select(F.col("text").alias("url"), F.lit(True).alias("blocked"))).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.contamination(d, some).count() == decontam.contamination(d, some.limit(0)).count() == 0
    assert token_rollup.deltas(d.withColumn("op", F.lit("insert"))).count() == 0
    assert langid.page_evidence(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))).count() == 0
