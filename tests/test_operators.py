"""Operators on small hand-made rows."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import hashing
from lumenframe.functions import text as T
from lumenframe.operators import coverage, fusion, portfolio, quality, ranking, residuals, routing, sequence, setops, text_search, timeline, validation, vector_search


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def evidence(spark, items):
    return spark.createDataFrame(items, "video_id string, shot_id string, keyframe_uid long, score double")


def test_uid_golden_value(spark):
    d = spark.createDataFrame([("L01_V001", "s000001", 2)], "v string, s string, i int")
    assert d.select(hashing.keyframe_uid(F.col("v"), F.col("s"), F.col("i"))).first()[0] == 8984422734592370359


def test_digests_ignore_or_keep_order(spark):
    import hashlib

    d = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "p int, i long")
    r = d.agg(hashing.set_digest(F.col("i")).alias("s"), hashing.sequence_digest(F.col("p"), F.col("i")).alias("q")).first()
    assert r["s"] == hashlib.sha256(b"1\n3\n").hexdigest() and r["q"] == hashlib.sha256(b"3\n1\n3\n").hexdigest()


def test_minmax_flat_group_is_one_and_nan_fails(spark):
    d = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    assert rows(d.select("g", "x", fusion.minmax(F.col("x"), "g").alias("n")), "n") == [(0.0,), (1.0,), (1.0,), (1.0,)]
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(float("nan"),), (1.0,)], "x double").select(fusion.minmax(F.col("x"))).collect()


def test_smooth_rank_fusion_orders_by_both_channels(spark):
    s = spark.createDataFrame([(0, 1, 0.9, 0.8), (0, 2, 0.7, 0.2), (0, 3, 0.1, 0.7)], "query_id long, keyframe_uid long, sig double, eva double")
    ref = {"sig": spark.createDataFrame([(0, [0.9, 0.7, 0.1])], "query_id long, sig array<double>"), "eva": spark.createDataFrame([(0, [0.8, 0.7, 0.2])], "query_id long, eva array<double>")}
    got = {r["keyframe_uid"]: r["fused"] for r in fusion.fuse_channels(s, ref).collect()}
    assert got[1] > got[2] and got[1] > got[3]


def test_query_combination_adds_a_tenth_of_the_second(spark):
    d = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5), (1, 1, 0.5), (1, 2, 1.0)], "query_id long, keyframe_uid long, fused double")
    assert {r["score"] for r in fusion.combine_queries(d).collect()} == {1.0}


def test_missing_channel_equals_visual_alone(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.2)], "keyframe_uid long, score double")
    both = fusion.fuse_modalities({"visual": v, "ocr": v.limit(0)}, {"visual": 0.55, "ocr": 0.45})
    assert rows(both, "keyframe_uid", "fused") == [(1, 1.0), (2, 0.0)]


def test_union_of_hits_keeps_one_row_a_key(spark, sf_dir):
    from lumenframe.queries import retrieval

    scored, hits = retrieval._scored(spark, sf_dir)
    got = vector_search.consensus(hits, scored)
    assert got.count() == scored.count() == got.select("query_id", "keyframe_uid").distinct().count()


def test_top_k_settles_ties_by_id(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(99, [2.0, 0.0])], "keyframe_uid long, clip array<double>").repartition(5)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, clip array<double>")
    got = [r["keyframe_uid"] for r in vector_search.top_k(v, q, "clip", 4).orderBy("rank").collect()]
    assert got == [99, 0, 1, 2]
    assert vector_search.top_k(v, q.limit(0), "clip", 4).count() == 0


def test_anchor_merge_raises_and_adds(spark):
    e = evidence(spark, [("v", "s16", 6471, 0.95), ("v", "s17", 7000, 0.80)])
    a = evidence(spark, [("v", "s16", 6471, 0.20), ("v", "s18", 7100, 0.75)])
    got = {r["keyframe_uid"]: r["score"] for r in fusion.merge_anchors(e, a).collect()}
    assert got[6471] >= 0.95 and 7100 in got and got[7000] == 0.80


def test_clip_tie_break_uses_the_group_leader(spark):
    d = spark.createDataFrame([("v1", 0.90, 0.2), ("v2", 0.89, 0.8)], "video_id string, video_score double, support double")
    assert [r["video_id"] for r in ranking.tie_break(d).orderBy("rank").collect()] == ["v2", "v1"]
    d = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.99, 0.1), ("c", 0.985, 0.2), ("d", 0.975, 0.3), ("e", 0.96, 0.4), ("f", 0.90, 0.5)], "video_id string, video_score double, support double")
    assert [r["video_id"] for r in ranking.tie_break(d).orderBy("rank").collect()] == ["c", "b", "a", "e", "d", "f"]


def test_beam_needs_rising_time(spark):
    m = spark.createDataFrame([(0, "v1", "s1", 1, 1, 1.0, 0.9), (0, "v2", "s1", 2, 2, 1.0, 0.9), (1, "v1", "s2", 3, 3, 4.0, 0.8), (1, "v1", "s3", 4, 4, 0.5, 0.9)], "moment int, video_id string, shot_id string, keyframe_uid long, frame_id long, pts_time double, score double")
    got = sequence.beam_sequences(m, 2).collect()
    assert [(r["video_id"], r["frame_ids"]) for r in got] == [("v1", [1, 3])]


def greedy(grouped, most=100, cap=40, first=30):
    """The result list by its rules, one place at a time."""
    counts = {v: 0 for v, _, _ in grouped}
    size = {v: min(len(c), cap) for v, _, c in grouped}
    out = []

    def take(v):
        if counts[v] < size[v] and len(out) < most:
            out.append((v, counts[v]))
            counts[v] += 1

    names = [v for v, _, _ in grouped]
    for i in (0, 0, 1, 0, 2):
        if i < len(names):
            take(names[i])
    total, target = min(most, sum(size.values())), dict(counts)
    for upto, least in ((5, 2), (12, 1), (1, first)):
        for v in names[:upto]:
            room = total - sum(target.values())
            target[v] += min(max(0, min(least, size[v]) - target[v]), max(room, 0))
    score = {v: max(s, 1e-6) for v, s, _ in grouped}
    while sum(target.values()) < total:
        v = max((v for v in names if target[v] < size[v]), key=lambda v: (score[v] / (target[v] + 1), -names.index(v)))
        target[v] += 1
    strength = {v: c for v, _, c in grouped}
    while len(out) < total:
        v = min((v for v in names if counts[v] < target[v]), key=lambda v: (counts[v] / target[v], -strength[v][counts[v]], names.index(v)))
        take(v)
    return out


@pytest.mark.parametrize(("videos", "frames", "step"), [(3, 4, 0.1), (3, 40, 0.1), (12, 40, 0.04), (1, 7, 0.1), (20, 9, 0.01)])
def test_portfolio_equals_the_greedy_rules(spark, videos, frames, step):
    grouped = [(f"v{i:02d}", max(1 - step * i, 0.0), [1 - 0.01 * j - 0.003 * ((i * 7 + j) % 5) for j in range(frames)]) for i in range(videos)]
    d = spark.createDataFrame([(v, i, s, j, x) for i, (v, s, c) in enumerate(grouped) for j, x in enumerate(c)], "video_id string, rank int, video_score double, place int, strength double")
    got = [(r["video_id"], r["place"]) for r in portfolio.portfolio(d).orderBy("position").collect()]
    assert got == greedy(grouped)
    if videos == 3 and frames == 4:
        assert [v for v, _ in got[:5]] == ["v00", "v00", "v01", "v00", "v02"]


def test_first_video_opens_with_three_shots(spark):
    e = evidence(spark, [("v1", "s16", 6480, 1.00), ("v1", "s16", 6471, 0.99), ("v1", "s14", 6430, 0.98), ("v1", "s15", 6462, 0.97)])
    v = spark.createDataFrame([("v1", 0, 0.9)], "video_id string, rank int, video_score double")
    got = portfolio.kis_candidates(v, e).orderBy("place").collect()
    assert [r["keyframe_uid"] for r in got] == [6480, 6430, 6462, 6471]


def test_answers_settle(spark):
    d = spark.createDataFrame([("a", 0, "42", 0.5), ("a", 1, " 42. ", 0.6), ("a", 2, "7", 0.99), ("b", 0, "x", 0.2), ("b", 1, "y", 0.3)], "video_id string, step int, answer string, confidence double")
    got = {r["video_id"]: (r["answer"].strip(" ."), r["settled"]) for r in portfolio.settle_answers(d).collect()}
    assert got == {"a": ("42", True), "b": ("y", False)}


def test_postings_count_phrases_as_a_scan_does(spark):
    texts = ["gia dau mazut", "mazut dau", "dau mazut dau mazut", "dau dau dau x dau dau", "dau x mazut", "x dau mazut dau", ""]
    docs = spark.createDataFrame([(i, "v", t) for i, t in enumerate(texts)], "keyframe_uid long, video_id string, text string")
    q = text_search.asked(spark, ["dau mazut", "dau mazut dau", "dau dau dau", "dau"])
    got = [{r["keyframe_uid"]: tuple(r[f"e{k}"] for k in range(4)) for r in d.collect()} for d in (text_search.scan(docs, q), text_search.look_up(text_search.postings(docs), q))]
    assert got[0] == got[1] | {6: (0, 0, 0, 0)}
    assert got[1] == {0: (1, 0, 0, 1), 1: (0, 0, 0, 1), 2: (2, 1, 0, 2), 3: (0, 0, 1, 5), 4: (0, 0, 0, 1), 5: (1, 1, 0, 2)}


def test_text_search_cascade_and_restriction(spark):
    docs = spark.createDataFrame([("target", 1, "gia dau mazut"), ("noise", 2, "dau " * 100)], "video_id string, keyframe_uid long, text string")
    got = text_search.search(docs, ["dau mazut"]).collect()
    assert [r["keyframe_uid"] for r in got] == [1, 2] and got[0]["score"] > got[1]["score"]
    d = spark.createDataFrame([("v1", 1, "hello hello hello"), ("v2", 2, "hello")], "video_id string, keyframe_uid long, text string")
    assert [r["keyframe_uid"] for r in text_search.search(d, ["hello"], 1, ["v2"]).collect()] == [2]
    assert text_search.search(d, ["  "]).count() == 0


def test_bm25_matches_sqlite(spark):
    import sqlite3

    texts = ["a cat sat", "cat cat dog", "dog", "the cat and the dog and the bird", "bird bird"]
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(x)")
    c.executemany("insert into t values (?)", [(t,) for t in texts])
    want = {r[0] - 1: -r[1] for r in c.execute("select rowid, bm25(t) from t where t match '\"bird\"'")}
    docs = spark.createDataFrame([("v", i, t) for i, t in enumerate(texts)], "video_id string, keyframe_uid long, text string")
    got = {r["keyframe_uid"]: r["relevance"] for r in text_search.stages(docs, ["bird"])["exact"].collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in got)


def test_index_folds_single_marks_only(spark):
    d = spark.createDataFrame([("giá dầu Đường tiếng a_b",)], "t string")
    got = d.select(T.index_terms(F.col("t"))).first()[0]
    assert got == ["gia", "dầu", "đuờng", "tiếng", "a", "b"]


def test_text_helpers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(T.best_number(F.array(F.lit("x 12 and 6549"), F.lit("77777")))) == "77777"
    assert get(T.quoted(F.lit('say "a  b" or “cd” or \'ef\' or "g'))) == ["a b", "cd", "ef"]
    assert get(T.literals(F.lit("thông tin về giá vàng hiển thị cùng 'AB c', con số hiển thị"))) == ["AB c", "giá vàng"]
    assert [get(T.value_type(F.lit(x))) for x in ("How many?", "màu gì", "WHO", "ở đâu", "tell")] == ["number", "color", "person", "place", "free_text"]
    assert get(T.scenes(F.lit("Một người đi. Sau đó, anh ta nói - next: x"))) == ["Một người đi.", "anh ta nói"]
    assert [get(T.frame_language(F.lit(a), F.lit(b), F.lit(c))) for a, b, c in ((True, False, None), (False, False, None), (True, True, False), (False, False, True))] == ["vi", "en", "mixed", "mixed"]
    assert [get(T.low_information(F.lit(x))) for x in ("", "7:05", "VTV 3", "10:30 HTV7 HD", "live", None)] == [True, True, True, True, False, True]
    assert get(T.safe_zip_name(F.lit("a/my file.v1.zip"))) == "myfilev1.zip"
    assert get(T.json_texts(F.lit('[" a ", "b", "a", ""]'))) == ["a", "b"] and get(T.json_texts(F.lit('"x"'))) == ["x"] and get(T.json_texts(F.lit("null"))) == []
    assert get(T.zoned_time(F.lit("2026-01-01T00:00:00"))) is None and get(T.compact_utc(T.zoned_time(F.lit("2026-01-01T02:00:00+02:00")))) == "20260101T000000Z"
    assert get(T.natural_key(F.lit("q10"))) > get(T.natural_key(F.lit("q9")))
    assert get(T.safe_component(F.lit("../a b"))) == "a-b" and get(T.safe_component(F.lit("?"))) == "query"
    assert get(T.first_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert get(T.similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert not get(T.is_relative_path(F.lit("a/../b"))) and get(T.is_relative_path(F.lit("a/b.jpg")))


def test_routing_and_guard(spark):
    d = spark.createDataFrame([("", 0.9, False, False), ("abc", 0.3, False, False), ("a?c", 0.5, True, True), ("abc", 0.7, True, True), ("abc", None, False, False)], "t string, c double, m boolean, w boolean")
    got = [r[0] for r in d.select(routing.region_reasons(F.col("t"), F.col("c"), F.col("m"), F.col("w"))).collect()]
    assert got == [["empty_text"], ["confidence_lt_0_40"], ["region_mixed_0_40_to_0_60", "ambiguous_glyph_0_40_to_0_60"], [], ["confidence_lt_0_40"]]
    g = spark.createDataFrame([("ab", ""), ("ab", "The text is BLURRY"), ("ab", "x" * 97)], "e string, o string")
    assert [r[0] for r in g.select(routing.output_reasons(F.col("e"), F.col("o"))).collect()] == [["empty_output"], ["prompt_or_explanation_leak"], ["gross_length_expansion"]]


def test_calibration_counts_and_backs_off(spark):
    d = spark.createDataFrame([("abc", "abc", "abc"), ("abd", "abd", "abd"), ("abe", "abe", "abf"), ("x" * 40, "x" * 40, "x" * 40)], "e string, o string, t string")
    e = d.withColumn("buckets", routing.buckets(F.col("e"), F.col("o"))).withColumn("correct", F.col("o") == F.col("t"))
    table = routing.fit_calibration(e)
    fine = [r for r in table.collect() if r["bucket"].startswith("fine") and r["support"] == 3]
    assert len(fine) == 1 and fine[0]["correct"] == 2 and math.isclose(fine[0]["accuracy"], 2 / 3)
    got = rows(routing.calibrated(e, table, 3), "e", "bucket_support")
    assert got[:3] == [("abc", 3), ("abd", 3), ("abe", 3)] and got[3][1] is None


def test_override_is_strict_and_audited(spark):
    d = spark.createDataFrame([(1, True, True, [], 0.6, 0.5), (2, True, True, [], 0.5, 0.5), (3, True, False, [], 0.9, 0.5), (4, False, False, [], 0.9, 0.5), (5, True, True, ["x"], 0.9, 0.5)], "i int, routed boolean, has_result boolean, rejection array<string>, calibrated double, easyocr_confidence double").withColumn("easyocr_text", F.lit("a")).withColumn("vintern_text", F.lit("b"))
    o = routing.overrides(d)
    assert rows(o, "i", "final_engine", "residual") == [(1, "vintern", False), (2, "easyocr", True), (3, "easyocr", True), (4, "easyocr", False), (5, "easyocr", True)]
    assert routing.override_violations(o).count() == 0
    assert routing.override_violations(o.withColumn("final_engine", F.lit("vintern"))).count() == 4


def test_residual_pages_part_exactly(spark):
    d = spark.createDataFrame([("v", "s", u, r) for u in range(4) for r in range(10)], "video_id string, shot_id string, keyframe_uid long, region_id int")
    q = residuals.requests(d)
    assert [len(p) for p in q.first()["pages"]] == [18, 18, 4]
    assert residuals.partition_violations(d, q).count() == 0
    assert residuals.partition_violations(d.filter("region_id > 0"), q).count() == 4


def test_budget_takes_part_of_the_last_shot(spark):
    d = spark.createDataFrame([("v", "a", 1, 9.0), ("v", "a", 2, 8.0), ("v", "b", 3, 7.0), ("v", "b", 4, 6.0), ("v", "c", 5, 5.0)], "video_id string, shot_id string, keyframe_uid long, priority double")
    assert rows(residuals.select_within_budget(d, 2, 3), "keyframe_uid", "route") == [(1, "paid"), (2, "paid"), (3, "paid"), (4, "overflow"), (5, "overflow")]


def test_overlay_in_the_top_corner(spark):
    quad = [0.9, 0.02, 0.98, 0.02, 0.98, 0.08, 0.9, 0.08]
    d = spark.createDataFrame([("v", i, quad, t) for i, t in enumerate(["HTV", "HTV9", "H"])], "video_id string, keyframe_uid long, q array<double>, text string")
    d = d.withColumn("g", residuals.overlay_group(residuals.box(F.col("q")), F.col("text"))).select("*", "g.group_id")
    n = spark.createDataFrame([("v", 3)], "video_id string, video_frames long")
    marked = residuals.suppress_overlays(d, residuals.overlay_groups(d, n, 2, 0.1))
    assert marked.filter("suppress").count() == 3


def test_coverage_and_gate(spark):
    r = spark.createDataFrame([(1, "success"), (1, "success"), (2, "error"), (9, "no_text")], "keyframe_uid long, status string")
    s = coverage.summary(r, spark.createDataFrame([(1,), (2,), (3,)], "keyframe_uid long")).first()
    assert (s["expected"], s["records"], s["duplicates"], s["missing"], s["foreign"], s["gate"]) == (3, 4, 1, 1, 1, "FAIL")
    e = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.5,)], "x double")
    assert [r["nearest"] for r in coverage.nearest_percentile(e, [], "x", 0.5).collect()] == [2.5]


def test_quality_fallback_and_near_copies(spark):
    d = spark.createDataFrame([("v", "s0", 0, 1, 1.0, "00"), ("v", "s0", 1, 2, 3.0, "00"), ("v", "s0", 2, 3, 2.0, "00"), ("v", "s1", 3, 4, 200.0, "00"), ("v", "s1", 4, 5, 300.0, "01"), ("v", "s1", 5, 6, 250.0, "ff")], "video_id string, shot_id string, local_idx int, keyframe_uid long, variance double, phash string")
    got = rows(quality.assess(d, 100.0, 1), "keyframe_uid", "reason", "duplicate_of")
    assert got == [(1, "blur", None), (2, "kept_best_blur_fallback", None), (3, "blur", None), (4, "kept", None), (5, "near_duplicate", 4), (6, "kept", None)]
    assert rows(quality.assess(d, None, 0).filter("kept"), "keyframe_uid") == [(1,), (4,), (5,), (6,)]


def test_hamming_of_full_words(spark):
    d = spark.createDataFrame([("ffffffffffffffff", "0"), ("8000000000000000", "8000000000000001")], "a string, b string")
    assert [r[0] for r in d.select(hashing.hamming(F.col("a"), F.col("b"))).collect()] == [64, 1]


def test_timeline_gaps_samples_neighbours(spark):
    s = spark.createDataFrame([("v", 5, 9), ("v", 12, 20)], "video_id string, start_frame long, end_frame long")
    n = spark.createDataFrame([("v", 25)], "video_id string, frame_count long")
    assert rows(timeline.gaps(s, n), "start_frame", "end_frame") == [(0, 4), (10, 11), (21, 24)]
    f = spark.createDataFrame([("v", i, i, float(i), "s") for i in range(6)], "video_id string, keyframe_uid long, frame_id long, pts_time double, shot_id string")
    got = {r["keyframe_uid"]: r["neighbours"] for r in timeline.neighbours(f).collect()}
    assert got[0] == [1, 2] and got[3] == [1, 2, 4, 5]
    assert rows(timeline.evenly_spaced(f, 3, ["video_id"], ["frame_id"]), "frame_id") == [(0,), (2,), (5,)]
    b = timeline.boost(f, spark.createDataFrame([(2, 1.0), (3, 0.5)], "keyframe_uid long, fused double"))
    assert {r["keyframe_uid"]: round(r["boosted"], 4) for r in b.collect()} == {2: 1.0375, 3: 0.575}


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k long") for xs in ((1, 2), (2, 3)))
    assert rows(setops.difference(a, b, "k"), "k", "kind") == [(1, "missing"), (3, "unexpected")]
    with pytest.raises(Exception, match="in two parts"):
        setops.union_disjoint({"a": a, "b": b}, "k").collect()
    index, known = a.withColumnRenamed("k", "keyframe_uid"), spark.createDataFrame([("s", "1")], "source string, signature string")
    batch = b.withColumnRenamed("k", "keyframe_uid")
    assert setops.append_new(index, batch, known, "s", "1").count() == 0
    with pytest.raises(Exception, match="another signature"):
        setops.append_new(index, batch, known, "s", "2").collect()
    with pytest.raises(Exception, match="already indexed"):
        setops.append_new(index, batch, known, "t", "1").collect()


def test_submission_rules(spark):
    c = spark.createDataFrame([("v", 1, 1.0), ("v", 2, 2.0)], "video_id string, frame_id long, pts_time double")
    d = spark.createDataFrame([("q", "KIS", "v", [1], None, None), ("q", "KIS", "v", [1], None, None), ("q", "KIS", "v", [9], None, None), ("r", "QA", "v", [1], "Unknown", False), ("r", "QA", "v", [2], "x", True), ("t", "TRAKE", "v", [2, 1], None, None), ("t", "TRAKE", "v", [1, 2], None, None), ("t", "TRAKE", "v", [1], None, None)], "query_name string, task string, video_id string, frame_ids array<long>, answer string, requires_review boolean")
    got = defaultdict(list)
    for r in validation.submission_violations(d, c, 2).collect():
        got[r["query_name"]] += [tuple(r["reasons"])]
    assert sorted(got["q"]) == [("duplicate",), ("unknown_frame",)]
    assert sorted(got["r"]) == [("needs_review",), ("placeholder_answer",)]
    assert sorted(got["t"]) == [("event_count",), ("not_rising",)]


def test_video_scores_over_shots(spark):
    d = spark.createDataFrame([(0, "v", "a", 1.0), (0, "v", "a", 0.9), (0, "v", "b", 0.5), (0, "w", "a", 0.2)], "query_id long, video_id string, shot_id string, score double")
    got = {r["video_id"]: (round(r["video_score"], 6), r["rank"]) for r in ranking.video_scores(d).collect()}
    assert got == {"v": (0.925, 1), "w": (0.2, 2)}


def test_empty_inputs(spark):
    e = evidence(spark, [])
    assert ranking.best_per_shot(e).count() == 0
    assert portfolio.portfolio(spark.createDataFrame([], "video_id string, rank int, video_score double, place int, strength double")).count() == 0


def test_answers_prefer_evidence_and_fall_back(spark):
    from lumenframe.operators import answers

    f = spark.createDataFrame([("v1", 1, 1, 1.0), ("v1", 2, 2, 2.0), ("v2", 3, 3, 1.0), ("v2", 4, 4, 2.0)], "video_id string, keyframe_uid long, frame_id long, pts_time double")
    t = spark.createDataFrame([(1, "text 12"), (2, "6549"), (3, "no digits"), (4, "seven 7")], "keyframe_uid long, text string")
    e = f.filter("frame_id in (1, 3)").select("video_id", "keyframe_uid")
    none = spark.createDataFrame([], "video_id string, keyframe_uid long, score double")
    assert rows(answers.extract(e, none, t, f, "number"), "video_id", "answer") == [("v1", "6549"), ("v2", "7")]
    hits = spark.createDataFrame([("v1", 2, 0.9), ("v1", 1, 0.1)], "video_id string, keyframe_uid long, score double")
    assert rows(answers.extract(e, hits, t, f, "text"), "video_id", "answer", "answer_confidence") == [("v1", "text 12", 0.65), ("v2", "no digits", 0.65)]


def test_image_metrics(spark):
    import numpy as np

    flat, edge = np.full((40, 50), 9, np.uint8), np.zeros((40, 50), np.uint8)
    edge[:, 25:] = 255
    d = spark.createDataFrame([(1, bytearray(flat.tobytes()), 50, 40), (2, bytearray(edge.tobytes()), 50, 40), (3, bytearray(b"x"), 50, 40), (4, None, None, None)], "keyframe_uid long, pixels binary, width int, height int")
    got = {r["keyframe_uid"]: r for r in quality.image_metrics(d).collect()}
    assert got[1]["variance"] == 0 and got[2]["variance"] > 100 and got[3]["phash"] is None and got[4]["variance"] is None
    rng = np.random.default_rng(0)
    picture = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    other = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    bits = lambda a, b: bin(int(quality.perceptual_hash(a), 16) ^ int(quality.perceptual_hash(b), 16)).count("1")
    assert len(got[2]["phash"]) == 16 and bits(picture, np.clip(picture, 4, 250)) <= 4 < 15 < bits(picture, other)


def test_no_query_or_setting_past_the_64th_is_dropped(spark):
    ids = range(70)
    labels = spark.createDataFrame([("locator", -1)] + [("target", q) for q in ids], "role string, query_id long")
    scores = spark.createDataFrame([(q, 1, q / 100, True) for q in range(-1, 70)], "query_id long, video_id long, video_score double, hit boolean")
    e = {r["role"]: r for r in ranking.role_evidence(scores, labels).collect()}
    assert e["target"]["matched"] == list(ids) and e["target"]["coverage"] == 1.0
    v = ranking.rank_videos(scores, labels, spark.createDataFrame([(q,) for q in ids], "query_id long"), scores.select("video_id", F.lit(0.0).alias("consensus")).distinct())
    assert v.first()["video_score"] == pytest.approx(0.35 * e["locator"]["evidence"] + 0.45 * e["target"]["evidence"] + 0.10 * 0.69)
    results = spark.createDataFrame([(1, f"c{i}") for i in ids] + [(2, "c0")], "keyframe_uid long, config_id string")
    assert sorted(r["config_id"] for r in coverage.grid_gaps(results).collect()) == sorted(f"c{i}" for i in range(1, 70))


def test_top_k_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector_search, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector_search, "HELD_BLOCKS", 1)
    m = np.random.default_rng(3).normal(size=(50, 4)).round(1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "keyframe_uid long, clip array<double>").repartition(3)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m[:8])], "query_id long, clip array<double>")
    got = {(r["query_id"], r["rank"]): r["keyframe_uid"] for r in vector_search.top_k(v, q, "clip", 5).collect()}
    for i in range(8):
        s = m @ m[i]
        assert [got[i, n + 1] for n in range(5)] == sorted(range(50), key=lambda j: (-s[j], j))[:5]


def test_nearest_frame_equals_all_pairs(spark):
    import random

    rng = random.Random(4)
    f = [(rng.choice("ab"), i, float(rng.randint(0, 40))) for i in range(60)] + [("c", 99, 5.0)]
    s = [(rng.choice("abz"), i, float(a := rng.randint(-3, 45)), float(a + rng.randint(0, 6))) for i in range(50)]
    got = {(r["video_id"], r["segment_id"]): (r["keyframe_uid"], r["inside"]) for r in timeline.nearest_frame(spark.createDataFrame(s, "video_id string, segment_id long, start_time double, end_time double"), spark.createDataFrame(f, "video_id string, keyframe_uid long, pts_time double")).collect()}
    want = {}
    for v, i, a, z in s:
        own = [(not a <= t <= z, abs(t - a), t, k) for w, k, t in f if w == v]
        if own:
            want[v, i] = (min(own)[3], not min(own)[0])
    assert got == want


def test_rank_over_all_and_budget(spark):
    d = spark.range(0, 500).select(((F.col("id") * 7919) % 1009).alias("x"), "id").repartition(6)
    got = [r["rank"] for r in timeline.rank_over_all(d, [F.col("x"), F.col("id")]).orderBy("x", "id").collect()]
    assert got == list(range(1, 501))


def test_frame_rerank_and_payload(spark):
    f = spark.createDataFrame([("v", i, 0.5) for i in range(4)], "video_id string, frame_id long, score double")
    p = spark.createDataFrame([("v", "2", "x", ["3", "3", "9", "a", "1"], [" s ", ""])], "video_id string, must_score string, should_score string, ranked_frame_ids array<string>, scene_matches array<string>")
    v = fusion.valid_verdicts(p, f)
    assert tuple(v.first()) == ("v", 1.0, 0.0, [3, 1], ["s"])
    assert [round(r["score"], 6) for r in fusion.rerank_frames(f, v).orderBy("frame_id").collect()] == [0.5, 0.35, 0.5, 0.65]


def test_selection_names_what_is_not_there(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "v string, x int")
    assert [r["x"] for r in setops.select_groups(d, ["b", "a"], "v").orderBy("place", "x").collect()] == [2, 1, 3]
    with pytest.raises(Exception, match="not in the catalog: c"):
        setops.select_groups(d, ["c"], "v").collect()
