"""Plans, planners and the search engine."""

from __future__ import annotations

import json

import numpy as np
import pytest

from lumenframe.operators import text_search
from lumenframe.plans import planner
from lumenframe.plans.engine import Encoders, Registry, SearchEngine
from lumenframe.plans.planner import PlannerChain, from_old_form, repair, rule_plan
from lumenframe.plans.query_plan import ANSWER, EVENT, LOCATOR, TARGET, Answer, QueryPlan, Unit, normal_roles


def test_rules():
    p = rule_plan('A man walks. Then a sign written "OPEN 24" is displayed.', "KIS")
    assert p.visible_text == ("OPEN 24",) and p.channel_weights() == {"visual": 0.55, "ocr": 0.45}
    assert p.with_roles([TARGET])[0].unit_id == p.units[-1].unit_id
    q = rule_plan("A shop. How many people are there?", "QA")
    assert (q.question, q.value_type) == ("How many people are there?", "number")
    t = rule_plan("Cooking\nE1: cut\nE2: fry", "TRAKE")
    assert [u.text for u in t.with_roles([EVENT])] == ["cut", "fry"] and t.units[0].text == "Cooking"
    with pytest.raises(ValueError, match="empty"):
        rule_plan("  ", "KIS")


def test_repair_and_roles():
    assert normal_roles(["target", "nonsense", "TARGET_MOMENT"]) == (TARGET,)
    raw = 'find the sign "OPEN"'
    p = repair("```json\n" + json.dumps({"query_units": [{"text": "a sign", "roles": "locator", "modalities": ["ocr", "x"], "known_text_literals": ["OPEN", "invented"]}]}) + "\n```", raw, "KIS")
    assert p.units[0].literals == ("OPEN",) and TARGET in p.units[0].roles
    with pytest.raises(ValueError, match="no JSON"):
        repair("sorry", raw, "KIS")


def test_literals_are_what_a_frame_shows():
    raw = "Tìm cảnh có thông tin về giá vàng hiển thị trên màn hình, dòng chữ 'SJC 9999'"
    assert planner.visible_literals(raw, ["giá", "5 chữ", "invented"]) == ("SJC 9999", "giá vàng", "giá")
    assert planner.visible_literals("con số hiển thị") == ()
    # Quoted text is no literal of a frame unless the query speaks of text.
    assert rule_plan('He says "hello there"', "KIS").spoken_text == ("hello there",)
    p = rule_plan('He says "hello there"', "KIS")
    assert p.visible_text == () and p.units[-1].modalities == ("visual", "asr") and p.weights == {"visual": 0.55, "asr": 0.45}


def test_events_run_on_to_the_next_mark():
    p = rule_plan("Cooking show\nE1: cut\n the meat.\nE2 fry it\nE3- eat", "TRAKE")
    assert [u.text for u in p.ordered(p.events)] == ["cut the meat", "fry it", "eat"] and p.units[0].roles == (LOCATOR,)
    with pytest.raises(ValueError, match="two ordered events"):
        rule_plan("E1: alone", "TRAKE")
    with pytest.raises(ValueError, match="not 2"):
        p.validated(2)


def test_a_question_has_a_target_that_is_no_literal():
    p = rule_plan("A shop front. Số mấy trên biển hiệu? Then rain.", "QA")
    assert p.answer == Answer("Số mấy trên biển hiệu?", "number", "ocr", (p.units[-1].unit_id,)) and p.units[-1].roles == (LOCATOR, TARGET, ANSWER)
    assert p.visible_text == () and p.units[-1].literals == ()


def test_provider_plans_are_made_good():
    raw = 'A car stops. A man reads the sign "EXIT" and asks who it is?'
    told = {
        "global_context_en": "a car and a man",
        "retrieval_queries": ["car", {"text": "man"}, "third"],
        "negative_constraints": ["no rain"],
        "must_have": "car",
        "query_units": [
            {"unit_id": "a", "description_original": "a CAR stops.", "retrieval_query_en": "car", "roles": "video", "modalities": "ocr", "confidence": 7, "temporal_group": -3, "requiredness": "should"},
            "not a unit",
            {"unit_id": "b", "description_original": "made up", "roles": ["EVIDENCE", "ORDERED_EVENT"], "known_text_literals": ["EXIT", "NOTHING"], "confidence": "x"},
        ],
        "answer_target": {"evidence_unit_ids": ["a", "b"], "value_type": "odd"},
        "submission_target_ids": ["a"],
    }
    p = repair(json.dumps(told), raw, "QA")
    a, b = p.units
    assert (a.text, a.modalities, a.confidence, a.group, a.required) == ("car", ("visual", "ocr"), 1.0, 0, False)
    assert b.source == 'A man reads the sign "EXIT" and asks who it is?' and b.literals == ("EXIT",) and b.roles == (ANSWER, TARGET) and b.confidence == 0.7
    assert p.targets == p.answer.evidence == ("b",) and p.answer.value_type == "person" and p.queries == ("car", "man") and p.must == ("car",)
    assert len(p.warnings) == 2 and p.visible_text == ("EXIT",)


def test_provider_plans_without_units():
    p = repair(json.dumps({"scenes": [{"caption": "one"}, "two"], "anchor_moment_index": 0}), "Một người. Rồi đi", "KIS")
    assert [u.text for u in p.units] == ["one", "two"] and p.targets == ("unit-1",)
    t = repair(json.dumps({"ordered_moments": ["x", "y"]}), "Lead\nE1: a\nE2: b", "TRAKE")
    assert [u.unit_id for u in t.units] == ["locator-1", "event-1", "event-2"] and [u.source for u in t.units][1:] == ["a", "b"]
    with pytest.raises(ValueError, match="two ordered events"):
        repair(json.dumps({"query_units": [{"retrieval_query_en": "x", "roles": ["EVENT"]}]}), "a. b. c", "TRAKE")
    twice = repair(json.dumps({"query_units": [{"unit_id": "u", "description": "x"}, {"unit_id": "u", "description": "y"}]}), "x then y", "KIS")
    assert [u.unit_id for u in twice.units] == ["unit-1", "unit-2"] and TARGET in twice.units[-1].roles


def test_old_plans_and_faults():
    assert from_old_form({"raw_query": "q", "ordered_moments": ["a", "b"]}, "TRAKE").events == ("event-1", "event-2")
    old = from_old_form({"raw_query": "q", "scenes": ["a", "b"], "answer_source": "visible_text", "anchor_moment_index": 0}, "QA")
    assert old.targets == ("unit-1",) and old.answer.source == "ocr"
    p = rule_plan("a walk. b talk", "KIS")
    for change, why in (({"targets": ("x",)}, "own units"), ({"weights": {"ocr": 1.0}}, "weights"), ({"units": (*p.units, p.units[0])}, "differ"), ({"events": ("unit-1",)}, "role of an event"), ({"task": "X"}, "unknown task"), ({"targets": ("unit-1",)}, "target")):
        with pytest.raises(ValueError, match=why):
            p.edited(**change)
    assert p.edited(context="c").changed


def test_texts_labels_and_weights():
    p = QueryPlan("raw", "KIS", (Unit("a", "one", (LOCATOR,)), Unit("b", " two ", (TARGET,), ("visual", "ocr"), ("L",))), "whole", ("whole", "more"), must=("must",), should=("one",), targets=("b",))
    assert p.search_texts() == ["whole", "more", "one", "two", "must"] and p.search_texts((TARGET,), False) == ["two"]
    assert p.labels() == {"locator": ("one",), "target": ("two",), "whole": ("whole", "more")}
    assert p.channel_weights() == {"visual": 0.55, "ocr": 0.45} and p.channel_weights((LOCATOR,)) == {"visual": 1.0}
    assert [u.unit_id for u in p.ordered(["b", "x", "a"])] == ["b", "a"]


def test_chain_rests_after_two_failures():
    now, asked = [0.0], []

    def broken(q, t):
        asked.append(q)
        raise TimeoutError

    c = PlannerChain([("a", broken)], clock=lambda: now[0])
    assert [c.plan("x y z", "KIS").provider for _ in range(3)] == ["rule"] * 3
    assert len(asked) == 2
    now[0] = 61
    c.plan("x y z", "KIS")
    assert len(asked) == 3


@pytest.fixture(scope="module")
def engine(spark):
    rng = np.random.default_rng(5)
    n = 60
    frames = spark.createDataFrame([(f"v{i % 4}", f"s{i // 8}", i + 1, i, float(i)) for i in range(n)], "video_id string, shot_id string, keyframe_uid long, frame_id int, pts_time double")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sig, eva = unit(rng.normal(size=(n, 8))), unit(rng.normal(size=(n, 8)))
    vectors = spark.createDataFrame([(i + 1, s.tolist(), e.tolist(), s.tolist()) for i, (s, e) in enumerate(zip(sig, eva, strict=True))], "keyframe_uid long, sig array<double>, eva array<double>, clip array<double>")
    ocr = spark.createDataFrame([(7, "v2", "OPEN late")], "keyframe_uid long, video_id string, text string")

    def encode(texts):
        at = [sum(map(ord, t)) % n for t in texts]
        return {"sig": [sig[i].tolist() for i in at], "eva": [eva[i].tolist() for i in at], "clip": [sig[i].tolist() for i in at]}

    return SearchEngine(spark, Registry(frames, vectors, ocr), encode, top_k=10), encode


def test_search_kis(engine):
    e, encode = engine
    got = e.search(e.plan('A man walks. The sign "OPEN" is displayed.', "KIS"), most=20).collect()
    assert 0 < len(got) <= 20 and [r["position"] for r in got] == list(range(1, len(got) + 1))
    assert len({r["keyframe_uid"] for r in got}) == len(got)
    assert encode(["x"])["sig"]


def test_search_trake_and_qa(engine, spark):
    e, _ = engine
    got = e.search(e.plan("Cooking\nE1: cut it\nE2: fry it", "TRAKE"), most=10).collect()
    assert got and all(r["frame_ids"] == sorted(r["frame_ids"]) and len(r["frame_ids"]) == 2 for r in got)
    answers = spark.createDataFrame([(f"v{i}", "42", 0.9) for i in range(4)], "video_id string, answer string, answer_confidence double")
    qa = e.search(e.plan("A shop. How many people are there?", "QA"), answers, most=5).collect()
    assert qa and {r["answer"] for r in qa} == {"42"}


def test_rollback_to_clip(engine):
    e, encode = engine
    f = SearchEngine(e.spark, e.registry, lambda t: {"clip": encode(t)["clip"]}, top_k=10)
    ev = f.retrieve(f.plan("A man walks.", "KIS"))
    assert ev.mode == "clip" and ev.warnings and {r["consensus"] for r in ev.frames.select("consensus").collect()} <= {0.0, 0.5}
    assert ev.frames.filter("sig is not null or eva is not null or clip is null").count() == 0


def test_an_encoder_that_raises_sends_the_request_to_clip(engine):
    e, encode = engine

    def broken(texts):
        raise RuntimeError("no model")

    channels = {c: lambda t, c=c: encode(t)[c] for c in ("eva", "clip")}
    f = SearchEngine(e.spark, e.registry, Encoders(channels | {"sig": broken}), top_k=10)
    ev = f.retrieve(f.plan("A man walks.", "KIS"))
    assert ev.mode == "clip" and "RuntimeError: no model" in ev.warnings[0] and ev.frames.count() > 0
    # Without clip the primary channels go on alone.
    g = SearchEngine(e.spark, e.registry, Encoders({c: lambda t, c=c: encode(t)[c] for c in ("sig", "eva")} | {"clip": broken}), top_k=10)
    ev = g.retrieve(g.plan("A man walks.", "KIS"))
    assert ev.mode == "primary" and ev.warnings and ev.frames.filter("clip is not null").count() == 0


def test_registry_and_index(engine, spark):
    e, _ = engine
    r = e.registry
    got = {x["artifact"]: x["status"] for x in r.inspect({"sig": 8, "eva": 9}).collect()}
    assert got == {"frames": "READY", "sig": "READY", "eva": "INVALID", "clip": "READY", "ocr": "READY", "asr": "UNAVAILABLE"}
    docs = spark.createDataFrame([(i, f"v{i % 3}", t) for i, t in enumerate(["gia dau mazut", "dau " * 9, "mazut dau", "", "dau mazut dau mazut", "daum mazuts"])], "keyframe_uid long, video_id string, text string")
    index = text_search.postings(docs)
    for words in (["dau mazut"], ["dau", "mazut dau"], ["maz"]):
        a = [tuple(x) for x in text_search.search(docs, words, 10, fuzzy=True).collect()]
        assert a == [tuple(x) for x in text_search.search(docs, words, 10, fuzzy=True, index=index, sizes=(6, docs.selectExpr("avg(size(filter(split(text, ' '), x -> x != '')))").first()[0])).collect()]
