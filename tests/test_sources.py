"""Readers and writers on files of a temporary folder."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pytest

from lumenframe.sources import readers, writers

HEADER = "video_id,local_idx,frame_id,pts_time,shot_id,window_id,keyframe_uid\n"


def test_catalog_round_trip(spark, tmp_path):
    p = tmp_path / "frames.csv"
    p.write_text(HEADER + "L01_V001,0,10,1.0,s000001,,101\nL01_V001,1,20,2.0,s000001,w1,102\n")
    d = readers.read_catalog(spark, str(p))
    assert [tuple(r) for r in d.orderBy("local_idx").collect()][0] == ("L01_V001", 0, 10, 1.0, "s000001", None, 101)
    assert readers.catalog_violations(d).count() == 0
    assert readers.catalog_violations(d.unionByName(d)).count() == 6
    out = str(tmp_path / "published")
    assert writers.publish_catalog(d, out)["rows"] == 2
    with pytest.raises(FileExistsError):
        writers.publish_catalog(d, out)
    assert readers.read_catalog(spark, f"{out}/frames").count() == 2


def test_catalog_refuses_other_header_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_catalog(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text(HEADER + "v,zero,1,1.0,s,,5\n")
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        readers.read_catalog(spark, str(tmp_path / "b.csv")).collect()


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.read_json_lines(spark, str(p), "a int").collect()) == [1, 2]
    p = tmp_path / "b.jsonl"
    p.write_text('{"a": 1}\n[2]\n{oops\n')
    assert readers.bad_json_lines(spark, str(p)).count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_json_lines(spark, str(p), "a int").collect()


def test_manifest_version(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "video_id": "v", "shots": [{"shot_id": "s000001", "start_frame": 0, "end_frame": 4}]}))
    item = "shot_id:string,start_frame:bigint,end_frame:bigint"
    assert readers.read_manifest(spark, str(tmp_path / "m.json"), "shots", item, 1).first()["end_frame"] == 4
    with pytest.raises(Exception, match="schema_version"):
        readers.read_manifest(spark, str(tmp_path / "m.json"), "shots", item, 2).collect()


def test_snapshots(spark, tmp_path):
    from lumenframe import schemas

    region = ("r1", None, None, " xin chào ", 0.8, True, False, "hello", 0.9, "vintern", False, None)
    d = spark.createDataFrame([("v", "s", 0, 1, 10, "text_detected", [region]), ("v", "s", 1, 2, 20, "no_text", []), ("v", "s", 2, 3, 30, "text_detected", [])], schemas.OCR_FRAMES)
    s = readers.snapshot_from_regions(d)
    got = {r["keyframe_uid"]: tuple(r)[3:] for r in s.collect()}
    assert got == {1: ("success", "easyocr", "xin chào", "vi", 0.8), 2: ("no_text", "easyocr", None, None, None), 3: ("error", "easyocr", None, None, None)}
    final = readers.snapshot_from_regions(d, "final_text", "final_confidence").filter("keyframe_uid = 1").first()
    assert (final["engine"], final["detected_text"], final["confidence"]) == ("vintern", "hello", 0.9)
    a = writers.publish_snapshot(s, str(tmp_path), "20260101T000000Z")
    b = writers.publish_snapshot(s.repartition(3), str(tmp_path / "again"), "20260101T000000Z")
    assert a == b and a.startswith("ocr-snapshot-20260101T000000Z-")
    with pytest.raises(FileExistsError):
        writers.publish_snapshot(s, str(tmp_path), "20260101T000000Z")
    p = writers.build_postings(s)
    assert writers.probe_postings(p, s).count() == 0 and writers.probe_postings(p.limit(0), s).count() == 1


def test_envelopes(spark):
    from lumenframe import schemas

    d = spark.createDataFrame([("b", "v", 1, 0, "x", "m", "success", "easyocr", False, (["a", "b"], None, "en", 0.5), []), ("b", "v", 2, 0, "x", "m", "error", "easyocr", False, (["z"], None, "en", 0.5), [])], schemas.ENVELOPE)
    got = [tuple(r)[5:] for r in readers.snapshot_from_envelopes(d).orderBy("keyframe_uid").collect()]
    assert got == [("a\nb", "en", 0.5), (None, None, None)]


def test_vector_shards(spark, tmp_path):
    for k in range(2):
        np.save(tmp_path / f"shard-{k}.uids.npy", np.arange(3) + 10 * k)
        np.save(tmp_path / f"shard-{k}.vectors.npy", np.eye(3, 4, dtype=np.float16))
    d = readers.read_npy_vectors(spark, str(tmp_path))
    assert d.count() == 6 and d.filter("keyframe_uid = 11").first()["vector"] == [0.0, 1.0, 0.0, 0.0]
    c = spark.createDataFrame([(x,) for x in (0, 1, 2, 10, 11, 99)], "keyframe_uid long")
    got = {(r["keyframe_uid"], r["reason"]) for r in readers.vector_violations(d, c, 4).collect()}
    assert got == {(12, "foreign"), (99, "missing")}
    np.save(tmp_path / "shard-1.uids.npy", np.arange(2))
    with pytest.raises(Exception, match="shard-1"):
        readers.read_npy_vectors(spark, str(tmp_path)).collect()


def test_query_bundle(spark, tmp_path):
    for n, t in (("query-10-kis", "find it"), ("query-9-qa", "who?"), ("query-1-trake", "E1: a\nE2: b")):
        (tmp_path / f"{n}.txt").write_text(t)
    got = [(r["query_name"], r["task"], r["event_count"]) for r in readers.read_query_bundle(spark, str(tmp_path)).collect()]
    assert got == [("query-1-trake", "TRAKE", 2), ("query-9-qa", "QA", 0), ("query-10-kis", "KIS", 0)]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("q-kis.txt", "find")
        z.writestr("sub/x-kis.txt", "no")
    assert [r["query_name"] for r in readers.read_query_bundle(spark, str(tmp_path / "b.zip")).collect()] == ["q-kis"]
    (tmp_path / "bad-trake.txt").write_text("E1: a\nE3: b")
    with pytest.raises(Exception, match="not numbered"):
        readers.read_query_bundle(spark, str(tmp_path)).collect()


def test_listing_and_checksums(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.MP4").write_bytes(b"x")
    (tmp_path / "v" / "b.txt").write_bytes(b"x")
    assert [r["stem"] for r in readers.list_files(spark, str(tmp_path / "v"), (".mp4",)).collect()] == ["a"]
    (tmp_path / "S").write_text("a" * 64 + "  one.bin\n" + "b" * 64 + "  two.bin\n")
    sums = readers.read_checksums(spark, str(tmp_path / "S"))
    assert sums.count() == 2
    state = lambda r: readers.remote_state(sums, r).first()["state"]
    assert [state(sums), state(sums.limit(0)), state(sums.filter("name = 'one.bin'"))] == ["complete", "missing", "partial"]


def test_probe(spark):
    j = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 640, "height": 360, "avg_frame_rate": "30000/1001", "r_frame_rate": "0/0"}], "format": {"duration": "10.01"}})
    r = readers.probe_rows(spark.createDataFrame([("v", "v.mp4", j)], "video_id string, relative_path string, probe string")).first()
    assert (r["width"], r["frame_count"], r["has_audio"]) == (640, 300, True)


def test_submission_zip(spark):
    d = spark.createDataFrame([(1, "v", 5, 'say "a", b'), (2, "v", 6, "x")], "position int, video_id string, frame_id int, answer string")
    data = writers.submission_zip({"q1": writers.submission_lines(d, "QA")})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.read("q1.csv") == b'v,5,"say ""a"", b"\nv,6,x\n'
    with pytest.raises(ValueError, match="1 to 100"):
        writers.submission_zip({"q": writers.submission_lines(d.limit(0), "QA")})


def test_drafts(spark, tmp_path):
    from lumenframe.sources.drafts import Drafts

    c = spark.createDataFrame([("v", i, float(i)) for i in range(5)], "video_id string, frame_id long, pts_time double")
    d = Drafts(spark, {"a": ("KIS", 0), "t": ("TRAKE", 2)})
    row = lambda *f: {"video_id": "v", "frame_ids": list(f)}
    d.replace("a", [row(1), row(2)])
    assert d.merge("a", [row(2), row(3)]) == 1
    d.move("a", 2, 0)
    d.remove("a", 1)
    assert [r["frame_ids"] for r in d.rows["a"]] == [[3], [2]]
    d.replace("t", [row(2, 1)])
    assert d.violations("t", c) == [["not_rising"]]
    with pytest.raises(ValueError, match="not_rising"):
        d.export(c)
    d.replace("t", [row(1, 2)])
    d.save(str(tmp_path / "d.json"))
    e = Drafts.load(spark, str(tmp_path / "d.json"))
    with zipfile.ZipFile(io.BytesIO(e.export(c))) as z:
        assert z.read("a.csv") == b"v,3\nv,2\n" and z.read("t.csv") == b"v,1,2\n"
    with pytest.raises(ValueError, match="unknown query"):
        d.merge("x", [])
