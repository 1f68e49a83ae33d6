"""The registered corpus queries and the pipeline over the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import queries

COLUMNS = corpus_pipeline.COLUMNS


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    want = c.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf_dir)
    plain = lambda v: ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(r[c]) for c in want.columns) for r in df.collect())
    assert sorted(want.columns) == sorted(df.columns) and got == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_queries_return_a_row_a_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op3_suffix_array_dedup", "op5_avi_clips", "op7_order_minhash", "op8_language_id", "op9_toxicity"):
        assert queries.QUERIES[name](spark, sf_dir).select("doc_id").distinct().count() == n, name
    assert queries.QUERIES["op6_url_rules"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage against a plain computation on the rows that it is given."""
    from test_stages import covered

    from lumenframe.llm import order_minhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), "test")
        kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == COLUMNS
        after = {r["doc_id"]: r for r in kept[name]}
        if name == "language ID":
            assert len(after) >= 0.99 * len(before)
        if name == "near duplicates":
            w = {i: order_minhash.words((r["text"] or "").encode()) for i, r in before.items()}
            near = lambda a, b: w[a] == w[b] or order_minhash.within(w[a], w[b], order_minhash.most_edits(len(w[a]), len(w[b]), 0.9))
            assert not any(near(a, b) for a in after for b in after if a < b and len(w[a]) >= 20)
            assert all(any(near(i, j) or order_minhash.within(w[i], w[j], order_minhash.most_edits(len(w[i]), len(w[j]))) for j in before if j < i) for i in before.keys() - after.keys())
        if name == "repeated passages":
            ids = sorted(before)
            marks = covered([(before[i]["text"] or "").encode() for i in ids], 200)
            for i, m in zip(ids, marks, strict=True):
                t = (before[i]["text"] or "").encode()
                left = bytes(b for b, c in zip(t, m, strict=True) if not c)
                if left or not t:
                    assert after[i]["text"] == left.decode("utf-8", "ignore") and (any(m) or after[i]["n_chars"] == before[i]["n_chars"])
                else:
                    assert i not in after
    assert {r["copy"] for r in kept["mixing"]} <= {1, 2, 3}
    assert {r["doc_id"] for r in kept["mixing"]} <= {r["doc_id"] for r in kept["benchmark passages"]}


def test_run_repeats_itself(spark, sf_dir):
    a, b = (sorted((r["doc_id"], r["copy"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a and a == b
