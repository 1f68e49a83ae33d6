"""Exact vector search: top-k by inner product, and scores of given ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a block, and blocks of queries whose best a task holds at once.
VECTOR_BLOCK, QUERY_BLOCK, HELD_BLOCKS = 4096, 1024, 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _best(uids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: greatest score, then least id."""
    if len(uids) > 4 * k:  # all at or above the k-th score take part, so ties are settled by id
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= edge
        uids, scores = uids[keep], scores[keep]
    order = np.lexsort((uids, -scores))[:k]
    return uids[order], scores[order]


def _blocks(rows: DataFrame, key: str, channel: str, size: int, prefix: str) -> DataFrame:
    """Rows of up to ``size`` vectors of one partition: ids and a matrix, both as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                ids, flat = part.column(0).to_numpy(), part.column(1).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([flat.astype("<f8").tobytes()], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_matrix"])

    some = rows.filter(F.col(channel).isNotNull()).select(F.col(key).cast("long"), F.col(channel).cast("array<double>"))
    return some.mapInArrow(run, f"{prefix}_ids binary, {prefix}_matrix binary")


def top_k(vectors: DataFrame, queries: DataFrame, channel: str, k: int) -> DataFrame:
    """query_id, keyframe_uid, score and rank (from 1) of the k nearest vectors of each query.

    Vectors and queries are packed into blocks where they lie; each block of vectors meets each
    block of the stated queries in one matrix product, and a task keeps k a query. The blocks are
    rows: the planner broadcasts the smaller side if its size allows and else pairs partitions.
    """
    pairs = _blocks(vectors, "keyframe_uid", channel, VECTOR_BLOCK, "v").crossJoin(_blocks(queries, "query_id", channel, QUERY_BLOCK, "q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out(key: bytes) -> Iterator[pa.RecordBatch]:
            for q, (u, s) in zip(np.frombuffer(key, "<i8").tolist(), held.pop(key), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), q)), pa.array(u), pa.array(s)], names=["query_id", "keyframe_uid", "score"])

        for b in batches:
            for v_ids, v_m, q_ids, q_m in zip(*(b.column(i) for i in range(4)), strict=True):
                key, uids, ids = q_ids.as_py(), np.frombuffer(v_ids.as_py(), "<i8"), np.frombuffer(q_ids.as_py(), "<i8")
                scores = np.frombuffer(q_m.as_py(), "<f8").reshape(len(ids), -1) @ np.frombuffer(v_m.as_py(), "<f8").reshape(len(uids), -1).T
                if key not in held:
                    if len(held) == HELD_BLOCKS:
                        yield from out(next(iter(held)))
                    held[key] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
                for i, (u, s) in enumerate(held[key]):
                    top = _best(uids, scores[i], k)
                    held[key][i] = _best(np.concatenate([u, top[0]]), np.concatenate([s, top[1]]), k)
        for key in list(held):
            yield from out(key)

    found = pairs.select("v_ids", "v_matrix", "q_ids", "q_matrix").mapInArrow(run, "query_id long, keyframe_uid long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "keyframe_uid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def score_given(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, channels: list[str]) -> DataFrame:
    """Scores of all ``channels`` for given (query_id, keyframe_uid): missing channels are filled in."""
    v = vectors.select("keyframe_uid", *[F.col(c).alias(f"v_{c}") for c in channels])
    q = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in channels])
    j = candidates.select("query_id", "keyframe_uid").join(v, "keyframe_uid").join(q, "query_id")
    return j.select("query_id", "keyframe_uid", *[dot(F.col(f"v_{c}"), F.col(f"q_{c}")).alias(c) for c in channels])


def consensus(hits: dict[str, DataFrame], scored: DataFrame) -> DataFrame:
    """1.0 for an id in both direct hit lists of the query, 0.5 in one, else 0."""
    marks = None
    for name, h in hits.items():
        m = h.select("query_id", "keyframe_uid", F.lit(name).alias("channel"))
        marks = m if marks is None else marks.unionByName(m)
    n = marks.groupBy("query_id", "keyframe_uid").agg(F.countDistinct("channel").alias("n"))
    value = F.when(F.col("n") >= 2, 1.0).when(F.col("n") == 1, 0.5).otherwise(0.0)
    return scored.select("query_id", "keyframe_uid").join(n, ["query_id", "keyframe_uid"], "left").select("query_id", "keyframe_uid", value.alias("consensus"))
