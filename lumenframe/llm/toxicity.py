"""Toxicity: subword-bag embeddings, averaged, into a linear softmax; trained jointly in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, packed, sample, utf8

#: Rows and bytes of text that a model is fitted on at most; of the labelled rows those with the least hash of the id.
TRAIN_ROWS, TRAIN_BYTES = 8000, 64 << 20
BUCKETS, DIM, EPOCHS, BATCH = 1 << 17, 12, 8, 64
SHORTEST, LONGEST = 3, 5
#: Bytes of a long word that are taken at a time; longer words are not kept for a second use.
PIECE = 4096
#: The mean is scaled by this before the softmax, so a few words of a long text can carry weight.
GAIN = 60.0
RATE = 0.15
TOXIC_FROM = 0.3

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def subwords(word: bytes) -> Iterator[np.ndarray]:
    """Buckets of the word itself and of its n-grams of 3 to 5 bytes, the ends marked.

    A long word comes in pieces, each with the n-grams that begin in its ``PIECE`` bytes.
    """
    w = b"<" + word + b">"
    for lo in range(0, len(w), PIECE):
        p = w[lo : lo + PIECE + LONGEST - 1]
        grams = [zlib.crc32(p[i : i + n]) % BUCKETS for n in range(SHORTEST, LONGEST + 1) for i in range(min(PIECE, len(p) - n + 1))]
        yield np.array(grams if lo else [zlib.crc32(w) % BUCKETS, *grams], np.int32)


@dataclass
class Model:
    """Subword embeddings, softmax weights and bias; ``level`` shifts all scores if fitted on few rows."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def word_scores(self) -> np.ndarray:
        """A bucket's share in the log-odds: averaging and the softmax's log-odds are both linear."""
        return GAIN * (self.embedding @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)


def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: buckets, weights and row starts. A text without words has an empty row."""
    known: dict[bytes, np.ndarray] = {}
    at, cols, vals = [0], [], []
    for t in texts:
        own: dict[bytes, int] = {}
        for w in words(t):
            own[w] = own.get(w, 0) + 1
        n = sum(own.values())
        parts, weight = [], []
        for w, c in own.items():
            s = known.get(w)
            if s is None:
                s = np.concatenate(list(subwords(w)))
                if len(w) < PIECE:
                    known[w] = s
            parts.append(s)
            weight.append(np.full(len(s), c / n / len(s), np.float32))
        if parts:
            b, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            cols.append(b.astype(np.int32))
            vals.append(np.bincount(inverse, np.concatenate(weight)).astype(np.float32))
        else:
            cols.append(np.zeros(0, np.int32))
            vals.append(np.zeros(0, np.float32))
        at.append(at[-1] + len(cols[-1]))
        if len(known) > 500_000:
            known.clear()
    empty = np.zeros(0, np.int32)
    return np.concatenate([empty, *cols]), np.concatenate([empty.astype(np.float32), *vals]), np.array(at, np.int64)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax learned together by minibatch AdaGrad.

    With one class only, or no rows, the model is the base rate alone.
    """
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    labels = np.asarray(labels, np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(embedding, np.zeros_like(weights), bias)
    cols, vals, at = _bags(texts)
    vals = vals * np.float32(GAIN)
    seen_e, seen_w, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full_like(weights, 1e-6), np.full(2, 1e-6, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            n = at[rows + 1] - at[rows]
            entry = np.repeat(at[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            owner = np.repeat(np.arange(len(rows)), n)
            c, v = cols[entry], vals[entry]
            hidden = np.zeros((len(rows), DIM), np.float32)
            if len(c):
                weighed, full = embedding[c] * v[:, None], n > 0
                hidden[full] = np.add.reduceat(weighed, (np.cumsum(n) - n)[full], axis=0)
            logit = hidden @ weights + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            to_hidden = p @ weights.T
            g = hidden.T @ p
            seen_w += g * g
            weights -= rate * g / np.sqrt(seen_w)
            g = p.sum(0)
            seen_b += g * g
            bias -= rate * g / np.sqrt(seen_b)
            touched, place = np.unique(c, return_inverse=True)
            grad = np.empty((len(touched), DIM), np.float32)
            for d in range(DIM):
                grad[:, d] = np.bincount(place, to_hidden[owner, d] * v, len(touched))
            seen_e[touched] += (grad * grad).mean(1)
            embedding[touched] -= rate * grad / np.sqrt(seen_e[touched])[:, None]
    return Model(embedding, weights, bias)


class Scorer:
    """Scores texts by a table of per-word shares, kept for words seen before."""

    def __init__(self, buckets: np.ndarray, bias: float) -> None:
        self.buckets, self.bias, self.known = buckets, bias, {}

    def _learn(self, word: bytes) -> float:
        if len(word) >= PIECE:
            sums = [(self.buckets[p].sum(dtype=np.float64), len(p)) for p in subwords(word)]
            return float(sum(x for x, _ in sums) / sum(n for _, n in sums))
        if len(self.known) > 200_000:
            self.known.clear()
        s = self.known[word] = float(self.buckets[np.concatenate(list(subwords(word)))].mean())
        return s

    def score(self, text: bytes) -> float:
        get, w = self.known.get, words(text)
        total = 0.0
        for x in w:
            s = get(x)
            total += self._learn(x) if s is None else s
        z = self.bias + (total / len(w) if w else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents, ``TRAIN_BYTES`` of text, that are not held out.

    They are those with the least hash of the id, so any size of corpus gives a like sample, and
    only these texts come to the driver. Null labels and null ids are not learned from; of
    repeated labels of one id the greatest counts; repeated rows count once; of an empty table,
    or of labels of one kind, the model is the base rate alone.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The chosen labels are at most `rows` rows, so the documents meet them in a broadcast.
    chosen = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(marks), "doc_id")
    texts, y = [], []
    for r in sample(chosen, "doc_id", rows, TRAIN_BYTES):
        texts.append(bytes(r["text"]))
        y.append(int(r["toxic"] > 0))
    return fit(texts, np.array(y, np.int64))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` and ``score`` (0 to 1) of each whole text, by the text alone.

    A null or empty text, or one without words, gets the score of the model's bias. Equal texts
    get equal scores, so repeated rows do; long texts are read word by word; an empty table gives
    an empty result. Other columns, whatever their names, are carried in ``row`` and not looked at.
    """
    p = packed(docs, text=utf8())
    out = T.StructType([p.schema["row"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.word_scores().astype(np.float32), float(model.bias[1] - model.bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(x.as_py()) for x in b.column(1)], pa.float64())], names=["row", "score"])

    return mapped(p, run, out)
