"""Cascaded full-text search: phrase, all-terms and prefix stages, ranked by BM25 inside each stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..workspace import staged

K1, B = 1.2, 0.75
BOOST = {"exact": 1.0, "full": 0.85, "prefix": 0.65}
ORDER = {"exact": 0, "full": 1, "prefix": 2}
PREFIX_POOL = 5000
#: Similarity from which a row gets a share of it, the share, and the rows looked at (fixed values).
FUZZY, FUZZY_SHARE, FUZZY_ROWS = 0.55, 0.4, 500


@dataclass(frozen=True)
class Asked:
    """A query's phrases as lists of index terms, and its distinct words, plain and as index terms."""

    phrases: list[list[str]]
    words: list[str]
    terms: list[str]


def asked(spark, phrases: list[str]) -> Asked:
    """Cut the query as the index cuts texts; one row of constants."""
    some = [p for p in phrases if p.strip()]
    if not some:
        return Asked([], [], [])
    words = T.tokens(F.lit(" ".join(some)))
    r = spark.range(1).select(F.array(*[T.index_terms(F.lit(p)) for p in some]).alias("p"), words.alias("w"), F.transform(words, T.index_terms).alias("t")).first()
    return Asked([list(p) for p in r["p"] if p], list(r["w"]), [t[0] if t else "" for t in r["t"]])


def phrase_hits(terms: Column, phrase: list[str]) -> Column:
    """Occurrences of consecutive terms, overlapping ones counted.

    The terms are one text here, so that a term list is made once a row and not once a place.
    """
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")), F.lit(f"(?= {' '.join(phrase)} )"))


def bm25(frequency: Column, n_docs: Column, with_term: Column, length: Column, mean_length: Column) -> Column:
    idf = F.greatest(F.log((n_docs - with_term + 0.5) / (with_term + 0.5)), F.lit(1e-6))
    return idf * frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / mean_length))


def _begins(term: str) -> Callable[[Column], Column]:
    return lambda x: F.startswith(x, F.lit(term))


def _back(k: int) -> Callable[[Column], Column]:
    """Of one argument: a second one, a default too, would get the index of the element from Spark."""
    return lambda x: x - k


def _frequencies(q: Asked, phrase: Callable, term: Callable, prefix: Callable) -> list[Column]:
    """Columns e0.., f0.., p0..: how often each phrase, term and prefix occurs."""
    out = [phrase(p).cast("int").alias(f"e{k}") for k, p in enumerate(q.phrases)]
    out += [term(t).cast("int").alias(f"f{k}") for k, t in enumerate(q.terms)]
    return out + [prefix(t).cast("int").alias(f"p{k}") for k, t in enumerate(q.terms)]


def scan(docs: DataFrame, q: Asked) -> DataFrame:
    """keyframe_uid, video_id, n_terms and the frequencies of all documents, in one pass over their texts."""
    d = docs.select("keyframe_uid", "video_id", T.index_terms(F.col("text")).alias("terms"))
    terms = F.col("terms")
    return d.select("keyframe_uid", "video_id", F.size("terms").alias("n_terms"), *_frequencies(q, lambda p: phrase_hits(terms, p), lambda t: F.size(terms) - F.size(F.array_remove(terms, t)), lambda t: F.size(F.filter(terms, _begins(t)))))


def postings(docs: DataFrame) -> DataFrame:
    """An index: term, keyframe_uid, video_id, n_terms and the term's positions. Write it ordered by term."""
    d = docs.select("keyframe_uid", "video_id", T.index_terms(F.col("text")).alias("terms"))
    d = d.select("keyframe_uid", "video_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("pos", "term"))
    return d.groupBy("term", "keyframe_uid", "video_id", "n_terms").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def look_up(index: DataFrame, q: Asked) -> DataFrame:
    """What ``scan`` returns, of the documents that have any of the query's terms, from ``postings``.

    Only the postings of the query's terms are read: the test on ``term`` reaches the files.
    """
    needed = sorted({t for p in q.phrases for t in p} | set(q.terms))
    test = reduce(lambda a, b: a | b, [F.col("term").isin(needed), *[F.startswith("term", F.lit(t)) for t in q.terms]])
    at = {t: F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), F.array().cast("array<int>")) for t in needed}
    hits = index.filter(test).groupBy("keyframe_uid", "video_id", "n_terms")
    names = {t: f"at{i}" for i, t in enumerate(needed)}
    begun = [F.sum(F.when(F.startswith("term", F.lit(t)), F.size("positions")).otherwise(0)).alias(f"b{k}") for k, t in enumerate(q.terms)]
    d = hits.agg(*[c.alias(names[t]) for t, c in at.items()], *begun)

    def phrase(p: list[str]) -> Column:
        starts = [F.transform(F.col(names[t]), _back(k)) for k, t in enumerate(p)]
        return F.size(reduce(F.array_intersect, starts))

    return d.select("keyframe_uid", "video_id", "n_terms", *_frequencies(q, phrase, lambda t: F.size(F.col(names[t])), lambda t: F.col(f"b{q.terms.index(t)}")))


def rank_factor() -> Column:
    return 1 - 0.1 * F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1))


def coverage(text: Column, words: list[str]) -> Column:
    """0.5 + half the share of query words that begin one of the text's first 20 distinct words."""
    own = T.tokens(text)
    hits = reduce(lambda a, b: a + b, [F.exists(own, _begins(t)).cast("int") for t in words])
    return 0.5 + 0.5 * hits / len(words)


def _ranked(found: DataFrame, sizes: tuple[int, float], names: list[str], stage: str, limit: int, every: bool, restrict: list | None) -> DataFrame:
    """Documents of one stage with ``rank`` from 0 by BM25, and ``n``, the rows of the stage.

    Document frequencies are those of the whole index, whatever the restriction; the restriction
    comes before the limit.
    """
    n_docs, mean = sizes
    with_term = found.agg(*[F.count_if(F.col(c) > 0).alias(f"d_{c}") for c in names])
    test = reduce(lambda a, b: (a & b) if every else (a | b), [F.col(c) > 0 for c in names])
    m = found.filter(test).crossJoin(F.broadcast(with_term))  # one row of statistics
    if restrict is not None:
        m = m.filter(F.col("video_id").isin(*restrict))
    score = reduce(lambda a, b: a + b, [bm25(F.col(c), F.lit(n_docs), F.col(f"d_{c}"), F.col("n_terms"), F.lit(mean)) for c in names])
    m = m.select("keyframe_uid", "video_id", F.round(score, 9).alias("relevance")).orderBy(F.col("relevance").desc(), "video_id", "keyframe_uid").limit(limit)
    w = Window.partitionBy()  # over the stage's rows, ``limit`` at most
    m = m.withColumn("rank", F.row_number().over(w.orderBy(F.col("relevance").desc(), "video_id", "keyframe_uid")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return m.withColumn("stage", F.lit(stage))


def stages(docs: DataFrame, phrases: list[str], limit: int = 1000, restrict: list | None = None, index: DataFrame | None = None, sizes: tuple[int, float] | None = None) -> dict[str, DataFrame]:
    """The three stages for one query. ``phrases`` are the query's literals.

    Without ``index`` the texts are read once, and only frequencies are written down; with it
    (``postings``, and ``sizes``: the number of texts and their mean number of terms) just the
    query's postings are. Texts come back for the rows of a stage alone.
    """
    q = asked(docs.sparkSession, phrases)
    if not q.phrases or not q.terms:
        return {}
    found = staged(scan(docs, q) if index is None else look_up(index, q), "frequencies")
    if sizes is None:
        r = (found if index is None else scan(docs, Asked([], [], []))).agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("mean")).first()
        sizes = (r["n"], r["mean"] or 0.0)
    names = lambda kind, n: [f"{kind}{k}" for k in range(n)]
    out = {
        "exact": _ranked(found, sizes, names("e", len(q.phrases)), "exact", limit, False, restrict),
        "full": _ranked(found, sizes, names("f", len(q.terms)), "full", limit, True, restrict),
        "prefix": _ranked(found, sizes, names("p", len(q.terms)), "prefix", PREFIX_POOL, False, restrict),
    }
    rows = staged(reduce(DataFrame.unionByName, out.values()), "stages")
    rows = rows.join(docs.select("keyframe_uid", "text").join(rows.select("keyframe_uid").distinct(), "keyframe_uid", "left_semi"), "keyframe_uid")
    cover = lambda s: coverage(F.col("text"), q.words) if s == "prefix" else F.lit(1.0)
    return {s: rows.filter(F.col("stage") == s).withColumn("score", BOOST[s] * cover(s) * rank_factor()) for s in out}


def search(docs: DataFrame, phrases: list[str], limit: int = 1000, restrict: list | None = None, fuzzy: bool = False, index: DataFrame | None = None, sizes: tuple[int, float] | None = None) -> DataFrame:
    """keyframe_uid, video_id, text and score: the best score over the stages, greatest first.

    With ``fuzzy`` the first 500 rows (by stage, then rank) also get 0.4 of their similarity to
    the query where that is at least 0.55.
    """
    got = stages(docs, phrases, limit, restrict, index, sizes)
    if not got:
        return docs.select("keyframe_uid", "video_id", "text", F.lit(0.0).alias("score")).limit(0)
    rows = reduce(DataFrame.unionByName, got.values())
    place = F.coalesce(*[F.when(F.col("stage") == s, F.lit(k)) for s, k in ORDER.items()])
    best = rows.groupBy("keyframe_uid").agg(F.max("score").alias("score"), F.min(F.struct(place.alias("s"), "rank")).alias("first"), F.first("video_id").alias("video_id"), F.first("text").alias("text"))
    if fuzzy:
        best = staged(best, "found")
        needle = " ".join(asked(docs.sparkSession, phrases).words)
        close = best.orderBy("first", "keyframe_uid").limit(FUZZY_ROWS).select("keyframe_uid", T.similarity(F.lit(needle), F.lower("text")).alias("ratio"))
        best = best.join(close, "keyframe_uid", "left").withColumn("score", F.greatest("score", F.when(F.col("ratio") >= FUZZY, FUZZY_SHARE * F.col("ratio"))))
    return best.select("keyframe_uid", "video_id", "text", "score").orderBy(F.col("score").desc(), "keyframe_uid").limit(limit)


def rows_by_id(docs: DataFrame, ids: list[int]) -> DataFrame:
    """Texts of the ids in the order asked for, blank ones left out, each at score 1.

    The ids are the caller's own list; the planner chooses the join by its size.
    """
    wanted = docs.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, keyframe_uid long")
    return docs.join(wanted, "keyframe_uid").filter(F.trim("text") != "").select("pos", "keyframe_uid", "video_id", "text", F.lit(1.0).alias("score"))
