"""Language identification by Bayesian fusion of text, declared language and host evidence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, sample, staged, utf8

#: Rows and bytes of text that the text model is fitted on at most: those with the least hash of the id.
TRAIN_ROWS, TRAIN_BYTES = 4000, 64 << 20
#: Rows of the sample that a declared language needs to be modelled; so at most 800 languages are.
LEAST_ROWS = 5
BUCKETS = 1 << 16
#: Bytes of a text that are taken at a time; the trigrams across the cuts are counted.
PIECE = 1 << 20
#: A text's likelihood counts as that of at most this many trigrams: neighbouring ones are not independent.
MOST_EVIDENCE = 100.0
#: Weight, in documents, of a suffix's distribution in its hosts' and of the whole corpus' in a suffix's.
SMOOTHING = 20.0
#: Least posterior of the best language; documents below it are rejected.
MIN_POSTERIOR = 0.5
#: Prior of a text in none of the languages, against the best of them; any trigram is as likely in it.
UNKNOWN = 0.01
NONE = "und"

_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def _buckets(b: np.ndarray) -> np.ndarray:
    b = b.astype(np.uint32)
    return (((b[:-2] * 961 + b[1:-1]) * 961 + b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def trigrams(text: bytes, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Buckets of byte trigrams of the lower-cased letters, runs of other characters as one blank.

    A blank opens and closes the text. The text comes in pieces, each with the last two bytes of
    the one before, so the pieces together have each trigram once.
    """
    tail = np.full(1, 32, np.uint8)
    for lo in range(0, len(text), piece):
        b = np.concatenate([tail, _LETTERS[np.frombuffer(text, np.uint8, min(piece, len(text) - lo), lo)]])
        b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
        if len(b) > 2:
            yield _buckets(b)
        tail = b[-2:]
    if tail[-1] != 32 and len(tail) == 2:
        yield _buckets(np.append(tail, np.uint8(32)))


@dataclass
class TextModel:
    """Log likelihoods of trigram buckets by language; ``langs`` names the columns."""

    langs: list[str]
    loglik: np.ndarray = field(repr=False)

    def score(self, text: bytes) -> tuple[list[float], int]:
        """Log likelihood by language, tempered to ``MOST_EVIDENCE`` trigrams, and the trigrams read."""
        n, total = 0, np.zeros(len(self.langs))
        for t in trigrams(text):
            total += self.loglik[t].sum(0, dtype=np.float64)
            n += len(t)
        return (total * min(1.0, MOST_EVIDENCE / n if n else 0.0)).tolist(), n


def fit(rows: Iterable[tuple[bytes, str]]) -> TextModel:
    """A model of texts and their languages, read one by one."""
    seen: dict[str, np.ndarray] = {}
    for text, lang in rows:
        counts = seen.setdefault(lang, np.full(BUCKETS, 0.1))
        for t in trigrams(text):
            counts += np.bincount(t, minlength=BUCKETS)
    names = sorted(seen)
    loglik = [np.log(seen[x] / seen[x].sum()).astype(np.float32) for x in names]
    return TextModel(names, np.stack(loglik, 1) if names else np.zeros((BUCKETS, 0), np.float32))


def primary(tag: Column) -> Column:
    """Primary subtag of a declared language, lower-cased; null if there is none."""
    x = F.lower(F.regexp_extract(F.trim(tag), "^([A-Za-z]{2,8})(?:[-_]|$)", 1))
    return F.when(x != "", x)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> TextModel:
    """Fit on at most ``rows`` documents that declare a language, ``TRAIN_BYTES`` of text.

    They are those with the least hash of the id; repeated rows count once. A language that fewer
    than ``LEAST_ROWS`` of them declare is not modelled.
    """
    known = docs.select("doc_id", primary(F.col("lang")).alias("lang"), utf8().alias("text")).filter("lang is not null and length(text) > 0")
    tags = known.groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    modelled = [r["lang"] for r in tags.groupBy("lang").count().filter(F.col("count") >= LEAST_ROWS).collect()]
    if not modelled:
        return fit([])
    return fit((bytes(r["text"]), r["lang"]) for r in sample(known.filter(F.col("lang").isin(modelled)), "doc_id", rows, TRAIN_BYTES))


def _scored(p: DataFrame, model: TextModel) -> DataFrame:
    """``p`` (ending in ``text``, binary) with ``ll`` and ``n_trigrams`` in place of the text."""
    others = p.columns[:-1]
    out = T.StructType([*(p.schema[c] for c in others), *T.StructType.fromDDL("ll array<double>, n_trigrams long")])
    shared = p.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.score(x.as_py()) for x in b.column(len(others))]
            cols = [b.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.int64())], names=[*others, "ll", "n_trigrams"])

    return mapped(p, run, out)


def text_scores(docs: DataFrame, model: TextModel) -> DataFrame:
    """``row`` (the input without ``text``), ``ll`` and ``n_trigrams``, written down: texts are read once."""
    kept = docs.drop("text")
    return staged(_scored(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), utf8().alias("text")), model), "lang-text")


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def unknown_text() -> Column:
    """Whether a text has letters and each language makes it less likely than trigrams at random."""
    at_random = F.least(F.col("n_trigrams").cast("double"), F.lit(MOST_EVIDENCE)) * float(-np.log(BUCKETS))
    return (F.col("n_trigrams") > 0) & (F.array_max("ll") < at_random + float(np.log(UNKNOWN)))


def _sums(n: int, of: str = "soft") -> Column:
    return F.array(*[F.sum(F.col(of)[i]) for i in range(n)])


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _soft(n: int) -> Column:
    """What the text alone says; nothing of a text without letters or in none of the languages."""
    return F.when((F.col("n_trigrams") > 0) & ~unknown_text(), _softmax(F.col("ll"))).otherwise(F.array(*[F.lit(1.0 / n)] * n))


def _known(declared: Column, langs: list[str]) -> Column:
    tag = primary(declared)
    return F.when(tag.isin(*langs), tag)


@dataclass
class Priors:
    """What grouped aggregation of text-only posteriors tells of places and declarations.

    ``corpus`` is the log prior over all documents and ``told`` a map from a declared language to
    the log likelihoods of that declaration. ``hosts`` (``h``, ``s``, ``lift``) has, for each host
    and suffix, how far its smoothed log prior lies above the corpus': a host's distribution is
    smoothed with its address suffix's, and that with the corpus'.
    """

    corpus: Column
    told: Column
    hosts: DataFrame


def _priors(langs: list[str], hosts: DataFrame, told: DataFrame, whole: DataFrame) -> Priors:
    """From sums ``soft`` by ``host`` and ``suffix``, by ``said``, and over all documents (rows to be added up)."""
    n = len(langs)
    total = np.array(whole.agg(_sums(n).alias("soft")).first()["soft"], float)  # one row
    total = np.nan_to_num(total) + 1.0
    by = {r["said"]: np.array(r["soft"]) for r in told.filter("said is not null").groupBy("said").agg(_sums(n).alias("soft")).collect()}  # a row a language
    corpus = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    likely = np.array([by.get(x, np.zeros(n)) + 0.5 for x in langs])
    likely = np.log(likely / likely.sum(0))
    likely = F.map_from_arrays(F.array(*map(F.lit, langs)), F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in likely]))
    smooth = lambda own, prior: F.zip_with(own, prior, lambda a, b: (a + SMOOTHING * b) / (F.aggregate(own, F.lit(0.0), lambda x, y: x + y) + SMOOTHING))
    hosts = hosts.groupBy("host", "suffix").agg(_sums(n).alias("soft"))
    suffixes = hosts.groupBy("suffix").agg(_sums(n).alias("soft")).select(F.col("suffix").alias("s"), smooth(F.col("soft"), corpus).alias("at_suffix"))
    hosts = hosts.join(suffixes, hosts["suffix"].eqNullSafe(suffixes["s"]))
    lift = F.zip_with(smooth(F.col("soft"), F.col("at_suffix")), corpus, lambda a, b: F.log(a / b))
    hosts = staged(hosts.select(F.col("host").alias("h"), F.col("suffix").alias("s"), lift.alias("lift")), "lang-hosts")
    return Priors(F.transform(corpus, lambda x: F.log(x)), likely, hosts)


def _decided(d: DataFrame, langs: list[str], logs: Column, said: Column) -> DataFrame:
    """Best language by ``logs``; ``said`` tells whether a known language was declared."""
    d = d.withColumn("post", _softmax(logs)).withColumn("posterior", F.array_max("post"))
    best = F.element_at(F.array(*map(F.lit, langs)), F.array_position("post", F.col("posterior")).cast("int"))
    silent = (F.col("n_trigrams") == 0) & ~said
    rejected = silent | unknown_text() | (F.col("posterior") < MIN_POSTERIOR)
    return d.select("row", F.when(rejected, F.lit(NONE)).otherwise(best).alias("predicted"), best.alias("best"), "posterior", rejected.alias("rejected"))


def _undecided(scored: DataFrame) -> DataFrame:
    return scored.select("row", F.lit(NONE).alias("predicted"), F.lit(None).cast("string").alias("best"), F.lit(0.0).alias("posterior"), F.lit(True).alias("rejected"))


def identify(docs: DataFrame, model: TextModel, declared: Column, host: Column, suffix: Column) -> DataFrame:
    """Language of documents whose own columns hold all evidence.

    log P(L | host) + log P(declared | L) + tempered log P(text | L). Grouped aggregation of the
    text-only posteriors over all documents gives the counts behind the first two; sums are
    combined before the shuffle, so a hot host sends a row a task. The host table has a row per
    host and is written down, so the join back is a broadcast where that table is small. The
    texts are read twice, once for the aggregation and once for the result, and not shuffled.

    Returns ``row`` (the whole input row), ``predicted`` (``und`` if rejected), ``best`` and
    ``posterior`` of the best language, and ``rejected``. A document is rejected if it has no
    letters and no declared language that is known, if no language reaches ``MIN_POSTERIOR``, or
    if its text is in none of the languages (``unknown_text``), whatever is declared; such a text
    adds to no language's counts.

    Defined cases: null or empty texts add no text evidence; a null or unknown declaration adds
    none; a null host or suffix is a group of its own; ties go to the first language by name;
    repeated rows are judged alike and each counts; very long texts are read whole, in pieces;
    without a modelled language all documents are rejected; an empty table gives an empty result.
    """
    langs, n = model.langs, len(model.langs)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marks = [_known(declared, langs).alias("said_"), host.alias("host_"), suffix.alias("suffix_"), utf8().alias("text")]
    if not n:
        return _undecided(docs.select(whole.alias("row")))
    cells = _scored(docs.select(*marks), model).withColumn("soft", _soft(n))
    cells = cells.groupBy(F.col("host_").alias("host"), F.col("suffix_").alias("suffix"), F.col("said_").alias("said")).agg(_sums(n).alias("soft"))
    cells = staged(cells, "lang-counts")
    p = _priors(langs, cells, cells, cells)
    d = _scored(docs.select(whole.alias("row"), *marks), model)
    d = d.join(p.hosts, d["host_"].eqNullSafe(p.hosts["h"]) & d["suffix_"].eqNullSafe(p.hosts["s"]), "left")
    none = F.array(*[F.lit(0.0)] * n)
    logs = _plus(_plus(F.col("ll"), _plus(p.corpus, F.coalesce("lift", none))), F.coalesce(F.try_element_at(p.told, F.col("said_")), none))
    return _decided(d, langs, logs, F.col("said_").isNotNull())


def identify_by_pages(scored: DataFrame, model: TextModel, pages: DataFrame) -> DataFrame:
    """Language of documents with the evidence of all pages that show them.

    ``scored`` is what ``text_scores`` returns; its ``row`` has ``doc_id`` and ``source``.
    ``pages`` has ``doc_id``, ``declared``, ``host`` and ``suffix``, any number of rows for a
    document. Each different host of a document counts the document once for that host, and adds
    how far the host's prior lies above the corpus'; each different declared language adds its
    likelihood. A document without a page has its source as its only host. The evidence of a
    document's pages is added up before the join with the documents, so neither many pages of one
    document nor a hot host come together in a row. Columns as ``identify``.

    Defined cases, beside those of ``identify``: pages without a document's number and pages of
    unknown documents count for nothing; repeated pages count once; documents that share an id
    share its pages; a null id has none; an empty table of pages leaves texts and sources.
    """
    langs, n = model.langs, len(model.langs)
    if not n:
        return _undecided(scored)
    none = F.array(*[F.lit(0.0)] * n)
    seen = pages.filter("doc_id is not null").select(F.col("doc_id").alias("d"), "host", "suffix", _known(F.col("declared"), langs).alias("said"))
    seen = staged(seen.distinct(), "lang-pages")
    base = scored.select(F.col("row.doc_id").alias("id"), F.col("row.source").alias("source"), _soft(n).alias("soft"))
    shown = staged(base.join(seen.select("d").distinct(), F.col("id") == F.col("d"), "left"), "lang-shown")
    own_host = F.concat(F.lit("source:"), F.col("source"))
    lone = shown.filter("d is null").groupBy(own_host.alias("host")).agg(_sums(n).alias("soft")).select("host", F.lit(None).cast("string").alias("suffix"), "soft")
    paged = shown.filter("d is not null").select("d", "soft")
    places, says = seen.select("d", "host", "suffix").distinct(), seen.filter("said is not null").select("d", "said").distinct()
    hosts = places.join(paged, "d").groupBy("host", "suffix").agg(_sums(n).alias("soft")).unionByName(lone)
    p = _priors(langs, hosts, says.join(paged, "d").select("said", "soft"), shown)
    lifts = places.join(p.hosts, places["host"].eqNullSafe(p.hosts["h"]) & places["suffix"].eqNullSafe(p.hosts["s"])).select("d", "lift", F.lit(0).alias("told"))
    lifts = lifts.unionByName(says.select("d", F.element_at(p.told, F.col("said")).alias("lift"), F.lit(1).alias("told")))
    lifts = staged(lifts.groupBy("d").agg(_sums(n, "lift").alias("paged"), F.max("told").alias("told")), "lang-evidence")
    lone_hosts = p.hosts.filter("s is null").select(F.col("h").alias("own"), F.col("lift").alias("sourced"))
    d = scored.join(lifts, scored["row.doc_id"] == lifts["d"], "left")
    d = d.join(lone_hosts, F.concat(F.lit("source:"), F.col("row.source")).eqNullSafe(F.col("own")), "left")
    evidence = F.coalesce("paged", "sourced", none)
    return _decided(d, langs, _plus(_plus(F.col("ll"), p.corpus), evidence), F.coalesce(F.col("told") == 1, F.lit(False)))


def page_evidence(pages: DataFrame) -> DataFrame:
    """``doc_id``, ``declared``, ``host`` and ``suffix`` of each page that shows a document.

    The number in the path is the document's; pages without one, or with a null url, are left out.
    ``declared`` is the ``lang`` of the page's markup, empty if there is none.
    """
    rest = F.substr(F.col("url"), F.instr(F.col("url"), "://") + 3)
    host = F.lower(F.regexp_extract(rest, "^[^/?#:]*", 0))
    doc = F.nullif(F.regexp_extract(rest, "/([0-9]{1,18})(?:[./?#]|$)", 1), F.lit("")).cast("bigint")
    tag = F.regexp_extract(F.coalesce("html", F.lit("")), r"""<html[^>]*\slang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    return pages.select(doc.alias("doc_id"), tag.alias("declared"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix")).filter("doc_id is not null")
