"""Token counts kept up to date by signed deltas, with idempotent batch commits."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
_STORE = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def word_tokens(text: Column) -> Column:
    """Maximal runs of letters, digits and marks, and each other visible character."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{Z}\x00-\x20]")), F.lit(0)).cast("long")


def byte_tokens(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bpe_tokens(path: str) -> Callable[[Column], Column]:
    """Counts by a published tokenizer file (``tokenizers`` JSON) at ``path``, a file on every executor."""

    @F.pandas_udf("long")
    def count(parts):
        enc = _tokenizer(path)
        # Batches are encoded a few at a time, so a batch of long texts stays small.
        out = []
        texts = [x or "" for x in parts]
        for i in range(0, len(texts), 64):
            out += [len(e.ids) for e in enc.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
        return pd.Series(out, dtype="int64")

    return lambda text: count(text)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


#: Tokenizer versions by name. The name is the version: a changed rule needs a new name.
VERSIONS: dict[str, Callable[[Column], Column]] = {"bytes-1": byte_tokens, "words-1": word_tokens}


def deltas(changes: DataFrame, versions: dict[str, Callable[[Column], Column]] = VERSIONS) -> DataFrame:
    """Additive deltas of a batch of changes.

    ``changes`` has ``op`` (insert, delete or revise), ``source``, ``lang``, ``text`` and, for a
    revision, ``old_source``, ``old_lang`` and ``old_text``. An insert counts +1, a delete -1, a
    revision -1 for the old form and +1 for the new. All versions are counted in one pass over
    the rows; the sums are combined before the shuffle, so a hot source sends a row per task.
    A null or empty text has no tokens; null sources and languages are groups of their own; an
    unknown or null ``op`` fails the batch; repeated rows each count; very long texts are counted
    whole; an empty batch adds nothing; other columns, whatever their names, are not looked at.
    """
    if "old_text" not in changes.columns:
        changes = changes.withColumns({c: F.lit(None).cast("string") for c in ("old_source", "old_lang", "old_text")})
    new = F.struct(F.lit(1).alias("sign"), "source", "lang", "text")
    gone = F.struct(F.lit(-1).alias("sign"), "source", "lang", "text")
    old = F.struct(F.lit(-1).alias("sign"), F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_text").alias("text"))
    forms = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(gone)).when(F.col("op") == "revise", F.array(old, new))
    forms = F.coalesce(forms, F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op"), F.lit("null")))))
    rows = changes.select(F.explode(forms).alias("f")).select("f.*")
    counts = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), count(F.col("text")).alias("n")) for v, count in versions.items()])
    rows = rows.select("sign", "source", "lang", counts.alias("counts")).select("sign", "source", "lang", F.inline("counts"))
    return rows.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).cast("long").alias("n_tokens"))


class Rollup:
    """Totals by source, language and tokenizer version at a shared path.

    Each batch is one folder ``batch/batch=<id>``, written aside and renamed into place; a batch
    id that is there is not applied again. The store must rename a folder at once or not at all,
    as HDFS and local disks do; on an object store that copies instead, keep the rollup elsewhere.
    Totals are the sum over batches. ``compact`` folds the batches so far into a new base, which
    lists the ids that it holds, so a reader never counts a batch twice and a crash leaves either
    the old or the new base. That list stays with the executors: it is asked for single ids.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self._path(f"{self.path}/{kind}")
        return sorted(s.getPath().getName().partition("=")[2] for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _publish(self, df: DataFrame, kind: str, name: str) -> bool:
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        df.write.parquet(aside)
        self._fs.mkdirs(self._path(f"{self.path}/{kind}"))
        to = self._path(f"{self.path}/{kind}/{kind}={name}")
        done = not self._fs.exists(to) and self._fs.rename(self._path(aside), to)
        # Where another writer came first in between, the rename has put the folder inside its own.
        inside = self._path(f"{self.path}/{kind}/{kind}={name}/{aside.rpartition('/')[2]}")
        if done and self._fs.exists(inside):
            done = not self._fs.delete(inside, True)
        self._fs.delete(self._path(aside), True)
        return done

    def _base(self) -> str | None:
        return max(self._names("base"), default=None)

    def _held(self, base: str | None, names: list[str]) -> set[str]:
        """Which of ``names`` the base holds."""
        if not base or not names:
            return set()
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/base/base={base}/held")
        return {r["batch"] for r in held.filter(F.col("batch").isin(names)).distinct().collect()}

    def commit(self, batch_id: str, changes: DataFrame, versions: dict[str, Callable[[Column], Column]] = VERSIONS) -> bool:
        """Apply a batch once; False if its id was applied before."""
        if not batch_id or any(c in batch_id for c in "/=") or batch_id.startswith((".", "_")):
            raise ValueError("a batch id must be a plain file name")
        if batch_id in self._names("batch") or self._held(self._base(), [batch_id]):
            return False
        return self._publish(deltas(changes, versions), "batch", batch_id)

    def totals(self) -> DataFrame:
        """Current totals; groups whose documents are all gone are left out."""
        base, names = self._base(), self._names("batch")
        held = self._held(base, names)
        paths = [f"{self.path}/batch/batch={b}" for b in names if b not in held]
        if base:
            paths.append(f"{self.path}/base/base={base}/totals")
        if not paths:
            return self.spark.createDataFrame([], _STORE)
        rows = self.spark.read.schema(_STORE).parquet(*paths)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Fold all batches into one base, then remove what it holds."""
        batches, base = self._names("batch"), self._base()
        held = self._held(base, batches)
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{aside}/totals")
        ids = self.spark.createDataFrame([(b,) for b in batches if b not in held], "batch string")
        if base:
            ids = ids.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/base/base={base}/held"))
        ids.coalesce(1).write.parquet(f"{aside}/held")
        self._fs.mkdirs(self._path(f"{self.path}/base"))
        number = int(base) + 1 if base else 1
        if not self._fs.rename(self._path(aside), self._path(f"{self.path}/base/base={number:012d}")):
            raise RuntimeError("another compaction came first")
        for b in batches:
            self._fs.delete(self._path(f"{self.path}/batch/batch={b}"), True)
        if base:
            self._fs.delete(self._path(f"{self.path}/base/base={base}"), True)


SQL = r"""
WITH d AS (SELECT doc_id, source, lang, text, doc_id % 10 AS r FROM documents),
v AS (
  SELECT source, lang, text FROM d WHERE r NOT IN (3, 7)
  UNION ALL SELECT source || '/moved', lang, text || ' ' || text FROM d WHERE r = 7)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM (
  SELECT source, lang, 'bytes-1' AS tokenizer_version, coalesce(strlen(text), 0) AS n FROM v
  UNION ALL SELECT source, lang, 'words-1', coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{Z}\x00-\x20]')), 0) FROM v)
GROUP BY source, lang, tokenizer_version
"""
