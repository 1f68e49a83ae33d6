"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontam, langid, mixing, order_minhash, suffix_dedup
from lumenframe.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: text, declared ``lang`` and the source's prior are weighed.

    Null or empty texts stay if their ``lang`` is a known language; repeated rows are judged alike;
    long texts are read whole; columns other than those of ``documents`` are dropped, and an empty
    table stays empty. The other stages treat the last two cases alike.
    """
    docs = docs.select(*COLUMNS)
    judged = langid.identify(docs, langid.train(docs), F.col("lang"), F.col("source"), F.lit(None).cast("string"))
    return judged.filter(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least id, null ids last.

    All null and empty texts are one class; of rows that are wholly alike one stays; long texts
    are aligned whole.
    """
    return order_minhash.keep_one(docs.select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; characters that a cut parts go whole.

    A document of which nothing is left goes, unless its text was empty before. ``n_chars`` is
    counted anew. Null texts stay null, repeated rows lose what they share, long texts are read whole.
    """
    d = suffix_dedup.remove_repeats(docs.select(*COLUMNS), kept_as="string")
    cut = d.filter((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept"))
    cut = cut.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))
    return cut.select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Null or empty texts stay; repeated rows go or stay together; long texts are read whole.
    """
    found = decontam.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with ``copy`` from 1.

    A null or empty text has no words, so it may be drawn but counts for nothing; null sources are
    a source; repeated rows are documents of their own.
    """
    return mixing.emit(mixing.mix(docs.select(*COLUMNS)))


STAGES = [("language ID", language), ("near duplicates", near_duplicates), ("repeated passages", repeats), ("benchmark passages", benchmark), ("mixing", mix)]

#: SQL cannot express the trained and the sketching stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
