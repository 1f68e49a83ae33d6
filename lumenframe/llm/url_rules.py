"""URL filtering by stated rules and mined association rules (built-in functions and Spark ML only)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, staged

#: A stated rule is (verdict, host, path); it fits the host and its subdomains and paths that start with the path.
STATED = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A mined rule needs these shares of labelled URLs and of those with its tokens.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.6
_BLOCK, _ALLOW = "y=block", "y=allow"


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(at > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host labels by place from the right, path segments, query keys.

    Runs of digits become ``0``, so numbered pages share tokens.
    """
    host, path = host_of(url), path_of(url)
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    named = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p="), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.split(x, "=")[0]))
    scheme = F.array(F.concat(F.lit("s="), F.lower(F.substring_index(url, "://", 1))))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(scheme, named, segments, keys))).otherwise(F.array().cast("array<string>"))


def stated_rule(host: Column, path: Column, rules: tuple = STATED) -> Column:
    """The longest stated rule that fits, as struct(length, rule, verdict), or null.

    The rules are an index in the plan, host -> rules; only the hosts that end the URL's host
    are looked up.
    """
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append((p, h + p, verdict))
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    entries = [F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for p, r, v in rs]) for rs in by_host.values()]
    index = F.map_from_arrays(F.array(*map(F.lit, by_host)), F.array(*entries))
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(ends, lambda e: F.try_element_at(index, e)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``tokens -> block`` from ``labelled`` (``url``, ``blocked`` boolean), by FP-growth.

    Kept are rules of the given support and confidence that also lift blocking over its base
    rate. Columns: ``antecedent``, ``confidence``, ``lift``, ``support``. Rows with a null url or
    label count for nothing; with no labelled rows there are no rules.
    """
    spark = labelled.sparkSession
    items = F.concat(tokens_of(F.col("url")), F.array(F.when(F.col("blocked"), F.lit(_BLOCK)).otherwise(F.lit(_ALLOW))))
    baskets = staged(labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select(items.alias("items")), "url-baskets")
    empty = "antecedent array<string>, confidence double, lift double, support double"
    if baskets.isEmpty():
        return spark.createDataFrame([], empty)
    # Items that cannot be frequent are left out by FP-growth itself, which deals the
    # conditional baskets of each frequent item to its own group.
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter((F.col("consequent") == F.array(F.lit(_BLOCK))) & (F.col("lift") > 1))
    return rules.select("antecedent", "confidence", "lift", "support")


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` and the confidence of its best mined rule, for the distinct urls that any rule fits.

    Inverted index: a rule is filed under one of its tokens, the one that fewest rules share; a
    URL meets the rules filed under its tokens, and the rest of a rule's tokens is checked there.
    """
    rules = rules.withColumn("id", F.xxhash64(F.array_join(F.array_sort("antecedent"), "\0")))
    listed = rules.select("id", F.explode("antecedent").alias("token"))
    spread = listed.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = listed.join(spread, "token").groupBy("id").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    index = staged(rules.join(filed, "id").select("token", "antecedent", "confidence"), "url-index")
    u = urls.filter(F.col("url").isNotNull()).select("url").distinct().select("url", tokens_of(F.col("url")).alias("tokens"))
    met = u.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.filter(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple = STATED, **limits: float) -> DataFrame:
    """Verdict on every url of ``pages``: the longest stated rule's, else the mined rules', else allow.

    Returns ``row``, ``host``, ``path``, ``rule`` (null without a stated rule), ``verdict`` and
    ``confidence`` (of the mined rule, where one fits).

    Defined cases: a null url or one without ``://`` has empty host and path, no rule and the
    verdict allow; very long urls are read whole; repeated urls get equal verdicts; ties of length
    go to the greater rule string; empty tables give empty results; other columns, whatever their
    names, are carried in ``row``.
    """
    mined = mined_verdicts(pages, mine(labelled, **limits))
    p = packed(pages, url=F.col("url"), host=host_of(F.col("url")), path=path_of(F.col("url")))
    p = p.join(mined, "url", "left")
    best = stated_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumn("best", best)
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return p.select("row", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "confidence")


def labels_by_page(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url`` and ``blocked`` (toxic or of low quality) of pages whose number in the path is a labelled document's."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})", 1)
    p = pages.select("url", F.nullif(number, F.lit("")).cast("bigint").alias("doc_id"))
    marks = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).alias("blocked"))
    return p.join(marks, "doc_id").select("url", "blocked")
