"""Full-text search and text functions over documents, benchmark, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import SQL_TEXTS, table, texts
from ..functions import text as T
from ..operators import coverage, text_search, timeline
from . import query

PHRASES = ["of the", "anhe"]
TERMS = ["of", "the", "anhe"]
LIMIT = 50


INDEX = f"""{SQL_TEXTS},
ix AS (SELECT *, regexp_extract_all(translate(lower(translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}')), '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+') AS terms FROM texts),
st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM ix)"""


def _bm25(freqs: list[str], test: str, limit: int, stage: str, boost: str, where: str = "true") -> str:
    """SQL of one stage: the frequency of each phrase, BM25 summed, ranked."""
    f = ", ".join(f"{x} AS f{k}" for k, x in enumerate(freqs))
    d = ", ".join(f"sum((f{k} > 0)::INT) AS d{k}" for k in range(len(freqs)))
    s = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len(terms) / mean))" for k in range(len(freqs)))
    return f"""{stage}_f AS (SELECT *, {f} FROM ix),
{stage}_d AS (SELECT {d} FROM {stage}_f),
{stage}_m AS (SELECT keyframe_uid, video_id, text, round({s}, 9) AS relevance FROM {stage}_f, {stage}_d, st WHERE ({test}) AND {where} ORDER BY relevance DESC, video_id, keyframe_uid LIMIT {limit}),
{stage} AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, video_id, keyframe_uid) - 1 AS rnk, count(*) OVER () AS cnt FROM {stage}_m),
{stage}_s AS (SELECT keyframe_uid, video_id, text, rnk, {boost} * (1 - 0.1 * rnk / greatest(cnt - 1, 1)) AS score FROM {stage})"""


_PHRASE = "len(list_filter(range(1, len(terms) - {n} + 2), lambda i: terms[i:i + {m}] = {p}))"
EXACT = _bm25([_PHRASE.format(n=2, m=1, p="['of', 'the']"), _PHRASE.format(n=1, m=0, p="['anhe']")], "f0 > 0 OR f1 > 0", LIMIT, "exact", "1.0::DOUBLE")
FULL = _bm25([f"len(list_filter(terms, lambda x: x = '{t}'))" for t in TERMS], "f0 > 0 AND f1 > 0 AND f2 > 0", LIMIT, "everyterm", "0.85::DOUBLE")

_COVER = "(0.5 + 0.5 * (" + " + ".join(f"(len(list_filter(own, lambda x: starts_with(x, '{t}'))) > 0)::INT" for t in TERMS) + f") / {len(TERMS)})"
# The first 20 distinct words of two characters or more, in order.
_OWN = "list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'p': list_position(w, x), 'x': x}))[1:20], lambda y: y.x)"
PREFIX = _bm25([f"len(list_filter(terms, lambda x: starts_with(x, '{t}')))" for t in TERMS], "f0 > 0 OR f1 > 0 OR f2 > 0", 5000, "pre", "1.0::DOUBLE") + f""",
pre_w AS (SELECT *, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1) AS w FROM pre_s),
pre_c AS (SELECT *, {_OWN} AS own FROM pre_w),
prefix_s AS (SELECT keyframe_uid, video_id, text, rnk, 0.65 * {_COVER} * score AS score FROM pre_c)"""


def _stage(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    s = text_search.stages(texts(spark, sf_dir), PHRASES, LIMIT)[name]
    return s.select("keyframe_uid", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(f"WITH {INDEX}, {EXACT} SELECT keyframe_uid, rnk AS rank, round(score, 9) AS score FROM exact_s")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "exact")


@query(f"WITH {INDEX}, {FULL} SELECT keyframe_uid, rnk AS rank, round(score, 9) AS score FROM everyterm_s")
def fts_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "full")


@query(f"WITH {INDEX}, {PREFIX} SELECT keyframe_uid, rnk AS rank, round(score, 9) AS score FROM prefix_s")
def fts_prefix_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "prefix")


@query(f"WITH {INDEX}, {FULL} SELECT keyframe_uid, round(relevance, 6) AS relevance FROM everyterm")
def fts_bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text_search.stages(texts(spark, sf_dir), PHRASES, LIMIT)["full"]
    return s.select("keyframe_uid", F.round("relevance", 6).alias("relevance"))


CASCADE = f"""{EXACT}, {FULL}, {PREFIX},
allrows AS (SELECT keyframe_uid, score FROM exact_s UNION ALL SELECT keyframe_uid, score FROM everyterm_s UNION ALL SELECT keyframe_uid, score FROM prefix_s),
cascade AS (SELECT keyframe_uid, max(score) AS score FROM allrows GROUP BY keyframe_uid)"""


@query(f"WITH {INDEX}, {CASCADE} SELECT keyframe_uid, round(score, 9) AS score FROM cascade ORDER BY cascade.score DESC, keyframe_uid LIMIT {LIMIT}")
def fts_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.search(texts(spark, sf_dir), PHRASES, LIMIT).select("keyframe_uid", F.round("score", 9).alias("score"))


@query(f"WITH {INDEX}, {_bm25([f'len(list_filter(terms, lambda x: x = {chr(39)}{t}{chr(39)}))' for t in TERMS], 'f0 > 0 AND f1 > 0 AND f2 > 0', 20, 'rest', '0.85::DOUBLE', chr(40) + 'video_id IN (' + chr(39) + 'src1' + chr(39) + ', ' + chr(39) + 'src2' + chr(39) + '))')} SELECT keyframe_uid, video_id, rnk AS rank, round(score, 9) AS score FROM rest_s")
def fts_video_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restriction comes before the limit, the statistics from the whole index."""
    s = text_search.stages(texts(spark, sf_dir), PHRASES, 20, ["src1", "src2"])["full"]
    return s.select("keyframe_uid", "video_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query()
def fts_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.search(texts(spark, sf_dir), PHRASES, LIMIT, fuzzy=True).select("keyframe_uid", F.round("score", 9).alias("score"))


@query("WITH " + SQL_TEXTS + ", a AS (SELECT * FROM (VALUES (0, 700), (1, 3), (2, 100), (3, -1)) t(pos, keyframe_uid)) SELECT pos, keyframe_uid::BIGINT AS keyframe_uid, video_id, md5(text) AS text_md5, 1.0::DOUBLE AS score FROM a JOIN texts USING (keyframe_uid) WHERE trim(text) <> ''")
def rows_for_uids_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search.rows_by_id(texts(spark, sf_dir), [700, 3, 100, -1]).select("pos", "keyframe_uid", "video_id", F.md5("text").alias("text_md5"), "score").orderBy("pos")


@query("SELECT doc_id, array_to_string(" + _OWN + ", ' ') AS tokens FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 1) AS w FROM documents)")
def fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("""SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_%]+', ' ', 'g'))) AS words,
md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS signature, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS answer, length(regexp_replace(text, '\\s', '', 'g')) AS visible FROM documents""")
def text_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse(t)).alias("collapsed"), F.md5(T.words_only(t)).alias("words"), F.md5(T.signature(t)).alias("signature"), F.md5(T.answer_form(t)).alias("answer"), T.visible_length(t).cast("long").alias("visible"))


@query("SELECT doc_id, md5(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS normal_md5 FROM documents")
def text_nfc_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed and case-folded forms; of the letters here only the sharp s folds otherwise than to lower case."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normal_form(F.col("text"))).alias("normal_md5"))


@query(f"""WITH t AS (SELECT doc_id, regexp_matches(lower(text), '[{T.VIETNAMESE}]') AS marks, regexp_matches(text, '[A-Za-z]{{3,}}') AS word,
 round(length(regexp_replace(text, '[\\s\\p{{L}}\\p{{N}}\\p{{P}}\\p{{S}}\\p{{M}}]', '', 'g')) / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0), 6) AS noise FROM documents)
SELECT doc_id, marks, word, CASE WHEN marks AND word THEN 'mixed' WHEN marks THEN 'vi' ELSE 'en' END AS language, coalesce(noise, 0) AS noise FROM t""")
def text_character_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", T.has_vietnamese_marks(F.col("text")).alias("marks"), T.has_ascii_word(F.col("text")).alias("word"))
    return d.select("doc_id", "marks", "word", T.frame_language(F.col("marks"), F.col("word")).alias("language"), F.round(T.noise_ratio(F.col("text")), 6).alias("noise"))


@query("""WITH t AS (SELECT item_id, 'It rains; a. Then, a man - next: ' || text || ' finally ok' AS text FROM benchmark),
p AS (SELECT item_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?;])\\s+', '\\1\n', 'g'), '(?i)\\n+|\\b(?:then|next|finally)\\b'), lambda x: trim(x, ' ,-:\t')), lambda x: length(x) >= 3) AS parts FROM t) SELECT item_id, array_to_string(parts[1:8], '|') AS scenes FROM p""")
def scene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("It rains; a. Then, a man - next: "), "text", F.lit(" finally ok"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.scenes(text), "|").alias("scenes"))


@query("""SELECT event_id, 'say "' || event_type || '" or "' || upper(event_type) || '"' AS q, array_to_string(list_distinct_sorted, '|') AS literals, CASE WHEN event_id % 3 = 0 THEN 'number' WHEN event_id % 3 = 1 THEN 'person' ELSE 'free_text' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'mixed' ELSE 'asr' END AS source
FROM (SELECT event_id, event_type, [event_type, upper(event_type)] AS list_distinct_sorted FROM events)""")
def question_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit('say "'), "event_type", F.lit('" or "'), F.upper("event_type"), F.lit('"'))
    e = table(spark, sf_dir, "events").select("event_id", q.alias("q"))
    asked = F.when(F.col("event_id") % 3 == 0, "How many are there?").when(F.col("event_id") % 3 == 1, "Who is it?").otherwise("Describe it")
    return e.select("event_id", "q", F.array_join(T.quoted(F.col("q")), "|").alias("literals"), T.value_type(asked).alias("kind"), T.answer_source(F.concat("q", F.when(F.col("event_id") % 2 == 0, " on the SIGN").otherwise(""))).alias("source"))


@query("SELECT o_orderkey, 3 AS events, 'a car stops and waits|a man waves|rain' AS told, o_orderkey % 2 = 0 AS contiguous, 'is it ' || o_orderstatus || '?' AS question FROM orders")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered events in query texts, in order or not, and the question sentence."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    text = F.concat(F.lit("Find it.\nE3: a car stops\nand  waits.\nE"), F.when(F.col("o_orderkey") % 2 == 0, "2").otherwise("4"), F.lit(" a man waves\ne1- rain"))
    question = F.concat(F.lit("Here it comes. is it "), "o_orderstatus", F.lit("? Tell."))
    e = T.events(text)
    return o.select("o_orderkey", F.size(e).alias("events"), F.array_join(F.transform(e, lambda x: x["text"]), "|").alias("told"), T.contiguous(e).alias("contiguous"), T.question(question).alias("question"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(trim('.' || p_name || ' / ' || p_brand || '!'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') AS safe, regexp_replace(p_name || '.v2', '[^A-Za-z0-9]+', '', 'g') || '.zip' AS zip_name, regexp_matches(p_brand, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS identifier,
regexp_matches(sha256(p_name), '^[0-9a-f]{64}$') AS digest, 'id-' || lpad((p_size)::VARCHAR, 6, '0') AS padded FROM part""")
def identifier_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.safe_component(F.concat(F.lit("."), "p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("safe"), T.safe_zip_name(F.concat(F.lit("a/"), "p_name", F.lit(".v2.zip"))).alias("zip_name"), T.is_identifier(F.col("p_brand")).alias("identifier"), T.is_sha256(F.sha2("p_name", 256)).alias("digest"), T.padded_id("id-", F.col("p_size")).alias("padded"))


@query("SELECT c_custkey, c_custkey % 6 IN (0, 1, 4, 5) AS low FROM customer")
def low_information_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks, marks, blanks and mixtures of them tell nothing; other words do."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 6
    v = F.when(k == 0, F.concat(F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0"), F.lit(":30"))).when(k == 1, "HTV9 HD").when(k == 2, "live").when(k == 4, "  ").when(k == 5, "7 : 05 VTV 3").otherwise(F.col("c_name"))
    return c.select("c_custkey", T.low_information(v).alias("low"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 7, s_suppkey // 7) AS place FROM supplier")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("Query"), (F.col("s_suppkey") % 7).cast("string"), F.lit("-part"), F.expr("s_suppkey div 7").cast("string"))
    return timeline.rank_over_all(s.select("s_suppkey", name.alias("name")), [T.natural_key(F.col("name"))]).select("s_suppkey", F.col("rank").alias("place"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of a fenced answer, parsed strictly."""
    fenced = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(T.first_json(fenced), "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def html_title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("""WITH b AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: length(x) > 8) AS lines FROM benchmark),
r AS (SELECT doc_id, item_id, len(list_filter(lines, lambda x: contains(text, x))) AS n, len(lines) AS of FROM b, documents WHERE len(lines) > 0) SELECT doc_id, item_id, n / of AS recall FROM r WHERE n > 0""")
def expected_line_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an item's long words that a document holds, for all documents and items that share any.

    The items are the stated query set; they meet the documents in blocks of 64.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", " "), lambda x: F.length(x) > 8).alias("lines")).filter(F.size("lines") > 0)
    blocks = b.groupBy(F.floor(F.col("item_id") / 64).alias("block")).agg(F.collect_list(F.struct("item_id", "lines")).alias("items")).select("items")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(blocks)
    held = F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), coverage.line_recall(F.col("text"), x["lines"]).alias("recall")))
    return d.select("doc_id", F.inline(F.filter(held, lambda x: x["recall"] > 0)))
