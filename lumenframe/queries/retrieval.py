"""Vector search, fusion, ranking, sequences and result lists over the embeddings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import SQL_FRAMES, SQL_VECTORS, frames, query_vectors, table, texts, vectors
from ..functions import text as T
from ..operators import fusion, portfolio, ranking, sequence, timeline, vector_search
from ..workspace import staged
from . import query

K = 20

HITS = f"""{SQL_VECTORS},
dots AS (SELECT query_id, v.keyframe_uid, v.video_id, v.shot_id, list_dot_product(v.sig, q.sig) AS sig, list_dot_product(v.eva, q.eva) AS eva, list_dot_product(v.clip, q.clip) AS clip
  FROM vectors v CROSS JOIN queries q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sig DESC, keyframe_uid) AS rs, row_number() OVER (PARTITION BY query_id ORDER BY eva DESC, keyframe_uid) AS re,
  row_number() OVER (PARTITION BY query_id ORDER BY clip DESC, keyframe_uid) AS rc FROM dots),
cand AS (SELECT * FROM ranked WHERE rs <= {K} OR re <= {K})"""
FUSED = f"""{HITS},
refs AS (SELECT query_id, list(sig ORDER BY sig DESC) FILTER (WHERE rs <= {K}) AS ref_sig, list(eva ORDER BY eva DESC) FILTER (WHERE re <= {K}) AS ref_eva FROM cand GROUP BY query_id),
sr AS (SELECT cand.*, 1 / (60 + 0.5 + list_sum(list_transform(ref_sig, lambda r: 1 / (1 + exp(-greatest(-60, least(60, 40 * (r - sig))))))))
  + 1 / (60 + 0.5 + list_sum(list_transform(ref_eva, lambda r: 1 / (1 + exp(-greatest(-60, least(60, 40 * (r - eva)))))))) AS srrf FROM cand JOIN refs USING (query_id)),
fused AS (SELECT *, CASE WHEN max(srrf) OVER w - min(srrf) OVER w <= 1e-12 THEN 1.0 ELSE (srrf - min(srrf) OVER w) / (max(srrf) OVER w - min(srrf) OVER w) END AS fused
  FROM sr WINDOW w AS (PARTITION BY query_id))"""


def _hits(spark: SparkSession, sf_dir: str, channels: tuple[str, ...] = ("sig", "eva")) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    v, q = vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    return v, q, {c: staged(vector_search.top_k(v, q, c, K), "hits") for c in channels}


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    v, q, hits = _hits(spark, sf_dir)
    both = reduce(DataFrame.unionByName, [h.select("query_id", "keyframe_uid") for h in hits.values()]).distinct()
    return staged(vector_search.score_given(both, v, q, ["sig", "eva"]), "scored"), hits


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, hits = _scored(spark, sf_dir)
    return staged(fusion.fuse_channels(s, {c: fusion.references(h, c) for c, h in hits.items()}), "fused")


def _placed(spark: SparkSession, sf_dir: str, fused: DataFrame | None = None) -> DataFrame:
    """Fused scores with the frame's video and shot."""
    v = vectors(spark, sf_dir).select("keyframe_uid", "video_id", "shot_id", "frame_id")
    d = _fused(spark, sf_dir) if fused is None else fused
    return d.select("query_id", "keyframe_uid", "fused").join(v, "keyframe_uid").withColumn("score", F.col("fused"))


@query(f"WITH {HITS} SELECT query_id, keyframe_uid, rc AS rank, round(clip, 6) AS score FROM ranked WHERE rc <= {K}")
def vec_topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir, ("clip",))[2]["clip"]
    return hits.select("query_id", "keyframe_uid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {HITS} SELECT query_id, keyframe_uid, round(sig, 6) AS sig, round(eva, 6) AS eva FROM cand")
def vec_score_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[0].select("query_id", "keyframe_uid", F.round("sig", 6).alias("sig"), F.round("eva", 6).alias("eva"))


@query(f"WITH {FUSED} SELECT query_id, keyframe_uid, round(srrf, 9) AS srrf, round(fused, 5) AS fused FROM fused")
def srrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "keyframe_uid", F.round("srrf", 9).alias("srrf"), F.round("fused", 5).alias("fused"))


@query("SELECT vec_id AS keyframe_uid, label, CASE WHEN max(embedding[1]::DOUBLE) OVER w - min(embedding[1]::DOUBLE) OVER w <= 1e-12 THEN 1.0 ELSE round((embedding[1]::DOUBLE - min(embedding[1]::DOUBLE) OVER w) / (max(embedding[1]::DOUBLE) OVER w - min(embedding[1]::DOUBLE) OVER w), 6) END AS norm FROM embeddings WINDOW w AS (PARTITION BY label)")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("keyframe_uid", F.col("video_id").alias("label"), F.element_at("clip", 1).alias("x"))
    return v.select("keyframe_uid", "label", F.round(fusion.minmax(F.col("x"), "label"), 6).alias("norm"))


COMBINED = f"""{FUSED},
o AS (SELECT keyframe_uid, query_id, fused, row_number() OVER (PARTITION BY keyframe_uid ORDER BY fused DESC, query_id) AS n FROM fused),
comb AS (SELECT keyframe_uid, max(query_id) FILTER (WHERE n = 1) AS best_query, max(fused) FILTER (WHERE n = 1) + 0.1 * coalesce(max(fused) FILTER (WHERE n = 2), 0) AS raw FROM o GROUP BY keyframe_uid),
vis AS (SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS score FROM comb)"""


@query(f"WITH {COMBINED} SELECT keyframe_uid, round(score, 5) AS score FROM vis")
def query_combine_best2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.combine_queries(_fused(spark, sf_dir)).select("keyframe_uid", F.round("score", 5).alias("score"))


@query(f"WITH {FUSED} SELECT keyframe_uid, arg_max(query_id, (fused, -query_id)) AS best_query, round(max(sig), 6) AS sig, round(max(eva), 6) AS eva FROM fused GROUP BY keyframe_uid")
def best_query_and_raw_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fused(spark, sf_dir)
    return f.groupBy("keyframe_uid").agg(F.max_by("query_id", F.struct("fused", -F.col("query_id"))).alias("best_query"), F.round(F.max("sig"), 6).alias("sig"), F.round(F.max("eva"), 6).alias("eva"))


@query(f"WITH {HITS} SELECT query_id, keyframe_uid, CASE WHEN rs <= {K} AND re <= {K} THEN 1.0::DOUBLE ELSE 0.5 END AS consensus FROM cand")
def consensus_direct_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, hits = _scored(spark, sf_dir)
    return vector_search.consensus(hits, s)


@query(f"WITH {HITS} SELECT query_id, keyframe_uid, 0.5::DOUBLE AS consensus, round(CASE WHEN max(clip) OVER w - min(clip) OVER w <= 1e-12 THEN 1.0 ELSE (clip - min(clip) OVER w) / (max(clip) OVER w - min(clip) OVER w) END, 5) AS score FROM ranked WHERE rc <= {K} WINDOW w AS (PARTITION BY query_id)")
def clip_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary channels are down: clip hits alone, each of half consensus."""
    v, q, hits = _hits(spark, sf_dir, ("clip",))
    s = vector_search.score_given(hits["clip"], v, q, ["clip"])
    c = vector_search.consensus(hits, s)
    return s.join(c, ["query_id", "keyframe_uid"]).select("query_id", "keyframe_uid", "consensus", F.round(fusion.minmax(F.col("clip"), "query_id"), 5).alias("score"))


SIDE = "ocr AS (SELECT doc_id AS keyframe_uid, least(n_chars, 5000) / 5000.0::DOUBLE AS score FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'en')"


def _side(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("keyframe_uid"), (F.least("n_chars", F.lit(5000)) / 5000).alias("score"))
    return d.join(vectors(spark, sf_dir).select("keyframe_uid"), "keyframe_uid", "left_semi")


LATE = f"""{COMBINED}, {SIDE},
parts AS (SELECT keyframe_uid, 0.55::DOUBLE * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS part FROM vis
  UNION ALL SELECT keyframe_uid, 0.45::DOUBLE * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) FROM ocr),
lraw AS (SELECT keyframe_uid, sum(part) AS raw FROM parts GROUP BY keyframe_uid),
late AS (SELECT keyframe_uid, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS fused FROM lraw)"""


@query(f"WITH {LATE} SELECT keyframe_uid, round(fused, 5) AS fused FROM late")
def modality_late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    visual = fusion.combine_queries(_fused(spark, sf_dir)).select("keyframe_uid", "score")
    out = fusion.fuse_modalities({"visual": visual, "ocr": _side(spark, sf_dir)}, fusion.default_weights(("visual", "ocr")))
    return out.select("keyframe_uid", F.round("fused", 5).alias("fused"))


@query(f"WITH {SQL_FRAMES}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts_time, frame_id) - 1 AS position FROM frames) "
       "SELECT a.keyframe_uid, a.position, array_to_string(list(b.keyframe_uid ORDER BY b.shot_id <> a.shot_id, b.position) FILTER (WHERE b.keyframe_uid IS NOT NULL), ',') AS neighbours "
       "FROM p a LEFT JOIN p b ON a.video_id = b.video_id AND b.position BETWEEN a.position - 2 AND a.position + 2 AND a.position <> b.position GROUP BY ALL")  # fmt: skip
def neighbor_window_pm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = timeline.neighbours(frames(spark, sf_dir))
    return n.select("keyframe_uid", F.col("position").cast("long").alias("position"), F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(f"WITH {HITS}, tl AS (SELECT keyframe_uid, video_id, row_number() OVER (PARTITION BY video_id ORDER BY keyframe_uid) AS p FROM vectors), c AS (SELECT DISTINCT keyframe_uid FROM cand) "
       "SELECT DISTINCT b.keyframe_uid FROM c JOIN tl a USING (keyframe_uid) JOIN tl b ON a.video_id = b.video_id AND b.p BETWEEN a.p - 2 AND a.p + 2")  # fmt: skip
def scoring_set_with_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)[2]
    found = reduce(DataFrame.unionByName, [h.select("keyframe_uid") for h in hits.values()]).distinct()
    line = vectors(spark, sf_dir).select("keyframe_uid", "video_id", "shot_id", "frame_id", F.col("frame_id").cast("double").alias("pts_time"))
    near = timeline.neighbours(line).join(found, "keyframe_uid").select(F.explode("neighbours").alias("keyframe_uid"))
    return found.unionByName(near).distinct()


BOOST = """tl AS (SELECT keyframe_uid, video_id, shot_id, row_number() OVER (PARTITION BY video_id ORDER BY keyframe_uid) AS p FROM vectors),
nb AS (SELECT f.query_id, f.keyframe_uid, f.video_id, f.shot_id, f.fused, b.keyframe_uid AS nuid, coalesce(g.fused, 0) AS nf
  FROM fused f JOIN tl a ON a.keyframe_uid = f.keyframe_uid JOIN tl b ON a.video_id = b.video_id AND b.p BETWEEN a.p - 2 AND a.p + 2 AND a.p <> b.p
  LEFT JOIN fused g ON g.query_id = f.query_id AND g.keyframe_uid = b.keyframe_uid),
sup AS (SELECT query_id, keyframe_uid, avg(nf) AS support FROM (SELECT *, row_number() OVER (PARTITION BY query_id, keyframe_uid ORDER BY nf DESC) AS n FROM nb) WHERE n <= 2 GROUP BY ALL),
boosted AS (SELECT f.query_id, f.keyframe_uid, f.video_id, f.shot_id, f.fused, coalesce(support, 0) AS support, f.fused + 0.15 * coalesce(support, 0) AS boosted FROM fused f LEFT JOIN sup USING (query_id, keyframe_uid)),
ev AS (SELECT *, CASE WHEN max(boosted) OVER w - min(boosted) OVER w <= 1e-12 THEN 1.0 ELSE (boosted - min(boosted) OVER w) / (max(boosted) OVER w - min(boosted) OVER w) END AS score FROM boosted WINDOW w AS (PARTITION BY query_id))"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame evidence of every query: boosted and normalised, with consensus."""
    s, hits = _scored(spark, sf_dir)
    f = staged(fusion.fuse_channels(s, {c: fusion.references(h, c) for c, h in hits.items()}), "fused")
    line = vectors(spark, sf_dir).select("keyframe_uid", "video_id", "shot_id", "frame_id", F.col("frame_id").cast("double").alias("pts_time"))
    b = timeline.boost(line, f.select("query_id", "keyframe_uid", "fused"), keys=("query_id",))
    c = vector_search.consensus(hits, s)
    return staged(b.join(c, ["query_id", "keyframe_uid"]).withColumn("score", fusion.minmax(F.col("boosted"), "query_id")), "evidence")


@query(f"WITH {FUSED}, {BOOST} SELECT query_id, keyframe_uid, round(support, 5) AS support, round(score, 5) AS score FROM ev")
def neighbor_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("query_id", "keyframe_uid", F.round("neighbour_support", 5).alias("support"), F.round("score", 5).alias("score"))


VIDEOS = """shots AS (SELECT query_id, video_id, shot_id, max(fused) AS score FROM fused GROUP BY ALL),
top3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, shot_id) AS n FROM shots),
vs AS (SELECT query_id, video_id, 0.7 * max(score) + (1 - 0.7) * avg(score) AS video_score FROM top3 WHERE n <= 3 GROUP BY ALL),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY video_score DESC, video_id) AS rnk FROM vs)"""


@query(f"WITH {FUSED}, {VIDEOS} SELECT query_id, video_id, round(video_score, 5) AS video_score, rnk <= 3 AS hit FROM vr")
def video_rank_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ranking.video_scores(_placed(spark, sf_dir), top_videos=3)
    return v.select("query_id", "video_id", F.round("video_score", 5).alias("video_score"), "hit")


ROLES = """labels AS (SELECT CASE WHEN query_id % 200 = 0 THEN 'locator' ELSE 'target' END AS role, query_id FROM queries),
grid AS (SELECT role, l.query_id, v.video_id, coalesce(r.video_score, 0) AS s, coalesce(r.rnk <= 3, false) AS hit FROM labels l CROSS JOIN (SELECT DISTINCT video_id FROM vr) v LEFT JOIN vr r ON r.query_id = l.query_id AND r.video_id = v.video_id),
roles AS (SELECT role, video_id, avg(hit::INT) AS coverage, 0.5 * avg(hit::INT) + 0.3 * avg(s) + 0.2 * min(s) AS evidence, list(query_id ORDER BY query_id) FILTER (WHERE hit) AS matched FROM grid GROUP BY ALL)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_vectors(spark, sf_dir).select(F.when(F.col("query_id") % 200 == 0, "locator").otherwise("target").alias("role"), "query_id")


@query(f"WITH {FUSED}, {VIDEOS}, {ROLES} SELECT role, video_id, round(coverage, 6) AS coverage, round(evidence, 5) AS evidence, coalesce(array_to_string(matched, ','), '') AS matched FROM roles")
def role_coverage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ranking.video_scores(_placed(spark, sf_dir), top_videos=3)
    e = ranking.role_evidence(v, _labels(spark, sf_dir))
    return e.select("role", "video_id", F.round("coverage", 6).alias("coverage"), F.round("evidence", 5).alias("evidence"), F.array_join(F.col("matched").cast("array<string>"), ",").alias("matched"))


HYP = f"""{FUSED}, {BOOST}, {VIDEOS}, {ROLES},
cons AS (SELECT query_id, keyframe_uid, CASE WHEN rs <= {K} AND re <= {K} THEN 1.0 ELSE 0.5 END AS consensus FROM cand),
evc AS (SELECT ev.*, consensus FROM ev JOIN cons USING (query_id, keyframe_uid)),
one AS (SELECT keyframe_uid, video_id, shot_id, max(score) AS score, max(consensus) AS consensus FROM evc GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY video_id, shot_id ORDER BY score DESC, keyframe_uid) AS n FROM one),
b3 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, keyframe_uid) AS k FROM bs WHERE n = 1),
c3 AS (SELECT video_id, avg(consensus) AS consensus FROM b3 WHERE k <= 3 GROUP BY video_id),
glo AS (SELECT video_id, max(video_score) AS overall FROM vr WHERE query_id = 0 GROUP BY video_id),
hyp AS (SELECT t.video_id, 0.35 * l.evidence + 0.45 * t.evidence + 0.10 * coalesce(overall, 0) + 0.10 * coalesce(consensus, 0) AS video_score, t.coverage, coalesce(consensus, 0) AS consensus
  FROM roles t JOIN roles l ON l.video_id = t.video_id AND l.role = 'locator' LEFT JOIN glo g ON g.video_id = t.video_id LEFT JOIN c3 ON c3.video_id = t.video_id WHERE t.role = 'target')"""


def _hypotheses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Video hypotheses over all queries as one plan, and the best evidence of each frame."""
    e = _evidence(spark, sf_dir)
    v = staged(ranking.video_scores(_placed(spark, sf_dir, e), top_videos=3), "videos")
    one = e.groupBy("keyframe_uid", "video_id", "shot_id").agg(F.max("score").alias("score"), F.max("consensus").alias("consensus"))
    whole = spark.createDataFrame([(0,)], "query_id long")
    return staged(ranking.rank_videos(v, _labels(spark, sf_dir), whole, ranking.top_consensus(one)), "hypotheses"), one


@query(f"WITH {HYP} SELECT video_id, round(video_score, 5) AS video_score, round(coverage, 6) AS coverage, round(consensus, 6) AS consensus FROM hyp")
def video_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hypotheses(spark, sf_dir)[0]
    return h.select("video_id", F.round("video_score", 5).alias("video_score"), F.round("coverage", 6).alias("coverage"), F.round("consensus", 6).alias("consensus"))


@query(f"WITH {HYP} SELECT video_id, shot_id, keyframe_uid, round(score, 5) AS score, k AS place FROM b3")
def distinct_shot_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = ranking.best_per_shot(_hypotheses(spark, sf_dir)[1])
    w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "keyframe_uid")
    return one.select("video_id", "shot_id", "keyframe_uid", F.round("score", 5).alias("score"), F.row_number().over(w).cast("long").alias("place"))


PORTFOLIO = """hr AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY video_score DESC, video_id) - 1 AS rnk FROM hyp) WHERE rnk < 12),
kc AS (SELECT o.*, rnk, video_score, 0.55 * video_score + 0.45 * score AS cs FROM one o JOIN hr USING (video_id)),
ks AS (SELECT *, CASE WHEN rnk = 0 THEN row_number() OVER (PARTITION BY video_id, shot_id ORDER BY cs DESC, keyframe_uid) END AS sn FROM kc),
kl AS (SELECT *, CASE WHEN sn = 1 THEN row_number() OVER (PARTITION BY video_id, sn ORDER BY cs DESC, keyframe_uid) END AS lead FROM ks),
kp AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN lead <= 3 THEN lead ELSE 4 END, cs DESC, keyframe_uid) - 1 AS place FROM kl),
pv AS (SELECT video_id, rnk, greatest(video_score, 1e-6) AS weight, least(count(*), 40) AS room FROM kp GROUP BY ALL),
pt AS (SELECT *, least(100, sum(room) OVER ()) AS total, least(room, CASE rnk WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END) AS opened FROM pv),
r1 AS (SELECT *, CASE WHEN rnk < 5 THEN greatest(0, least(2, room) - opened) ELSE 0 END AS need, total - sum(opened) OVER () AS lft FROM pt),
t1 AS (SELECT * EXCLUDE (need, lft), opened + least(need, greatest(0, lft - coalesce(sum(need) OVER (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS target FROM r1),
r2 AS (SELECT *, CASE WHEN rnk < 12 THEN greatest(0, least(1, room) - target) ELSE 0 END AS need, total - sum(target) OVER () AS lft FROM t1),
t2 AS (SELECT * EXCLUDE (need, lft, target), target + least(need, greatest(0, lft - coalesce(sum(need) OVER (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS target FROM r2),
r3 AS (SELECT *, CASE WHEN rnk < 1 THEN greatest(0, least(30, room) - target) ELSE 0 END AS need, total - sum(target) OVER () AS lft FROM t2),
t3 AS (SELECT * EXCLUDE (need, lft, target), target + least(need, greatest(0, lft - coalesce(sum(need) OVER (ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS target FROM r3),
seats AS (SELECT video_id, row_number() OVER (ORDER BY weight / k DESC, rnk) AS n, (SELECT max(total) - sum(target) FROM t3) AS spare FROM (SELECT *, unnest(range((target + 1)::BIGINT, (room + 1)::BIGINT)) AS k FROM t3)),
won AS (SELECT video_id, count(*) AS won FROM seats WHERE n <= spare GROUP BY video_id),
t4 AS (SELECT video_id, rnk, opened, target + coalesce(won, 0) AS target FROM t3 LEFT JOIN won USING (video_id)),
pc AS (SELECT kp.*, opened, target FROM kp JOIN t4 USING (video_id) WHERE place < target),
pf AS (SELECT *, row_number() OVER (ORDER BY place >= opened, CASE WHEN place < opened THEN CASE rnk WHEN 0 THEN [0, 1, 3][place + 1] WHEN 1 THEN 2 ELSE 4 END END,
  CASE WHEN place >= opened THEN place / target END, CASE WHEN place >= opened THEN -score END, rnk, place) AS position FROM pc)"""


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.portfolio(_candidates(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the first twelve videos."""
    h, one = _hypotheses(spark, sf_dir)
    w = Window.partitionBy().orderBy(F.col("video_score").desc(), "video_id")
    v = h.orderBy(F.col("video_score").desc(), "video_id").limit(12).withColumn("rank", F.row_number().over(w) - 1)
    return portfolio.kis_candidates(v.select("video_id", "rank", "video_score"), one)


@query(f"WITH {HYP}, {PORTFOLIO} SELECT position, video_id, keyframe_uid, round(cs, 5) AS score FROM pf WHERE position <= 100")
def kis_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-item search from query vectors to 100 diversified frames."""
    return _flagship(spark, sf_dir).select(F.col("position").cast("long").alias("position"), "video_id", "keyframe_uid", F.round("candidate_score", 5).alias("score"))


@query(f"WITH {HYP}, {PORTFOLIO} SELECT video_id, keyframe_uid, place, round(cs, 5) AS score FROM kp")
def kis_candidates_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("video_id", "keyframe_uid", F.col("place").cast("long").alias("place"), F.round("candidate_score", 5).alias("score"))


@query(f"WITH {HYP}, {PORTFOLIO} SELECT video_id, count(*) AS places, min(position) AS first_position FROM pf WHERE position <= 100 GROUP BY video_id")
def portfolio_dhondt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _flagship(spark, sf_dir)
    return p.groupBy("video_id").agg(F.count(F.lit(1)).alias("places"), F.min("position").cast("long").alias("first_position"))


@query(f"WITH {HYP}, {PORTFOLIO} SELECT row_number() OVER (ORDER BY rnk, position) AS row_no, (row_number() OVER (ORDER BY rnk, position) - 1) // 25 AS page, video_id, keyframe_uid FROM pf WHERE position <= 100")
def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = portfolio.shown_pages(_flagship(spark, sf_dir))
    return p.select(F.col("row").cast("long").alias("row_no"), F.col("page").cast("long").alias("page"), "video_id", "keyframe_uid")


@query(f"WITH RECURSIVE {HYP}, cl AS (SELECT keyframe_uid, max(clip) AS clip FROM dots GROUP BY keyframe_uid), su AS (SELECT video_id, max(clip) AS c FROM b3 JOIN cl USING (keyframe_uid) WHERE k <= 3 GROUP BY video_id), s AS (SELECT video_id, video_score AS v, c, row_number() OVER (ORDER BY video_score DESC, video_id) AS n FROM hyp LEFT JOIN su USING (video_id)), "
       "g AS (SELECT video_id, v, c, n, v AS leader FROM s WHERE n = 1 UNION ALL SELECT s.video_id, s.v, s.c, s.n, CASE WHEN g.leader - s.v <= 0.02 THEN g.leader ELSE s.v END FROM g JOIN s ON s.n = g.n + 1) "
       "SELECT video_id, row_number() OVER (ORDER BY leader DESC, c DESC NULLS LAST, v DESC, video_id) AS rank FROM g")  # fmt: skip
def clip_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close videos in the order of the best clip score of their three best frames."""
    h, one = _hypotheses(spark, sf_dir)
    v, q = vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    grid = one.select("keyframe_uid").distinct().crossJoin(q.select("query_id"))  # found frames times the stated queries
    clip = vector_search.score_given(grid, v, q, ["clip"]).groupBy("keyframe_uid").agg(F.max("clip").alias("clip"))
    support = ranking.clip_support(one.join(clip, "keyframe_uid"))
    return ranking.tie_break(h.select("video_id", "video_score").join(support, "video_id", "left")).select("video_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HYP}, p AS (SELECT video_id, video_score, row_number() OVER (ORDER BY video_score DESC, video_id) - 1 AS pos FROM hyp), vl AS (SELECT video_id, pos, (video_id * 37 % 100) / 100.0::DOUBLE AS vlm FROM p WHERE pos < 4) "
       "SELECT video_id, round(CASE WHEN vlm IS NULL THEN video_score ELSE 0.7 * video_score + 0.2 * vlm + 0.1 * (1 - vl.pos / 3) END, 5) AS video_score FROM p LEFT JOIN vl USING (video_id)")  # fmt: skip
def vlm_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hypotheses(spark, sf_dir)[0].withColumn("base_video_score", F.col("video_score"))
    top = h.orderBy(F.col("video_score").desc(), "video_id").limit(4)
    w = Window.partitionBy().orderBy(F.col("video_score").desc(), "video_id")
    verdicts = top.select("video_id", (F.col("video_id") * 37 % 100 / 100.0).alias("vlm_score"), (F.row_number().over(w) - 1).alias("position"), F.lit(4).alias("n"))
    return fusion.rerank(h, verdicts).select("video_id", F.round("video_score", 5).alias("video_score"))


@query(f"WITH {HYP}, a AS (SELECT keyframe_uid, video_id, shot_id, max(sig) AS score FROM fused WHERE rs <= 5 GROUP BY ALL), e AS (SELECT video_id, shot_id, keyframe_uid, max(score) AS score FROM ev WHERE query_id = 0 GROUP BY ALL), "
       "m AS (SELECT e.video_id, e.shot_id, e.keyframe_uid, greatest(e.score, least(1.0, e.score + 0.15 * coalesce(o.score, n.score, 0))) AS score FROM e LEFT JOIN a o USING (keyframe_uid) LEFT JOIN (SELECT video_id, shot_id, max(score) AS score FROM a GROUP BY ALL) n ON n.video_id = e.video_id AND n.shot_id = e.shot_id "
       "UNION ALL SELECT video_id, shot_id, keyframe_uid, score FROM a WHERE keyframe_uid NOT IN (SELECT keyframe_uid FROM e)), "
       "k AS (SELECT *, row_number() OVER (PARTITION BY video_id, shot_id ORDER BY score DESC, keyframe_uid) AS n FROM m) SELECT keyframe_uid, round(score, 5) AS score FROM k WHERE n <= 3 ORDER BY k.score DESC, keyframe_uid LIMIT 100")  # fmt: skip
def anchor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the first query, raised by the five best frames of every query in one channel."""
    e = _evidence(spark, sf_dir).filter("query_id = 0").select("video_id", "shot_id", "keyframe_uid", "score")
    v, _, hits = _hits(spark, sf_dir, ("sig",))
    a = hits["sig"].filter("rank <= 5").groupBy("keyframe_uid").agg(F.max("score").alias("score")).join(v.select("keyframe_uid", "video_id", "shot_id"), "keyframe_uid")
    return fusion.merge_anchors(e, a).select("keyframe_uid", F.round("score", 5).alias("score"))


@query(f"WITH {HYP}, h3 AS (SELECT video_id FROM hyp ORDER BY video_score DESC, video_id LIMIT 3), t AS (SELECT o.*, row_number() OVER (PARTITION BY o.video_id ORDER BY o.score DESC, o.keyframe_uid) AS n FROM (SELECT keyframe_uid, video_id, shot_id, max(score) AS score FROM ev WHERE query_id % 200 <> 0 GROUP BY ALL) o JOIN h3 USING (video_id)) "
       "SELECT video_id, keyframe_uid, round(score, 5) AS score FROM t WHERE n <= 100")  # fmt: skip
def target_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the target queries alone, in the first three videos."""
    h = _hypotheses(spark, sf_dir)[0].orderBy(F.col("video_score").desc(), "video_id").limit(3).select("video_id")
    e = _evidence(spark, sf_dir).filter(F.col("query_id") % 200 != 0).groupBy("keyframe_uid", "video_id").agg(F.max("score").alias("score")).join(h, "video_id", "left_semi")
    w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "keyframe_uid")
    return e.withColumn("n", F.row_number().over(w)).filter("n <= 100").select("video_id", "keyframe_uid", F.round("score", 5).alias("score"))


MOMENTS = """mo AS (SELECT video_id, shot_id, keyframe_uid, frame_id, pts_time, score, CASE shot_id WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS moment FROM (SELECT *, keyframe_uid % 40 AS sub FROM frames) WHERE shot_id IN ('view', 'click', 'purchase')),
ms AS (SELECT *, video_id || ':' || (keyframe_uid % 40) AS s2 FROM mo)"""


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).filter(F.col("shot_id").isin("view", "click", "purchase"))
    return f.withColumn("moment", F.when(F.col("shot_id") == "view", 0).when(F.col("shot_id") == "click", 1).otherwise(2)).withColumn("shot_id", F.concat(F.col("video_id").cast("string"), F.lit(":"), (F.col("keyframe_uid") % 40).cast("string")))


BEAM = f"""{SQL_FRAMES}, {MOMENTS},
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY moment, video_id, s2 ORDER BY score DESC, keyframe_uid) AS k FROM ms) WHERE k = 1),
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY moment, video_id ORDER BY score DESC, keyframe_uid) AS n FROM bm) WHERE n <= 32),
w0 AS (SELECT * FROM (SELECT video_id, [frame_id] AS ids, pts_time AS t, score AS total, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, [frame_id]) AS n FROM bt WHERE moment = 0) WHERE n <= 8),
w1 AS (SELECT * FROM (SELECT a.video_id, list_append(ids, frame_id) AS ids, b.pts_time AS t, total + score AS total, row_number() OVER (PARTITION BY a.video_id ORDER BY total + score DESC, list_append(ids, frame_id)) AS n FROM w0 a JOIN bt b ON a.video_id = b.video_id AND b.moment = 1 AND b.pts_time > a.t AND NOT list_contains(ids, frame_id)) WHERE n <= 8),
w2 AS (SELECT * FROM (SELECT a.video_id, list_append(ids, frame_id) AS ids, b.pts_time AS t, total + score AS total, row_number() OVER (PARTITION BY a.video_id ORDER BY total + score DESC, list_append(ids, frame_id)) AS n FROM w1 a JOIN bt b ON a.video_id = b.video_id AND b.moment = 2 AND b.pts_time > a.t AND NOT list_contains(ids, frame_id)) WHERE n <= 8)"""


@query(f"WITH {BEAM} SELECT video_id, array_to_string(ids, ',') AS frame_ids, round(total, 6) AS total FROM w2")
def trake_beam_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sequence.beam_sequences(_moments(spark, sf_dir), 3)
    return b.select("video_id", F.array_join(F.col("frame_ids").cast("array<string>"), ",").alias("frame_ids"), F.round("total", 6).alias("total"))


TRAKE = """mv AS (SELECT moment, video_id, max(score) AS video_score FROM mo GROUP BY ALL),
mh AS (SELECT *, row_number() OVER (PARTITION BY moment ORDER BY video_score DESC, video_id) <= 50 AS hit FROM mv),
lo AS (SELECT video_id, avg(score) AS locator FROM frames GROUP BY video_id),
tv AS (SELECT m.video_id, 0.15 * any_value(locator) + 0.45 * sum(hit::INT) / 3 + 0.20 * CASE WHEN count(*) < 3 THEN 0 ELSE min(video_score) END + 0.10 * sum(video_score) / 3 + 0.10 * 0.5 AS video_score, sum(hit::INT) / 3 AS coverage FROM mh m JOIN lo USING (video_id) GROUP BY m.video_id)"""


def _trake_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moments(spark, sf_dir).groupBy("moment", "video_id").agg(F.max("score").alias("video_score"))
    f = frames(spark, sf_dir).groupBy("video_id").agg(F.avg("score").alias("locator"))
    return ranking.rank_by_moments(m, 3, f, f.select("video_id", F.lit(0.5).alias("consensus")))


@query(f"WITH {SQL_FRAMES}, {MOMENTS}, {TRAKE} SELECT video_id, round(video_score, 5) AS video_score, round(coverage, 6) AS coverage FROM tv")
def trake_video_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trake_videos(spark, sf_dir).select("video_id", F.round("video_score", 5).alias("video_score"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {BEAM}, {TRAKE} SELECT w2.video_id, array_to_string(ids, ',') AS frame_ids, round(0.4 * video_score + 0.6 * total / 3, 5) AS score FROM w2 JOIN tv USING (video_id)")
def trake_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sequence.sequence_candidates(sequence.beam_sequences(_moments(spark, sf_dir), 3), _trake_videos(spark, sf_dir))
    return c.select("video_id", F.array_join(F.col("frame_ids").cast("array<string>"), ",").alias("frame_ids"), F.round("score", 5).alias("score"))


QA = """nums AS (SELECT video_id, keyframe_uid, row_number() OVER (PARTITION BY video_id ORDER BY keyframe_uid) AS r, text FROM (SELECT label AS video_id, doc_id AS keyframe_uid, text FROM documents JOIN embeddings ON doc_id = vec_id)),
nf AS (SELECT video_id, r, unnest(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?')) AS v FROM nums),
ans AS (SELECT video_id, arg_max(v, (length(regexp_replace(v, '\\D', '', 'g')), -r, v)) AS answer FROM nf GROUP BY video_id)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number with most digits in any text of a video; of equals that of the earliest text."""
    d = texts(spark, sf_dir).drop("video_id").join(vectors(spark, sf_dir).select("keyframe_uid", "video_id"), "keyframe_uid")
    n = d.select("video_id", "keyframe_uid", F.explode(T.numbers(F.col("text"))).alias("v"))
    best = F.max(F.struct(F.length(F.regexp_replace("v", r"\D", "")).alias("digits"), (-F.col("keyframe_uid")).alias("early"), "v"))
    return n.groupBy("video_id").agg(best["v"].alias("answer"))


@query(f"WITH {QA} SELECT video_id, answer FROM ans")
def qa_number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir)


@query(f"WITH {HYP}, {QA}, hr AS (SELECT *, row_number() OVER (ORDER BY video_score DESC, video_id) - 1 AS rnk FROM hyp), q AS (SELECT o.*, rnk, video_score, row_number() OVER w AS n, first(score) OVER w AS top FROM one o JOIN hr USING (video_id) WHERE rnk < 3 WINDOW w AS (PARTITION BY video_id ORDER BY score DESC, keyframe_uid)) "
       "SELECT video_id, keyframe_uid, answer, round(least(1.0, greatest(0.0, 0.6 * video_score + 0.4 * top), 0.78), 5) AS confidence, round(0.55 * video_score + 0.45 * score, 5) AS score, true AS requires_review FROM q JOIN ans USING (video_id) WHERE n <= 12".replace("least(1.0, greatest(0.0, 0.6 * video_score + 0.4 * top), 0.78)", "least(least(1.0, greatest(0.0, 0.6 * video_score + 0.4 * top)), 0.78)"))  # fmt: skip
def qa_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, one = _hypotheses(spark, sf_dir)
    v = h.orderBy(F.col("video_score").desc(), "video_id").limit(3).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("video_score").desc(), "video_id")) - 1)
    c = portfolio.qa_candidates(v.select("video_id", "rank", "video_score"), one, _answers(spark, sf_dir).withColumn("answer_confidence", F.lit(0.78)))
    return c.select("video_id", "keyframe_uid", "answer", F.round("confidence", 5).alias("confidence"), F.round("candidate_score", 5).alias("score"), "requires_review")


@query("""WITH a AS (SELECT conv_id AS video_id, turn AS step, text AS answer, (length(text) % 100) / 100.0::DOUBLE AS confidence, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS norm FROM conversations),
e AS (SELECT *, confidence >= 0.85 OR (row_number() OVER (PARTITION BY video_id, norm ORDER BY step) >= 2 AND norm <> '') AS ends FROM a),
l AS (SELECT *, coalesce(max(ends::INT) OVER (PARTITION BY video_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM e)
SELECT video_id, arg_max(confidence, (ends, confidence, -step, answer)) AS confidence, arg_max(step, (ends, confidence, -step, answer)) AS step, bool_or(ends) AS settled FROM l WHERE done = 0 GROUP BY video_id""")
def answer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as the answers of a chain of providers."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("step"), F.col("text").alias("answer"), (F.length("text") % 100 / 100.0).alias("confidence"))
    return portfolio.settle_answers(c).select("video_id", "confidence", "step", "settled")


@query("""SELECT conv_id AS video_id, CASE WHEN count(DISTINCT trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) = 1 THEN arg_min(text, turn) ELSE 'Uncertain' END AS answer,
CASE WHEN count(DISTINCT trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) = 1 THEN min((length(text) % 100) / 100.0::DOUBLE) ELSE 0.0 END AS confidence FROM conversations GROUP BY conv_id""")
def two_prompt_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("prompt"), F.col("text").alias("answer"), (F.length("text") % 100 / 100.0).alias("confidence"))
    return portfolio.agree_prompts(c)
