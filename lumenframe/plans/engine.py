"""The search engine: a plan over a registry of tables, from query texts to ranked candidates."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import artifacts, fusion, portfolio, ranking, sequence, text_search, timeline, vector_search
from ..workspace import staged
from .planner import PlannerChain
from .query_plan import ANSWER, LOCATOR, TARGET, QueryPlan

Encoder = Callable[[list[str]], list[list[float]]]


class Encoders:
    """Text encoders by channel. What a revision of a channel has coded once is kept, ``most`` texts at most."""

    def __init__(self, channels: Mapping[str, Encoder], revision: str = "1", most: int = 10_000) -> None:
        self.channels, self.revision, self.most = dict(channels), revision, most
        self.known: dict[tuple[str, str, str], list[float]] = {}

    @classmethod
    def of(cls, encode: Callable[[list[str]], dict[str, list[list[float]]]]) -> Encoders:
        """Encoders from one callable that returns all of its channels."""
        return cls({c: lambda texts, c=c: encode(texts)[c] for c in ("sig", "eva", "clip")})

    def encode(self, channel: str, texts: list[str]) -> list[list[float]]:
        keys = [(channel, self.revision, t) for t in texts]
        new = [t for k, t in zip(keys, texts, strict=True) if k not in self.known]
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = texts
            for t, v in zip(new, self.channels[channel](new), strict=True):
                self.known[channel, self.revision, t] = [float(x) for x in v]
        return [self.known[k] for k in keys]


@dataclass
class Registry:
    """Tables of a collection. Missing ones are None, and the search goes on without them.

    frames: video_id, shot_id, keyframe_uid, frame_id, pts_time. vectors: keyframe_uid and
    channels (clip, sig, eva). ocr and asr: keyframe_uid, video_id, text; ocr_index may hold the
    ``text_search.postings`` of ocr, with its number of texts and their mean length.
    """

    frames: DataFrame
    vectors: DataFrame
    ocr: DataFrame | None = None
    asr: DataFrame | None = None
    ocr_index: DataFrame | None = None
    ocr_sizes: tuple[int, float] | None = None

    def status(self) -> dict[str, str]:
        have = {"frames": self.frames, "vectors": self.vectors, "ocr": self.ocr, "asr": self.asr}
        return {k: "UNAVAILABLE" if d is None else "READY" for k, d in have.items()}

    def inspect(self, dims: Mapping[str, int] | None = None) -> DataFrame:
        """``artifacts.inspect`` of all tables: READY, UNAVAILABLE or INVALID, rows and what is wrong."""
        return artifacts.inspect(self.frames, {"vectors": self.vectors}, {"ocr": self.ocr, "asr": self.asr}, dims or {})


@dataclass
class Evidence:
    """Frames with their scores, scores per query text, and what was left out."""

    frames: DataFrame
    per_query: DataFrame
    texts: list[str]
    mode: str
    warnings: list[str] = field(default_factory=list)


class SearchEngine:
    def __init__(self, spark: SparkSession, registry: Registry, encode: Encoders | Callable, planner: PlannerChain | None = None, top_k: int = 1000) -> None:
        self.spark, self.registry, self.planner, self.top_k = spark, registry, planner or PlannerChain([]), top_k
        self.encoders = encode if isinstance(encode, Encoders) else Encoders.of(encode)

    def plan(self, raw_query: str, task: str) -> QueryPlan:
        return self.planner.plan(raw_query, task)

    def _coded(self, texts: list[str], warnings: list[str]) -> tuple[str, dict[str, list[list[float]]]]:
        """Query vectors by channel. If any primary channel fails, the whole request goes back to clip."""
        have = set(self.registry.vectors.columns)
        try:
            if not {"sig", "eva"} <= have:
                raise LookupError("no vectors of a primary channel")
            mode, coded = "primary", {c: self.encoders.encode(c, texts) for c in ("sig", "eva")}
        except Exception as e:  # whatever an encoder raises
            warnings.append(f"a primary channel failed, clip stands in: {type(e).__name__}: {e}")
            return "clip", {"clip": self.encoders.encode("clip", texts)}
        try:
            if "clip" in have:
                coded["clip"] = self.encoders.encode("clip", texts)
        except Exception as e:  # clip only settles ties here
            warnings.append(f"clip is not compared: {type(e).__name__}: {e}")
        return mode, coded

    def retrieve(self, plan: QueryPlan, roles: tuple[str, ...] = (), with_context: bool = True) -> Evidence:
        """Evidence for the units of ``roles`` (all if empty).

        Direct hits of both channels and of the texts are candidates; they and their neighbours
        are scored in all channels, fused by query, over queries and over modalities, and raised
        by their neighbours. If a primary channel cannot be encoded, clip stands in alone. Beside
        the score, ``frames`` has the best raw score of each channel (sig, eva, clip, ocr, asr).
        """
        r, texts, warnings = self.registry, plan.search_texts(roles, with_context), []
        if not texts:
            raise ValueError("no query text for these roles")
        mode, coded = self._coded(texts, warnings)
        channels = ["sig", "eva"] if mode == "primary" else ["clip"]
        cols = ", ".join(f"{c} array<double>" for c in coded)
        queries = self.spark.createDataFrame([(i, *[coded[c][i] for c in coded]) for i in range(len(texts))], f"query_id long, {cols}")
        hits = {c: staged(vector_search.top_k(r.vectors, queries, c, self.top_k), "hits") for c in channels}
        found = reduce(DataFrame.unionByName, [h.select("keyframe_uid") for h in hits.values()])
        sides = {}
        for name, docs in (("ocr", r.ocr), ("asr", r.asr)):
            words = plan.literals(name, roles)
            if words and docs is not None:
                index, sizes = (r.ocr_index, r.ocr_sizes) if name == "ocr" else (None, None)
                side = text_search.search(docs, words, self.top_k, fuzzy=True, index=index, sizes=sizes)
                sides[name] = staged(side.join(r.frames.select("keyframe_uid"), "keyframe_uid", "left_semi").select("keyframe_uid", "score"), name)
                found = found.unionByName(sides[name].select("keyframe_uid"))
            elif words:
                warnings.append(f"{name} is unavailable; weights were shared anew")
        found = staged(found.distinct(), "candidates")
        videos = found.join(r.frames, "keyframe_uid").select("video_id").distinct()
        around = timeline.neighbours(r.frames.join(videos, "video_id", "left_semi")).join(found, "keyframe_uid")
        every = found.unionByName(around.select(F.explode("neighbours").alias("keyframe_uid"))).distinct()
        grid = every.crossJoin(F.broadcast(queries.select("query_id")))  # candidates times the plan's few texts
        scored = staged(vector_search.score_given(grid, r.vectors, queries, list(coded)), "scored")
        if mode == "primary":
            fused = fusion.fuse_channels(scored, {c: fusion.references(hits[c], c) for c in channels}).drop(*channels)
        else:
            fused = scored.select("query_id", "keyframe_uid", fusion.minmax(F.col("clip"), "query_id").alias("fused"))
        fused = staged(fused, "fused")
        visual = fusion.combine_queries(fused.select("query_id", "keyframe_uid", "fused"))
        final = fusion.fuse_modalities({"visual": visual.select("keyframe_uid", "score")} | sides, plan.channel_weights(roles))
        boosted = timeline.boost(r.frames, final).join(found, "keyframe_uid")
        agree = vector_search.consensus(hits, fused).groupBy("keyframe_uid").agg(F.max("consensus").alias("consensus"))
        raw = scored.groupBy("keyframe_uid").agg(*[(F.max(c) if c in coded else F.lit(None).cast("double")).alias(c) for c in ("sig", "eva", "clip")])
        frames = boosted.join(visual.select("keyframe_uid", "best_query", F.col("score").alias("visual")), "keyframe_uid", "left").join(agree, "keyframe_uid", "left").join(raw, "keyframe_uid", "left")
        for name in ("ocr", "asr"):
            frames = frames.join(sides[name].withColumnRenamed("score", name), "keyframe_uid", "left") if name in sides else frames.withColumn(name, F.lit(None).cast("double"))
        frames = fusion.minmax_all(staged(frames, "boosted"), "boosted", "score")
        frames = frames.select("video_id", "shot_id", "keyframe_uid", "frame_id", "pts_time", "fused", "neighbour_support", "best_query", F.coalesce("consensus", F.lit(0.0)).alias("consensus"), "visual", "sig", "eva", "clip", "ocr", "asr", "score")
        per_query = fused.select("query_id", "keyframe_uid", F.col("fused").alias("score")).join(r.frames.select("keyframe_uid", "video_id", "shot_id"), "keyframe_uid")
        return Evidence(staged(frames, "evidence"), staged(per_query, "scores"), texts, mode, warnings)

    def rank(self, plan: QueryPlan, e: Evidence, limit: int = 12) -> DataFrame:
        """Video hypotheses of the evidence, close ones in the order of their clip scores; ``rank`` from 0."""
        place = {t: i for i, t in enumerate(e.texts)}
        names = plan.labels()
        pairs = [(role, place[t]) for role in ("locator", "target") for t in names[role] if t in place]
        labels = self.spark.createDataFrame(pairs or [("target", 0)], "role string, query_id long")
        whole = self.spark.createDataFrame([(place[t],) for t in names["whole"] if t in place] or [(0,)], "query_id long")
        v = ranking.rank_videos(ranking.video_scores(e.per_query), labels, whole, ranking.top_consensus(e.frames))
        v = ranking.tie_break(v.join(ranking.clip_support(e.frames), "video_id", "left"))
        return staged(v.filter(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1), "videos")

    def search(self, plan: QueryPlan, answers: DataFrame | None = None, most: int = 100) -> DataFrame:
        """Ranked rows of the plan's task, at most ``most``."""
        plan = plan.validated()
        if plan.task == "TRAKE":
            return self._sequences(plan, most)
        e = self.retrieve(plan)
        videos = self.rank(plan, e)
        target = self.retrieve(plan, (TARGET, ANSWER), with_context=False).frames.join(videos.select("video_id"), "video_id", "left_semi")
        if plan.task == "KIS":
            c = portfolio.kis_candidates(videos, target)
        else:
            if answers is None:
                raise ValueError("a QA search needs answers by video")
            c = portfolio.qa_candidates(videos, target, answers)
        return portfolio.portfolio(c, most).orderBy("position")

    def _sequences(self, plan: QueryPlan, most: int) -> DataFrame:
        whole = self.retrieve(plan, (LOCATOR,))
        moments, scores = None, None
        for i, unit in enumerate(plan.ordered(plan.events)):
            e = self.retrieve(plan.only(unit), with_context=False)
            m = e.frames.withColumn("moment", F.lit(i))
            s = ranking.video_scores(e.per_query).select(F.lit(i).alias("moment"), "video_id", "video_score")
            moments = m if moments is None else moments.unionByName(m)
            scores = s if scores is None else scores.unionByName(s)
        n = len(plan.events)
        locator = ranking.video_scores(whole.per_query).groupBy("video_id").agg(F.max("video_score").alias("locator"))
        v = ranking.rank_by_moments(scores, n, locator, ranking.top_consensus(whole.frames))
        v = v.orderBy(F.col("video_score").desc(), "video_id").limit(20)
        v = staged(v.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("video_score").desc(), "video_id")) - 1), "videos")
        found = sequence.sequence_candidates(sequence.beam_sequences(moments.join(v.select("video_id"), "video_id", "left_semi"), n), v)
        w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "frame_ids")
        c = staged(found.join(v.select("video_id", "rank"), "video_id").withColumn("place", F.row_number().over(w) - 1).withColumn("strength", F.col("score")), "sequences")
        dense = c.select("video_id", "rank").distinct().withColumn("dense", F.row_number().over(Window.partitionBy().orderBy("rank")) - 1).select("video_id", "dense")
        return portfolio.portfolio(c.join(dense, "video_id").withColumn("rank", F.col("dense")).drop("dense"), most).orderBy("position")
