"""Submission drafts: up to 100 rows a query, edited on the driver, checked and packed through Spark."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import validation
from . import writers

ROW = "query_name string, task string, video_id string, frame_ids array<long>, answer string, requires_review boolean"
MOST = 100
VERSION = 2


@dataclass
class Drafts:
    """Drafts of a set of queries: ``queries`` maps a name to (task, number of events)."""

    spark: SparkSession
    queries: dict[str, tuple[str, int]]
    rows: dict[str, list[dict]] = field(default_factory=dict)

    def _known(self, name: str) -> None:
        if name not in self.queries:
            raise ValueError(f"unknown query {name}")

    @staticmethod
    def _key(row: dict) -> tuple:
        return row["video_id"], tuple(row["frame_ids"]), row.get("answer")

    def replace(self, name: str, rows: list[dict]) -> None:
        self._known(name)
        self.rows[name] = list(rows)[:MOST]

    def merge(self, name: str, rows: list[dict]) -> int:
        """Add rows that are not there yet, at the end; returns how many."""
        self._known(name)
        have = self.rows.setdefault(name, [])
        seen, before = {self._key(r) for r in have}, len(have)
        for r in rows:
            if self._key(r) not in seen and len(have) < MOST:
                seen.add(self._key(r))
                have.append(r)
        return len(have) - before

    def remove(self, name: str, index: int) -> None:
        self._known(name)
        del self.rows[name][index]

    def move(self, name: str, index: int, to: int) -> None:
        self._known(name)
        self.rows[name].insert(to, self.rows[name].pop(index))

    def table(self, name: str) -> DataFrame:
        task, _ = self.queries[name]
        listed = [(name, task, r["video_id"], [int(x) for x in r["frame_ids"]], r.get("answer"), bool(r.get("requires_review"))) for r in self.rows.get(name, [])]
        return self.spark.createDataFrame(listed, ROW)

    def violations(self, name: str, catalog: DataFrame) -> list[list[str]]:
        self._known(name)
        bad = validation.submission_violations(self.table(name), catalog, self.queries[name][1])
        return [r["reasons"] for r in bad.limit(MOST).collect()]

    def export(self, catalog: DataFrame) -> bytes:
        """The ZIP of all drafts; a draft with a violation, or none for a query, is refused."""
        out = {}
        for name, (task, _) in self.queries.items():
            bad = self.violations(name, catalog)
            if bad or not self.rows.get(name):
                raise ValueError(f"{name}: {bad or 'no rows'}")
            listed = [(i, r["video_id"], int(r["frame_ids"][0]), [int(x) for x in r["frame_ids"]], r.get("answer")) for i, r in enumerate(self.rows[name])]
            d = self.spark.createDataFrame(listed, "position int, video_id string, frame_id long, frame_ids array<long>, answer string")
            out[name] = writers.submission_lines(d, task)
        return writers.submission_zip(out)

    def save(self, path: str) -> None:
        """To any store that Spark writes, written aside and moved into place."""
        fs, p = writers._fs(self.spark, path)
        aside = p(f"{path}.part")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"schema_version": VERSION, "queries": self.queries, "rows": self.rows}).encode()))
        out.close()
        fs.delete(p(path), False)
        if not fs.rename(aside, p(path)):
            raise RuntimeError(f"the drafts could not be moved to {path}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Drafts:
        data = json.loads(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
        if data.get("schema_version") != VERSION:
            raise ValueError("another version of drafts")
        return cls(spark, {k: (t, n) for k, (t, n) in data["queries"].items()}, data["rows"])
