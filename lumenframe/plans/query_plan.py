"""What a search is asked to do: units, roles, literals, weights, and what the answer should be."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

TASKS = ("KIS", "QA", "TRAKE")
LOCATOR, TARGET, ANSWER, EVENT = "VIDEO_LOCATOR", "TARGET_MOMENT", "ANSWER_EVIDENCE", "ORDERED_EVENT"
ROLES = (LOCATOR, TARGET, ANSWER, EVENT)
#: Names that planners have used for the roles (fixed values).
ROLE_NAMES = {"LOCATOR": LOCATOR, "VIDEO": LOCATOR, "TARGET": TARGET, "ANSWER": ANSWER, "EVIDENCE": ANSWER, "EVENT": EVENT, "TRAKE_EVENT": EVENT}
MODALITIES = ("visual", "ocr", "asr")
VALUE_TYPES = ("number", "color", "person", "place", "free_text")
SOURCES = ("visual", "ocr", "asr", "mixed")


def unique(values: Iterable[str]) -> tuple[str, ...]:
    """Trimmed, without blanks and repeats, in order."""
    out: dict[str, None] = {}
    for v in values:
        if v.strip():
            out.setdefault(v.strip())
    return tuple(out)


@dataclass(frozen=True)
class Unit:
    """A part of the query: ``text`` is searched for, ``source`` is the query's own span."""

    unit_id: str
    text: str
    roles: tuple[str, ...] = (LOCATOR,)
    modalities: tuple[str, ...] = ("visual",)
    literals: tuple[str, ...] = ()
    source: str = ""
    attributes: tuple[str, ...] = ()
    required: bool = True
    group: int = 0
    order: int = 0
    confidence: float = 1.0


@dataclass(frozen=True)
class Answer:
    """The value that a QA search must find; it is never a literal to search for."""

    question: str
    value_type: str = "free_text"
    source: str = "visual"
    evidence: tuple[str, ...] = ()


@dataclass(frozen=True)
class QueryPlan:
    """A plan. ``targets`` and ``events`` are ids of units, ``queries`` further texts for the whole."""

    raw_query: str
    task: str
    units: tuple[Unit, ...]
    context: str = ""
    queries: tuple[str, ...] = ()
    visible_text: tuple[str, ...] = ()
    spoken_text: tuple[str, ...] = ()
    must: tuple[str, ...] = ()
    should: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: {"visual": 1.0})
    answer: Answer | None = None
    targets: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    provider: str = "rule"
    warnings: tuple[str, ...] = ()
    changed: bool = False

    @property
    def question(self) -> str | None:
        return self.answer.question if self.answer else None

    @property
    def value_type(self) -> str | None:
        return self.answer.value_type if self.answer else None

    def with_roles(self, roles: Iterable[str]) -> tuple[Unit, ...]:
        """Units that have any of the roles; all units if none is named."""
        wanted = frozenset(roles)
        return tuple(u for u in self.units if not wanted or not wanted.isdisjoint(u.roles))

    def ordered(self, ids: Iterable[str]) -> list[Unit]:
        """Units as ``ids`` list them; ids of no unit are passed over."""
        out: list[Unit] = []
        for i in ids:
            out += [u for u in self.units if u.unit_id == i][:1]
        return out

    def search_texts(self, roles: tuple[str, ...] = (), with_context: bool = True) -> list[str]:
        """Distinct texts to search with: the whole first, then the units, then wishes if all roles are meant."""
        whole = (self.context or self.raw_query, *self.queries) if with_context else ()
        wishes = () if roles else (*self.must, *self.should)
        return list(unique([*whole, *(u.text for u in self.with_roles(roles)), *wishes]))

    def literals(self, modality: str, roles: tuple[str, ...] = ()) -> list[str]:
        """Distinct literals of a text channel: the plan's, then those of units that use the channel."""
        of_plan = {"ocr": self.visible_text, "asr": self.spoken_text}[modality]
        of_units = (x for u in self.with_roles(roles) if modality in u.modalities for x in u.literals)
        return list(unique([*of_plan, *of_units]))

    def channel_weights(self, roles: tuple[str, ...] = ()) -> dict[str, float]:
        """The plan's weights, or the defaults where it has literals and no weight for their channel."""
        ocr, asr = (bool(self.literals(m, roles)) for m in ("ocr", "asr"))
        out = dict(self.weights)
        if ocr and "ocr" not in out:
            out = default_weights(True, False)
        if asr and "asr" not in out:
            out = default_weights(ocr, True)
        return out

    def labels(self) -> dict[str, tuple[str, ...]]:
        """Texts by which a video is judged as locator, target and whole; each stands in for one that is missing."""
        locator = unique(u.text for u in self.with_roles([LOCATOR]))
        target = unique(u.text for u in self.with_roles([TARGET, ANSWER])) or locator or (self.context or self.raw_query,)
        return {"locator": locator or target, "target": target, "whole": unique([self.context or self.raw_query, *self.queries])}

    def only(self, unit: Unit) -> QueryPlan:
        """A plan for one unit alone, for a search of its own; it need not be valid for a task."""
        return replace(self, units=(unit,), context=unit.text, queries=(), must=(), should=(), visible_text=(), spoken_text=(), targets=(unit.unit_id,), events=())

    def edited(self, **changes) -> QueryPlan:
        """The plan with an operator's changes, checked anew."""
        return replace(self, **{"changed": True} | changes).validated()

    def validated(self, event_count: int | None = None) -> QueryPlan:
        bad = next(iter(self.faults(event_count)), None)
        if bad:
            raise ValueError(bad)
        return self

    def faults(self, event_count: int | None = None) -> list[str]:
        """All reasons why the plan cannot be run."""
        roles = {u.unit_id: set(u.roles) for u in self.units}
        named = [*self.targets, *self.events, *(self.answer.evidence if self.answer else ())]
        of = lambda ids, role: all(role in roles.get(i, ()) for i in ids)
        tests = [
            (self.task in TASKS, f"unknown task {self.task}"),
            (self.raw_query.strip() and self.units, "a plan needs a query and a unit"),
            (len(roles) == len(self.units), "unit ids must differ"),
            (all(u.text.strip() and u.roles and set(u.roles) <= set(ROLES) for u in self.units), "a unit needs a text and known roles"),
            (all(u.modalities and set(u.modalities) <= set(MODALITIES) for u in self.units), "a unit needs known modalities"),
            (set(named) <= set(roles), "a plan may name its own units only"),
            (of(self.events, EVENT), "events must be units with the role of an event"),
            (set(self.weights) <= set(MODALITIES) and all(w >= 0 for w in self.weights.values()) and self.weights.get("visual", 0) > 0, "weights must be of known channels, not negative, and positive for visual"),
        ]
        if self.task == "TRAKE":
            tests += [(len(self.events) >= 2, "a TRAKE plan needs two ordered events"), (event_count is None or len(self.events) == event_count, f"the plan has {len(self.events)} events, not {event_count}")]
        else:
            tests.append((self.targets and of(self.targets, TARGET), "the plan needs a target unit"))
        if self.task == "QA":
            a = self.answer
            tests += [(a and a.question.strip(), "a QA plan needs a question"), (a and a.evidence and of(a.evidence, ANSWER) and set(a.evidence) <= set(self.targets), "a QA plan needs evidence among its targets")]
            tests.append((a and a.value_type in VALUE_TYPES and a.source in SOURCES, "unknown kind of answer"))
        return [reason for good, reason in tests if not good]


def default_weights(ocr: bool, asr: bool) -> dict[str, float]:
    """Channel weights by the text channels that a plan uses (fixed values)."""
    return {(False, False): {"visual": 1.0}, (True, False): {"visual": 0.55, "ocr": 0.45}, (False, True): {"visual": 0.55, "asr": 0.45}, (True, True): {"visual": 0.50, "ocr": 0.25, "asr": 0.25}}[ocr, asr]


def normal_roles(values: object) -> tuple[str, ...]:
    """Roles of a planner's answer: aliases resolved, unknown ones dropped, in order and distinct."""
    listed = values if isinstance(values, list | tuple) else [values]
    names = (str(v).strip().upper() for v in listed)
    return unique(r for r in (ROLE_NAMES.get(n, n) for n in names) if r in ROLES)
