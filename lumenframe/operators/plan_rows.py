"""Plans as rows: the parts of query plans as expressions over units, for tables of plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..plans.query_plan import ROLE_NAMES, ROLES, QueryPlan


def units_with_roles(units: Column, *roles: str) -> Column:
    """Units (structs with ``roles``) that have any of the roles."""
    wanted = F.array(*map(F.lit, roles))
    return F.filter(units, lambda u: F.arrays_overlap(u["roles"], wanted))


def ordered_units(units: Column, ids: Column) -> Column:
    """Units as the ids list them; ids of no unit are passed over."""
    found = F.transform(ids, lambda i: F.try_element_at(F.filter(units, lambda u: u["unit_id"] == i), F.lit(1)))
    return F.filter(found, lambda u: u.isNotNull())


def distinct_texts(*lists: Column) -> Column:
    """Trimmed texts of all lists without blanks and repeats, in order."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))


def literals(of_plan: Column, units: Column, modality: str) -> Column:
    """The plan's literals, then those of units that use the channel."""
    own = F.flatten(F.transform(F.filter(units, lambda u: F.array_contains(u["modalities"], modality)), lambda u: u["literals"]))
    return distinct_texts(of_plan, own)


def normal_roles(values: Column) -> Column:
    """Role names: aliases resolved, unknown ones dropped, distinct, in order."""
    names = F.map_from_arrays(F.array(*[F.lit(x) for x in (*ROLE_NAMES, *ROLES)]), F.array(*[F.lit(x) for x in (*ROLE_NAMES.values(), *ROLES)]))
    known = F.transform(values, lambda v: F.try_element_at(names, F.upper(F.trim(v))))
    return F.array_distinct(F.filter(known, lambda r: r.isNotNull()))


def grounded_span(raw: Column, span: Column, fallback: Column) -> Column:
    """The span, collapsed, where it lies in the query once case and blanks are levelled, else the fallback; and which of them it is."""
    s = T.collapse(F.coalesce(span, F.lit("")))
    there = (s != "") & F.contains(F.lower(T.collapse(raw)), F.lower(s))
    return F.struct(F.when(there, s).otherwise(F.coalesce(F.nullif(F.trim(fallback), F.lit("")), raw)).alias("span"), there.alias("grounded"))


PLAN = (
    "task string, context string, units array<struct<unit_id:string,text:string,roles:array<string>,modalities:array<string>,literals:array<string>,source:string>>, "
    "visible array<string>, spoken array<string>, ocr_weight double, question string, value_type string, answer_source string, targets array<string>, events array<string>, provider string, warnings int, error string"
)


def _row(p: QueryPlan) -> dict:
    units = [{"unit_id": u.unit_id, "text": u.text, "roles": list(u.roles), "modalities": list(u.modalities), "literals": list(u.literals), "source": u.source} for u in p.units]
    a = p.answer
    return {"task": p.task, "context": p.context, "units": units, "visible": list(p.visible_text), "spoken": list(p.spoken_text), "ocr_weight": p.weights.get("ocr", 0.0), "question": p.question, "value_type": p.value_type, "answer_source": a.source if a else None, "targets": list(p.targets), "events": list(p.events), "provider": p.provider, "warnings": len(p.warnings), "error": None}


def planned(rows: DataFrame, make: Callable[..., QueryPlan], columns: list[str], key: str) -> DataFrame:
    """``key`` and the plan (columns ``PLAN``) that ``make`` gives for the named text columns of each row.

    Planning is Python over one small text, so it runs in Arrow batches; a refused plan has its reason in ``error``.
    """
    out_type = StructType([*rows.select(key).schema.fields, *StructType.fromDDL(PLAN).fields])
    schema = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    made = _row(make(*(row[c] for c in columns)))
                except (ValueError, TypeError) as e:
                    made = {"error": str(e)}
                out.append({key: row[key]} | made)
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select(key, *columns).mapInArrow(run, out_type)
