"""Each registered query against its SQL in DuckDB, and the registry itself."""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenframe import catalog


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [df.columns.index(c) for c in want.columns]
    assert sorted(tuple(plain(r[i]) for i in at) for r in got) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["gate_snapshot", "gate_snapshot_final"])
def test_first_of_repeated_lines(spark, tmp_path, name):
    """A line's rows lie in two files, the larger one last, and some have no date: the first date counts, as SQL finds it in one thread."""
    d = tmp_path / "lineitem.parquet"
    d.mkdir()
    schema = pa.schema([("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_shipdate", pa.timestamp("us"))])
    day = lambda k: datetime(1995, 1, 1) + timedelta(k)
    for i, copies in enumerate((1, 5)):
        rows = [(k, n, None if (k + n + i + c) % 4 == 0 else day(k + n + 1000 * i + 100 * c)) for c in range(copies) for k in range(60) for n in range(1, 5)]
        pq.write_table(pa.table(list(zip(*rows, strict=True)), schema=schema), d / f"part-{i}.parquet")
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"create view lineitem as select * from '{d}/*.parquet'")
    want = c.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_entry_contract(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
