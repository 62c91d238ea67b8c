"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pytest

from sluice.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: (v is None, "nan" if isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v)
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert normal(rows, got.columns) == normal(found.fetchall(), names)
