"""Each registered query with SQL gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillion.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A form in which equal values of both engines are equal."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool | str):
        return str(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    try:
        return f"{float(value) + 0.0:.5g}"
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    rows = sorted("|".join(plain(r[c] if not hasattr(r[c], "asDict") else r[c].asDict()) for c in order) for r in got.collect())
    expected = sorted("|".join(plain(r[columns.index(c)]) for c in order) for r in want.fetchall())
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    got.collect()
