"""Scans of registered tables."""

import pytest

from quillion.sources.catalog import Catalog, equals


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 0.5, True, "a", 2**62), (2, 1.5, False, "1", 5), (None, None, None, None, None)], "n int, d double, b boolean, s string, big long")


@pytest.mark.parametrize(
    ("name", "value", "count"),
    [("n", "1", 1), ("n", 1.0, 1), ("n", "1.5", 0), ("n", "x", 0), ("n", None, 0), ("n", "nan", 0), ("d", "0.5", 1), ("d", 0.5 + 1e-17, 1), ("d", "inf", 0), ("b", "TRUE", 1), ("b", False, 1), ("b", "maybe", 0), ("s", "1", 1), ("s", "A", 0), ("big", str(2**62), 1), ("big", 2**62 + 1, 0), ("big", 2**70, 0), ("none", 1, 0)],
)
def test_typed_equality(rows, name, value, count):
    assert rows.where(equals(rows, name, value)).count() == count


def test_equality_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(equals(df, "n", "1") & equals(df, "d", "0.5"))._jdf.queryExecution().toString()
    assert "EqualTo(n,1)" in plan and "GreaterThanOrEqual(d," in plan


def test_scans_by_workspace_and_session(spark):
    known = Catalog(spark)
    known.register("session", spark.createDataFrame([("s1", "w"), ("s2", "v")], "id string, workspace_id string"))
    known.register("message", spark.createDataFrame([("m1", "s1"), ("m2", "s2")], "id string, session_id string"))
    known.register("kg_edge", spark.createDataFrame([("e", 0), ("f", 9)], "id string, invalid_at long"))
    known.register("context_directory", spark.createDataFrame([("d",)], "id string"))
    assert [r.id for r in known.messages("w").collect()] == ["m1"]
    assert [r.id for r in known.edges(current=True).collect()] == ["e"] and known.edges().count() == 2
    assert known.table("directory").count() == 1
    with pytest.raises(KeyError):
        known.table("unknown")
