"""Versions against plain copies of the tables."""

import random

import pytest

from quillion.operators.versions import VersionStore

SCHEMA = "id string, body string, n int"


def tables():
    draw = random.Random(2)
    first = {f"k{i:03d}": (f"body {i}", i if i % 9 else None) for i in range(300)}
    second = dict(first)
    for k in draw.sample(sorted(first), 5):
        second[k] = ("changed " + k, 1)
    for k in draw.sample(sorted(first), 3):
        del second[k]
    second["new"] = (None, 5)
    third = dict(second)
    third["k007"] = ("third", 3)
    return first, second, third


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = VersionStore.create(spark, str(tmp_path_factory.mktemp("versions") / "v"), fan=8)
    names, parent = [], None
    for k, table in enumerate(tables()):
        df = spark.createDataFrame([(i, *v) for i, v in table.items()], SCHEMA).repartition(3)
        parent = s.commit(df, "me", f"version {k}", 100 + k, parent)
        names.append(parent)
    return s, names


def rows(df):
    return {r.id: (r.body, r.n) for r in df.collect()}


def test_restore_and_log(store):
    s, names = store
    for name, table in zip(names, tables(), strict=True):
        assert rows(s.restore(name, SCHEMA)) == table
    log = s.log().collect()
    assert [r.version for r in log] == names[::-1] and [r.parent for r in log] == [names[1], names[0], None] and log[0].message == "version 2"
    with pytest.raises(KeyError):
        s.restore("none", SCHEMA)


def test_differences_read_only_what_differs(store):
    s, names = store
    versions = tables()
    for a, b in ((0, 1), (1, 2), (0, 2), (2, 0)):
        old, new = versions[a], versions[b]
        want = {(k, "added" if k not in old else "removed" if k not in new else "changed") for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
        assert {(r.row_key, r.change) for r in s.diff(names[a], names[b]).collect()} == want
    assert s.differing(names[1], names[2]).count() == 1 and s.diff(names[1], names[1]).count() == 0
    # The third version wrote one leaf and one inner node; the others are shared.
    assert s._read("leaves").select("leaf", "slot").distinct().count() <= 64 + 9 + 1
    assert s._read("inner").select("node").distinct().count() <= 8 + 8 + 1


def test_history_and_rollback(store):
    s, names = store
    versions = tables()
    for key in ("k007", "new", "k001", "nowhere", *sorted(versions[0].keys() - versions[1].keys())):
        states = [None, *[v.get(key) for v in versions]]
        want = [(k, "added" if states[k] is None else "removed" if states[k + 1] is None else "changed") for k in range(3) if states[k] != states[k + 1]]
        assert [(r.number, r.change) for r in s.history(key).orderBy("number").collect() if r.number < 3] == want
    leaves = s._read("leaves").count()
    back = s.rollback(names[0], "me", 200, names[2])
    assert rows(s.restore(back, SCHEMA)) == versions[0] and s._read("leaves").count() == leaves
    assert s.diff(names[0], back).count() == 0


def test_empty_table(spark, tmp_path):
    s = VersionStore.create(spark, str(tmp_path / "e"))
    empty = s.commit(spark.createDataFrame([], SCHEMA))
    full = s.commit(spark.createDataFrame([("a", "b", 1)], SCHEMA))
    assert s.restore(empty, SCHEMA).count() == 0 and [r.change for r in s.diff(empty, full).collect()] == ["added"]
