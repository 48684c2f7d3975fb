"""Queries: versions of the memory table in a Merkle store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.operators.versions import VersionStore
from quillion.plans.registry import Tables, query
from quillion.sources.shared import new_folder

SCHEMA = "id string, tier string, strength double"
AFTER_SQL = "b AS (SELECT id, CASE WHEN num % 7 = 0 THEN 'L9' ELSE tier END AS tier, strength FROM memory WHERE num % 11 <> 0), a AS (SELECT id, tier, strength FROM memory WHERE num % 13 <> 0)"


def _store(t: Tables) -> tuple[VersionStore, str, str]:
    """A store with two versions: some rows come, some go and some change their tier."""
    store = VersionStore.create(t.spark, new_folder(t.spark, "versions"))
    first = store.commit(t.memory.where("num % 13 <> 0").select("id", "tier", "strength"), "query", "before", 1)
    after = t.memory.where("num % 11 <> 0").select("id", F.when(F.col("num") % 7 == 0, "L9").otherwise(F.col("tier")).alias("tier"), "strength")
    return store, first, store.commit(after, "query", "after", 2, first)


@query(
    f"WITH {AFTER_SQL} SELECT coalesce(a.id, b.id) AS row_key, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change"
    " FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.tier <> b.tier", "memory",
)
def version_diff(t: Tables) -> DataFrame:
    store, first, second = _store(t)
    return store.diff(first, second).select("row_key", "change")


@query(f"WITH {AFTER_SQL} SELECT id, tier, strength FROM a", "memory")
def version_restore(t: Tables) -> DataFrame:
    """The first version, restored from the leaves that the second one shares and those that only it has."""
    store, first, _ = _store(t)
    return store.restore(first, SCHEMA)


@query(f"WITH {AFTER_SQL} SELECT 0 AS number, 'added' AS change FROM a WHERE id = '7' UNION ALL SELECT 1, 'changed' FROM a JOIN b ON a.id = b.id WHERE a.id = '7' AND a.tier <> b.tier", "memory")
def version_history(t: Tables) -> DataFrame:
    store, _, _ = _store(t)
    return store.history("7").select("number", "change")
