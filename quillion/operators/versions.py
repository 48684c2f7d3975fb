"""Versions of a keyed table as a Merkle tree of content-addressed leaves.

A key's digest places its row in one of `fan` * `fan` leaves. A leaf is named by the digest of its
rows, an inner node by that of its leaves, a root by that of its inner nodes; a version is a root
with a parent. Leaves and nodes are written only if no version has them yet, so versions share
what they have in common, and a difference is found from the top: only nodes and leaves whose
names differ are read.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillion.sources.shared import saved

COMMITS = "version string, parent string, root string, author string, message string, created_at long, number long"
LEAVES = "leaf string, slot int, row_key string, row_json string, inner int"
INNER = "node string, slot int, leaf string"
ROOTS = "root string, inner int, node string"


def named(digests: Column) -> Column:
    return F.sha2(F.concat_ws("|", digests), 256)


class VersionStore:
    """Versions in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", fan: int = 16):
        self.spark, self.path, self.key, self.fan = spark, path, key, fan

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str = "id", fan: int = 16) -> VersionStore:
        """An empty store; fan ** 2 leaves, chosen so that a leaf's row digests fit a task."""
        for kind, schema in (("commits", COMMITS), ("leaves", LEAVES), ("inner", INNER), ("roots", ROOTS)):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{kind}")
        return cls(spark, path, key, fan)

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema({"commits": COMMITS, "leaves": LEAVES, "inner": INNER, "roots": ROOTS}[kind]).parquet(f"{self.path}/{kind}")

    def _append(self, kind: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{kind}")

    @cached_property
    def slots(self) -> int:
        return self.fan * self.fan

    def slot(self, key: Column) -> Column:
        return (F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") % self.slots).cast("int")

    def commit(self, df: DataFrame, author: str = "", message: str = "", created_at: int = 0, parent: str | None = None) -> str:
        """A version of df, whose keys are unique and not null; returns its name. Rows are written only in leaves that are new."""
        rows = df.select(F.col(self.key).cast("string").alias("row_key"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row_json")).where("row_key is not null")
        rows = saved(rows.withColumn("slot", self.slot(F.col("row_key"))))
        leaves = rows.groupBy("slot").agg(named(F.array_sort(F.collect_list(F.sha2(F.concat_ws("=", "row_key", "row_json"), 256)))).alias("leaf"))
        leaves = saved(leaves.withColumn("inner", (F.col("slot") / self.fan).cast("int")))
        # A tree's upper levels have `slots` rows at most.
        inner = saved(leaves.groupBy("inner").agg(named(F.transform(F.array_sort(F.collect_list(F.struct("slot", "leaf"))), lambda x: F.concat_ws(":", x["slot"].cast("string"), x["leaf"]))).alias("node")))
        root = inner.agg(named(F.transform(F.array_sort(F.collect_list(F.struct("inner", "node"))), lambda x: F.concat_ws(":", x["inner"].cast("string"), x["node"]))).alias("root")).first()["root"]
        new_leaves = leaves.join(self._read("leaves").select("leaf", "slot").distinct(), ["leaf", "slot"], "left_anti")
        self._append("leaves", rows.join(F.broadcast(new_leaves), "slot").select("leaf", "slot", "row_key", "row_json", "inner").repartitionByRange("slot").sortWithinPartitions("slot"))
        new_inner = inner.join(self._read("inner").select("node").distinct(), "node", "left_anti")
        self._append("inner", leaves.join(new_inner, "inner").select("node", "slot", "leaf"))
        if self._read("roots").where(F.col("root") == root).isEmpty():
            self._append("roots", inner.select(F.lit(root).alias("root"), "inner", "node"))
        version, number = uuid.uuid4().hex, self._read("commits").count()
        self._append("commits", self.spark.createDataFrame([(version, parent, root, author, message, created_at, number)], COMMITS).coalesce(1))
        return version

    def root(self, version: str) -> str:
        found = self._read("commits").where(F.col("version") == version).first()
        if found is None:
            raise KeyError(f"no version {version!r}")
        return found["root"]

    def tree(self, version: str) -> DataFrame:
        """(slot, leaf) of a version."""
        nodes = self._read("roots").where(F.col("root") == self.root(version)).select("node")
        return self._read("inner").join(F.broadcast(nodes), "node").select("slot", "leaf")  # fan rows

    def differing(self, old: str, new: str) -> DataFrame:
        """(slot, old_leaf, new_leaf) of the leaves that differ: inner nodes that both roots have aren't read."""
        a, b = (self._read("roots").where(F.col("root") == self.root(v)).select("inner", "node") for v in (old, new))
        both = a.withColumnRenamed("node", "old").join(b.withColumnRenamed("node", "new"), "inner", "full").where(~F.col("old").eqNullSafe(F.col("new")))
        side = lambda c: self._read("inner").join(F.broadcast(both.select(F.col(c).alias("node")).where("node is not null")), "node").select("slot", F.col("leaf").alias(f"{c}_leaf"))
        return side("old").join(side("new"), "slot", "full").where(~F.col("old_leaf").eqNullSafe(F.col("new_leaf")))

    def _rows(self, leaves: DataFrame) -> DataFrame:
        """(row_key, row_json) of (slot, leaf); a leaf that two writers stored is read once."""
        return self._read("leaves").join(F.broadcast(leaves), ["slot", "leaf"]).select("row_key", "row_json").distinct()

    def diff(self, old: str, new: str) -> DataFrame:
        """(row_key, change, old_json, new_json): added, removed and changed rows."""
        leaves = saved(self.differing(old, new))
        a = self._rows(leaves.select("slot", F.col("old_leaf").alias("leaf"))).withColumnRenamed("row_json", "old_json")
        b = self._rows(leaves.select("slot", F.col("new_leaf").alias("leaf"))).withColumnRenamed("row_json", "new_json")
        change = F.when(F.col("old_json").isNull(), "added").when(F.col("new_json").isNull(), "removed").otherwise("changed")
        return a.join(b, "row_key", "full").where(~F.col("old_json").eqNullSafe(F.col("new_json"))).select("row_key", change.alias("change"), "old_json", "new_json")

    def restore(self, version: str, schema: str) -> DataFrame:
        """The rows of a version; schema is that of the committed table."""
        return self._rows(self.tree(version)).select(F.from_json("row_json", schema).alias("r")).select("r.*")

    def log(self) -> DataFrame:
        """(version, parent, author, message, created_at, number), newest first."""
        return self._read("commits").drop("root").orderBy(F.desc("number"))

    def history(self, key: str) -> DataFrame:
        """(number, version, change, row_json): the versions that changed a key's row, in order of their commits; only its slot's leaves are read."""
        slot = self.slot(F.lit(key))
        at = self._read("commits").join(self._read("roots"), "root").where(F.col("inner") == (slot / self.fan).cast("int")).join(self._read("inner").where(F.col("slot") == slot), "node").select("version", "leaf")
        row = self._read("leaves").where((F.col("slot") == slot) & (F.col("row_key") == key)).select("leaf", "row_json").distinct()
        states = self._read("commits").select("number", "version").join(at, "version", "left").join(row, "leaf", "left").select("number", "version", "row_json")
        w = Window.orderBy("number")  # a row a version
        before = F.lag("row_json").over(w)
        change = F.when(before.isNull(), "added").when(F.col("row_json").isNull(), "removed").otherwise("changed")
        rows = states.withColumn("change", change).withColumn("same", F.col("row_json").eqNullSafe(before))
        return rows.where(~F.col("same")).select("number", "version", "change", "row_json")

    def rollback(self, version: str, author: str = "", created_at: int = 0, parent: str | None = None) -> str:
        """A new version with an old one's root: nothing else is written."""
        new, number = uuid.uuid4().hex, self._read("commits").count()
        self._append("commits", self.spark.createDataFrame([(new, parent, self.root(version), author, f"rollback to {version}", created_at, number)], COMMITS).coalesce(1))
        return new
