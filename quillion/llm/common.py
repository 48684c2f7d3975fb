"""What the training-data operators share: shared-folder checkpoints and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary folder is set in local mode, as in tests; on a
    cluster that would lose files, so it is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillion-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and read them from there on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of undirected edges (a, b), as (node, root): root is the smallest node reachable.

    Alternates large-star and small-star rounds, each a few shuffles by key of rows that are
    summed before they are dealt; rounds grow with the logarithm of a component's width.
    Rows with a null end, self-loops and repeated edges are ignored. Nodes without an edge to
    another node aren't returned; a table without edges gives no rows.
    """
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept, mark = materialize(kept), None
    for _ in range(max_rounds):
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        both = kept.union(kept.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = kept.select("v").distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def join_by_size(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = 200_000) -> DataFrame:
    """big joined with small; small is broadcast only if it is counted and has max_rows at most.

    small should be materialized and its rows narrow (keys and a few numbers: tens of MB at
    the bound). Beyond the bound both sides are shuffled by the key.
    """
    narrow = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if narrow else small, on, how)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
