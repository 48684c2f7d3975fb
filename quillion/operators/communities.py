"""Communities of a graph: modularity moves, seeding, hierarchy and similarity clusters, by joins and sums in rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillion.operators import graph
from quillion.operators.graph import sent
from quillion.sources.shared import saved, stored


def _links(edges: DataFrame) -> DataFrame:
    """(a, b, w): summed weights both ways; a self-loop counts twice, as in degrees."""
    rows = graph.oriented(edges)
    return rows.unionAll(rows.where("a = b")).groupBy("a", "b").agg(F.sum("weight").alias("w"))


def _modularity(links: DataFrame, state: DataFrame, total: float, resolution: float) -> float:
    ends = links.join(sent(state.select(F.col("id").alias("a"), F.col("community").alias("ca"))), "a").join(sent(state.select(F.col("id").alias("b"), F.col("community").alias("cb"))), "b")
    inside = ends.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")))).first()[0] or 0.0
    squares = ends.groupBy("ca").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / total - resolution * squares / total**2


def _moved(links: DataFrame, degrees: DataFrame, state: DataFrame, total: float, resolution: float, turn: int) -> DataFrame:
    """One round of moves to the neighbouring community of most gain: nodes of one half of a hash take their turn, so that no two swap for ever."""
    rows = state.join(sent(degrees), "id")
    volume = rows.groupBy("community").agg(F.sum("k").alias("volume"))
    near = links.where("a <> b").join(sent(state.select(F.col("id").alias("b"), "community")), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"))
    own = rows.select("id", "community", F.lit(0.0).alias("w"))
    offers = near.unionByName(own).groupBy("id", "community").agg(F.sum("w").alias("w"))
    offers = offers.join(sent(volume), "community").join(sent(rows.select("id", F.col("community").alias("old"), "k")), "id")
    rest = F.col("volume") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0.0)
    offers = offers.withColumn("gain", F.round(F.col("w") - resolution * rest * F.col("k") / total, 9))
    best = offers.groupBy("id").agg(
        F.min_by("community", F.struct(-F.col("gain"), "community")).alias("new"), F.max("gain").alias("gain"), F.max(F.when(F.col("community") == F.col("old"), F.col("gain"))).alias("kept"), F.max("old").alias("old")
    )
    turns = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
    move = turns & (F.col("gain") > F.col("kept") + 1e-9)
    return best.select("id", F.when(move, F.col("new")).otherwise(F.col("old")).alias("community"), move.alias("moved"))


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 20, levels: int = 5, least_size: int = 1) -> DataFrame:
    """(id, community): nodes move to the neighbouring community of most gain in modularity, then communities are nodes of the next level.

    The assignment of the best modularity seen is returned. A community is named by the
    smallest id in it. Communities under least_size nodes go to the one that they are tied to
    most. Each round is a few joins and sums by node or community; edges to a hub are summed by
    the other end and community before they meet.
    """
    links = stored(_links(edges))
    total = links.agg(F.sum("w")).first()[0] or 0.0
    ids = links.select(F.col("a").alias("id")).distinct()
    best, score = saved(ids.withColumn("community", F.col("id"))), float("-inf")
    whole, members, base = links, best, links
    if not total:
        return best
    for _ in range(levels):
        degrees = stored(base.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
        state = stored(degrees.select("id", F.col("id").alias("community")))
        idle, changed = 0, False
        for turn in range(rounds):
            new = stored(_moved(base, degrees, state, total, resolution, turn))
            idle = idle + 1 if new.where("moved").isEmpty() else 0
            changed |= not idle
            state = new.drop("moved")
            if idle == 2:
                break
        members = stored(members.join(sent(state.select(F.col("id").alias("community"), F.col("community").alias("up"))), "community").select("id", F.col("up").alias("community")))
        now = _modularity(whole, members, total, resolution)
        if now > score + 1e-12:
            best, score = members, now
        if not changed:
            break
        named = state.select(F.col("id").alias("a"), F.col("community").alias("ca"))
        both = base.join(sent(named), "a").join(sent(named.select(F.col("a").alias("b"), F.col("ca").alias("cb"))), "b")
        base = stored(both.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    if least_size > 1:
        best = _without_small(whole, best, least_size)
    names = best.groupBy("community").agg(F.min("id").alias("name"))
    return best.join(sent(names), "community").select("id", F.col("name").alias("community"))


def _without_small(links: DataFrame, state: DataFrame, least: int) -> DataFrame:
    sizes = state.groupBy("community").agg(F.count("*").alias("n"))
    small, large = sizes.where(F.col("n") < least).select("community"), sizes.where(F.col("n") >= least).select(F.col("community").alias("to"))
    ends = links.join(sent(state.select(F.col("id").alias("a"), "community")), "a").join(sent(state.select(F.col("id").alias("b"), F.col("community").alias("to"))), "b")
    ties = ends.join(sent(small), "community", "left_semi").join(sent(large), "to", "left_semi").groupBy("community", "to").agg(F.sum("w").alias("w"))
    into = ties.groupBy("community").agg(F.min_by("to", F.struct(-F.col("w"), "to")).alias("to"))
    return saved(state.join(sent(into), "community", "left").select("id", F.coalesce("to", "community").alias("community")))


def seeded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with a new community for each that has none (0) and has an edge, numbered on from the largest, in order of id.

    Numbers come from counts by range of ids, so that no task holds all nodes.
    """
    ends = edges.select(F.col("source_node_id").alias("id")).union(edges.select(F.col("target_node_id").alias("id"))).distinct()
    top = nodes.agg(F.coalesce(F.max("community_id"), F.lit(0))).first()[0]
    fresh = nodes.where("community_id = 0").select("id").distinct().join(ends, "id", "left_semi")
    ranged = saved(fresh.sort("id").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).select("_part", "before")  # one row a task
    place = F.row_number().over(Window.partitionBy("_part").orderBy("id"))
    named = ranged.join(F.broadcast(before), "_part").select("id", (F.lit(top) + F.col("before") + place).alias("_new"))
    return nodes.join(named, "id", "left").withColumn("community_id", F.coalesce("_new", "community_id")).drop("_new")


def hierarchy(nodes: DataFrame, edges: DataFrame | None = None, least: float = 0.1, depth: int = 5) -> DataFrame:
    """(cluster, depth, community_id): each community as a cluster of its own at depth 0, and what they are merged into.

    Communities share no node, so their Jaccard likeness is zero and depth 0 is all that it
    gives. With edges, likeness is the share of the smaller cluster's edge ends that lead to
    the other; clusters that pick each other or a chain of them, at `least` or more, are one at
    the next depth.
    """
    state = nodes.where("community_id > 0").select("community_id").distinct().select(F.col("community_id").alias("cluster"), "community_id")
    levels = state.withColumn("depth", F.lit(0))
    if edges is None:
        return levels.select("cluster", "depth", "community_id")
    of = nodes.where("community_id > 0").select("id", "community_id")
    ends = graph.oriented(edges).join(of.select(F.col("id").alias("a"), F.col("community_id").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("community_id").alias("y")), "b")
    ties = saved(ends.groupBy("x", "y").agg(F.sum("weight").alias("w")))
    for d in range(1, depth + 1):
        here = state.select(F.col("community_id").alias("x"), F.col("cluster").alias("cx"))
        there = state.select(F.col("community_id").alias("y"), F.col("cluster").alias("cy"))
        between = ties.join(here, "x").join(there, "y").groupBy("cx", "cy").agg(F.sum("w").alias("w"))
        size = between.groupBy("cx").agg(F.sum("w").alias("all"))
        both = between.where("cx <> cy").join(size, "cx").join(size.select(F.col("cx").alias("cy"), F.col("all").alias("other")), "cy")
        like = both.withColumn("like", F.col("w") / F.least("all", "other")).where(F.col("like") >= least)
        picks = like.groupBy("cx").agg(F.min_by("cy", F.struct(-F.col("like"), "cy")).alias("cy"))
        joined = saved(picks.select(F.col("cx").cast("string").alias("source_node_id"), F.col("cy").cast("string").alias("target_node_id")))
        if joined.isEmpty():
            break
        roots = graph.components(joined).select(F.col("id").cast("long").alias("cluster"), "component")
        least_of = roots.groupBy("component").agg(F.min("cluster").alias("root"))
        up = roots.join(least_of, "component").select("cluster", "root")
        state = saved(state.join(up, "cluster", "left").select(F.coalesce("root", "cluster").alias("cluster"), "community_id"))
        levels = levels.unionByName(state.withColumn("depth", F.lit(d)))
    return levels.select("cluster", "depth", "community_id")


def similar_clusters(index: DataFrame, least: float = 0.7, least_size: int = 2, tile_rows: int = 4_096) -> DataFrame:
    """(id, cluster): rows (id, embedding) that chains of cosine `least` or more connect, in clusters of least_size; named by the smallest id.

    Every pair is compared, tile against tile; a tile pair gives a spanning forest of its links.
    Rows without an embedding, or with one of zeros, are in no cluster.
    """
    rows = index.select("id", "embedding").where("embedding is not null and size(embedding) > 0")
    tiles = max(1, -(-rows.count() // tile_rows))
    own = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.select("id", "embedding", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    schema = f"source_node_id {rows.schema['id'].dataType.simpleString()}, target_node_id {rows.schema['id'].dataType.simpleString()}"

    def links(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        v = np.array([np.asarray(e, float) for e in part["embedding"]])
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        ids = part["id"].to_numpy()
        left = np.flatnonzero(part["own"].to_numpy() == key[0])
        right = left if key[0] == key[1] else np.flatnonzero(part["own"].to_numpy() == key[1])
        label = np.arange(len(part))
        for k in range(0, len(left), 512):
            i, j = np.nonzero(v[left[k : k + 512]] @ v[right].T >= least - 1e-9)
            for a, b in zip(left[k + i].tolist(), right[j].tolist(), strict=True):
                while label[a] != a:
                    label[a] = a = label[label[a]]
                while label[b] != b:
                    label[b] = b = label[label[b]]
                if a != b:
                    label[max(a, b)] = min(a, b)
        tied = np.flatnonzero(label != np.arange(len(part)))
        return pd.DataFrame({"source_node_id": ids[tied], "target_node_id": ids[label[tied]]})

    found = graph.components(saved(dealt.groupBy("x", "y").applyInPandas(links, schema)))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least_size)
    return found.join(sizes, "component").select("id", F.col("component").alias("cluster"))
