"""Graph analytics over edge tables. Iterative operators cut their lineage with checkpoints each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.sources.shared import saved


def oriented(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of each edge both ways; a self-loop once."""
    rows = edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"), (F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)).alias("weight"))
    return rows.unionAll(rows.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node, a self-loop once."""
    return edges.select(F.explode(F.array_distinct(F.array("source_node_id", "target_node_id"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(k)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source_node_id").alias("id")).union(edges.select("target_node_id")).distinct()
    return nodes.join(ends, "id", "left_anti")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return oriented(edges).where((F.col("a") == node) & (F.col("b") != node)).select(F.col("b").alias("id")).distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, communities, unassigned, orphans, mean degree."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_distinct(F.when(F.col("community_id") > 0, F.col("community_id"))).alias("communities"), F.count_if(F.col("community_id") == 0).alias("unassigned"))
    e, o = edges.agg(F.count("*").alias("edges")), orphans(nodes, edges).agg(F.count("*").alias("orphans"))
    return n.crossJoin(e).crossJoin(o).withColumn("mean_degree", F.coalesce(F.try_divide(2 * F.col("edges"), F.col("nodes")), F.lit(0.0)))  # one row each


def bridges(nodes: DataFrame, edges: DataFrame, least: int = 2, k: int = 20) -> DataFrame:
    """(id, communities, score): nodes that touch the most communities, their own included; score (c - 1) / (C - 1)."""
    of = nodes.select(F.col("id").alias("b"), "community_id")
    touched = oriented(edges).select("a", "b").union(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))).join(of, "b").groupBy("a").agg(F.count_distinct("community_id").alias("communities"))
    total = nodes.agg(F.count_distinct(F.when(F.col("community_id") > 0, F.col("community_id"))).alias("total"))
    rows = touched.where(F.col("communities") >= least).crossJoin(F.broadcast(total))  # one row
    score = F.when(F.col("total") > 1, (F.col("communities") - 1) / (F.col("total") - 1)).otherwise(0.0)
    return rows.select(F.col("a").alias("id"), "communities", score.alias("score")).orderBy(F.desc("communities"), "id").limit(k)


def bfs(edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """(id, depth) of the nodes within `depth` (1 to 6) undirected steps of start."""
    links = oriented(edges).select("a", "b").distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    front = seen
    for d in range(1, max(1, min(6, depth)) + 1):
        step = links.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front = saved(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def distances(edges: DataFrame, sources: DataFrame, depth: int = 3, hub: int = 10_000) -> DataFrame:
    """(source, id, depth): steps from each of the sources (id) to the nodes within `depth` undirected steps, all sources at once.

    A node keeps its least depth for each source. Edges of a node with more than `hub` of them
    are dealt to several keys, and a front that reaches it goes to each.
    """
    links = oriented(edges).select("a", "b").where("a <> b").distinct()
    parts = saved(links.groupBy("a").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts")))
    links = saved(links.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b"))
    start = sources.select(F.col("id").alias("source"), "id").where("id is not null").distinct().withColumn("depth", F.lit(0))
    seen = front = saved(start)
    for d in range(1, depth + 1):
        reached = front.select("source", F.col("id").alias("a")).join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        step = reached.join(links, ["a", "part"]).select("source", F.col("b").alias("id")).distinct()
        front = saved(step.join(seen, ["source", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def distance_scores(hits: DataFrame, edges: DataFrame, sources: DataFrame, depth: int = 3, most: float = 5.0) -> DataFrame:
    """hits with score 1 - steps / most from the nearest of the query's nodes (sources); 0 where none is within depth."""
    near = distances(edges, sources, depth).groupBy("id").agg(F.min("depth").alias("_steps"))
    return hits.drop("score").join(near, "id", "left").withColumn("score", F.greatest(F.lit(0.0), 1 - F.coalesce("_steps", F.lit(most)) / F.lit(float(most)))).drop("_steps")


def shortest_path(edges: DataFrame, start: str, end: str, hops: int = 6) -> DataFrame:
    """(position, id) of the nodes on a shortest undirected path of at most `hops` (1 to 12); no rows if there is none.

    Of equally short paths the one with the smallest predecessors, from the end back, is taken.
    """
    links = oriented(edges).select("a", "b").distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, None, 0)], "id string, parent string, depth int")
    front, found = seen, start == end
    for d in range(1, max(1, min(12, hops)) + 1):
        if found:
            break
        step = links.join(front.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        front = saved(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        found = not front.where(F.col("id") == end).isEmpty()
    if not found:
        return spark.createDataFrame([], "position int, id string")
    path, at = [end], end
    while at != start:
        at = seen.where(F.col("id") == at).first()["parent"]
        path.append(at)
    return spark.createDataFrame(list(enumerate(reversed(path))), "position int, id string")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, sinks_take: bool = True) -> DataFrame:
    """(id, rank), summing to 1. Nodes without out-edges spread their rank over all.

    sinks_take False leaves such nodes without incoming rank (the parity mode).
    """
    links = edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"))
    ids = nodes.select("id") if nodes is not None else links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    out = links.groupBy("a").agg(F.count("*").alias("out"))
    links = saved(links.join(out, "a"))
    n = ids.count()
    state = saved(ids.join(out.select(F.col("a").alias("id"), "out"), "id", "left").withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        loose = state.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        taken = links.join(state.select(F.col("id").alias("a"), "rank"), "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        got = F.coalesce("got", F.lit(0.0)) if sinks_take else F.when(F.col("out").isNotNull(), F.coalesce("got", F.lit(0.0))).otherwise(0.0)
        new = state.join(taken, "id", "left").withColumn("new", (1 - damping) / n + damping * (got + loose / n))
        new = saved(new.select("id", "out", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("rank")).alias("moved")))
        moved = new.agg(F.max("moved")).first()[0]
        state = new.drop("moved")
        if moved is None or moved < tolerance:
            break
    total = state.agg(F.sum("rank")).first()[0] or 1.0
    return state.select("id", (F.col("rank") / total).alias("rank"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): each round a node takes its neighbours' most frequent label, the smallest of equal ones."""
    links = saved(oriented(edges).select("a", "b").where("a <> b").distinct())
    state = links.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = links.join(state.select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
        new = saved(best.select(F.col("a").alias("id"), "community"))
        moved = new.join(state.withColumnRenamed("community", "old"), "id").where("community <> old").limit(1).count()
        state = new
        if not moved:
            break
    return state


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id of the nodes that edges connect.

    Alternates large-star and small-star rounds: neighbours of a node are tied to the least of
    them, which is found by a sum before the shuffle; rounds grow with the logarithm of a
    component's width. An error where the rounds end first.
    """
    rows = edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")).where("a is not null and b is not null")
    alone = rows.where("a = b").select(F.col("a").alias("id"))
    links = saved(rows.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select("v", "v")).distinct()
    return found.union(alone.distinct().join(found, "id", "left_anti").select("id", F.col("id").alias("component")))


def sent(rows: DataFrame) -> DataFrame:
    """rows for a join by shuffle: a side of a row a node, broadcast in each round, would pass the driver each time."""
    return rows.hint("merge")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: the modularity of (id, community)."""
    rows = oriented(edges)
    rows = rows.unionAll(rows.where("a = b"))
    degree = rows.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("k"))
    total = degree.agg(F.sum("k").alias("m2"))
    inside = rows.join(sent(communities.select(F.col("id").alias("a"), F.col("community").alias("ca"))), "a").join(sent(communities.select(F.col("id").alias("b"), F.col("community").alias("cb"))), "b")
    part = inside.where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    share = degree.join(sent(communities), "id").groupBy("community").agg(F.sum("k").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("squares"))
    return part.crossJoin(share).crossJoin(total).select((F.col("inside") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))  # one row each


def co_mention_edges(mentions: DataFrame, existing: DataFrame, by: str = "text_id", entity: str = "entity_id") -> DataFrame:
    """(source_node_id, target_node_id): pairs named in one text that have no edge either way."""
    sets = mentions.groupBy(by).agg(F.array_sort(F.collect_set(entity)).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a, i: F.transform(F.slice(F.col("e"), i + 2, F.size("e")), lambda b: F.struct(a.alias("source_node_id"), b.alias("target_node_id")))))
    fresh = sets.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    known = existing.select(F.least("source_node_id", "target_node_id").alias("source_node_id"), F.greatest("source_node_id", "target_node_id").alias("target_node_id"))
    return fresh.join(known, ["source_node_id", "target_node_id"], "left_anti")


def directory_tree(directories: DataFrame, root: str, depth: int = 10) -> DataFrame:
    """(id, depth, path) of the directories below root, itself included; cycles end."""
    directories.createOrReplaceTempView("_directories")
    return directories.sparkSession.sql(
        """
        WITH RECURSIVE tree(id, depth, trail, path) AS (
          SELECT id, 0, array(id), name FROM _directories WHERE id = :root
          UNION ALL
          SELECT d.id, t.depth + 1, array_append(t.trail, d.id), concat(t.path, '/', d.name)
          FROM tree t JOIN _directories d ON d.parent_id = t.id WHERE t.depth < :depth AND NOT array_contains(t.trail, d.id))
        SELECT id, min(depth) AS depth, min_by(path, depth) AS path FROM tree GROUP BY id""",
        args={"root": root, "depth": depth},
    )


def impact(changes: DataFrame, sources: DataFrame, pending: DataFrame) -> DataFrame:
    """(node_id) of nodes that stem from changed records (source_id) and aren't pending yet."""
    return sources.join(changes, "source_id", "left_semi").select("node_id").distinct().join(pending, "node_id", "left_anti")
