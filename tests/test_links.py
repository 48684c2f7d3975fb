"""Suggested links and cross links, hubs included."""

import random
from collections import defaultdict

import pandas as pd

from quillion.operators import store


def test_shared_neighbours_are_counted_over_hubs_too(spark):
    draw = random.Random(7)
    edges = [(f"n{i:04d}", hub) for i in range(1300) for hub in ("hub1", "hub2")]
    edges += [(f"n{draw.randrange(1300):04d}", f"rare{draw.randrange(400)}") for _ in range(700)] + [("n0001", "n0002"), ("n0003", "n0003"), ("n0001", "hub1")]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    nodes = sorted(n for n in near if len(near[n]) >= 3)
    want = {(a, b): len(near[a] & near[b]) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if b not in near[a] and len(near[a] & near[b]) >= 3}
    df = spark.createDataFrame(edges, "source_node_id string, target_node_id string")
    for hub in (5_000, 1_000):
        got = store.suggested_links(df, 3, hub).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want
    assert len(want) > 100 and any({"hub1", "hub2"} < near[a] & near[b] for a, b in want)


def test_cross_links_with_whole_texts(spark):
    texts = {"a": "x" * 90 + " the same beginning and more", "b": "x" * 90 + " the same beginning but other words", "c": "see: " + "x" * 90 + " the same beginning and more, indeed", "d": "short"}
    memories = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts.items())], "id string, content string, created_at long")
    pairs = lambda found: {tuple(sorted((r.source_node_id, r.target_node_id))) for r in found.collect()}
    none = spark.createDataFrame([], "source_node_id string, target_node_id string")
    assert pairs(store.cross_links(memories, none)) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert pairs(store.cross_links(memories, none, head_chars=None)) == {("a", "c")}
    assert pairs(store.cross_links(memories, spark.createDataFrame([("c", "a")], "source_node_id string, target_node_id string"), head_chars=None)) == set()


def test_pairs_are_counted_by_tiles(spark):
    draw = random.Random(9)
    near = defaultdict(set)
    for _ in range(900):
        near[draw.randrange(60)].add(100 + draw.randrange(40))
    links = spark.createDataFrame([(a, b) for a in near for b in near[a]], "a long, b long")
    want = {(a, b): len(near[a] & near[b]) for a in near for b in near if a < b and len(near[a] & near[b]) >= 3}
    for tile_links in (2_000_000, 60):
        got = store.pairs_by_tiles(links, 3, tile_links).collect()
        assert len(got) == len(want) and {(r.x, r.y): r.shared for r in got} == want


def test_pairs_are_counted_for_some_nodes_at_a_time():
    lists = pd.Series([["a", "b", "c"], ["a", "b"], ["b", "c"], ["d"]])
    for most in (1, 4, 1_000):
        x, y, shared = store.counted_pairs(lists, lists, True, 2, most)
        assert {tuple(sorted(p)) for p in zip(x, y, strict=True)} == {("a", "b"), ("b", "c")} and list(shared) == [2, 2]


def test_communities_join_without_broadcasts(spark):
    """Neither the rounds nor the last joins collect a side in the driver."""
    from quillion.operators import communities, graph

    edges = spark.createDataFrame([(f"a{k % 7}", f"b{k}", 1.0) for k in range(60)], "source_node_id string, target_node_id string, weight double")
    found = graph.modularity(edges, communities.louvain(edges, rounds=2, levels=1))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
