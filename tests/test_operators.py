"""Operators against small tables with known results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.operators import entities, graph, patterns, relations, search, store, textquery
from quillion.plans import registry
from quillion.streaming import changes


def test_rank_fusion(spark):
    hits = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "id string, score double")
    fused = {r.id: r.score for r in search.rrf(search.legs(keyword=hits, semantic=hits)).collect()}
    assert fused["a"] == pytest.approx(2 / 60) and fused["a"] > fused["b"]


@pytest.mark.parametrize(("query", "want"), [("apple AND pear", {2}), ("apple OR plum", {1, 2, 3}), ("apple NOT pear", {1}), ("(apple OR plum) AND NOT pear", {1, 3}), ('"ripe plum"', {3})])
def test_boolean_queries(spark, query, want):
    rows = spark.createDataFrame([(1, "apple tart"), (2, "apple and pear"), (3, "a ripe plum"), (4, None)], "id long, content string")
    tree = textquery.parse(query)
    assert {r.id for r in rows.where(textquery.compile_tree(tree, ["content"])).collect()} == want


def test_as_of_join_matches_brute_force(spark):
    draw = random.Random(4)
    left = [(i, draw.randrange(5), draw.randrange(100)) for i in range(80)]
    right = [(draw.randrange(5), t, i) for i, t in enumerate(draw.sample(range(100), 60))]
    out = relations.as_of_join(spark.createDataFrame(left, "i long, k long, t long"), spark.createDataFrame(right, "k long, at long, v long"), "k", "t", "at", ["v"])
    want = {i: max(((at, v) for key, at, v in right if key == k and at <= t), default=(None, None))[1] for i, k, t in left}
    assert {r.i: r.v for r in out.collect()} == want


def test_components_match_brute_force(spark):
    draw = random.Random(2)
    pairs = [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(35)]
    edges = spark.createDataFrame([(a, b, "r") for a, b in pairs], "source_node_id string, target_node_id string, relation string")
    groups = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    found = {}
    frame = graph.components(edges)
    node, root = frame.columns[:2]
    for r in frame.collect():
        found.setdefault(r[root], set()).add(r[node])
    wanted = {frozenset(g) for g in groups.values() if len(g) > 1}
    assert {frozenset(g) for g in found.values() if len(g) > 1} == wanted


def test_near_duplicates_keep_copies_linear(spark):
    text = "the meeting about the harbour budget moved to the second week of october because of rain"
    rows = [(f"m{i:03d}", text, i) for i in range(60)] + [("near", text.replace("second", "third"), 100), ("far", "something else that has nothing to do with any of the others here", 101)]
    got = relations.near_duplicates(spark.createDataFrame(rows, "id string, content string, created_at long")).collect()
    newer = {r.newer for r in got}
    assert newer == {f"m{i:03d}" for i in range(1, 60)} | {"near"} and len(got) == 60
    assert all(r.older == "m000" for r in got)


def test_budget_pack(spark):
    rows = spark.createDataFrame([(i, 10 * i) for i in range(1, 6)], "id long, size long")
    packed = relations.budget_pack(rows, 60, F.col("size"), [F.col("id")])
    assert {r.id for r in packed.collect()} == {1, 2, 3}


def test_lost_updates_do_not_reappear(spark):
    log = [("memory", "insert", "a", '{"v": 1}', 1), ("memory", "update", "a", '{"v": 2}', 2), ("memory", "insert", "b", '{"v": 3}', 3), ("memory", "delete", "b", "{}", 4)]
    frame = spark.createDataFrame(log, "table_name string, operation string, record_id string, data_json string, created_at long").withColumn("id", F.monotonically_increasing_id().cast("string"))
    assert {r.record_id for r in changes.current_state(frame).collect()} == {"a"}


def test_note_blocks_parses_whole_texts(spark, tmp_path):
    """Lines after a document's first 200 characters are blocks of its note, too."""
    spark.createDataFrame([(1, "a" * 300 + "\n- late item\n> late quote\n")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.type, r.state): r.n for r in registry.QUERIES["note_blocks"](spark, str(tmp_path)).collect()}
    assert got["list_item", "none"] == 2 and got["quote", "none"] == 2


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_duplicates_find_every_pair(spark):
    """Pairs whose edits are spread evenly, at ratios up to the bound itself, against all pairs."""
    draw = random.Random(3)
    texts = ["", "a"]
    for n in (10, 20, 40, 61):
        body = "".join(draw.choice("abcdefgh ") for _ in range(n))
        texts.append(body)
        for share in (0.1, 0.2, 0.3, 0.31):
            texts.append("".join("X" if int((i + 1) * share + 1e-9) > int(i * share + 1e-9) else c for i, c in enumerate(body)))
            texts.append("".join(c for i, c in enumerate(body) if int((i + 1) * share + 1e-9) == int(i * share + 1e-9)))
    texts = list(dict.fromkeys(texts))
    rows = [(f"m{i:03d}", t, i) for i, t in enumerate(texts)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] < b[2] and edits(a[1], b[1]) / max(len(a[1]), len(b[1]), 1) <= 0.3}
    frame = spark.createDataFrame(rows, "id string, content string, created_at long")
    for tile_rows in (2000, 10):
        got = [(r.older, r.newer) for r in relations.near_duplicates(frame, tile_rows=tile_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("least", [0.5, 0.6, 0.85])
def test_duplicate_pairs_find_every_pair(spark, least):
    draw = random.Random(5)
    stems = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(4, 14))) for _ in range(25)]
    names = sorted({s[:i] + draw.choice("xyz") * k + s[i + k :] for s in stems for i in (0, len(s) // 2, len(s) - 1) for k in (0, 1, 2)})
    frame = spark.createDataFrame([(f"e{i:03d}", x) for i, x in enumerate(names)] + [("z1", names[0].upper()), ("z2", "ab")], "id string, name string")
    keys = {r.id: r.key for r in frame.select("id", text.normalise_name(F.col("name")).alias("key")).collect()}
    of = {}
    for i, key in sorted(keys.items()):
        of.setdefault(key, []).append(i)
    grams = {k: {k[i : i + 3] for i in range(len(k) - 2)} or {k} for k in of}
    want = {(ids[0], other): 1.0 for ids in of.values() for other in ids[1:]}
    for x in of:
        for y in of:
            likeness = len(grams[x] & grams[y]) / len(grams[x] | grams[y])
            if of[x][0] < of[y][0] and likeness >= least:
                want[of[x][0], of[y][0]] = likeness
    got = entities.duplicate_pairs(frame, least).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.likeness for r in got} == pytest.approx(want)


def test_words_are_split_once_for_all_chunks(spark):
    """Each chunk used to split the whole text again."""
    word = "ab " * 5
    frame = spark.createDataFrame([(word,), ("",), ("  ",), (None,)], "t string")
    got = [r.c for r in frame.select(text.word_chunks(F.col("t"), 3, 1).alias("c")).collect()]
    assert got == [["ab ab ab", "ab ab ab"], [], [], []]
    assert frame.select(text.word_chunks(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_term_counts(spark):
    rows = [("1", "river river stone the"), ("2", "stone x lamp"), ("3", None), ("4", "")]
    for more in ([], [("1", "river cloud")], [(None, "river")]):
        frame = spark.createDataFrame(rows + more, "id string, content string")
        want = {}
        for i, t in rows + more:
            for w in (t or "").split():
                if len(w) > 1 and w != "the":
                    n, ids = want.get(w, (0, frozenset()))
                    want[w] = (n + 1, ids | ({i} if i else set()))
        assert {r.term: (r.n, r.df) for r in search.term_counts(frame).collect()} == {w: (n, len(ids)) for w, (n, ids) in want.items()}
    plan = search.term_counts(spark.createDataFrame(rows, "id string, content string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(term#\d+, \d+", plan) and not re.search(r"hashpartitioning\(term#\d+, id#", plan)


def test_topics_sum_in_tasks(spark, monkeypatch):
    rows = [("1", "river stone stone x1y", 0.2), ("2", "river stone lamp", None), ("3", "lamp cloud", 0.5), ("4", None, 0.9), ("5", "river", 0.6)]
    frame = spark.createDataFrame(rows, "id string, content string, confidence double")
    got = {r.topic: (r.n, r.mean_confidence, r.top_terms) for r in patterns.topics(frame, k=3, terms_each=2).collect()}
    assert got == {"river": (3, 0.4, ["river", "stone"]), "stone": (2, 0.2, ["stone", "river"]), "lamp": (2, 0.5, ["lamp", "cloud"])}
    assert patterns.topics(frame.where("id = '4'")).collect() == []
    plans = []
    monkeypatch.setattr(patterns, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    assert patterns.topics(frame, k=3).count() == 3
    assert "hashpartitioning(term#" in plans[0] and not re.search(r"hashpartitioning\(topic#\d+, term#", plans[0])  # tokens aren't repeated for each topic


def test_document_search_makes_likely_chunks_only_again(spark):
    frame = spark.createDataFrame([("a", "x " * 300 + "Trash can"), ("b", "trash " * 3), ("c", "nothing here"), ("d", None)], "id string, content string")
    got = store.document_search(frame, ["trash"], 5)
    assert [(r.id, r.chunk) for r in got.collect()] == [("b", 0), ("a", 1)]
