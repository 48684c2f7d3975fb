"""Operators that have no SQL, against plain versions on small tables."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillion.functions import scoring, text
from quillion.operators import communities, dreams, graph, notes, patterns, relations, search, sessions, store
from quillion.sources import connectors
from quillion.streaming import changes

WORDS = "river stone lamp winter garden paper window silver music bread travel engine harbour quiet orange letter market forest cloud bridge".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", ".", "!", ""]) for _ in range(n))


def candidates(spark, n=40, dims=6):
    draw = random.Random(1)
    rows = [(f"c{i:02d}", round(draw.random(), 2), [draw.uniform(-1, 1) for _ in range(dims)], prose(i, 12)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, score double, embedding array<double>, content string")


def greedy(rows, k, lam, like):
    """Chosen ids in order: relevance against the largest likeness to those chosen; ties by score, then id."""
    left, chosen = sorted(rows, key=lambda r: (-r[1], r[0])), []
    while left and len(chosen) < k:
        best = max(left, key=lambda r: (lam * r[1] - (1 - lam) * max((like(r, c) for c in chosen), default=0.0)))
        chosen.append(best)
        left.remove(best)
    return [r[0] for r in chosen]


def cosine(a, b):
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b))))


def test_mmr(spark):
    rows, frame = candidates(spark)
    got = sorted((r.mmr_rank, r.id) for r in search.mmr(frame, 10, 0.6).collect() if r.mmr_rank)
    assert [i for _, i in got] == greedy(rows, 10, 0.6, lambda a, b: cosine(a[2], b[2]))
    words = lambda r: set(r[3].lower().split())
    got = sorted((r.mmr_rank, r.id) for r in search.text_mmr(frame.drop("embedding"), 10, 0.6).collect())
    assert [i for _, i in got] == greedy(rows, 10, 0.6, lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b)))


def test_session_fuzzy_and_proximity(spark):
    draw = random.Random(2)
    rows = [(f"s{i}", "".join(draw.choice("thandrxyz ") for _ in range(15)), prose(i, 30).replace(".", "").replace("!", "")) for i in range(60)]
    frame = spark.createDataFrame(rows, "id string, name string, summary string").withColumn("metadata", F.lit("{}"))

    def subsequence(q, s):
        at = 0
        for c in s:
            at += at < len(q) and c == q[at]
        return at / len(q)

    want = {i: subsequence("thandr", n) for i, n, _ in rows}
    got = {r.id: r.score for r in sessions.fuzzy(frame, "thandr", 100).collect()}
    assert got == pytest.approx({i: v for i, v in want.items() if v > 0.3})

    def near(summary, a, b, within=5):
        w = summary.split()
        far = [w[i + 1 : i + 1 + within].index(b) + 1 for i, x in enumerate(w) if x == a and b in w[i + 1 : i + 1 + within]]
        return 1 - min(far) / within if far else None

    want = {i: near(s, "river", "stone") for i, _, s in rows}
    got = {r.id: r.score for r in sessions.proximity(frame, "river stone", 5, 100).collect()}
    assert got == pytest.approx({i: v for i, v in want.items() if v is not None}) and len(got) > 2


def test_document_chunks_cover_the_text(spark):
    texts = [prose(i, n) for i, n in enumerate((1, 10, 30, 200, 900))] + ["x" * 1700]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")

    def chunks(t, size=500, overlap=50, least=100):
        out, at = [], 0
        while len(t.encode()) >= least and at < len(t):
            window = t[at : at + size]
            last = max((k + 1 for k, c in enumerate(window) if c in ".!?\n"), default=0)
            taken = len(window) if at + size >= len(t) else last if last > size // 2 else size
            out.append(window[:taken].strip(" "))
            at = len(t) if at + size >= len(t) else at + max(taken - overlap, 1)
        return out

    got = {r.id: r.c for r in frame.select("id", text.document_chunks(F.col("content")).alias("c")).collect()}
    assert got == {i: chunks(t) for i, t in enumerate(texts)}


def test_extractive_summary(spark):
    draw = random.Random(4)
    odd = ["This is an important rule, number 7.", "Short.", "Alice Brown and Carol Dean decided it in 1999."]
    texts = [" ".join(draw.choice([prose(draw.randrange(999), 9).capitalize() + ".", *odd]) for _ in range(8)) for _ in range(12)]

    def summary(t, most=3):
        sentences = [x.strip(" ") for x in re.split(r"(?<=[.!?])\s+|\n+", t) if x.strip(" ")]
        scored = []
        for i, s in enumerate(sentences):
            marks = len(re.findall(r"\b\d+\b", s)) + 0.5 * len(re.findall(r"\b[A-Z][a-z]{2,}\b", s))
            score = 0.5 + (-0.3 if len(s) < 10 else -0.2 if len(s) > 500 else 0) + min(0.15 * sum(k in s.lower() for k in patterns.KEY_WORDS), 0.6) + 0.1 * (i == 0) + 0.1 * (i == len(sentences) - 1 > 0) + min(marks / max(len(s), 1) * 20, 0.2)
            scored.append((-max(0.0, min(1.0, score)), i, s))
        chosen = []
        for x in sorted(scored):
            words = set(x[2].lower().split())
            if len(chosen) < most and not any(len(words & set(c[2].lower().split())) / len(words | set(c[2].lower().split())) >= 0.8 for c in chosen):
                chosen.append(x)
        return " ".join(s for _, _, s in sorted(chosen, key=lambda c: c[1]))

    frame = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    assert {r.id: r.summary for r in patterns.extractive_summary(frame, most=3).collect()} == {i: summary(t) for i, t in enumerate(texts)}


def test_contradiction_scores(spark):
    pairs = [("I like the red car a lot", "I dislike the red car a lot", 0.35), ("it was old and past", "it is new today", 0.15), ("we have 3 cats", "they own 3 dogs", 0.1), ("", "x", 0.0), ("the cat sat on the mat", "but the cat sat not on the mat", 0.1), ("sun", "moon", 0.0)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, want double")
    for r in frame.select("a", "b", "want", text.contradiction_score(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(r.want), (r.a, r.b)


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source_node_id string, target_node_id string, weight double")


def cliques():
    ring = [[f"{g}{i}" for i in range(6)] for g in "abcd"]
    pairs = [(x, y) for g in ring for i, x in enumerate(g) for y in g[i + 1 :]]
    return ring, pairs + [(ring[k][0], ring[(k + 1) % 4][1]) for k in range(4)]


def modularity(pairs, of, resolution=1.0):
    m2, inside, volume = 2 * len(pairs), 0, {}
    for a, b in pairs:
        inside += 2 * (of[a] == of[b])
        for x in (a, b):
            volume[of[x]] = volume.get(of[x], 0) + 1
    return inside / m2 - resolution * sum(v * v for v in volume.values()) / m2**2


def test_louvain_finds_the_cliques(spark):
    ring, pairs = cliques()
    got = {r.id: r.community for r in communities.louvain(edges_of(spark, pairs)).collect()}
    assert {frozenset(i for i in got if got[i] == c) for c in got.values()} == {frozenset(g) for g in ring}
    frame = spark.createDataFrame(list(got.items()), "id string, community string")
    assert graph.modularity(edges_of(spark, pairs), frame).first()[0] == pytest.approx(modularity(pairs, got))
    draw = random.Random(7)
    loose = list({tuple(sorted((f"n{draw.randrange(30)}", f"n{draw.randrange(30)}"))) for _ in range(60)})
    loose = [(a, b) for a, b in loose if a != b]
    got = {r.id: r.community for r in communities.louvain(edges_of(spark, loose)).collect()}
    found = modularity(loose, got)
    assert found > 0.25 and set(got) == {x for p in loose for x in p}
    for v in got:  # no single move to a neighbour's community is better
        for u in {b if a == v else a for a, b in loose if v in (a, b)}:
            assert modularity(loose, got | {v: got[u]}) <= found + 0.02


def test_small_communities_and_empty_graph(spark):
    pairs = cliques()[1] + [("z0", "z1"), ("z1", "a3")]
    got = {r.id: r.community for r in communities.louvain(edges_of(spark, pairs), least_size=4).collect()}
    assert min(list(got.values()).count(c) for c in set(got.values())) >= 4
    assert communities.louvain(edges_of(spark, []).limit(0)).count() == 0


def test_label_propagation(spark):
    _, pairs = cliques()
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {x: x for x in near}
    for _ in range(4):
        votes = {x: [label[y] for y in near[x]] for x in near}
        label = {x: min(set(v), key=lambda c: (-v.count(c), c)) for x, v in votes.items()}
    assert {r.id: r.community for r in graph.label_propagation(edges_of(spark, pairs), 4).collect()} == label


def test_hierarchy_joins_tied_communities(spark):
    ring, pairs = cliques()
    nodes = spark.createDataFrame([(x, k + 1) for k, g in enumerate(ring) for x in g] + [("lone", 9), ("none", 0)], "id string, community_id long")
    leaf = communities.hierarchy(nodes).collect()
    assert sorted((r.cluster, r.depth) for r in leaf) == [(1, 0), (2, 0), (3, 0), (4, 0), (9, 0)]
    levels = communities.hierarchy(nodes, edges_of(spark, pairs), least=0.01).collect()
    top = max(r.depth for r in levels)
    assert top >= 1 and {r.cluster for r in levels if r.depth == top} == {1, 9}


@pytest.mark.parametrize("tile_rows", [7, 4096])
def test_similar_clusters(spark, tile_rows):
    draw = random.Random(3)
    rows = [(f"v{i:02d}", [draw.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [("zero", [0.0] * 4), ("null", None)]
    group = {r[0]: {r[0]} for r in rows}
    for a in rows[:50]:
        for b in rows[:50]:
            if a[0] < b[0] and sum(x * y for x, y in zip(a[1], b[1], strict=True)) / math.hypot(*a[1]) / math.hypot(*b[1]) >= 0.8 and group[a[0]] is not group[b[0]]:
                group[a[0]] |= group[b[0]]
                for x in group[b[0]]:
                    group[x] = group[a[0]]
    got = {r.id: r.cluster for r in communities.similar_clusters(spark.createDataFrame(rows, "id string, embedding array<double>"), 0.8, tile_rows=tile_rows).collect()}
    assert got == {i: min(g) for i, g in group.items() if len(g) > 1}


def test_best_matches_and_store(spark):
    draw = random.Random(6)
    rows = [(f"m{i:02d}", [draw.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [("zero", [0.0] * 3), ("null", None)]
    index = spark.createDataFrame(rows, "id string, embedding array<double>")
    real = [r for r in rows if r[1] and any(r[1])]
    like = lambda a, b: sum(x * y for x, y in zip(a[1], b[1], strict=True)) / math.hypot(*a[1]) / math.hypot(*b[1])
    want = {}
    for a in real:
        s, i = max(((like(a, b), b[0]) for b in real if b[0] != a[0]), key=lambda x: (x[0], x[1]))
        if s > 0:
            want[a[0]] = (i, pytest.approx(s))
    for block in (7, 1024):
        assert {r.id: (r.match, r.score) for r in store.best_matches(index.repartition(3), index, block).collect()} == want
    current = index.select("id", "id").toDF("id", "content").withColumns({"access_count": F.lit(0), "strength": F.lit(0.5), "tier": F.lit("L1"), "updated_at": F.lit(0).cast("long")})
    incoming = spark.createDataFrame([("a", "copy", rows[4][1]), ("b", "new", [-x for x in rows[4][1]])], "id string, content string, embedding array<double>")
    after = {r.id: r for r in store.store(current, index.where("id = 'm04'"), incoming, 9).collect()}
    assert len(after) == len(rows) + 1 and "a" not in after and after["b"].content == "new" and after["m04"].access_count == 1 and after["m05"].access_count == 0
    assert store.best_matches(index.limit(0), index).count() == 0


def test_dreams(spark):
    rows = [("1", "river stone lamp winter garden", 0.9), ("2", "river stone lamp market cloud", 0.2), ("3", "bread river stone travel", 0.5), ("4", "music only here", 0.5), ("5", None, 0.5), ("6", "river lamp engine bridge forest orange", 0.5)]
    frame = spark.createDataFrame(rows, "id string, content string, confidence double")
    tokens = {i: set(t.split()) for i, t, _ in rows if t}
    pairs = [(a, b, len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b])) for a in tokens for b in tokens if a < b]
    got = [tuple(r.source_ids) for r in dreams.connections(frame).collect()]
    assert got == [(a, b) for a, b, j in pairs if 0.15 <= j <= 0.85][:5]
    got = {tuple(r.source_ids): r.confidence for r in dreams.contrasts(frame).collect()}
    assert set(got) == {(a, b) for a, b, j in pairs if 0.2 <= j <= 0.6} and got["1", "2"] == pytest.approx(0.8)
    triples = []
    for a, b, _ in pairs:
        shared = tokens[a] & tokens[b]
        third = [c for c in tokens if c > b and len(shared & tokens[c]) >= 2]
        if len(shared) >= 2 and third:
            triples.append((a, b, third[0]))
    assert [tuple(r.source_ids) for r in dreams.generalisations(frame).collect()] == triples[:5]
    found = dreams.gaps(frame, 2).collect()
    assert [tuple(r.source_ids) for r in found] == [("1", "2"), ("1", "2")] and "'river'" in found[0].content
    named = frame.withColumn("entities_json", F.when(F.col("id").isin("3", "6"), '["Ann"]').otherwise("[]"))
    assert [tuple(r.source_ids) for r in dreams.gaps(named).collect()] == [("3", "6")]
    assert dreams.dream(frame.limit(0)).count() == 0


def test_debounced_matches_a_loop(spark):
    draw = random.Random(5)
    rows = [(f"k{draw.randrange(3)}", draw.randrange(1000), f"{i:03d}") for i in range(300)]
    last, want = {}, set()
    for k, at, i in sorted(rows):
        if k not in last or at - last[k] >= 50:
            last[k] = at
            want.add((k, at, i))
    got = changes.debounced(spark.createDataFrame(rows, "dedup_key string, created_at long, id string"), 50)
    assert {(r.dedup_key, r.created_at, r.id) for r in got.collect()} == want
    assert changes.debounced(got.limit(0), 50).count() == 0


def test_jaccard_pairs_find_every_pair(spark):
    draw = random.Random(9)
    base = [draw.sample([f"word{k}" for k in range(60)], 20) for _ in range(25)]
    texts = [" ".join(b) for b in base] + [" ".join(b[k:]) for b in base for k in (1, 3, 6)] + [" ".join(base[0])] * 4 + ["", "a b"]
    sets = [frozenset(w for w in t.split() if len(w) >= 3) for t in texts]
    ids = [f"m{i:03d}" for i in range(len(texts))]
    first = {s: min(i for i, x in zip(ids, sets, strict=True) if x == s) for s in sets}
    want = {(first[s], i): 1.0 for i, s in zip(ids, sets, strict=True) if s and i != first[s]}
    reps = {i: s for s, i in first.items() if s}
    want |= {(a, b): len(x & y) / len(x | y) for a, x in reps.items() for b, y in reps.items() if a < b and len(x & y) / len(x | y) >= 0.7}
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "id string, content string")
    got = relations.jaccard_pairs(frame, 0.7).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.jaccard for r in got} == pytest.approx(want)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("s", f"t{i}") for i in range(200)]
    got = {r.id: r.component for r in graph.components(edges_of(spark, chain + star + [("own", "own")])).collect()}
    assert set(got.values()) == {"c0000", "s", "own"} and len(got) == 301 + 201 + 1
    with pytest.raises(RuntimeError):
        graph.components(edges_of(spark, chain), rounds=2)


def test_cards(spark):
    """A new card that lapses keeps its easiness; a known one loses its repetitions."""
    state = lambda reviews: spark.range(1).select(scoring.card_fold(F.array(*[F.struct(F.lit(t).cast("long").alias("at"), F.lit(g).alias("grade")) for t, g in reviews])).alias("c")).first().c
    assert tuple(state([(0, 1)])) == (2.5, 0, 0, 0.0, 600)
    known = state([(0, 5), (100, 5), (200, 5)])
    assert (known.reps, known.lapses) == (3, 0) and known.ef == pytest.approx(2.8) and known.interval == pytest.approx(6 * 2.8)
    lapsed = state([(0, 5), (100, 2)])
    assert (lapsed.reps, lapsed.lapses, lapsed.next) == (0, 1, 700) and lapsed.ef == pytest.approx(2.6 + 0.1 - 3 * 0.14)


def test_note_blocks(spark):
    body = "# Head\n\nplain text\n\n- [x] done\n- [ ] open\n- item\n\n> said\n\n```\ncode\n```\n"
    got = [(r.type, r.state) for r in notes.note_blocks(spark.createDataFrame([("1", body), ("2", "")], "id string, content string")).collect()]
    assert {t for t, _ in got} >= {"heading", "paragraph", "todo", "list_item", "quote", "code_block"} and len(got) >= 7


def test_code_of_each_language(spark):
    files = [("a/x.py", "import os\nfrom a.b import c\ndef f():\n  class G: pass\n"), ("b.ts", "import {x} from './y'\nexport async function go() {}\nclass K {}"), ("C.java", "import java.util.List;\npublic final class C {}"), ("d.go", 'import "fmt"\nfunc (s *S) Run() {}\ntype S struct'), ("e.rs", "use std::io;\npub fn main() {}"), ("f.txt", "def no(): pass"), ("g.py", None)]
    nodes, edges = connectors.code_graph(spark.createDataFrame(files, "path string, content string"))
    got = {(r.source_node_id, r.target_node_id) for r in edges.collect()}
    assert got == {("a/x.py", "os"), ("a/x.py", "a.b"), ("a/x.py", "a/x.py#f"), ("a/x.py", "a/x.py#G"), ("b.ts", "./y"), ("b.ts", "b.ts#go"), ("b.ts", "b.ts#K"), ("C.java", "java.util.List"), ("C.java", "C.java#C"), ("d.go", "fmt"), ("d.go", "d.go#Run"), ("d.go", "d.go#S"), ("e.rs", "std::io"), ("e.rs", "e.rs#main")}
    assert nodes.where("node_type = 'file'").count() == len(files)


@pytest.mark.parametrize("kind", sorted(connectors.PATHS))
def test_payloads_become_events(spark, kind):
    def payload(values):
        out = {}
        for path, value in values.items():
            at, keys = out, path.removeprefix("$.").split(".")
            for k in keys[:-1]:
                at = at.setdefault(k, {})
            at[keys[-1]] = value
        return json.dumps(out)

    body, author, thread, link = connectors.PATHS[kind]
    first = body.split("|")[0]
    rows = [payload({first: " hello ", author: "ann", thread: "t1", link: "l"}), payload({author: "ann"}), "no json", None]
    got = connectors.events(spark.createDataFrame([(r,) for r in rows], "value string"), kind, "w").collect()
    assert [(r.content, r.peer_id, r.session_id, r.memory_type, json.loads(r.metadata)) for r in got] == [("hello", "ann", "t1", kind, {"source": kind, "link": "l"})]


@pytest.mark.parametrize("head", [16, 64])
def test_pairs_of_heads_equal_all_pairs(spark, head):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"{i}", " ".join(draw.sample(words, draw.randrange(1, 12)))) for i in range(90)] + [(None, "w1 w2"), ("7x", ""), ("90", "w1 " * 5)]
    tokens = {i: set(t.split()) for i, t in rows if i and t}
    score = lambda a, b: len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b])
    want = [(a, b) for a in sorted(tokens) for b in sorted(tokens) if a < b and 0.3 <= score(a, b) <= 0.6]
    frame = dreams.hashed(spark.createDataFrame(rows, "id string, content string")).repartition(5)
    for most in (1, len(want) + 5):
        found = dreams.first_pairs(frame, dreams.sharing(dreams.between(0.3, 0.6), most), most, head, 2 * head).orderBy("a_id", "b_id")
        assert [(r.a_id, r.b_id) for r in found.collect()] == want[:most]


def test_a_third_beyond_the_first_memories_counts(spark):
    rows = [("1", "river stone lamp cloud"), ("2", "lamp cloud"), ("3", "river stone"), ("4", "river stone"), ("5", "river stone"), ("6", "lamp cloud")]
    frame = spark.createDataFrame(rows, "id string, content string")
    for head in (4, 5):
        got = [tuple(r.source_ids) for r in dreams.generalisations(frame, 2, head).collect()]
        assert got == [("1", "2", "6"), ("1", "3", "4")]
    assert [tuple(r.source_ids) for r in dreams.generalisations(frame, 1, 5).collect()] == [("1", "2", "6")]


def test_dreams_compare_in_tasks(spark):
    frame = spark.createDataFrame([("1", "river stone lamp", 0.9), ("2", "river stone cloud", 0.2)], "id string, content string, confidence double")
    rows = dreams.hashed(frame).select("id", "t")
    plan = dreams.sharing(dreams.between(0.2, 0.6), 5)(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
