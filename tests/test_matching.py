"""Matching blocks, combined similarity, signatures and distances against plain versions."""

import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillion.functions import text
from quillion.operators import graph, matching
from quillion.plans import recipes


def words(seed, n, alphabet="abcdé "):
    draw = random.Random(seed)
    return "".join(draw.choice(alphabet) for _ in range(n))


def test_ratio_is_that_of_difflib():
    for seed in range(400):
        draw = random.Random(seed)
        a, b = words(seed, draw.randrange(0, 30), "ab" if seed % 3 else "abcdefgh "), words(seed + 1000, draw.randrange(0, 30), "ab" if seed % 3 else "abcdefgh ")
        matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert matching.block_ratio(a, b) == pytest.approx(matcher.ratio()), (a, b)
        if a and b:
            m = matcher.find_longest_match(0, len(a), 0, len(b))
            found = matching.Automaton(a).longest_block(b)
            assert found == (m.size, m.a if m.size else 0, m.b if m.size else 0), (a, b)


def test_fuzzy_get_looks_at_every_row(spark):
    rows = [(f"m{i:03d}", words(i, 5 + i % 40)) for i in range(300)] + [("null", None), ("empty", "")]
    df = spark.createDataFrame(rows, "id string, content string")
    name = rows[250][1][:-1] + "X"
    want = sorted(((difflib.SequenceMatcher(None, name.lower(), t.lower(), autojunk=False).ratio(), i) for i, t in rows if t), key=lambda x: (-x[0], x[1]))
    got = matching.fuzzy_get(df, name, k=5).collect()
    assert [r.id for r in got] == [i for s, i in want if s >= 0.5][:5] and got[0].score == pytest.approx(want[0][0])
    assert matching.fuzzy_get(df, "", k=1).count() == 0


def test_combined_pairs_match_all_pairs(spark):
    draw = random.Random(4)
    vocabulary = "river stone lamp winter garden paper window silver".split()
    rows = []
    for i in range(80):
        base = [draw.choice(vocabulary) for _ in range(6)] if i % 4 == 0 else (rows[-1][1].split()[::-1] if i % 4 == 1 else rows[-1][1].split()[:-1] + [draw.choice(vocabulary)])
        rows.append((f"m{i:02d}", " ".join(base)))
    rows += [("copy", f"  {rows[4][1].upper()}  "), ("null", None), ("blank", "  ")]

    def like(a, b):
        x, y = set(a.split()), set(b.split())
        return 0.4 * len(x & y) / len(x | y) + 0.6 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()

    normal = {i: " ".join(t.lower().split()) for i, t in rows if t and t.strip()}
    first = {}
    for i in sorted(normal):
        first.setdefault(normal[i], i)
    reps = sorted(first.values())
    want = {(a, b): like(normal[a], normal[b]) for k, a in enumerate(reps) for b in reps[k + 1 :]}
    want = {p: v for p, v in want.items() if v >= 0.75} | {(first[t], i): 1.0 for i, t in normal.items() if first[t] != i}
    got = matching.combined_pairs(spark.createDataFrame(rows, "id string, content string")).collect()
    assert len(got) == len(want) and {(r.a, r.b): pytest.approx(r.similarity) for r in got} == want and len(want) > 20


def plain_signature(text, hashes=128, n=3):
    text = text.lower().strip()
    if not text:
        return [0] * hashes
    text = text.ljust(n)
    number = lambda b: int.from_bytes(hashlib.sha256(b).digest()[:8], "little")
    grams = {number(text[i : i + n].encode()) for i in range(len(text) - n + 1)}
    return [min(g ^ number(f"minhash_perm_{k}".encode()) for g in grams) for k in range(hashes)]


def grams(text):
    text = text.lower().strip().ljust(3)
    return {text[i : i + 3] for i in range(len(text) - 2)}


def test_signatures_estimates_and_bands(spark):
    draw = random.Random(6)
    names = [words(i, 30 + i % 30, "abcdefghijklmnop ") for i in range(60)]
    for i in range(60):
        chars = list(names[i])
        for _ in range(1 + i % 2):
            chars[draw.randrange(len(chars))] = draw.choice("xyz")
        names.append("".join(chars))
    rows = [(f"e{i:03d}", t) for i, t in enumerate([*names, "é", "", "ab", names[3], "  " + names[3].upper()])]
    df = spark.createDataFrame(rows, "id string, name string")
    got = {r.id: [x % (1 << 64) for x in r.s] for r in df.select("id", matching.signature(F.col("name")).alias("s")).collect()}
    assert got == {i: plain_signature(t) for i, t in rows}
    jaccard = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    text = dict(rows)
    pairs = [(f"e{i:03d}", f"e{i + 60:03d}") for i in range(60)]
    signed = lambda i: [x - (1 << 64) if x >= 1 << 63 else x for x in plain_signature(text[i])]
    frame = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a array<long>, b array<long>")
    estimates = [r.x for r in frame.select(matching.signature_likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    assert sum(abs(e - jaccard(text[a], text[b])) for e, (a, b) in zip(estimates, pairs, strict=True)) / 60 < 0.06
    reps = [r for r in rows[:122]]
    want = {(a, b) for k, (a, s) in enumerate(reps) for b, t in reps[k + 1 :] if s.strip() and t.strip() and jaccard(s, t) >= 0.8}
    found = matching.banded_pairs(df, 0.8).collect()
    pairs = {(r.a, r.b) for r in found}
    assert len(want & pairs) >= 0.9 * len(want) and all(r.likeness == 1 or (r.a, r.b) in want for r in found if r.b < "e122") and len(want) > 30
    assert {("e003", "e123"), ("e003", "e124")} <= pairs
    split = {(r.a, r.b) for r in matching.banded_pairs(df, 0.8, most_bucket=1).collect()}
    assert split <= pairs


def test_distances_from_several_nodes(spark):
    draw = random.Random(5)
    edges = [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(70)] + [("hub", f"n{i}") for i in range(40)] + [("n1", "n1")]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "source_node_id string, target_node_id string, weight double")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in ("n1", "n50", "alone"):
        front, depth = {s}, {s: 0}
        for d in (1, 2, 3):
            front = {y for x in front for y in near.get(x, ())} - depth.keys()
            depth |= dict.fromkeys(front, d)
        want |= {(s, n): d for n, d in depth.items()}
    sources = spark.createDataFrame([("n1",), ("n50",), ("alone",), (None,), ("n1",)], "id string")
    for hub in (3, 10_000):
        got = graph.distances(df, sources, 3, hub).collect()
        assert len(got) == len(want) and {(r.source, r.id): r.depth for r in got} == want
    hits = spark.createDataFrame([("n1", 0.1), ("hub", 0.2), ("nowhere", 0.9), ("alone", 0.3)], "id string, score double")
    got = {r.id: r.score for r in recipes.node_distance_reranker(df, sources)(hits).collect()}
    least = lambda n: min((d for (_, x), d in want.items() if x == n), default=5)
    assert got == {n: pytest.approx(max(0, 1 - least(n) / 5)) for n in ("n1", "hub", "nowhere", "alone")}
    blended = recipes.fusion_reranker([(recipes.node_distance_reranker(df, sources), 1.0), (lambda rows: rows, 0.5)])(hits).collect()
    assert {r.id for r in blended} == {"n1", "hub", "nowhere", "alone"} and max(blended, key=lambda r: r.score).id in ("n1", "alone")


def test_gram_likeness_is_the_expressions(spark):
    texts = ["", "a", "ab", "abc", "customer#000000123", "customer#000000124", "naïve 🙂 text", "aaaaaaa"]
    frame = spark.createDataFrame([(a, b) for a in texts for b in texts if a and b], "a string, b string")
    padded = lambda c: text.shingles(F.rpad(c, F.greatest(F.length(c), F.lit(3)), F.lit(" ")))
    rows = frame.select(matching.gram_likeness(F.col("a"), F.col("b")).alias("got"), text.jaccard(padded("a"), padded("b")).alias("want")).collect()
    assert all(abs(r.got - r.want) < 1e-12 for r in rows) and len(rows) == 49


def test_banded_pairs_send_no_side_through_the_driver(spark):
    rows = spark.createDataFrame([(f"n{i:02d}", f"name of the {i % 9}th thing") for i in range(40)], "id string, name string")
    found = matching.banded_pairs(rows, 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") >= 4
    assert {(r.a, r.b) for r in found.where("likeness = 1").collect()} >= {(f"n{i % 9:02d}", f"n{i:02d}") for i in range(9, 40)}
