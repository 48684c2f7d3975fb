"""The persisted full-text index against full scans."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillion.operators import search
from quillion.operators.textindex import TextIndex, staged_blocks

WORDS = "river stone lamp winter garden paper window silver music bread travel engine harbour quiet orange letter market forest cloud bridge".split()


def rows(n=700):
    draw = random.Random(3)
    out = []
    for i in range(n):
        words = [draw.choice(WORDS[: 4 + i % 17]) for _ in range(draw.randrange(0, 40))]
        if i % 50 == 0:
            words += ["comet"] * (1 + i // 100)
        out.append((f"d{i:04d}", " ".join(words)))
    return out + [("null", None), ("empty", ""), ("stops", "the and of"), ("long", "comet " + "river stone " * 20_000)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(), "id string, content string").repartition(5, "id")
    return df, TextIndex.build(df, str(tmp_path_factory.mktemp("index") / "ix"), buckets=8, span=16, files=6)


def close(got, want):
    assert [r.id for r in got] == [r.id for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want])


@pytest.mark.parametrize("terms", [["comet"], ["comet", "river"], ["bridge", "stone", "comet"], ["river", "river"], ["nowhere"], ["nowhere", "cloud"], []])
@pytest.mark.parametrize("k", [1, 10, 2000])
def test_search_equals_a_full_scan(index, terms, k):
    df, ix = index
    want = search.top(search.bm25(df, terms), k).collect() if terms else []
    for first in (1, 4, 64):
        close(ix.search(terms, k, first).collect(), want)


def test_terms_equal_the_scan(index):
    df, ix = index
    want = search.postings(df).groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))
    assert sorted(ix.terms().select("term", "n", "df").collect()) == sorted(want.select("term", "n", "df").collect())


def read(df):
    """(rows out of the scans of blocks, folders that the scans list) of an executed plan."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Scan parquet" in name:
            found.append((node.metrics().apply("numOutputRows").value(), node.metrics().apply("numFiles").value(), node.metrics().apply("numPartitions").value() if node.metrics().contains("numPartitions") else None))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return found


def test_a_query_reads_its_terms_blocks_only(index):
    _, ix = index
    everything = ix.blocks()
    ((all_rows, all_files, _),) = read(everything)
    ((few_rows, few_files, folders),) = read(ix.blocks(["comet"]))
    assert folders == 1 and few_files < all_files / 2 and few_rows < all_rows / 4
    plan = ix.bounds(["comet"])._jdf.queryExecution().toString()
    assert "places" not in plan.split("ReadSchema")[1].split("\n")[0] and "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_bounds_hold_and_prune(index):
    _, ix = index
    n, mean = ix.statistics()
    scored = {(r.segment, r.doc // 16): r.score for r in ix.scored(["comet"], {"comet": 1.0}, mean).orderBy("score").collect()}
    for b in ix.bounds(["comet"]).collect():
        tf, length = b.most_tf, b.least_length
        assert tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / max(mean, 1.0))) >= scored[b.segment, b.range] - 1e-9
    assert n == sum(1 for _, t in rows() if t and set(t.split()) - {"the", "and", "of"})


def test_phrases(index, spark):
    _, ix = index
    want = {}
    for i, t in rows():
        w = (t or "").split()
        n = sum(w[j : j + 2] == ["river", "stone"] for j in range(len(w)))
        if n:
            want[i] = n
    assert {r.id: r.n for r in ix.phrase(["river", "stone"]).collect()} == want
    assert ix.phrase(["stone", "nowhere"]).count() == 0 and ix.phrase([]).count() == 0


def test_segments_deletes_and_merge(spark, tmp_path):
    all_rows = rows(200)
    frame = lambda some: spark.createDataFrame(some, "id string, content string")
    ix = TextIndex.build(frame(all_rows[:120]), str(tmp_path / "a"), buckets=4, span=16, files=2)
    ix.add(frame(all_rows[120:]), files=2)
    close(ix.search(["comet", "river"], 20, 2).collect(), search.top(search.bm25(frame(all_rows), ["comet", "river"]), 20).collect())
    gone = {i for i, _ in all_rows[::7]}
    ix.delete(frame([(i, "") for i in sorted(gone)]))
    assert not gone & {r.id for r in ix.search(["river"], 1000, 2).collect()}
    left = frame([r for r in all_rows if r[0] not in gone])
    close(ix.merged(str(tmp_path / "b"), files=2).search(["comet", "river"], 20, 2).collect(), search.top(search.bm25(left, ["comet", "river"]), 20).collect())


def test_empty_table(spark, tmp_path):
    ix = TextIndex.build(spark.createDataFrame([], "id string, content string"), str(tmp_path / "e"), files=1)
    assert ix.search(["river"], 5).count() == 0 and ix.terms().count() == 0


def test_blocks_are_made_in_tasks(spark, tmp_path):
    draw = random.Random(4)
    texts = [" ".join(draw.choice([*WORDS, "the", "x", "Ärger"]) for _ in range(draw.randrange(0, 60))) for _ in range(90)]
    lists = [t.lower().split() for t in texts]
    docs = [*range(40), *range(8, 58)]  # two partitions' numbers: the second one's begin at 2^33
    docs = [d if i < 40 else d + (1 << 33) for i, d in enumerate(docs)]
    stop = ["the"]
    batches = [pa.RecordBatch.from_arrays([pa.array(docs[i:j], pa.int64()), pa.array([f"d{x}" for x in range(i, j)], pa.string()), pa.array(lists[i:j], pa.list_(pa.string()))], ["doc", "id", "parts"]) for i, j in ((0, 3), (3, 40), (40, 40), (40, 90))]
    want = {(t, d): [p for p, w in enumerate(words) if w == t] for d, words in zip(docs, lists, strict=True) for t in set(words) if len(t.encode()) >= 2 and t not in stop}
    for most in (1, 100, 2_000_000):
        got, lengths, blocks = {}, {}, 0
        for row in (r for b in staged_blocks(iter(batches), stop, 16, most) for r in b.to_pylist()):
            if row["term"] is None:
                lengths |= {row["range"] * 16 + d: (i, n) for d, i, n in zip(row["docs"], row["ids"], row["lengths"], strict=True)}
                continue
            blocks += 1
            assert row["n"] == len(row["docs"]) and row["most_tf"] == max(row["tfs"]) and row["least_length"] == min(row["lengths"])
            for d, tf, gaps in zip(row["docs"], row["tfs"], row["places"], strict=True):
                got[row["term"], row["range"] * 16 + d] = list(itertools.accumulate(gaps))
                assert tf == len(gaps)
        assert got == want
        assert lengths == {d: (f"d{i}", sum(len(w.encode()) >= 2 and w not in stop for w in words)) for i, (d, words) in enumerate(zip(docs, lists, strict=True))}
        assert most < 2_000_000 or blocks == len({(t, d // 16) for t, d in want})


def test_a_build_shuffles_blocks_only(spark, tmp_path):
    frame = spark.createDataFrame([(str(i), "river stone " * 2000) for i in range(40)], "id string, content string").repartition(4)
    ix = TextIndex.build(frame, str(tmp_path / "s"), files=2)
    staged = spark.read.parquet(f"{ix.path}/staged/*")
    assert staged.where("term is not null").count() == ix.blocks().count() == 8 and "text" not in staged.columns  # not a row an occurrence
    assert ix.terms().where("n = 80000").count() == 2


def test_ranges_in_parts_give_the_same_hits(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows(200), "id string, content string").repartition(3, "id")
    monkeypatch.setattr(TextIndex, "part", 50)
    ix = TextIndex.build(df, str(tmp_path / "p"), buckets=4, span=64, files=2)
    assert ix.blocks(["river"]).count() > ix.blocks(["river"]).select("range").distinct().count()
    for first in (1, 64):
        close(ix.search(["comet", "river"], 20, first).collect(), search.top(search.bm25(df, ["comet", "river"]), 20).collect())
