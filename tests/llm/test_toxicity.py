import random

from conftest import prose
from pyspark.sql import functions as F

from quillion.llm import toxicity

RUDE = "idiot loser scum moron trash".split()


def rows():
    draw = random.Random(1)
    out = []
    for i in range(400):
        words = prose(i, 40).split(" ")
        if i % 4 == 0:
            for _ in range(1 + i % 3):
                words.insert(draw.randrange(len(words)), draw.choice(RUDE))
        out.append((i, " ".join(words)))
    return out


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame([(*r, "z", 0) for r in rows()], "doc_id long, text string, _scored string, toxic int")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    right = sum(got[i].toxic == (i % 4 == 0) for i in range(200, 400))
    assert right >= 196
    assert all(0 <= r.severity <= 3 for r in got.values())
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.toxic for r in kept.collect()} == {0}
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_driver_tables_held_out(spark):
    """Labels of half the documents predict the others'."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    others = labels.where("doc_id % 4 >= 2").select("doc_id", (F.col("toxic") == 1).alias("label"))
    scored = toxicity.toxicity(docs, labels.where("doc_id % 4 < 2")).join(others, "doc_id").select("toxic", "label").collect()
    toxic, clean = [r.toxic for r in scored if r.label], [r.toxic for r in scored if not r.label]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "word " * 20_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.severity for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    one_class = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, one_class).count() == 4
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
