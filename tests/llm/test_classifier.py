import zlib

import numpy as np
import pytest
from conftest import prose

from quillion.llm import classifier


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def auc(scores, labels) -> float:
    rank = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    labels = np.array(labels)
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


@pytest.mark.parametrize(("sf", "least_auc", "least_right"), [("sf0.01", 0.97, 0.95), ("sf0.1", 0.99, 0.98)])
def test_driver_tables_held_out(spark, sf, least_auc, least_right):
    path = f"/root/testdata/{sf}"
    rows = classifier.classify_query(spark, path).collect()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    mine = [r for r in rows if r.held_out and r.doc_id in known]
    labels = [known[r.doc_id] for r in mine]
    assert auc([r.score for r in mine], labels) >= least_auc
    for label in (0, 1):
        assert np.mean([r.predicted == label for r, x in zip(mine, labels, strict=True) if x == label]) >= least_right


def table(spark, n=600):
    junk = lambda i: " ".join(w.upper() + "!!" for w in prose(i, 40).split())
    docs = [(i, junk(i) if i % 5 == 0 else prose(i, 60)) for i in range(n)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, n, 2)]
    return docs, spark.createDataFrame([(*d, "x", 0.0) for d in docs], "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_moments_prior_and_risk_match_plain_versions(spark):
    docs, df, labels = table(spark)
    rows = classifier.featurise(df, "text")
    good = {r.doc_id for r in classifier.trusted(labels, 1000).collect()}
    assert good == {i for i in range(0, 600, 2) if i % 5 and not held(i)}
    model = classifier.train(rows, labels, 1000, None)
    assert abs(model.prior - 0.8) < 0.05
    x = {i: classifier.features(t).astype(float) for i, t in docs}
    u = np.array([x[i] for i, _ in docs if not held(i)])
    p = np.array([x[i] for i in sorted(good)])
    ridge = 1e-3 + 1 / len(p)

    def risk(w):
        parts = model.prior * np.mean((1 - p @ w) ** 2), np.mean((1 + u @ w) ** 2) - model.prior * np.mean((1 + p @ w) ** 2)
        return parts[0] + max(0.0, parts[1]) + ridge * (w[:-1] @ w[:-1]), parts[1]

    best, negative = risk(model.weights)
    assert negative >= -1e-6
    draw = np.random.default_rng(3)
    for size in (1e-3, 1e-2, 0.1, 1):  # no other weights have a smaller risk
        assert all(risk(model.weights + size * draw.normal(size=classifier.SIZE) / classifier.SIZE)[0] >= best - 1e-6 for _ in range(50))
    got = {r.doc_id: r.score for r in classifier.classify(df, labels, most_positives=1000).collect()}
    assert all(abs(got[i] - model.scores(x[i][None])[0]) < 1e-6 for i, _ in docs)


def test_labels_of_held_out_rows_and_negatives_do_not_matter(spark):
    _, df, labels = table(spark)
    other = labels.collect()
    changed = spark.createDataFrame([(r.doc_id, 1 - r.quality if held(r.doc_id) else r.quality, 1) for r in other if held(r.doc_id) or r.quality], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in classifier.classify(df, x).collect()} for x in (labels, changed))
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_scoring_another_table(spark):
    docs, df, labels = table(spark)
    model = classifier.model_of(df, labels)
    kept = classifier.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id % 5 == 0 for r in kept.collect()} == {False} and kept.count() == 480


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word\n" * 400_000), (4, "漢" * 50)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in classifier.classify(docs, none).collect()} == {(0.5, 1)}
    odd = spark.createDataFrame([(2, 1, 0), (4, 1, 0), (4, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = classifier.classify(docs, odd).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert classifier.classify(docs.limit(0), odd).count() == 0
    parts = np.frombuffer(b"ab " * 700_000, np.uint8)
    assert classifier.pair_counts(parts, classifier.PAIR_BUCKET, classifier.PAIR_BUCKETS).sum() == len(parts) - 1
