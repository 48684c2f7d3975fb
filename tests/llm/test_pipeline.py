import brute
import pytest
from conftest import changed, prose

import corpus_pipeline

ITEM = prose(4321, 24)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, prose(i, 90)) for i in range(60)]
    rude = [(100 + i, prose(500 + i, 40) + " you idiot, loser, scum and moron") for i in range(20)]
    docs += rude + [(200, docs[3][1]), (201, changed(docs[4][1], 30, "~")), (202, "before " + ITEM + " after " + prose(9, 12)), (203, None), (204, ""), (205, ITEM)]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, {i for i, _ in rude}


def test_stages_match_brute_force(spark, tables):
    path, docs, rude = tables
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    kept = [(i, t) for i, t in docs if i not in rude]
    lines = brute.line_dedup(kept)
    prints = brute.simhash(list(lines.items()))
    lines = {i: t for i, t in lines.items() if prints[i][1] == i}
    lines = {i: t for i, t in lines.items() if not brute.contaminated(t, ITEM)}
    assert {i: r.text for i, r in got.items()} == lines
    sizes = {i: len(brute.WORD.findall(t or "")) for i, t in lines.items()}
    totals = {}
    for i, n in sizes.items():
        source = ("a", "b", None)[i % 3]
        totals[source] = totals.get(source, 0) + n
    want = brute.targets(totals)
    taken = dict.fromkeys(totals, 0)
    for i, r in got.items():
        assert r.size == sizes[i] and r.taken <= 3 * r.size and r.target == pytest.approx(want[r.source]) and len(r.shards) * r.size == r.taken
        taken[r.source] += r.taken
    assert all(0 <= want[s] - taken[s] < 100 for s in totals)


def test_stage_columns_and_empty_input(spark, tables):
    path = tables[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
