import brute
import numpy as np
import pytest

from quillion.llm import simhash


def test_matches_brute_force(spark, corpus):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in corpus], "doc_id long, text string, id int, fingerprint string")
    want = brute.simhash(corpus)
    got = {r.id: (r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_forest_links_what_all_pairs_link():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (40, 5), dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ np.bitwise_xor.reduce(flips[:, :k], axis=1) for k in range(1, 6)]))
    ids = values.tolist()
    want = brute.components(ids, lambda a, b: (a ^ b).bit_count() <= 4)
    nodes, roots = simhash.forest(values, None, 4)
    edges = set(zip(nodes.tolist(), roots.tolist(), strict=True))
    got = brute.components(ids, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == want


@pytest.mark.parametrize("tile", [3, 1000])
def test_tiles_lose_no_link(spark, corpus, tile):
    values = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in {brute.fingerprint(t) for _, t in corpus}], "fingerprint long")
    edges = {(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(values, 4, tile).collect()}
    prints = sorted({brute.fingerprint(t) for _, t in corpus})
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)
    want = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert brute.components(prints, lambda a, b: (a, b) in edges or (b, a) in edges) == want


def test_empty_repeated_and_null_rows(spark):
    schema = "doc_id long, text string, _kept_id int"
    assert simhash.deduplicate(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e", 7), (1, "a b c d e", 7), (2, "a b c d e", 8), (None, "a b c d e", 9), (None, "q r s t u v", 9)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "_kept_id"]
    assert [tuple(r) for r in kept.where("doc_id is not null").collect()] == [(1, "a b c d e", 7)] * 2
    # Of equal texts one with an id stays; texts that no row with an id has stay without one.
    null = [tuple(r) for r in kept.where("doc_id is null").collect()]
    assert null == [(None, "q r s t u v", 9)]
