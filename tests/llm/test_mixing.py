import math
from collections import Counter

import brute
import pytest

from quillion.llm import mixing

SCHEMA = "doc_id long, source string, text string, size int"


def rows():
    out = [(i, ("hot", "hot", "hot", "b", "c", None)[i % 6], "w " * (1 + i % 17), 5) for i in range(400)]
    return out + [(1000, "rare", "a b c", 5), (1001, "empty", "", 5), (1002, "empty", None, 5), (1003, "hot", "y " * 5000, 5)]


@pytest.mark.parametrize("options", [{}, {"shard_words": 500, "block_words": 64, "bucket_rows": 50}, {"shard_words": 300, "block_words": 32, "narrow_blocks": 0}])
def test_targets_and_bounds(spark, options):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mix(docs, **options).collect()
    again = mixing.mix(docs.repartition(3), **options).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {i: len(brute.WORD.findall(t or "")) for i, _, t, _ in rows()}
    totals = Counter()
    for i, s, _, _ in rows():
        totals[s] += size[i]
    want = brute.targets(totals)
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], totals[r.source])
        assert r.target == pytest.approx(want[r.source])
        assert len(r.copies) <= 3 and len({c.epoch for c in r.copies}) == len(r.copies)
        taken[r.source] += r.size * len(r.copies)
    assert len(got) == len(size)
    for s in totals:
        assert taken[s] <= want[s] + 1e-6
        assert want[s] - taken[s] < 17 + 1e-6 or s == "hot" and want[s] - taken[s] < 5000


def test_tree_deals_each_block_once(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 37), (None, 5)], "source string, blocks long")
    assert mixing.split_quotas(quotas.limit(0), 5, 1).count() == 0
    for fan in (16, 2):
        check_tree(quotas, mixing.split_quotas(quotas, 5, 1, fan).collect())


def test_splits_follow_the_distribution_whatever_their_size(spark):
    """Shares of sources stay within six deviations of a draw without replacement; test_hypergeometric has the distribution itself."""
    for factor in (1, 100_000):
        sizes = {"a": 90 * factor, "b": 30 * factor, "c": 8 * factor}
        quotas = spark.createDataFrame(list(sizes.items()), "source string, blocks long")
        total, shards = sum(sizes.values()), 4
        for seed in range(2):
            got = mixing.split_quotas(quotas, shards, seed).collect()
            for shard in range(shards):
                n = {r.source: r.last - r.first for r in got if r.shard == shard}
                assert sum(n.values()) == total // shards
                for s, size in sizes.items():
                    p = size / total
                    assert abs(n.get(s, 0) - total / shards * p) < 6 * math.sqrt(total / shards * p * (1 - p) * (1 - 1 / shards) * total / (total - 1))


def check_tree(quotas, got):
    for source, blocks in (("a", 100), ("b", 37), (None, 5)):
        ranges = sorted((r.first, r.last) for r in got if r.source == source)
        assert ranges[0][0] == 0 and ranges[-1][1] == blocks and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    each = Counter()
    for r in got:
        each[r.shard] += r.last - r.first
    assert sum(each.values()) == 142 and max(each.values()) - min(each.values()) <= 1 + len(each)
    blocks = mixing.dealt_blocks(quotas, quotas.sparkSession.createDataFrame(got), 1).collect()
    assert Counter((r.source, r.block) for r in blocks) == Counter((s, b) for s, n in (("a", 100), ("b", 37), (None, 5)) for b in range(n))
    assert Counter(r.shard for r in blocks) == each


def test_shards_and_empty(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    mixed = mixing.mix(docs, shard_words=500, block_words=64)
    copies = sum(len(r.copies) for r in mixed.collect())
    assert mixing.shards(docs, mixed).count() == copies
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 50}])
def test_no_unused_document_fits_the_gap(spark, options):
    """A very long document across the cut doesn't end a source; repeated ids and exact fits included."""
    rows = [(i, "long", "w " * 10) for i in range(2000)] + [(5000 + i, "long", "w " * 20000) for i in range(2)]
    rows += [(10000 + i, "odd", "x " * (1 + i * i % 977)) for i in range(300)] + [(10000, "odd", "x " * 3)] * 4 + [(20000, "huge", "y " * 90000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), **options).collect()
    assert len(got) == len(rows)
    for s in ("long", "odd", "huge"):
        of = [r for r in got if r.source == s]
        gap = of[0].target - sum(r.size * len(r.copies) for r in of)
        assert gap >= -1e-6
        assert all(r.size > gap for r in of if r.size and len(r.copies) < 3)
        assert all(sorted(c.epoch for c in r.copies) == list(range(len(r.copies))) for r in of)


def test_both_ways_to_the_blocks_agree(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    one, other = ([str(r) for r in mixing.mix(docs, shard_words=500, block_words=64, narrow_blocks=n).sort("doc_id").collect()] for n in (1 << 16, 0))
    assert one == other


def test_repeated_ids_get_copies_by_rule(spark):
    """Rows of one id with different sources and texts; reruns in another layout agree, and nothing is lost."""
    rows = [(1, "a", "x " * 9, 1, 2), (1, "a", "y " * 4, 1, 2), (1, "b", "z " * 5, 1, 2), (None, None, None, 1, 2), (2, "b", "w " * 30, 1, 2), (2, "b", "w " * 30, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, _id int")
    first = sorted(map(str, mixing.mixed_documents(docs, mixing.mix(docs)).collect()))
    again = sorted(map(str, mixing.mixed_documents(docs.repartition(4), mixing.mix(docs.repartition(2))).collect()))
    assert first == again and len(first) == len(rows)
    got = mixing.mixed_documents(docs, mixing.mix(docs))
    assert got.columns == ["doc_id", "source", "text", "_id", "size", "source_size", "target", "taken", "shards", "places"]
    assert all(len(r.shards) == len(r.places) and len(set(r.places)) == len(r.places) for r in got.collect())
