import random
import time
import tracemalloc

import brute
from conftest import changed, prose

from quillion.llm import decontaminate

PASSAGES = [(1, prose(101, 20)), (2, prose(102, 35)), (3, "tiny"), (4, "Σίσυφος rolls the stone up the hill again and again"), (5, None), (6, ""), (7, "short query"), (8, "a bit longer, of 22 ch"), (9, "this one is 31 characters long."), (10, "ab" * 40), (11, "zz " * 30)]


def texts():
    draw = random.Random(3)
    rows = [(0, None), (1, ""), (2, "tin y"), (3, "a tiny thing")]
    for k in range(24):
        item = PASSAGES[(0, 1, 3)[k % 3]][1]
        body = prose(k, 25)
        for _ in range(k // 2):
            at = draw.randrange(len(item))
            item = draw.choice([changed(item, at, "#"), item[:at] + item[at + 1 :], item[:at] + "~" + item[at:]])
        rows.append((10 + k, body[:60] + " " + item.upper().lower() + " " + body[60:]))
    for k, (_, item) in enumerate(PASSAGES[6:11]):
        for n in range(4):
            for _ in range(n):
                at = draw.randrange(len(item))
                item = draw.choice([changed(item, at, "#"), item[:at] + item[at + 1 :], item[:at] + "~" + item[at:]])
            rows.append((50 + 4 * k + n, prose(k, 12) + item + prose(n, 9)))
    return rows + [(90 + k, prose(200 + k, 60)) for k in range(4)]


def test_matches_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(PASSAGES, "item_id long, text string")
    want = {(i, k) for i, t in rows for k, p in PASSAGES if brute.contaminated(t, p)}
    got = decontaminate.contamination(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    by_id = dict(rows)
    for r in got:
        part = brute.plain(by_id[r.doc_id])[r.start : r.end]
        assert brute.best_edits(part, brute.plain(dict(PASSAGES)[r.item_id].strip())) == r.distance
    kept = {r.doc_id for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    small = decontaminate.contamination(docs, benchmark, block_chars=60)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == want


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(texts(), "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame(PASSAGES, "item_id long, text string")).count() == 0


def test_repetitive_texts_take_bounded_memory():
    """A gram repeated on both sides: 60,000 places times 1,000, and a long text with one copy."""
    block = decontaminate.Block([(1, "a " * 1000), (2, prose(5, 300))])
    long = prose(77, 40_000)
    tracemalloc.start()
    began = time.monotonic()
    found = block.hits(["a " * 60_000, long + prose(5, 300) + "b " * 50_000, "a " * 900 + "c" + "a " * 90])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {h[0] for h in found[0]} == {1} and {h[0] for h in found[1]} == {2} and {h[0] for h in found[2]} == {1}
    assert found[1][0][1:] == (len(long), len(long) + len(prose(5, 300)), 0)
    assert peak < 1 << 29 and time.monotonic() - began < 120
