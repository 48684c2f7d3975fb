import re
from itertools import permutations

from conftest import prose

from quillion.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """Each order applied to each part's documents, filter by filter."""
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}

    def failed(i, text):
        text, words = text or "", WORD.findall(text or "")
        found = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > firsts[text],
        }
        return {x for x, bad in found.items() if bad}

    parts = {}
    for i, text, source in docs:
        parts.setdefault(source or "", []).append((i, failed(i, text)))
    out = {}
    for part, rows in parts.items():
        removals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone, stay = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                all_failing = [r for r in rows if x in r[1]]
                ids = [i for i, _ in gone]
                out[part, "".join(order), step] = [len(stay), len(gone), len(all_failing) - len(gone), sum(f == {x} for _, f in rows), sum(i in good for i in ids if i is not None), sum(i in toxic for i in ids if i is not None)]
                removals[x] += len(gone)
                left = stay
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(removals[x])
    return out


def test_matches_plain_version(spark, corpus):
    sources = ["hot", "hot", None, "", "b"]
    docs = [(i, t, sources[i % 5]) for i, t in corpus]
    docs += [(60 + i, prose(3, 260), "hot") for i in range(40)] + [(7, corpus[7][1], "b"), (None, prose(3, 260), "b"), (None, None, None), (None, None, None), (90, "a\x1fb c d " * 150, "b")]
    docs += [(91, "WORD " * 30 + prose(5, 300), "hot"), (92, "same " * 300, "hot"), (93, "#" + prose(8, 220), "b")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 95, 3)] + [(None, 1, 1), (6, None, 1), (6, 1, None)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, mask int")
    got = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain(docs, labels)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want
    assert len(got) == len(want) == 3 * 600
    assert any(r.redundant for r in got) and any(r.toxic_lost for r in got)


def test_removals_of_an_order_and_the_kept_are_all(spark, corpus):
    rows = audit.audit(spark.createDataFrame([(i, t, "s") for i, t in corpus], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    for order in {r.filter_order for r in rows}:
        steps = sorted((r for r in rows if r.filter_order == order), key=lambda r: r.step)
        assert sum(r.removed for r in steps) + steps[-1].kept == len(corpus)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
