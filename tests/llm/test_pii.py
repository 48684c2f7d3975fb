import hashlib
import math
import re
import time

import brute

from quillion.llm import pii

TEXTS = [
    (1, "mail a.b@c.example.org, 10.0.0.1 and 999.1.1.1 or 1.2.3.4.5.6.7.8"), (2, "card 4111 1111 1111 1111 or 4111-1111-1111-1112; +44 (20) 7946-0958 or +1 2"),
    (3, None), (4, ""), (5, "x" * 30_000 + "@y.zz"), (6, "1" * 30_000), (7, "漢字 𝒳 me@x.io 𝒳"), (8, "a@b.c@d.e"), (9, "+123456789012345678"), (10, "5500005555555559 1"),
    (11, "@@a@b..c a@-.- +1() .5"),
]


def result(spark, rows, **options):
    return {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}


def test_base_spans_match_brute_force(spark):
    got = result(spark, TEXTS)
    assert {i: [s for s in spans if s[0] != "term"] for i, spans in got.items()} == {i: brute.base_spans(t) for i, t in TEXTS}


def test_driver_table_digests(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r.base_sha256 for r in pii.pii_query(spark, sf).collect()}
    assert got == {r.doc_id: hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute.base_spans(r.text)).encode()).hexdigest() for r in rows}


def test_disclosing_terms_match_brute_force(spark):
    docs = [(i, f"plain words number {'abcdefgh'[i % 8]} ask at nothing much") for i in range(60)]
    docs += [(100 + i, f"ask {x} Zarathustra at zara@mail.example {x} today") for i, x in enumerate(["kindly", "please", "quickly"])]
    docs += [(200, "Zarathustra alone, without a sign")]
    got = result(spark, docs)
    window, n = 5, len(docs)
    contexts = {}
    for i, t in docs:
        for kind, s, e in brute.base_spans(t):
            words = t[:s].split()[-window:] + t[e:].split()[:window]
            contexts.setdefault((kind, t[s:e].lower()), set()).add(tuple(sorted(set(re.findall(r"[^\W\d_]+", " ".join(words).lower())))))
    holds = lambda term: sum(term in re.findall(r"[^\W\d_]+", t.lower()) for _, t in docs)
    told = {}
    for entity, seen in contexts.items():
        for term in {x for c in seen for x in c}:
            n_te = sum(term in c for c in seen)
            if len(seen) >= 2 and n_te >= 2 and math.log2(n_te / len(seen) / (holds(term) / n)) >= 0.8 * math.log2(n / len(seen)):
                told.setdefault(entity, set()).add(term)
    assert told == {("email", "zara@mail.example"): {"zarathustra", "today"}}
    terms = {x for found in told.values() for x in found}
    for i, t in docs:
        want = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in terms]
        assert [s for s in got[i] if s[0] == "term"] == want
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert clean[100] == "ask kindly [TERM] at [EMAIL] kindly [TERM]" and clean[200] == "[TERM] alone, without a sign" and clean[0] == docs[0][1]


def test_odd_tables(spark):
    assert result(spark, []) == {}
    docs = spark.createDataFrame([(None, "a@b.cc", 1, 2), (None, "a@b.cc", 1, 2)], "doc_id long, text string, spans int, _id int")
    assert [len(r.spans) for r in pii.personal_data(docs).collect()] == [1, 1]


def test_very_long_texts_with_many_matches(spark):
    """Spans, contexts and sanitising of texts with tens of thousands of matches take linear time."""
    many = " ".join(f"u{i}@host{i % 7}.example then 10.0.{i % 256}.{i % 99}" for i in range(4_000))
    wide = "Zarathustra" + " " * 100_000 + "zara@mail.example" + "\t" * 5_000 + "today"
    docs = [(1, many), (2, wide), (3, wide + " else"), (4, "x " * 300_000), *[(10 + i, f"plain {i}") for i in range(40)]]
    began = time.monotonic()
    got = result(spark, docs)
    base = lambda t: [s for s in t if s[0] != "term"]
    assert {i: base(s) for i, s in got.items()} == {i: brute.base_spans(t) for i, t in docs}
    assert {wide[s:e] for k, s, e in got[2] if k == "term"} == {"Zarathustra", "today"}
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    out, at = [], 0
    for kind, s, e in got[1]:
        if s >= at:
            out += [many[at:s], f"[{kind.upper()}]"]
            at = e
    assert clean[1] == "".join(out) + many[at:] and clean[4] == docs[3][1]
    assert time.monotonic() - began < 90
