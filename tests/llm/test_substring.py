import random

import brute
import pytest
from conftest import prose

from quillion.llm import substring


def spans(frame) -> set:
    return {(r.doc_id, r.start_word, r.end_word) for r in frame.collect()}


def planted(seed: int, texts: list[list[str]], passages: list[list[str]]) -> list[tuple[int, str]]:
    """Each passage put into two texts or three, at places of their own, in small and capital letters."""
    draw = random.Random(seed)
    for p in passages:
        for k in draw.sample(range(len(texts)), draw.choice([2, 2, 3])):
            at = draw.randrange(len(texts[k]) + 1)
            texts[k][at:at] = p if draw.random() < 0.5 else [w.upper() for w in p]
    return [(i, "".join(w + draw.choice([" ", " ", "\n", "  "]) for w in t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("kind", ["prose", "few words", "letters"])
def test_every_passage_and_its_ends(spark, kind):
    """Against all runs of 51 words: passages of 49 to 75 words, over ten or so of each size."""
    draw = random.Random(11)
    few = {"prose": None, "few words": ["ab", "cd", "ef", "gh"], "letters": list("abcdefg")}[kind]
    word = (lambda: draw.choice(few)) if few else (lambda: "".join(draw.choice("etaoinshr") for _ in range(draw.randint(1, 9))))
    passages = [[word() for _ in range(draw.randint(2, 5))] * 40 if kind == "few words" and k % 4 == 0 else [word() for _ in range(80)] for k in range(160)]
    passages = [p[: 49 + k % 27] for k, p in enumerate(passages)]
    rows = planted(5, [[word() for _ in range(draw.randint(60, 240))] for _ in range(120)], passages)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.repeated_passages(rows)
    assert len(want) > 200 and spans(substring.repeated_passages(docs)) == want
    assert spans(substring.repeated_passages(docs, within=True)) == brute.repeated_passages(rows, within=True)


def test_first_holder_and_odd_rows(spark):
    passage = prose(777, 80).replace("\n", " ")
    docs = [(i, prose(1000 + i, 200)) for i in range(12)]
    docs[2] = (2, docs[2][1] + " " + passage)
    docs[5] = (5, passage + " " + docs[5][1])
    docs[9] = (9, "an insertion shifts it " + docs[9][1][:333] + " " + passage.upper() + "\n" + docs[9][1][333:])
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs] + [(50, None, "k", 1), (51, "", "k", 1), (None, "before " + passage, "k", 1)], "doc_id long, text string, key string, id int")
    got = substring.repeated_passages(frame).collect()
    assert {r.doc_id for r in got} == {2, 5, 9, None} and all(r.n_words == 80 == r.end_word - r.start_word and r.first_doc_id is None for r in got)
    got = substring.repeated_passages(frame.where("doc_id is not null")).collect()
    assert {r.doc_id for r in got} == {2, 5, 9} and all(r.first_doc_id == 2 for r in got)


def test_copies_and_short_repeats(spark):
    text, short = prose(5, 120), prose(6, 20)
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, short), (4, short), (5, text + " more"), (5, text + " more")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring.repeated_passages(docs).collect()}
    assert set(got) == {1, 2, 5} and all(r.n_words == 120 for r in got.values())
    assert substring.repeated_passages(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(7, text), (7, text)], "doc_id long, text string")
    assert substring.repeated_passages(one).count() == 0


def test_removal_keeps_the_first_place(spark):
    a, b, p, q = prose(1, 60), prose(2, 70), prose(3, 90), prose(4, 55)
    rows = [(1, f"{a}\n{p}\n{b}"), (2, f"start {p.upper()}\nend"), (3, a), (4, None), (5, ""), (6, f"{q} mid {q}"), (7, prose(8, 30)), (8, "x " * 200)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _key int, gone int")
    got = {r.doc_id: r.text for r in substring.remove_repeats(docs).collect()}
    assert got == {1: rows[0][1], 2: "start end", 3: "", 4: None, 5: "", 6: f"{q} mid ", 7: rows[6][1], 8: got[8]}
    assert 1 <= len(got[8].split()) < 110
    assert substring.remove_repeats(docs).columns == docs.columns


def test_removal_loses_no_word(spark):
    """Words that each passage has for itself are left once, whichever passages meet."""
    draw = random.Random(3)
    passages = [[f"p{k}-{j}" for j in range(60 + k)] for k in range(30)]
    rows = planted(9, [[f"d{k}-{j}" for j in range(150)] for k in range(40)], passages)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [w for r in substring.remove_repeats(docs).collect() for w in r.text.lower().split()]
    assert set(left) == {w for _, t in rows for w in t.lower().split()}
    assert len(left) < 0.93 * sum(len(t.split()) for _, t in rows)  # where one passage cuts another, pieces may be too short


def test_cuts_follow_the_content():
    text = prose(8, 3000)
    a, b = (substring.cuts(*substring.words_of(t)) for t in (text, "new " + text))
    assert len({x + 1 for x in a.tolist()} & set(b.tolist())) >= 0.99 * len(a)
    for t in ("a " * 10_000, "x" * 50_000 + " y" * 30, text):
        data, ends = substring.words_of(t)
        run = substring.cuts(data, ends)
        assert run[0] == 0 and run[-1] == len(ends) and (run[1:] - run[:-1]).max() <= substring.WINDOW
