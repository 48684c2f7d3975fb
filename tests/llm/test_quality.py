import brute

from quillion.llm import quality


def test_counts_match_brute_force(spark, corpus):
    rows = quality.quality(spark.createDataFrame([(i, t, 0, "q") for i, t in corpus], "doc_id long, text string, n_words int, _row string")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert got == {i: brute.quality(t) for i, t in corpus}
    assert all(not (r.base_failed and r.kept) for r in rows) and all(r.n_words is not None and r._row == "q" for r in rows)


def test_rules(spark):
    good = "the cat sat on the mat and then it went to sleep for an hour; " * 1 + " ".join(f"word{i} of{i} the tale{i}" for i in range(20))
    rows = {"good": good, "symbols": good + " #" * 60, "no stop words": " ".join(f"zeta{i}" for i in range(80)), "long words": " ".join("the " + "x" * 40 + str(i) for i in range(60)), "loud": good.upper()}
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(list(rows.items()), "doc_id string, text string")).collect()}
    assert kept == {"good": True, "symbols": False, "no stop words": False, "long words": False, "loud": False}
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0
