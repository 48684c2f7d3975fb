import brute
from conftest import changed

from quillion.llm import linededup


def result(spark, rows):
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: r.text for r in out.collect()}


def test_matches_brute_force(spark, corpus):
    assert result(spark, corpus) == brute.line_dedup(corpus)


def test_one_edit_in_each_place(spark):
    line = "The quick brown fox jumps over the lazy dog; then it sleeps for a good many hours in the sun."
    edits = [changed(line, i, "#") for i in range(0, len(line), 9)] + [line[:i] + line[i + 1 :] for i in range(0, len(line), 11)] + [line[:i] + "+" + line[i:] for i in range(0, len(line) + 1, 13)]
    two = [changed(changed(line, 5, "#"), 50, "#"), "shorter line"]
    rows = [(1, line)] + [(k + 2, x) for k, x in enumerate(edits + two)]
    assert result(spark, rows) == brute.line_dedup(rows)
    assert sum(bool(t) for t in result(spark, rows).values()) < len(rows) - len(edits) + 2


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup_lines(empty).count() == 0
    docs = spark.createDataFrame([(None, "a\nb", 1, 2, 3), (1, "a\n\n\nb", 1, 2, 3), (2, None, 1, 2, 3)], "doc_id long, text string, _kept int, _all int, n_lines int")
    out = linededup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "_kept", "_all", "n_lines", "n_removed"]
    assert {(r.doc_id, r.text, r._kept, r.n_removed) for r in out.collect()} == {(None, "a\nb", 1, 0), (1, "\n", 1, 2), (2, None, 1, 0)}


def test_lines_repeated_thousands_of_times(spark):
    """A line that most documents hold, near lines of it, and a very long line with a near copy."""
    hot, long = "This very common line stands in each of the documents of the table.", "word " * 8000
    rows = [(i, f"{hot}\nline of its own, number {i:04d}{i * 7919 % 10007:05d}{i * 104729 % 99991:05d}\n{hot}") for i in range(2000)]
    rows += [(5000, hot + "!"), (5001, hot.replace("very", "vary")), (5002, long), (5003, long.replace("word", "ward", 1)), (5004, long + "more and more")]
    got = result(spark, rows)
    assert got[0] == rows[0][1].rsplit("\n", 1)[0] and all(got[i] == rows[i][1].split("\n")[1] for i in range(1, 2000))
    assert (got[5000], got[5001], got[5002], got[5003], got[5004]) == ("", "", long, "", rows[-1][1])


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "the first text of the id one, long enough"), (1, "another text of the same id, long enough"), (2, "the first text of the id one, long enough!")]
    got = [(r.doc_id, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 3 and {t for i, t in got if i == 2} == {""}
