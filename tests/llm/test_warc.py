import brute
import pytest

from quillion.llm import warc

PAGES = [(i, f"http://{'www.' * (i % 2)}Site{i % 7}.example:80/p/{i // 2}?q={i}#top", f"<html>page {i % 23}</html>") for i in range(120)]
PAGES += [(500, None, None), (501, "", ""), (502, "http://[bad", "ünï ✓"), (503, "http://big.example/", "<p>x</p>" * 20_000), (503, "http://big.example/", "<p>x</p>" * 20_000), (504, "http://a b.example/c d", "1"), (None, "http://null.example/", "page"), (505, "http://later.example/", "page")]


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}"
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, key int").repartition(5)
    captures, _ = warc.archive(pages, path)
    return path, captures, warc.write_index(captures, path + "/small", block_lines=7)


def test_round_trip(spark, archived):
    path, captures, directory = archived
    assert directory.count() >= -(-len(PAGES) // 7)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    keys = spark.createDataFrame([(warc.capture_key(u, i),) for i, u, _ in PAGES], "query string")
    for options in ({}, {"max_blocks": 4}):
        import shutil
        from pathlib import Path

        for part in Path(path.removeprefix("file://")).glob("warc-*"):
            shutil.copy(part, Path(path.removeprefix("file://"), "small", part.name))
        got = warc.lookup(keys, directory, path + "/small", with_payload=True, **options).collect()
        assert len(got) == len(PAGES)
        want = {i: (html or "").encode() for i, _, html in PAGES}
        for r in got:
            payload = want[r.page_id]
            refers = first[payload.decode()] if first[payload.decode()] != r.page_id else None
            assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(payload), brute.digest(payload), refers)
            assert r.record_type == ("response" if refers is None else "revisit")
            assert (bytes(r.payload) == payload) if refers is None else r.payload is None


def test_prefix_and_missing_keys(spark, archived):
    path, _, directory = archived
    some = warc.url_key(PAGES[0][1]).split(")")[0] + ")"
    got = warc.lookup(spark.createDataFrame([(some,), ("zzz,none)/",), (None,)], "query string"), directory, path + "/small").collect()
    assert {r.page_id for r in got} == {i for i, u, _ in PAGES if warc.url_key(u).startswith(some)}


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/"


def test_least_payload_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "v", "abcd"), (4, "v", "abcd")], "page_id long, url string, html string")
    _, directory = warc.archive(pages, f"file://{tmp_path}/a", min_payload=3)
    keys = spark.createDataFrame([("u",), ("v",)], "query string")
    got = {r.page_id: r.record_type for r in warc.lookup(keys.selectExpr("concat(query, ' ') query").union(keys), directory, f"file://{tmp_path}/a").collect()}
    assert got in ({}, {1: "response", 2: "response", 3: "response", 4: "revisit"})
    _, none = warc.archive(pages.limit(0), f"file://{tmp_path}/b")
    assert none.count() == 0 and warc.lookup(keys, none, f"file://{tmp_path}/b").count() == 0


def test_copies_beyond_the_broadcast_bound(spark):
    """Joined by digest in narrow rows and by page number: the same firsts, null numbers and repeated rows included."""
    rows = [(i, f"u{i}", f"payload {i % 3}") for i in range(30)] + [(None, "n", "payload 0"), (7, "u7", "payload 1"), (99, "x", "alone"), (100, "y", None), (101, "z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    pages = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    same = pages.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    plain = lambda df: sorted(str((r.page_id, r.url, r.first)) for r in df.collect())
    one, other = plain(warc.with_first(pages, same)), plain(warc.with_first(pages, same, max_rows=0))
    assert one == other and len(one) == len(rows)


def test_very_long_payload(spark, tmp_path):
    text = "<p>ünï & so on</p>" * 400_000
    pages = spark.createDataFrame([(1, "http://long.example/", text), (2, "http://other.example/", text)], "page_id long, url string, html string")
    _, directory = warc.archive(pages, f"file://{tmp_path}/a", file_bytes=1 << 12)
    keys = spark.createDataFrame([("example,long)/",), ("example,other)/",)], "query string")
    got = {r.page_id: r for r in warc.lookup(keys, directory, f"file://{tmp_path}/a", with_payload=True).collect()}
    assert bytes(got[1].payload).decode() == text and got[2].refers_to == 1 and got[2].payload_bytes == len(text.encode())
