"""Queries: ranked boolean search, session strategies by topic and in turn, tier summaries, the client's BM25, JSON lists and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.functions import scoring, text
from quillion.operators import filters, patterns, search, sessions, textquery
from quillion.plans.registry import Tables, query
from quillion.plans.retrieval import COS, HAY, SESSIONS, VEC, probe, rounded, session_table, tokens_sql, vectors
from quillion.sources import turtle


@query(
    f"WITH {VEC} SELECT id, round({COS}, 6) AS score FROM v JOIN memory m USING (id) CROSS JOIN q WHERE lower(content) LIKE '%the%' AND NOT lower(content) LIKE '%scum%' ORDER BY {COS} DESC, id LIMIT 20",
    "memory",
)
def ranked_boolean_search(t: Tables) -> DataFrame:
    """Rows that a boolean query keeps, by cosine to the vector of its positive terms."""
    rows = t.memory.join(vectors(t).select("id", "embedding"), "id")
    return rounded(textquery.ranked_search(rows, "the AND NOT scum", probe(t), limit=20).select("id", "score"), "score")


KEYWORD_SQL = f"k AS (SELECT id, (({HAY} LIKE '%the%')::INT + ({HAY} LIKE '%of%')::INT) / 2.0 AS score FROM ses), h AS (SELECT * FROM k WHERE score > 0 ORDER BY score DESC, id LIMIT 40)"


@query(
    f"WITH {SESSIONS}, {KEYWORD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY CAST(id AS BIGINT) % 5 ORDER BY score DESC, id) AS n FROM h)"
    " SELECT id, round(score, 6) AS score FROM r WHERE n <= 3 ORDER BY r.score DESC, id LIMIT 10", "session_turn",
)
def session_topic(t: Tables) -> DataFrame:
    """At most three sessions of a topic (here, of a residue of the id)."""
    table = session_table(t)
    topics = table.select("id", (F.col("id").cast("long") % 5).alias("topic"))
    return rounded(sessions.by_topic(sessions.keyword(table, "the of", 40), topics), "score")


@query(
    f"WITH {SESSIONS}, p AS (SELECT id, 1.0::DOUBLE AS score FROM ses WHERE lower(concat_ws(' ', name, summary)) LIKE '%of the%' ORDER BY id LIMIT 10), {KEYWORD_SQL},"
    " u AS (SELECT coalesce(p.id, h.id) AS id, coalesce(p.score, h.score) AS score FROM p FULL JOIN h ON p.id = h.id) SELECT id, round(score, 6) AS score FROM u ORDER BY u.score DESC, id LIMIT 30", "session_turn",
)
def session_hybrid(t: Tables) -> DataFrame:
    """Phrase hits, then keyword hits: a session takes the score of the first strategy that has it."""
    table = session_table(t)
    return rounded(sessions.first_of(sessions.phrase(table, "of the"), sessions.keyword(table, "the of", 40), limit=30), "score")


@query()
def tier_summaries(t: Tables) -> DataFrame:
    return patterns.tier_summary(t.memory)


@query(
    f"WITH c AS (SELECT id, len(t) AS dl, len(list_filter(t, lambda x: x = 'stupid')) AS tf FROM (SELECT id, {tokens_sql('content')} AS t FROM memory)), n AS (SELECT avg(dl) FILTER (dl > 0) AS mean FROM c)"
    " SELECT id, round(tf / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(mean, 1.0))), 6) AS score FROM c, n WHERE tf > 0", "memory",
)
def client_bm25(t: Tables) -> DataFrame:
    """The client's term weight, from the postings of one term."""
    postings = search.postings(t.memory)
    mean = postings.select("id", "doc_length").distinct().agg(F.avg("doc_length").alias("mean"))
    hits = postings.where("term = 'stupid'").crossJoin(F.broadcast(mean))  # one row
    return hits.select("id", F.round(scoring.bm25_tf_plain(F.col("tf").cast("double"), F.col("doc_length"), F.col("mean")), 6).alias("score"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN [] ELSE [p_name, p_brand] END AS aliases FROM part")
def alias_lists(t: Tables) -> DataFrame:
    """Aliases from JSON lists, every fourth of which is broken off."""
    whole = F.to_json(F.array("p_name", "p_brand"))
    json = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("["), F.col("p_name"))).otherwise(whole)
    return t.part.select(F.col("p_partkey").alias("id"), text.aliases(json).alias("aliases"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69' AND event_type = 'error'")
def property_equalities(t: Tables) -> DataFrame:
    """All of the given equalities on a JSON object's properties."""
    events = t.events.withColumn("entities_json", F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"))))
    return events.where(filters.all_properties(F.col("entities_json"), {"k": 69, "kind": "error"})).select("event_id")


@query(
    "SELECT CAST(n_regionkey AS VARCHAR) AS document, 'http://x/n' || n_nationkey AS subject, unnest(['http://x/key', 'http://x/in', 'http://x/seen']) AS predicate,"
    " unnest([CAST(n_nationkey AS VARCHAR), 'the \"' || r_name || '\"', 'http://x/' || n_name]) AS object, unnest(['http://www.w3.org/2001/XMLSchema#integer', NULL, NULL]) AS datatype, unnest([NULL, 'en', NULL]) AS lang"
    " FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def turtle_import(t: Tables) -> DataFrame:
    """A Turtle document for each region, with a statement for each of its nations."""
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    statement = F.concat(F.lit("x:n"), F.col("n_nationkey").cast("string"), F.lit(" x:key "), F.col("n_nationkey").cast("string"), F.lit(' ; x:in "the \\"'), "r_name", F.lit('\\""@en ; <seen> <'), "n_name", F.lit("> ."))
    documents = joined.groupBy(F.col("n_regionkey").alias("id")).agg(F.concat(F.lit("@prefix x: <http://x/> .\n@base <http://x/> .\n"), F.array_join(F.collect_list(statement), "\n")).alias("content"))
    return turtle.turtle(documents).select("document", "subject", "predicate", "object", "datatype", "lang")
