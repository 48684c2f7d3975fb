"""Queries: searches in steps, storing, communities, dreams and the operators of statistics, reviews, logs and files."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.functions import scoring, text
from quillion.functions.scoring import DAY
from quillion.operators import communities, dreams, maintenance, relations, search, sessions, stats, store
from quillion.plans.governance import log_of
from quillion.plans.registry import Tables, query
from quillion.plans.retrieval import COS, LEGS_SQL, NOW_SQL, TERMS, VEC, WORDS, bm25_sql, now_of, probe, rounded, vectors
from quillion.sources import connectors, io
from quillion.sources.catalog import Catalog
from quillion.sources.shared import new_folder
from quillion.streaming import changes

FUSED = "r AS (SELECT id, 1.0 / (60 + row_number() OVER (PARTITION BY strategy ORDER BY score DESC, id) - 1) AS s FROM legs), u AS (SELECT id, sum(s) AS score FROM r GROUP BY id ORDER BY sum(s) DESC, id LIMIT 20)"


@query(f"WITH {LEGS_SQL}, {FUSED} SELECT 'causal' AS intent, 'semantic_graph' AS strategy, '' AS reranker, id, round(score, 6) AS score FROM u", "memory")
def intent_routed_search(t: Tables) -> DataFrame:
    """A question's intent names strategy and reranker; the fused legs answer it."""
    memories = t.memory
    hits = search.hybrid(memories, vectors(t), WORDS, probe(t), now_of(memories))
    return rounded(sessions.routed("why did it fail", hits), "score")


@query(
    f"""WITH {LEGS_SQL}, {FUSED},
  x AS (SELECT u.id, content, tier, created_at, score * (1 + 0.4 * least(1.0, ((lower(content) LIKE '%idiot%')::INT + (lower(content) LIKE '%trash%')::INT) / 2.0)) AS score FROM u JOIN memory m ON u.id = m.id),
  y AS (SELECT id, score * (1 + 0.15 * greatest(exp(-pow(greatest(({NOW_SQL} - created_at) / 86400000000.0, 0) / 7.0, 0.5)), 0.05)) AS score FROM x WHERE tier <> 'L2')
  SELECT id, round(score, 6) AS score FROM y ORDER BY y.score DESC, id LIMIT 10""",
    "memory",
)
def client_search(t: Tables) -> DataFrame:
    """The whole search as stages: fused legs, texts, entity boost, entity injection, tier filter, recency boost, limit."""
    memories = t.memory
    now, named = now_of(memories), ["idiot", "trash"]
    texts = memories.select("id", "content", "tier", "created_at")
    stages = maintenance.Pipeline([
        ("enrich", lambda hits: hits.join(texts, "id")),
        ("boost", lambda hits: search.entity_boost(hits, named)),
        ("inject", lambda hits: search.entity_injection(hits, t.kg_node, t.kg_edge, memories, named)),
        ("filter", lambda hits: hits.where("tier <> 'L2'")),
        ("recency", lambda hits: hits.withColumn("score", scoring.temporal_boost(F.col("score"), scoring.days_between(now, F.col("created_at"))))),
        ("limit", lambda hits: search.top(hits, 10)),
    ])
    return rounded(stages.run(search.hybrid(memories, vectors(t), WORDS, probe(t), now)).select("id", "score"), "score")


@query(
    r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents),
  memory AS (SELECT concat(id, '/', (s - 1) // 180) AS id, array_to_string(w[s:s + 199], ' ') AS content FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 20, 1) + 1, 180)) AS s FROM d WHERE len(w) > 0)),"""
    + bm25_sql("mean")
    + """, h AS (SELECT split_part(id, '/', 1) AS id, CAST(split_part(id, '/', 2) AS INT) AS chunk, score FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk) AS k FROM h)
  SELECT id, chunk, round(score, 6) AS score FROM r WHERE k = 1 ORDER BY r.score DESC, id LIMIT 20""",
)
def document_search(t: Tables) -> DataFrame:
    documents = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return rounded(store.document_search(documents, TERMS, 20), "score")


DIRECTORIES = "d AS (SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id > 0 THEN CAST((id - 1) // 3 AS VARCHAR) END AS parent_id FROM (SELECT unnest(range(0, 121)) AS id))"


@query(f"WITH RECURSIVE {DIRECTORIES}, x(id, depth) AS (SELECT id, 0 FROM d WHERE id = '1' UNION ALL SELECT d.id, depth + 1 FROM x JOIN d ON d.parent_id = x.id) SELECT m.id, x.depth AS directory_depth FROM memory m JOIN x ON CAST(m.num % 121 AS VARCHAR) = x.id", "memory")
def directory_search(t: Tables) -> DataFrame:
    """Memories filed below a directory, by a tree of 121 directories."""
    number = F.col("id")
    parent = F.when(number > 0, F.floor((number - 1) / 3).cast("string"))
    directories = t.spark.range(121).select(number.cast("string").alias("id"), parent.alias("parent_id"), F.concat(F.lit("d"), number.cast("string")).alias("name"), F.concat(F.lit("/d"), number.cast("string")).alias("path"))
    memories = t.memory.withColumn("parent_directory_id", (F.col("num") % 121).cast("string"))
    return store.directory_contents(directories, memories, "/d1").select("id", "directory_depth")


MATCHES = f"""{VEC}, m AS (SELECT a.id, b.id AS match, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.id <> b.id WHERE CAST(a.id AS BIGINT) % 20 = 0),
  best AS (SELECT id, min((-round(score, 12), match)) AS x FROM m WHERE score > 0 GROUP BY id)"""


@query(f"WITH {MATCHES} SELECT id, x[2] AS match, round(-x[1], 6) AS score FROM best WHERE -x[1] >= 0.3")
def near_duplicate_lookup(t: Tables) -> DataFrame:
    """The nearest other vector of every twentieth one, over all vectors."""
    index = vectors(t)
    return rounded(store.near_duplicates_of(index, index.where("cast(id as bigint) % 20 = 0"), 0.3), "score")


@query(f"""WITH {MATCHES}, hit AS (SELECT id, x[2] AS match FROM best WHERE -x[1] >= 0.3), n AS (SELECT match AS id, count(*) AS n FROM hit GROUP BY 1)
  SELECT m.id, access_count + coalesce(n, 0) AS access_count, round(least(1.0, strength + 0.05 * coalesce(n, 0)), 6) AS strength FROM memory m LEFT JOIN n ON m.id = n.id
  UNION ALL SELECT 'new-' || id, 0, 0.5 FROM v WHERE CAST(id AS BIGINT) % 20 = 0 AND id NOT IN (SELECT id FROM hit)""", "memory")
def store_without_duplicates(t: Tables) -> DataFrame:
    """Every twentieth vector comes as a memory: it reinforces what it matches, or is inserted."""
    index, memories = vectors(t), t.memory
    some = index.where("cast(id as bigint) % 20 = 0")
    hits = store.near_duplicates_of(index, some, 0.3)
    stronger = maintenance.reinforce(memories, hits.select(F.col("match").alias("id"), F.lit(1).alias("n")), 0)
    fresh = some.join(hits.select("id"), "id", "left_anti").select(F.concat(F.lit("new-"), "id").alias("id"))
    return rounded(maintenance.insert(stronger, fresh, 0).select("id", "access_count", "strength"), "strength")


@query("""WITH e AS (SELECT DISTINCT unnest([source_node_id, target_node_id]) AS id FROM kg_edge), f AS (SELECT id, row_number() OVER (ORDER BY id) + (SELECT max(community_id) FROM kg_node) AS c FROM (SELECT id FROM kg_node WHERE community_id = 0 AND id IN (SELECT id FROM e)))
  SELECT n.id, coalesce(f.c, community_id) AS community_id FROM kg_node n LEFT JOIN f ON n.id = f.id""", "kg_node", "kg_edge")
def community_seeding(t: Tables) -> DataFrame:
    return communities.seeded(t.kg_node, t.kg_edge).select("id", "community_id")


@query("SELECT community_id AS cluster, 0 AS depth, community_id, count(*) AS members FROM kg_node WHERE community_id > 0 GROUP BY community_id", "kg_node")
def community_hierarchy(t: Tables) -> DataFrame:
    sizes = t.kg_node.groupBy("community_id").agg(F.count("*").alias("members"))
    return communities.hierarchy(t.kg_node).join(sizes, "community_id").select("cluster", "depth", "community_id", "members")


@query(f"""WITH RECURSIVE {VEC}, n AS (SELECT id, e, label FROM (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS e, label FROM embeddings)),
  p AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.5), f(id, root) AS (SELECT a, a FROM p UNION SELECT p.b, f.root FROM f JOIN p ON f.id = p.a)
  SELECT id, min(root) AS cluster FROM f GROUP BY id""")
def similarity_clusters(t: Tables) -> DataFrame:
    return communities.similar_clusters(vectors(t).select("id", "embedding"), 0.5)


@query("SELECT id, CASE WHEN id IN (SELECT a FROM (SELECT CAST(o_orderkey AS VARCHAR) AS a FROM orders WHERE o_orderstatus = 'F')) AND invalid_at = 0 THEN 7 ELSE invalid_at END AS invalid_at FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 2 AS invalid_at FROM orders)")
def invalidated_contradictions(t: Tables) -> DataFrame:
    """Current edges that a list of contradictions names end now."""
    edges = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 2).alias("invalid_at"))
    listed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id"))
    return relations.invalidated(edges, listed, 7)


AGE = f"greatest(({NOW_SQL} - created_at) / 86400000000.0, 0)"


@query(f"""WITH a AS (SELECT id, confidence AS c, {AGE} AS d FROM memory), p AS (SELECT *, c * CASE WHEN d + 90 > 90 THEN 0.1 ELSE greatest(0.1, least(1.0, 1 - 0.005 * (d + 90))) END AS plain, least(1.0, c * (1 + 0.3 * (1 - c))) AS s FROM a), q AS (SELECT *, least(1.0, s * (1 + 0.3 * (1 - s))) AS s2 FROM p)
  SELECT id, round(plain, 6) AS plain, round(least(1.0, s2 * (1 + 0.3 * (1 - s2))) * 0.775, 6) AS reviewed FROM q""", "memory")
def cramming(t: Tables) -> DataFrame:
    memories = t.memory
    found = scoring.cramming(F.col("confidence"), scoring.days_between(now_of(memories), F.col("created_at")))
    return rounded(memories.select("id", found.alias("c")).select("id", "c.plain", "c.reviewed"), "plain", "reviewed")


@query(f"SELECT id, round(confidence * CASE WHEN {AGE} > 90 THEN 0.1 ELSE greatest(0.1, least(1.0, 1 - 0.005 * {AGE})) END, 6) AS strength, round(confidence * CASE WHEN {AGE} + 30 > 90 THEN 0.1 ELSE greatest(0.1, least(1.0, 1 - 0.005 * ({AGE} + 30))) END, 6) AS later FROM memory", "memory")
def predicted_strength(t: Tables) -> DataFrame:
    memories = t.memory
    found = scoring.predicted_strength(F.col("confidence"), scoring.days_between(now_of(memories), F.col("created_at")))
    return rounded(memories.select("id", found.alias("p")).select("id", F.col("p.now").alias("strength"), F.col("p.then").alias("later")), "strength", "later")


CARD = """WITH RECURSIVE g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 6 AS q, epoch_us(ts) // 1000000 AS t FROM events),
  s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 2.5::DOUBLE AS ef, 0::BIGINT AS reps, 0::BIGINT AS lapses, 0::DOUBLE AS days, 0::BIGINT AS next FROM g
    UNION ALL SELECT user_id, i, CASE WHEN q <= 2 AND reps = 0 THEN ef ELSE up END, CASE WHEN q <= 2 THEN 0 ELSE reps + 1 END, lapses + (q <= 2 AND reps > 0)::BIGINT,
      CASE WHEN q <= 2 THEN 0 WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE greatest(1.0, days * up) END,
      t + CASE WHEN q <= 2 THEN 600 WHEN reps = 0 THEN 86400 WHEN reps = 1 THEN 518400 ELSE floor(greatest(1.0, days * up) * 86400)::BIGINT END
    FROM (SELECT s.user_id, g.i, q, t, ef, reps, lapses, days, greatest(1.3, ef + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))) AS up FROM s JOIN g ON s.user_id = g.user_id AND g.i = s.i + 1))"""


@query(f"{CARD} SELECT user_id, round(max_by(ef, i), 6) AS ef, max_by(reps, i) AS reps, max_by(lapses, i) AS lapses FROM s GROUP BY user_id")
def card_fold(t: Tables) -> DataFrame:
    """Events as reviews of a card for each user."""
    reviews = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: F.struct(F.floor(F.unix_micros(x["ts"].cast("timestamp")) / 1_000_000).alias("at"), (x["event_id"] % 6).cast("int").alias("grade")))
    rows = t.events.groupBy("user_id").agg(reviews.alias("r"))  # a card's own reviews
    return rounded(rows.select("user_id", scoring.card_fold(F.col("r")).alias("c")).select("user_id", "c.ef", "c.reps", "c.lapses"), "ef")


@query("SELECT o_orderkey AS id, epoch_us(o_orderdate) + (o_orderkey % 9) * 86400000000 AS due FROM orders")
def scheduled_days(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select(F.col("o_orderkey").alias("id"), scoring.add_days(at, F.col("o_orderkey") % 9).alias("due"))


TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda t: octet_length(encode(t)) >= 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")))"
PAIRS = (
    f"d AS (SELECT id, confidence, {TOKENS} AS t FROM memory WHERE content <> ''), i AS (SELECT a.id AS a, b.id AS b, abs(a.confidence - b.confidence) AS apart, len(a.t) + len(b.t) AS n, len(list_intersect(a.t, b.t)) AS k"
    " FROM d a JOIN d b ON a.id < b.id AND len(a.t) >= 0.15 * len(b.t) AND len(b.t) >= 0.15 * len(a.t)), p AS (SELECT a, b, apart, k / greatest(n - k, 1) AS j FROM i)"
)


@query(f"WITH {PAIRS} SELECT [a, b] AS source_ids, round(j, 6) AS score, round(least(0.9, 0.4 + 0.5 * j), 6) AS confidence FROM p WHERE j BETWEEN 0.15 AND 0.85 ORDER BY a, b LIMIT 5", "memory")
def dream_connections(t: Tables) -> DataFrame:
    return rounded(dreams.connections(t.memory).select("source_ids", "score", "confidence"), "score", "confidence")


@query(f"WITH {PAIRS} SELECT [a, b] AS source_ids, round(j, 6) AS score, round(least(0.8, 0.3 + apart), 6) AS confidence FROM p WHERE j BETWEEN 0.2 AND 0.6 ORDER BY a, b LIMIT 5", "memory")
def dream_contrasts(t: Tables) -> DataFrame:
    return rounded(dreams.contrasts(t.memory).select("source_ids", "score", "confidence"), "score", "confidence")


@query(f"""WITH w AS (SELECT id, {TOKENS.replace("list_distinct", "")} AS w FROM memory WHERE content <> ''), d AS (SELECT id, list_filter(w, lambda x, i: list_position(w, x) = i) AS t FROM w), n AS (SELECT id, unnest(range(least(3, len(t)))) AS k, unnest(t[1:3]) AS name FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS i, min((id, k)) OVER (PARTITION BY name) AS first FROM n)
  SELECT [any_value(first[1]), max(id) FILTER (WHERE i = 2)] AS source_ids, name FROM r WHERE i <= 2 GROUP BY name, first HAVING count(*) = 2 ORDER BY first, name LIMIT 5""", "memory")
def dream_gaps(t: Tables) -> DataFrame:
    found = dreams.gaps(t.memory)
    return found.select("source_ids", F.regexp_extract("content", r"(?s).* involving '(.*)'$", 1).alias("name"))


@query()
def dream_generalisations(t: Tables) -> DataFrame:
    return dreams.generalisations(t.memory).select("source_ids", "score", "content")


@query("SELECT a, b, count(*) AS shared FROM (SELECT x.l_partkey AS a, y.l_partkey AS b, x.l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) y ON x.l_suppkey = y.l_suppkey AND x.l_partkey < y.l_partkey) GROUP BY a, b HAVING count(*) >= 4")
def suggested_links(t: Tables) -> DataFrame:
    """Parts with four suppliers in common."""
    edges = t.lineitem.select(F.col("l_partkey").alias("source_node_id"), (-F.col("l_suppkey") - 1).alias("target_node_id"))
    return store.suggested_links(edges, 4, among=F.col("a") >= 0)


@query("SELECT (SELECT count(*) FROM kg_node) AS total, count(*) AS orphans FROM kg_node WHERE id NOT IN (SELECT source_node_id FROM kg_edge UNION SELECT target_node_id FROM kg_edge)", "kg_node", "kg_edge")
def lint_workspace(t: Tables) -> DataFrame:
    return store.lint(t.kg_node, t.kg_edge)


@query("""WITH h AS (SELECT id, lower(content[1:100]) AS head FROM memory WHERE length(content) >= 20 ORDER BY created_at DESC, id LIMIT 50)
  SELECT DISTINCT least(m.id, h.id) AS a, greatest(m.id, h.id) AS b FROM memory m JOIN h ON contains(lower(m.content), h.head) AND m.id <> h.id""", "memory")
def cross_links(t: Tables) -> DataFrame:
    none = t.spark.createDataFrame([], "source_node_id string, target_node_id string")
    found = store.cross_links(t.memory, none)
    return found.select(F.least("source_node_id", "target_node_id").alias("a"), F.greatest("source_node_id", "target_node_id").alias("b"))


@query(f"WITH tok AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(CASE WHEN num % 7 = 0 THEN 'new words here' ELSE content END), '[^\\p{{L}}\\p{{N}}]+'), lambda t: octet_length(encode(t)) >= 2 AND t NOT IN ({', '.join(repr(w) for w in text.STOP_WORDS)}))) AS term FROM memory WHERE num % 11 <> 0) SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM tok GROUP BY term", "memory")
def index_maintenance(t: Tables) -> DataFrame:
    """The term index after every seventh memory changed and every eleventh went."""
    memories = t.memory
    vector = F.array(F.lit(0.0))
    changed = memories.where("num % 7 = 0 and num % 11 <> 0").select("id", F.lit("new words here").alias("content"), vector.alias("embedding"))
    _, terms = store.upsert_index(memories.select("id", vector.alias("embedding")), search.postings(memories), changed, memories.where("num % 11 = 0").select("id"))
    return terms.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query("SELECT CAST(doc_id AS VARCHAR) AS source_memory_id, sha256(text) AS source FROM documents WHERE doc_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def citation_lookup(t: Tables) -> DataFrame:
    """The memories that orders of a status cite."""
    rows = t.orders.select(F.col("o_orderstatus").alias("entity_id"), F.lit("status").alias("entity_type"), F.col("o_custkey").cast("string").alias("source_memory_id")).distinct()
    memories = t.memory
    found = store.citations(rows, "F", "status", memories)
    return found.where("source is not null").select("source_memory_id", F.sha2("source", 256).alias("source"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 = 3")
def stale_nodes(t: Tables) -> DataFrame:
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 3, 5).otherwise(0).alias("stale_since"))
    return store.stale(nodes).select("id")


REVIEW = "i AS (SELECT o_orderkey AS id, o_custkey % 50 AS user_id, 1.3 + o_orderkey % 13 / 10.0 AS ef, epoch_us(o_orderdate) AS next_review_at, o_orderkey % 6 AS grade_sum, o_orderkey % 3 AS grade_count, o_orderstatus <> 'P' AS is_active FROM orders)"


def review_items(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("id"), (F.col("o_custkey") % 50).cast("string").alias("user_id"), (1.3 + key % 13 / 10.0).alias("easiness_factor"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("next_review_at"),
        (key % 6).alias("grade_sum"), (key % 3).alias("grade_count"), (F.col("o_orderstatus") != "P").alias("is_active"),
    )


@query(f"WITH {REVIEW} SELECT count(*) AS total, count(*) FILTER (WHERE next_review_at <= 852076800000000) AS due, round(sum(grade_sum) / sum(grade_count), 6) AS mean_grade, round(avg(ef), 6) AS mean_easiness FROM i WHERE is_active")
def review_stats(t: Tables) -> DataFrame:
    return rounded(stats.review_stats(review_items(t), 852076800000000), "mean_grade", "mean_easiness")


@query(f"WITH {REVIEW} SELECT id, next_review_at FROM i WHERE is_active AND next_review_at <= 852076800000000 AND user_id = 7")
def due_reviews(t: Tables) -> DataFrame:
    return stats.due_reviews(review_items(t), 852076800000000, "7").select("id", "next_review_at")


@query("""WITH m AS (SELECT memory_type AS peer_id, count(*) FILTER (WHERE is_active) AS memories, max(updated_at) AS a FROM memory GROUP BY 1), s AS (SELECT role AS peer_id, count(DISTINCT session_id) AS sessions FROM session_turn GROUP BY 1)
  SELECT coalesce(m.peer_id, s.peer_id) AS peer_id, coalesce(memories, 0) AS memories, coalesce(sessions, 0) AS sessions, coalesce(a, 0) AS last_active FROM m FULL JOIN s ON m.peer_id = s.peer_id""", "memory", "session_turn")
def peer_summary(t: Tables) -> DataFrame:
    none = t.spark.createDataFrame([], "peer_id string, is_active boolean, created_at long")
    people = t.session_turn.select(F.col("role").alias("peer_id"), "session_id", F.lit(0).cast("long").alias("joined_at"))
    return stats.peer_summary(t.memory.withColumn("peer_id", F.col("memory_type")), none, people).select("peer_id", "memories", "sessions", "last_active")


@query("SELECT DISTINCT session_id, 1.0 AS score FROM session_turn WHERE session_id = '0' UNION ALL SELECT DISTINCT session_id, 0.7 FROM session_turn WHERE session_id <> '0' AND role IN (SELECT DISTINCT role FROM session_turn WHERE session_id = '0')", "session_turn")
def sessions_by_shared_peers(t: Tables) -> DataFrame:
    people = t.session_turn.select("session_id", F.col("role").alias("peer_id")).distinct()
    hits = t.spark.createDataFrame([("0", 1.0)], "session_id string, score double")
    return rounded(relations.sessions_by_shared_peers(hits, people), "score")


@query("SELECT 'message' AS kind, count(*) AS n, sum(turn) AS at FROM session_turn UNION ALL SELECT 'event', count(*), sum(event_id) FROM events", "session_turn")
def session_timeline(t: Tables) -> DataFrame:
    messages = t.session_turn.select(F.col("turn").alias("created_at"), F.col("text").alias("content"))
    steps = t.spark.createDataFrame([], "created_at long, content string")
    events = t.events.select(F.col("event_id").alias("created_at"), F.col("event_type").alias("event"))
    return sessions.timeline(messages, steps, events).groupBy("kind").agg(F.count("*").alias("n"), F.sum("created_at").alias("at"))


@query("SELECT id, json_object('workspace_context', coalesce('about ' || workspace_id, ''), 'memory_context', tier) AS context_json FROM memory", "memory")
def context_chain(t: Tables) -> DataFrame:
    memories = t.memory.withColumn("context", F.col("tier"))
    spaces = memories.select(F.col("workspace_id").alias("id")).distinct().withColumn("context", F.concat(F.lit("about "), "id"))
    return relations.context_chain(memories, spaces).select("id", "context_json")


@query("SELECT id, entity_type, CASE entity_type WHEN 'memory' THEN sha256(content) ELSE sha256(label) END AS shown FROM (SELECT m.id, 'memory' AS entity_type, content, NULL AS label FROM memory m UNION ALL SELECT id, 'node', NULL, label FROM kg_node)", "memory", "kg_node")
def enriched_hits(t: Tables) -> DataFrame:
    memories, nodes = t.memory, t.kg_node
    notes = t.spark.createDataFrame([], "id string, title string, content string")
    hits = memories.select("id", F.lit("memory").alias("entity_type"), F.lit(1.0).alias("score")).union(nodes.select("id", F.lit("node"), F.lit(1.0)))
    return relations.enriched(hits, memories, nodes, notes).select("id", "entity_type", F.sha2("shown", 256).alias("shown"))


@query("SELECT id, tier, is_active, access_count FROM memory UNION ALL SELECT 'n' || c_custkey, 'L1', true, 0 FROM customer", "memory")
def insert_memories(t: Tables) -> DataFrame:
    memories = t.memory
    fresh = t.customer.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("content"))
    return maintenance.insert(memories, fresh, 0).select("id", "tier", "is_active", "access_count")


@query("SELECT id, is_active AND num % 6 <> 0 AS is_active FROM memory", "memory")
def deactivate_memories(t: Tables) -> DataFrame:
    memories = t.memory
    return maintenance.deactivate(memories, memories.where("num % 6 = 0").select("id"), 0).select("id", "is_active")


@query("SELECT id, CASE WHEN is_active THEN CASE WHEN tier = 'L2' AND access_count >= 5 THEN 'L1' WHEN tier = 'L1' AND access_count >= 20 THEN 'L0' ELSE tier END ELSE tier END AS tier FROM memory", "memory")
def escalation_run(t: Tables) -> DataFrame:
    return maintenance.Pipeline([("escalate", maintenance.registered("escalate"))]).run(t.memory).select("id", "tier")


@query(f"WITH d AS (SELECT *, greatest(({NOW_SQL} - updated_at) / 86400000000.0, 0) AS days FROM memory) SELECT id, round(CASE WHEN NOT is_active THEN trust_score WHEN days > 90 THEN 0.1 ELSE greatest(0.1, least(1.0, trust_score * (1 - 0.005 * days))) END, 6) AS trust_score FROM d", "memory")
def decay_run(t: Tables) -> DataFrame:
    memories = t.memory
    return rounded(maintenance.decay_trust(memories, now_of(memories)).select("id", "trust_score"), "trust_score")


@query("WITH v AS (SELECT o_custkey AS id, epoch_us(o_orderdate) AS t, o_orderkey AS version FROM orders) SELECT id, max_by(version, (t, version)) AS version FROM v WHERE t <= 852076800000000 GROUP BY id")
def snapshot_as_of(t: Tables) -> DataFrame:
    versions = t.orders.select(F.col("o_custkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("updated_at"), F.col("o_orderkey").alias("version"))
    return maintenance.snapshot_as_of(versions, 852076800000000).select("id", "version")


@query("SELECT table_name, operation, count(*) AS n FROM (SELECT 'customer' AS table_name, 'insert' AS operation FROM customer UNION ALL SELECT 'supplier', 'delete' FROM supplier) GROUP BY 1, 2")
def change_log(t: Tables) -> DataFrame:
    """Changes of two tables appended to a log in the shared folder, streamed to handlers, and what those got."""
    folder = new_folder(t.spark, "log")
    rows = changes.change_rows(t.customer.withColumnRenamed("c_custkey", "id"), "customer", "insert").unionByName(changes.change_rows(t.supplier.withColumnRenamed("s_suppkey", "id"), "supplier", "delete"))
    changes.append(rows, f"{folder}/log")
    keep = lambda batch: changes.append(batch, f"{folder}/seen")
    changes.dispatch(changes.stream(t.spark, f"{folder}/log"), {("customer", "*"): keep, ("supplier", "delete"): keep}, f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/seen").groupBy("table_name", "operation").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS created_at FROM events) SELECT id FROM c WHERE created_at >= (SELECT max(created_at) FROM c) - 5 * 86400000000")
def retained_changes(t: Tables) -> DataFrame:
    log = log_of(t)
    return changes.retained(log, changes.latest_cursor(log).first()[0] - 5 * DAY).select("id")


@query("SELECT 'nation' AS name, CAST(n_nationkey AS VARCHAR) AS id, n_name AS label FROM nation UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part")
def backup_restore(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "backup")
    io.backup({"nation": t.nation, "part": t.part}, folder)
    tables = io.restore(t.spark, folder)
    rows = {"nation": ("n_nationkey", "n_name"), "part": ("p_partkey", "p_name")}
    parts = [tables[name].select(F.lit(name).alias("name"), F.col(key).cast("string").alias("id"), F.col(label).alias("label")) for name, (key, label) in rows.items()]
    return parts[0].union(parts[1])


@query("SELECT CAST(id AS VARCHAR) AS id, sha256(content) AS digest FROM memory WHERE workspace_id = 'es'", "memory")
def csv_round_trip(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "csv") + "/out"
    io.export_memories(t.memory.select("id", "workspace_id", F.base64(F.encode("content", "UTF-8")).alias("content")), folder, "csv", {"workspace_id": "es"})
    rows = io.import_memories(t.spark, folder, "csv")
    return rows.select("id", F.sha2(F.decode(F.unbase64("content"), "UTF-8"), 256).alias("digest"))


@query("SELECT 'http://x/' || n_nationkey AS subject, 'http://x/in' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey")
def triple_import(t: Tables) -> DataFrame:
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = joined.select(F.concat(F.lit("<http://x/"), F.col("n_nationkey").cast("string"), F.lit('> <http://x/in> "'), "r_name", F.lit('" .')).alias("value"))
    return io.triples(lines)


@query("SELECT page_id AS id, len(regexp_extract_all(html, '\\(\\(([^()\\s]+)\\)\\)')) AS links FROM pages")
def block_references(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").alias("id"), F.size(text.block_references(F.col("html"))).alias("links"))


@query("SELECT id, tier, 0 < n AS named FROM (SELECT id, tier, length(content) AS n FROM memory)", "memory")
def entity_lists(t: Tables) -> DataFrame:
    """Names from lists in JSON: each memory names its type."""
    listed = F.concat(F.lit('[{"type":"x","name":"'), "tier", F.lit('"}]'))
    found = t.memory.select("id", F.upper(F.array_join(text.entity_names(listed), ",")).alias("tier"), (F.length("content") > 0).alias("named"))
    return found


@query(f"WITH {bm25_sql('mean')} SELECT id, round(score * 0.75 + confidence * 0.25, 6) AS score FROM b JOIN memory USING (id)", "memory")
def importance_blend(t: Tables) -> DataFrame:
    hits = search.bm25(t.memory, TERMS).join(t.memory.select("id", "confidence"), "id")
    return hits.select("id", F.round(scoring.importance_blend(F.col("score"), F.col("confidence"), 0.25), 6).alias("score"))


@query(f"WITH {VEC} SELECT id, round({COS}, 6) AS score FROM v, q WHERE {COS} >= 0.2")
def parsed_vectors(t: Tables) -> DataFrame:
    """Vectors that went through their JSON form."""
    from quillion.functions import vector

    index = vectors(t).select("id", vector.parse(F.to_json("embedding")).alias("embedding"))
    return rounded(search.semantic(index, probe(t), least=0.2), "score")


@query("SELECT 'slack' AS memory_type, text AS content, role AS peer_id, CAST(conv_id AS VARCHAR) AS session_id FROM conversations WHERE trim(text) <> '' UNION ALL SELECT 'github', 'page' || chr(10) || url, 'bot', 'a/b' FROM pages")
def connector_events(t: Tables) -> DataFrame:
    """Payloads of two services made of the tables, and read as events."""
    slack = t.conversations.select(F.to_json(F.struct("text", F.col("role").alias("user"), F.col("conv_id").cast("string").alias("channel"))).alias("value"))
    user, repository = F.struct(F.lit("bot").alias("login")), F.struct(F.lit("a/b").alias("full_name"))
    github = t.pages.select(F.to_json(F.struct(F.lit("page").alias("title"), F.col("url").alias("body"), user.alias("user"), repository.alias("repository"))).alias("value"))
    both = io.poll_all({"slack": connectors.events(slack, "slack", "w"), "github": connectors.events(github, "github", "w")})
    return both.select("memory_type", "content", "peer_id", "session_id")


@query("""WITH f AS (SELECT p_partkey AS k, p_name AS n FROM part) SELECT 'src/m' || k || '.py' AS source_node_id, 'src/m' || k || '.py#f' || k AS target_node_id, 'defines' AS relation FROM f
  UNION ALL SELECT 'src/m' || k || '.py', 'src/m' || k || '.py#C', 'defines' FROM f
  UNION ALL SELECT 'src/m' || a.k || '.py', CASE WHEN b.k IS NULL THEN 'src.m' || (a.k + 1) ELSE 'src/m' || b.k || '.py' END, 'imports' FROM f a LEFT JOIN f b ON b.k = a.k + 1""")
def code_ingest(t: Tables) -> DataFrame:
    """A source file for each part, with its name in a docstring full of traps, and what the file defines and imports."""
    k = F.col("p_partkey").cast("string")
    trap = F.concat(F.lit('"""\nimport '), F.translate("p_name", " ", "_"), F.lit('\ndef no():\n  # "\n"""\n# import nothing\n'))
    body = F.concat(trap, F.lit("from src.m"), (F.col("p_partkey") + 1).cast("string"), F.lit(" import x\n\nasync def f"), k, F.lit("(a):\n    return '#'\n\nclass C:\n    y = 'def no'  # \"\n    z = \"\\\"\\n\"\n"))
    return connectors.code_graph(t.part.select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), body.alias("content")))[1]


@query()
def source_ingest(t: Tables) -> DataFrame:
    """Entity pages of all documents."""
    texts = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return connectors.source_pages(texts)[2]


@query("""SELECT 'memories' AS scan, count(*) AS n FROM memory WHERE is_active AND workspace_id = 'en' UNION ALL SELECT 'l1', count(*) FROM memory WHERE tier = 'L1' AND access_count = 31 UNION ALL SELECT 'nodes', count(*) FROM kg_node WHERE node_type = 'supplier'
  UNION ALL SELECT 'edges', count(*) FROM kg_edge WHERE weight = 1.0 AND relation = 'lives_in' UNION ALL SELECT 'permitted', count(*) FROM memory WHERE workspace_id IN ('de', 'fr') UNION ALL SELECT 'sql', count(*) FROM memory WHERE strength > 0.5""", "memory", "kg_node", "kg_edge")
def catalog_scans(t: Tables) -> DataFrame:
    """Scans of registered tables: by workspace, typed equalities, an account's workspaces, and SQL with parameters."""
    known = Catalog(t.spark)
    for name in ("memory", "kg_node", "kg_edge"):
        known.register(name, getattr(t, name))
    known.register("space_permission", t.spark.createDataFrame([("de", "ann"), ("fr", "ann"), ("en", "bob")], "workspace_id string, account_id string"))
    scans = {
        "memories": known.memories("en"), "l1": known.table("memory", filters={"tier": "L1", "access_count": "31"}, columns=["id"]), "nodes": known.table("kg_node", filters={"node_type": "supplier"}),
        "edges": known.table("kg_edge", filters={"weight": "1.0", "relation": "lives_in"}), "permitted": known.permitted(known.table("memory"), "ann"), "sql": known.sql("SELECT id FROM memory WHERE strength > :least", {"least": 0.5}),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("scan"), "n") for name, df in scans.items()]
    return functools.reduce(DataFrame.union, counts)
