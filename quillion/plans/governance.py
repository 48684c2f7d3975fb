"""Queries: statistics, decay, trust, histories, packing and maintenance, over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.functions import scoring, text
from quillion.functions.scoring import DAY
from quillion.operators import maintenance, relations, stats
from quillion.plans.registry import Tables, query
from quillion.plans.retrieval import NOW_SQL, now_of, rounded
from quillion.streaming import changes

DAYS_U = f"greatest(({NOW_SQL} - updated_at) / 86400000000.0, 0)"
DAYS_C = f"greatest(({NOW_SQL} - created_at) / 86400000000.0, 0)"
EFF = f"strength * exp(-0.0231 * {DAYS_U})"


def days(now: int, column: str):
    return scoring.days_between(now, F.col(column))


@query(f"""
  SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active,
    count(*) FILTER (WHERE is_active AND tier = 'L0') AS tier_l0, count(*) FILTER (WHERE is_active AND tier = 'L1') AS tier_l1, count(*) FILTER (WHERE is_active AND tier = 'L2') AS tier_l2,
    round(avg(confidence) FILTER (WHERE is_active), 6) AS avg_confidence, floor(avg(floor(({NOW_SQL} - created_at) / 86400000000.0)) FILTER (WHERE is_active)) AS avg_age_days,
    count(DISTINCT user_scope) FILTER (WHERE user_scope <> '') AS user_scopes FROM memory""", "memory")
def memory_stats(t: Tables) -> DataFrame:
    memories = t.memory
    return rounded(stats.memory_stats(memories, now_of(memories)), "avg_confidence")


@query("SELECT tier, count(*) AS n FROM memory GROUP BY tier", "memory")
def tier_histogram(t: Tables) -> DataFrame:
    return stats.counts_by(t.memory, "tier")


@query("SELECT name, count(*) AS n FROM memory_tag GROUP BY name ORDER BY n DESC, name LIMIT 10", "memory_tag")
def top_tags(t: Tables) -> DataFrame:
    return stats.top_tags(t.memory_tag)


@query("""
  SELECT m.id, round(coalesce(greatest(0, least(1, avg(score) / 5)), any_value(trust_score)), 6) AS trust_score, count(score) AS feedback_count
  FROM memory m LEFT JOIN memory_feedback f ON m.id = f.memory_id GROUP BY m.id""", "memory", "memory_feedback")
def trust_from_feedback(t: Tables) -> DataFrame:
    return rounded(stats.trust_from_feedback(t.memory, t.memory_feedback), "trust_score")


@query("SELECT peer_id, count(*) FILTER (WHERE score >= 4) AS helpful, count(*) AS total, round((count(*) FILTER (WHERE score >= 4) + 1) / (count(*) + 2), 6) AS reputation FROM memory_feedback GROUP BY peer_id", "memory_feedback")
def peer_reputation_laplace(t: Tables) -> DataFrame:
    return rounded(stats.peer_reputation(t.memory_feedback), "reputation")


@query(f"SELECT id, round({EFF}, 6) AS strength FROM memory", "memory")
def effective_strength(t: Tables) -> DataFrame:
    memories = t.memory
    return memories.select("id", F.round(scoring.effective_strength(F.col("strength"), days(now_of(memories), "updated_at")), 6).alias("strength"))


@query(f"SELECT id, round(CASE WHEN {DAYS_U} > 90 THEN 0.1 ELSE greatest(0.1, least(1.0, trust_score * (1 - 0.005 * {DAYS_U}))) END, 6) AS trust FROM memory", "memory")
def linear_decay(t: Tables) -> DataFrame:
    memories = t.memory
    return memories.select("id", F.round(scoring.linear_decay(F.col("trust_score"), days(now_of(memories), "updated_at")), 6).alias("trust"))


@query(f"SELECT id, round(greatest(0.05, least(1.0, greatest(trust_score, 0.5) * exp(-pow({DAYS_U} / 30.0, 0.8)))), 6) AS trust FROM memory", "memory")
def weibull_decay(t: Tables) -> DataFrame:
    memories = t.memory
    return memories.select("id", F.round(scoring.weibull_decay(F.col("trust_score"), days(now_of(memories), "updated_at")), 6).alias("trust"))


@query(f"SELECT id, round(confidence * (1 + 0.15 * greatest(exp(-pow({DAYS_C} / 7.0, 0.5)), 0.05)), 6) AS score FROM memory", "memory")
def temporal_boost(t: Tables) -> DataFrame:
    memories = t.memory
    return memories.select("id", F.round(scoring.temporal_boost(F.col("confidence"), days(now_of(memories), "created_at")), 6).alias("score"))


@query("SELECT id, round(strength * exp(-0.0231 * 7), 6) AS week, round(strength * exp(-0.0231 * 90), 6) AS quarter FROM memory", "memory")
def forgetting_curve(t: Tables) -> DataFrame:
    curve = scoring.strength_curve(F.col("strength"))
    return t.memory.select("id", curve.alias("c")).select("id", F.round(F.get("c", F.lit(7)), 6).alias("week"), F.round(F.get("c", F.lit(90)), 6).alias("quarter"))


IMPORTANCE = f"""greatest(0, least(1, strength * 0.35 + trust_score * 0.15 + confidence * 0.10 + greatest(0, 1 - {DAYS_C} / 365) * 0.15
    + CASE WHEN {DAYS_U} > 0 THEN greatest(0, 1 - {DAYS_U} / 90) ELSE 0.5 END * 0.10 + least(1.0, access_count / 50.0) * 0.2 * 0.10
    + CASE tier WHEN 'L0' THEN 1.0 WHEN 'L1' THEN 0.7 ELSE 0.4 END * 0.05))"""


@query(f"SELECT id, round({IMPORTANCE}, 6) AS score, CASE WHEN {IMPORTANCE} >= 0.85 THEN 'critical' WHEN {IMPORTANCE} >= 0.65 THEN 'important' WHEN {IMPORTANCE} >= 0.35 THEN 'normal' ELSE 'trivial' END AS label FROM memory", "memory")
def importance_score(t: Tables) -> DataFrame:
    memories = t.memory
    now = now_of(memories)
    score = scoring.importance(F.col("strength"), F.col("trust_score"), F.col("confidence"), F.col("access_count"), F.col("tier"), days(now, "created_at"), days(now, "updated_at"))
    return memories.select("id", F.round(score, 6).alias("score"), scoring.importance_label(score).alias("label"))


@query(f"SELECT id, round(0.6 * greatest(0, 1 - {DAYS_U} / 30) + 0.4 * CASE WHEN {DAYS_C} > 0 THEN least(1, access_count / {DAYS_C} / 2) WHEN access_count = 0 THEN 0 ELSE 0.5 END, 6) AS composite FROM memory", "memory")
def lifecycle_score(t: Tables) -> DataFrame:
    memories = t.memory
    now = now_of(memories)
    return memories.select("id", F.round(scoring.lifecycle(days(now, "created_at"), days(now, "updated_at"), F.col("access_count"))["composite"], 6).alias("composite"))


@query("""
  WITH e AS (SELECT memory_id, 1 + sum(CASE WHEN score >= 4 THEN 1.0 ELSE 0 END) AS a, 1 + sum(CASE WHEN score < 4 THEN 1.0 ELSE 0 END) AS b, count(*) AS n FROM memory_feedback GROUP BY memory_id), c AS (SELECT *, a / (a + b) AS c FROM e)
  SELECT memory_id, round(c, 6) AS confidence, CASE WHEN c >= 0.9 AND n >= 10 THEN 'CERTAIN' WHEN c >= 0.8 AND n >= 3 THEN 'HIGH' WHEN c >= 0.6 AND n >= 3 THEN 'MEDIUM' WHEN c >= 0.4 THEN 'LOW' ELSE 'SPECULATIVE' END AS tier FROM c""", "memory_feedback")
def veracity_tiers(t: Tables) -> DataFrame:
    evidence = t.memory_feedback.select("memory_id", (F.col("score") >= 4).alias("outcome"), F.lit(1.0).alias("weight"))
    return rounded(stats.veracity(evidence).select("memory_id", "confidence", "tier"), "confidence")


@query("SELECT id, round((1 - pow(1 - confidence, greatest(feedback_count, 1))) * (0.5 + 0.5 * trust_score), 6) AS confidence FROM memory", "memory")
def source_compounding(t: Tables) -> DataFrame:
    value = scoring.compounded(F.col("confidence"), F.col("feedback_count")) * scoring.veracity_multiplier(F.col("trust_score"))
    return t.memory.select("id", F.round(value, 6).alias("confidence"))


@query("""
  WITH s AS (SELECT avg(value) AS m1, coalesce(stddev_samp(value), 0) AS s1, avg(length(props)) AS m2, coalesce(stddev_samp(length(props)), 0) AS s2 FROM events),
  z AS (SELECT event_id AS id, 'value' AS metric, value, (value - m1) / greatest(s1, 0.01) AS z FROM events, s UNION ALL SELECT event_id, 'size', length(props), (length(props) - m2) / greatest(s2, 1.0) FROM events, s)
  SELECT CAST(id AS VARCHAR) AS id, metric, value, round(z, 6) AS z FROM z WHERE abs(z) > 3""")
def zscore_anomalies(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").cast("string").alias("id"), "value", F.length("props").alias("size"))
    return rounded(stats.zscore_anomalies(rows, {"value": 0.01, "size": 1.0}), "z")


@query(f"""
  WITH u AS (SELECT id, CASE WHEN feedback_count >= 3 AND trust_score < 0.3 THEN 'discard' WHEN feedback_count = 0 AND trust_score < 0.5 AND {DAYS_U} > 7 THEN 'reinforce' ELSE 'review' END AS action,
    least(1.0, (1 - trust_score) * CASE WHEN {DAYS_U} < 1 THEN 1.5 WHEN {DAYS_U} < 7 THEN 1.2 WHEN {DAYS_U} < 30 THEN 1.0 ELSE 0.8 END
      * CASE WHEN feedback_count >= 3 AND trust_score < 0.3 THEN 1.5 WHEN feedback_count >= 5 AND trust_score < 0.5 THEN 1.2 ELSE 1.0 END) AS urgency FROM memory WHERE is_active)
  SELECT id, action, round(urgency, 6) AS urgency FROM u WHERE urgency >= 0.3 ORDER BY u.urgency DESC, id LIMIT 20""", "memory")
def recommendations(t: Tables) -> DataFrame:
    memories = t.memory
    return rounded(stats.recommendations(memories, now_of(memories)), "urgency")


@query(f"SELECT count(*) AS n, round(avg({DAYS_C}), 4) AS mean_age, round(avg({EFF}), 6) AS mean_strength, count(*) FILTER (WHERE {EFF} < 0.3) AS weak, count(*) FILTER (WHERE {EFF} >= 0.3 AND {EFF} < 0.7) AS medium, count(*) FILTER (WHERE {EFF} >= 0.7) AS strong FROM memory WHERE is_active", "memory")
def memory_health(t: Tables) -> DataFrame:
    memories = t.memory
    found = stats.memory_health(memories, now_of(memories)).select("n", F.round("mean_age", 4).alias("mean_age"), "mean_strength", "weak", "medium", "strong")
    return rounded(found, "mean_strength")


@query("SELECT floor(strength / 0.1) AS bucket, count(*) AS n FROM memory GROUP BY 1", "memory")
def strength_histogram(t: Tables) -> DataFrame:
    return stats.histogram_of(t.memory, F.col("strength"), 0.1)


@query("""
  WITH RECURSIVE g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 6 AS grade FROM events),
  s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 2.5::DOUBLE AS ef, 0::BIGINT AS interval_days, 0::BIGINT AS reps FROM g
    UNION ALL SELECT s.user_id, g.i, greatest(1.3, ef + 0.1 - (5.0 - grade) * (0.08 + (5.0 - grade) * 0.02)),
      CASE WHEN grade < 2 OR reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE greatest(1, floor(interval_days * ef + 0.5)) END::BIGINT, CASE WHEN grade >= 2 THEN reps + 1 ELSE 0 END
    FROM s JOIN g ON s.user_id = g.user_id AND g.i = s.i + 1)
  SELECT user_id, round(max_by(ef, i), 6) AS ef, max_by(interval_days, i) AS interval_days, max_by(reps, i) AS reps FROM s GROUP BY user_id""")
def sm2_fold(t: Tables) -> DataFrame:
    grades = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"] % 6)
    rows = t.events.groupBy("user_id").agg(grades.alias("g"))
    state = rows.select("user_id", scoring.sm2_fold(F.col("g")).alias("s"))
    return state.select("user_id", F.round("s.ef", 6).alias("ef"), F.col("s.interval").alias("interval_days"), F.col("s.reps").alias("reps"))


@query("""
  WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 170) - 85.0 AS lat, (s_suppkey * 91 % 360) - 180.0 AS lon FROM supplier),
  d AS (SELECT s_suppkey, 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 48.0) / 2), 2) + cos(radians(48.0)) * cos(radians(lat)) * pow(sin(radians(lon - 11.0) / 2), 2))) AS km FROM p)
  SELECT s_suppkey, round(km, 4) AS km FROM d WHERE km <= 3000""")
def haversine_radius(t: Tables) -> DataFrame:
    points = t.supplier.select("s_suppkey", ((F.col("s_suppkey") * 37) % 170 - 85.0).alias("lat"), ((F.col("s_suppkey") * 91) % 360 - 180.0).alias("lon"))
    km = scoring.haversine_km(F.lit(48.0), F.lit(11.0), F.col("lat"), F.col("lon"))
    return points.select("s_suppkey", km.alias("km")).where("km <= 3000").select("s_suppkey", F.round("km", 4).alias("km"))


@query("SELECT id, CASE WHEN s >= 0.8 AND a <> 'L0' THEN 'L0' WHEN s >= 0.5 AND a = 'L2' THEN 'L1' WHEN s < 0.2 AND a <> 'L2' THEN 'L2' ELSE a END AS tier FROM (SELECT id, strength AS s, CASE WHEN access_count >= 20 AND tier <> 'L0' THEN 'L0' WHEN access_count >= 5 AND tier = 'L2' THEN 'L1' ELSE tier END AS a FROM memory)", "memory")
def tier_escalation(t: Tables) -> DataFrame:
    return t.memory.select("id", scoring.escalated_tier(F.col("tier"), F.col("access_count"), F.col("strength")).alias("tier"))


@query(f"SELECT id, tier, CASE tier WHEN 'L2' THEN 'L1' ELSE 'L0' END AS new_tier FROM memory WHERE is_active AND updated_at >= {NOW_SQL} - 7 * 86400000000 AND ((tier = 'L2' AND access_count >= 3) OR (tier = 'L1' AND access_count >= 10)) ORDER BY memory.tier DESC, access_count DESC, id LIMIT 20", "memory")
def tier_promotion(t: Tables) -> DataFrame:
    memories = t.memory
    return maintenance.promotions(memories, now_of(memories))


@query(f"""
  WITH s AS (SELECT id, workspace_id, access_count, {DAYS_U} AS idle, 0.5 * greatest(0, 1 - {DAYS_U} / 30) + 0.3 * least(1.0, access_count / 50.0) + 0.2 * confidence AS score FROM memory WHERE is_active AND tier = 'L0'),
  r AS (SELECT *, count(*) OVER (PARTITION BY workspace_id) AS n, row_number() OVER (PARTITION BY workspace_id ORDER BY score, id) AS k FROM s)
  SELECT id, workspace_id, round(score, 6) AS score FROM r WHERE k <= n - 20 AND (idle > 10 OR access_count = 0)""", "memory")
def l0_eviction(t: Tables) -> DataFrame:
    memories = t.memory
    return rounded(maintenance.evictions(memories, now_of(memories), keep=20, idle_days=10), "score")


@query(f"SELECT count(*) AS n FROM memory WHERE is_active AND NOT (expires_at > 0 AND expires_at < {NOW_SQL}) AND NOT (strength < 0.3 AND updated_at < {NOW_SQL} - 7 * 86400000000)", "memory")
def full_maintenance(t: Tables) -> DataFrame:
    memories = t.memory
    return maintenance.full_maintenance(memories, now_of(memories)).where("is_active").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN upper(tier) || '*' ELSE tier END AS tier, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 2 ELSE 1 END AS version FROM memory", "memory")
def update_with_revision(t: Tables) -> DataFrame:
    current = t.memory.withColumn("version", F.lit(1))
    updates = current.where(F.col("num") % 10 == 0).select("id", F.concat("tier", F.lit("*")).alias("tier"))
    return maintenance.update(current, updates, 0)[0].select("id", "tier", "version")


@query("""
  WITH g AS (SELECT num // 50 AS g, workspace_id, string_agg(content, chr(10) ORDER BY id) AS content, max(confidence) AS confidence FROM memory WHERE num % 50 < 2 GROUP BY 1, 2)
  SELECT id, NOT num % 50 < 2 AND is_active AS is_active, sha256(content) AS digest, confidence FROM memory
  UNION ALL SELECT 'consolidated-' || g, true, sha256(content), confidence FROM g""", "memory")
def consolidation_members(t: Tables) -> DataFrame:
    """The first two memories of each fifty go into one of their workspace."""
    memories = t.memory
    groups = memories.where(F.col("num") % 50 < 2).select(F.floor(F.col("num") / 50).alias("group_id"), "id")
    return maintenance.consolidate(memories, groups, 0).select("id", "is_active", F.sha2("content", 256).alias("digest"), "confidence")


@query("SELECT id, used FROM (SELECT id, workspace_id, sum(greatest(octet_length(encode(content)) // 4, 1)) OVER w AS used, row_number() OVER w AS n FROM memory WHERE is_active WINDOW w AS (PARTITION BY workspace_id ORDER BY tier, confidence DESC, strength DESC, id)) WHERE used <= 20000 OR n = 1", "memory")
def token_budget_pack(t: Tables) -> DataFrame:
    return relations.context_pack(t.memory, 20000).select("id", "used")


@query("SELECT id, used FROM (SELECT id, sum(length(content) + 100) OVER w AS used, row_number() OVER w AS n FROM memory WHERE is_active WINDOW w AS (PARTITION BY workspace_id ORDER BY created_at DESC, id)) WHERE used <= 30000 OR n = 1", "memory")
def character_budget_pack(t: Tables) -> DataFrame:
    rows = t.memory.where("is_active").withColumn("score", F.col("confidence"))
    return relations.compressed(rows, 30000, "recency", "workspace_id").select("id", "used")


@query(f"SELECT id, CASE WHEN is_active THEN 'changed' ELSE 'removed' END AS change FROM memory WHERE updated_at > {NOW_SQL} - 10 * 86400000000", "memory")
def delta_pack(t: Tables) -> DataFrame:
    memories = t.memory
    return relations.delta_pack(memories, now_of(memories) - 10 * DAY)


ORDER_EDGE = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS edge_group_id, o_orderkey, concat('status_', o_orderstatus) AS relation, epoch_us(o_orderdate) AS valid_at,
  row_number() OVER w AS version, coalesce(lead(epoch_us(o_orderdate)) OVER w, 0) AS invalid_at FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
AT = 852076800000000  # 1997-01-01


def order_edges(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").cast("string").alias("edge_group_id"), "o_orderkey", F.concat(F.lit("status_"), "o_orderstatus").alias("relation"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_totalprice").alias("weight")
    )
    return relations.versioned(rows, "edge_group_id", "at", "o_orderkey")


@query(f"WITH {ORDER_EDGE} SELECT edge_group_id, version, relation, valid_at, invalid_at FROM o", "memory")
def edge_versions(t: Tables) -> DataFrame:
    return order_edges(t).select("edge_group_id", "version", "relation", "valid_at", "invalid_at")


@query(f"WITH {ORDER_EDGE}, v AS (SELECT *, row_number() OVER (PARTITION BY edge_group_id ORDER BY valid_at DESC, version DESC) AS r FROM o WHERE valid_at <= {AT} AND (invalid_at = 0 OR invalid_at > {AT})) SELECT edge_group_id, version, relation FROM v WHERE r = 1", "memory")
def asof_edge(t: Tables) -> DataFrame:
    return relations.as_of(order_edges(t), AT).select("edge_group_id", "version", "relation")


@query(f"WITH {ORDER_EDGE} SELECT version, relation, valid_at, invalid_at FROM o WHERE edge_group_id = '769'", "memory")
def edge_history(t: Tables) -> DataFrame:
    return relations.edge_history(order_edges(t), "769").select("version", "relation", "valid_at", "invalid_at")


@query(f"WITH {ORDER_EDGE} SELECT edge_group_id, version FROM o WHERE valid_at >= {AT} AND (invalid_at = 0 OR invalid_at >= {AT + 31536000000000})", "memory")
def bitemporal_filter(t: Tables) -> DataFrame:
    from quillion.operators.filters import bitemporal

    return order_edges(t).where(bitemporal(valid_from=AT, invalid_from=AT + 31536000000000)).select("edge_group_id", "version")


@query("""
  SELECT e.event_id, e.user_id, o.o_orderkey AS last_order FROM (SELECT *, ts - INTERVAL 9580 DAY AS t FROM events) e
  ASOF LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, o_orderdate FROM orders GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.t >= o.o_orderdate""")
def asof_join(t: Tables) -> DataFrame:
    left = t.events.withColumn("at", F.col("ts") - F.expr("INTERVAL 9580 DAYS"))
    right = t.orders.groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("last_order"))
    return relations.as_of_join(left, right, "user_id", "at", "o_orderdate", ["last_order"]).select("event_id", "user_id", "last_order")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(t: Tables) -> DataFrame:
    return relations.latest(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts").select("user_id", "event_type", "ts")


@query("SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type")
def first_wins_dedup(t: Tables) -> DataFrame:
    return relations.first_wins(t.events.withColumn("name", F.upper("event_type")), F.lower("name"), "event_id").select("event_type", F.col("event_id").alias("first_id"))


LOG_SQL = "c AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS record_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS operation, epoch_us(ts) AS created_at, props AS data_json FROM events)"


def log_of(t: Tables) -> DataFrame:
    operation = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return t.events.select(
        F.col("event_id").cast("string").alias("id"), F.lit("user").alias("table_name"), operation.alias("operation"), F.col("user_id").cast("string").alias("record_id"), F.col("props").alias("data_json"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at")
    )


@query(f"WITH {LOG_SQL}, l AS (SELECT record_id, max_by(operation, (created_at, id)) AS o, max_by(data_json, (created_at, id)) AS data_json, max(created_at) AS created_at FROM c GROUP BY record_id) SELECT record_id, data_json, created_at FROM l WHERE o <> 'delete'", "memory")
def current_state(t: Tables) -> DataFrame:
    return changes.current_state(log_of(t)).select("record_id", "data_json", "created_at")


@query(f"WITH {LOG_SQL}, m AS (SELECT max(created_at) - 86400000000 AS cut FROM c) SELECT id, operation FROM c, m WHERE created_at > cut", "memory")
def changes_since(t: Tables) -> DataFrame:
    log = log_of(t)
    cut = changes.latest_cursor(log).first()[0] - DAY
    return changes.since(log, cut, "~").select("id", "operation")


@query(f"""
  WITH {LOG_SQL}, f AS (SELECT record_id, max_by((operation, data_json), (created_at, operation)) AS x, max(created_at) AS at FROM c WHERE CAST(record_id AS BIGINT) % 2 = 0 GROUP BY record_id),
  l AS (SELECT DISTINCT record_id, 1704067200000000 + CAST(record_id AS BIGINT) * 3600000000 AS at FROM c WHERE CAST(record_id AS BIGINT) % 3 = 0)
  SELECT coalesce(l.record_id, f.record_id) AS id, CASE WHEN f.at IS NOT NULL AND (l.at IS NULL OR f.at > l.at) THEN f.at ELSE l.at END AS updated_at FROM l FULL JOIN f ON l.record_id = f.record_id
  WHERE NOT (f.at IS NOT NULL AND (l.at IS NULL OR f.at > l.at) AND x[1] = 'delete')""", "memory")
def lww_merge(t: Tables) -> DataFrame:
    log = log_of(t)
    number = F.col("record_id").cast("long")
    local = log.where(number % 3 == 0).select(F.col("record_id").alias("id"), (F.lit(1704067200000000) + number * 3600000000).alias("updated_at"), F.lit("local").alias("data_json")).distinct()
    remote = log.where(number % 2 == 0).select(F.col("record_id").alias("id"), "operation", F.col("created_at").alias("updated_at"), "data_json")
    return changes.replicate(local, remote).select("id", "updated_at")


@query("SELECT peer, count(*) AS pending FROM (SELECT 'p' || event_id % 3 AS peer, event_id FROM events WHERE event_id % 4 <> 0) GROUP BY peer")
def unsynced_status(t: Tables) -> DataFrame:
    log = t.events.select(F.col("event_id").alias("id"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("peer_id"))
    return changes.unsynced(log, log.where("id % 4 = 0")).withColumnRenamed("peer_id", "peer")


@query("""
  WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events),
  n AS (SELECT a.user_id, a.t, min(b.t) AS up FROM e a JOIN e b ON a.user_id = b.user_id AND b.t >= a.t + 86400000000 GROUP BY a.user_id, a.t),
  k AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL SELECT k.user_id, n.up FROM k JOIN n ON k.user_id = n.user_id AND k.t = n.t)
  SELECT CAST(user_id AS VARCHAR) AS dedup_key, t AS created_at FROM k""")
def debounced_jobs(t: Tables) -> DataFrame:
    """Events as jobs of their user, one a day at most."""
    jobs = t.events.select(F.col("user_id").cast("string").alias("dedup_key"), F.col("event_id").cast("string").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))
    return changes.debounced(jobs, DAY).select("dedup_key", "created_at")


@query("SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY 5 - CAST(left(o_orderpriority, 1) AS INT) DESC, o_orderdate, o_orderkey LIMIT 10")
def job_dequeue(t: Tables) -> DataFrame:
    jobs = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), "o_orderpriority", (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderdate").alias("created_at"), F.lit("pending").alias("status"))
    return changes.next_jobs(jobs, 10).select("id", "o_orderpriority")


@query("SELECT role AS peer_id, count(*) AS messages, round(avg(length(text)), 4) AS mean_length, CASE WHEN avg(length(text)) < 50 THEN 'short' WHEN avg(length(text)) < 200 THEN 'medium' ELSE 'long' END AS style FROM conversations GROUP BY role")
def persona_profile(t: Tables) -> DataFrame:
    messages = t.conversations.select(F.col("role").alias("peer_id"), F.col("text").alias("content"))
    types = messages.select("peer_id", F.lit("chat").alias("memory_type"))
    return stats.persona(messages, types).select("peer_id", "messages", F.round("mean_length", 4).alias("mean_length"), "style")


@query("""
  WITH r AS (SELECT label AS query, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), g AS (SELECT label AS query, vec_id AS id FROM embeddings WHERE vec_id % 3 = 0),
  h AS (SELECT r.query, count(*) FILTER (WHERE rank <= 5) AS k, min(rank) AS first FROM r JOIN g USING (query, id) GROUP BY r.query), m AS (SELECT query, count(*) AS m FROM g GROUP BY query)
  SELECT round(avg(coalesce(k, 0) / 5), 6) AS precision, round(avg(coalesce(k, 0) / m), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM m LEFT JOIN h USING (query)""")
def mrr_precision_recall(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    ranked = t.embeddings.select(F.col("label").alias("query"), F.col("vec_id").alias("id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    relevant = t.embeddings.where("vec_id % 3 = 0").select(F.col("label").alias("query"), F.col("vec_id").alias("id"))
    return rounded(stats.ranking_quality(ranked, relevant, 5), "precision", "recall", "mrr")


@query("SELECT id, greatest(octet_length(encode(content)) // 4, 1) AS tokens FROM memory", "memory")
def token_estimates(t: Tables) -> DataFrame:
    return t.memory.select("id", text.token_estimate(F.col("content")).alias("tokens"))
