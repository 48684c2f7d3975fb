"""Aggregates over memories, feedback, graphs, reviews and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import scoring
from quillion.functions.scoring import DAY


def key_values(row: DataFrame) -> DataFrame:
    """(key, value) text rows of a one-row table."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in row.columns])).alias("x")).select("x.*")


def memory_stats(memories: DataFrame, now: int) -> DataFrame:
    """One row: total, active, by tier, mean confidence and whole days of age of active memories, user scopes."""
    active = F.col("is_active")
    age = F.floor((now - F.col("created_at")) / F.lit(float(DAY)))
    return memories.agg(
        F.count("*").alias("total"),
        F.count_if(active).alias("active"),
        *[F.count_if(active & (F.col("tier") == t)).alias(f"tier_{t.lower()}") for t in ("L0", "L1", "L2")],
        F.avg(F.when(active, F.col("confidence"))).alias("avg_confidence"),
        F.floor(F.avg(F.when(active, age))).alias("avg_age_days"),
        F.count_distinct(F.when(F.col("user_scope") != "", F.col("user_scope"))).alias("user_scopes"),
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def top_tags(memory_tags: DataFrame, k: int = 10) -> DataFrame:
    return counts_by(memory_tags, "name").orderBy(F.desc("n"), "name").limit(k)


def trust_from_feedback(memories: DataFrame, feedback: DataFrame) -> DataFrame:
    """(id, trust_score, feedback_count): mean score over 5, cut to [0, 1]; without feedback the old trust."""
    given = feedback.groupBy("memory_id").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    joined = memories.join(given, memories["id"] == given["memory_id"], "left")
    return joined.select("id", F.coalesce(scoring.clamp(F.col("mean") / 5), "trust_score").alias("trust_score"), F.coalesce("n", F.lit(0)).cast("long").alias("feedback_count"))


def peer_reputation(feedback: DataFrame) -> DataFrame:
    """(peer_id, helpful, total, reputation): (helpful + 1) / (total + 2), helpful from a score of 4."""
    rows = feedback.groupBy("peer_id").agg(F.count_if(F.col("score") >= 4).alias("helpful"), F.count("*").alias("total"))
    return rows.withColumn("reputation", (F.col("helpful") + 1) / (F.col("total") + 2))


def veracity(evidence: DataFrame) -> DataFrame:
    """(memory_id, alpha, beta, confidence, tier) from weighted outcomes (memory_id, outcome, weight), on a Beta(1, 1) prior."""
    rows = evidence.groupBy("memory_id").agg(
        (1 + F.sum(F.when(F.col("outcome"), F.col("weight")).otherwise(0.0))).alias("alpha"), (1 + F.sum(F.when(~F.col("outcome"), F.col("weight")).otherwise(0.0))).alias("beta"), F.count("*").alias("n")
    )
    confidence = scoring.beta_confidence(F.col("alpha"), F.col("beta"))
    return rows.select("memory_id", "alpha", "beta", confidence.alias("confidence"), scoring.veracity_tier(confidence, F.col("n")).alias("tier"))


def zscore_anomalies(df: DataFrame, metrics: dict[str, float], threshold: float = 3.0, least_rows: int = 3) -> DataFrame:
    """(id, metric, value, z) of values more than `threshold` standard deviations from the mean.

    metrics: column and the standard deviation that it is taken to have at least.
    """
    stats = df.agg(F.count("*").alias("_n"), *[F.avg(m).alias(f"_mean_{m}") for m in metrics], *[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"_std_{m}") for m in metrics])
    rows = df.crossJoin(F.broadcast(stats)).where(F.col("_n") >= least_rows)  # one row
    z = lambda m, least: (F.col(m) - F.col(f"_mean_{m}")) / F.greatest(F.col(f"_std_{m}"), F.lit(least))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), z(m, least).alias("z")) for m, least in metrics.items()]))
    return rows.select("id", each.alias("x")).select("id", "x.*").where(F.abs("z") > threshold)


def recommendations(memories: DataFrame, now: int, limit: int = 20, least: float = 0.3) -> DataFrame:
    """(id, action, urgency) of the active memories that most need attention."""
    days = scoring.days_between(now, F.col("updated_at"))
    trust, n = F.col("trust_score"), F.col("feedback_count")
    rows = memories.where("is_active").select("id", scoring.recommended_action(trust, n, days).alias("action"), scoring.urgency(trust, n, days).alias("urgency"))
    return rows.where(F.col("urgency") >= least).orderBy(F.desc("urgency"), "id").limit(limit)


def review_stats(items: DataFrame, now: int) -> DataFrame:
    """One row: active items, due now, mean grade, mean easiness."""
    return items.where("is_active").agg(
        F.count("*").alias("total"), F.count_if(F.col("next_review_at") <= now).alias("due"), F.try_divide(F.sum("grade_sum"), F.sum("grade_count")).alias("mean_grade"), F.avg("easiness_factor").alias("mean_easiness")
    )


def due_reviews(items: DataFrame, now: int, user_id: str | None = None) -> DataFrame:
    due = items.where(F.col("is_active") & (F.col("next_review_at") <= now))
    return (due.where(F.col("user_id") == user_id) if user_id else due).orderBy("next_review_at", "id")


def peer_summary(memories: DataFrame, insights: DataFrame, participants: DataFrame) -> DataFrame:
    """(peer_id, memories, insights, sessions, last_active); the last counts inactive rows too."""
    m = memories.groupBy("peer_id").agg(F.count_if("is_active").alias("memories"), F.max("updated_at").alias("a"))
    i = insights.groupBy("peer_id").agg(F.count_if("is_active").alias("insights"), F.max("created_at").alias("b"))
    s = participants.groupBy("peer_id").agg(F.count_distinct("session_id").alias("sessions"), F.max("joined_at").alias("c"))
    joined = m.join(i, "peer_id", "full").join(s, "peer_id", "full").na.fill(0)
    return joined.select("peer_id", "memories", "insights", "sessions", F.greatest("a", "b", "c").alias("last_active"))


def memory_health(memories: DataFrame, now: int) -> DataFrame:
    """One row: mean age and strength of active memories, strength classes, share updated within 30 days, health."""
    active = memories.where("is_active")
    eff = scoring.effective_strength(F.col("strength"), scoring.days_between(now, F.col("updated_at")))
    fresh = F.avg(F.when(scoring.days_between(now, F.col("updated_at")) <= 30, 1.0).otherwise(0.0))
    return active.agg(
        F.count("*").alias("n"), F.avg(scoring.days_between(now, F.col("created_at"))).alias("mean_age"), F.avg(eff).alias("mean_strength"), F.count_if(eff < 0.3).alias("weak"),
        F.count_if((eff >= 0.3) & (eff < 0.7)).alias("medium"), F.count_if(eff >= 0.7).alias("strong"), fresh.alias("freshness"), (0.6 * F.avg(eff) + 0.4 * fresh).alias("health"),
    )


def histogram_of(df: DataFrame, value: Column, width: float) -> DataFrame:
    return df.groupBy(F.floor(value / width).alias("bucket")).agg(F.count("*").alias("n"))


def persona(messages: DataFrame, types: DataFrame) -> DataFrame:
    """(peer_id, messages, mean_length, style, top_types): style short, medium or long by mean length."""
    lengths = messages.groupBy("peer_id").agg(F.count("*").alias("messages"), F.avg(F.length("content")).alias("mean_length"))
    rank = F.row_number().over(Window.partitionBy("peer_id").orderBy(F.desc("n"), "memory_type"))
    favourite = types.groupBy("peer_id", "memory_type").agg(F.count("*").alias("n")).withColumn("r", rank).where("r <= 3").groupBy("peer_id").agg(F.array_sort(F.collect_list(F.struct("r", "memory_type"))).alias("x"))
    style = F.when(F.col("mean_length") < 50, "short").when(F.col("mean_length") < 200, "medium").otherwise("long")
    return lengths.join(favourite, "peer_id", "left").select("peer_id", "messages", "mean_length", style.alias("style"), F.transform("x", lambda s: s["memory_type"]).alias("top_types"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row of means over queries: precision at k, recall at k, reciprocal rank.

    ranked: (query, id, rank from 1); relevant: (query, id).
    """
    total = relevant.groupBy("query").agg(F.count("*").alias("m"))
    hits = ranked.join(relevant, ["query", "id"], "left_semi").groupBy("query").agg(F.count_if(F.col("rank") <= k).alias("at_k"), F.min("rank").alias("first"))
    rows = total.join(hits, "query", "left").na.fill(0, ["at_k"])
    return rows.agg(F.avg(F.col("at_k") / k).alias("precision"), F.avg(F.col("at_k") / F.col("m")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
