"""Scores, decays and confidence formulas as Column expressions. Times are microseconds; `now` is always passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def days_between(now: int | Column, then: Column) -> Column:
    """Days from then to now, 0 at least."""
    now = F.lit(now) if isinstance(now, int) else now
    return F.greatest((now - then) / F.lit(float(DAY)), F.lit(0.0))


def bm25_idf(df: Column, n: Column) -> Column:
    score = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return F.when((n > 0) & (df > 0), F.greatest(F.lit(0.0), score)).otherwise(0.0)


def bm25_tf(tf: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(mean_length, F.lit(1.0))))


def bm25_tf_plain(tf: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """The client's variant: no (k1 + 1) in the numerator."""
    return tf / (tf + k1 * (1 - b + b * length / F.greatest(mean_length, F.lit(1.0))))


def effective_strength(strength: Column, days: Column) -> Column:
    return strength * F.exp(-0.0231 * days)


def linear_decay(trust: Column, days: Column, rate: float = 0.005, max_days: float = 90.0) -> Column:
    """trust (1 - rate days), within [.1, 1]; the floor past max_days."""
    return F.when(days > max_days, 0.1).otherwise(clamp(trust * (1 - rate * days), 0.1, 1.0))


def weibull_decay(trust: Column, days: Column, scale: float = 30.0, shape: float = 0.8) -> Column:
    return clamp(F.greatest(trust, F.lit(0.5)) * F.exp(-F.pow(days / scale, F.lit(shape))), 0.05, 1.0)


def recency_weight(days: Column, scale: float = 7.0, shape: float = 0.5, floor: float = 0.05) -> Column:
    return F.greatest(F.exp(-F.pow(days / scale, F.lit(shape))), F.lit(floor))


def temporal_boost(score: Column, days: Column, share: float = 0.15) -> Column:
    return score * (1 + share * recency_weight(days))


def strength_curve(strength: Column, days: int = 91) -> Column:
    """Effective strength on each of the coming days."""
    return F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda d: effective_strength(strength, d))


def importance(strength: Column, trust: Column, confidence: Column, access_count: Column, tier: Column, days_created: Column, days_accessed: Column) -> Column:
    """Weighted behaviour signals, within [0, 1]."""
    recency = F.greatest(F.lit(0.0), 1 - days_created / 365)
    access = F.when(days_accessed > 0, F.greatest(F.lit(0.0), 1 - days_accessed / 90)).otherwise(0.5)
    by_tier = F.when(tier == "L0", 1.0).when(tier == "L1", 0.7).when(tier == "L2", 0.4).otherwise(0.5)
    volume = F.least(F.lit(1.0), access_count / 50) * 0.2
    return clamp(strength * 0.35 + trust * 0.15 + confidence * 0.10 + recency * 0.15 + access * 0.10 + volume * 0.10 + by_tier * 0.05)


def importance_label(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.65, "important").when(score >= 0.35, "normal").otherwise("trivial")


def importance_blend(score: Column, importance_score: Column, weight: float) -> Column:
    return score * (1 - weight) + importance_score * weight


def beta_confidence(alpha: Column, beta: Column) -> Column:
    return F.when(alpha + beta > 0, alpha / (alpha + beta)).otherwise(0.5)


def veracity_tier(confidence: Column, evidence: Column) -> Column:
    return (
        F.when((confidence >= 0.9) & (evidence >= 10), "CERTAIN")
        .when((confidence >= 0.8) & (evidence >= 3), "HIGH")
        .when((confidence >= 0.6) & (evidence >= 3), "MEDIUM")
        .when(confidence >= 0.4, "LOW")
        .otherwise("SPECULATIVE")
    )


def compounded(base: Column | float, sources: Column) -> Column:
    """1 - (1 - base)^sources."""
    base = F.lit(base) if isinstance(base, float) else base
    return 1 - F.pow(1 - base, F.greatest(sources, F.lit(1)))


def veracity_multiplier(confidence: Column) -> Column:
    return 0.5 + 0.5 * confidence


def sm2_step(state: Column, grade: Column) -> Column:
    """The next spaced-repetition state struct<ef, interval, reps> for a grade from 0 to 6."""
    q = 5.0 - F.least(grade, F.lit(6))
    ef = F.greatest(state["ef"] + (0.1 - q * (0.08 + q * 0.02)), F.lit(1.3))
    grown = F.greatest(F.floor(state["interval"] * state["ef"] + 0.5), F.lit(1)).cast("long")
    passed = grade >= 2
    interval = F.when(~passed | (state["reps"] == 0), F.lit(1).cast("long")).when(state["reps"] == 1, F.lit(6).cast("long")).otherwise(grown)
    return F.struct(ef.alias("ef"), interval.alias("interval"), F.when(passed, state["reps"] + 1).otherwise(F.lit(0).cast("long")).alias("reps"))


def sm2_fold(grades: Column) -> Column:
    """The state after grades in order, from a new item's (2.5, 0 days, 0 repetitions)."""
    start = F.struct(F.lit(2.5).alias("ef"), F.lit(0).cast("long").alias("interval"), F.lit(0).cast("long").alias("reps"))
    return F.aggregate(grades, start, sm2_step)


def lifecycle(days_created: Column, days_accessed: Column, access_count: Column) -> Column:
    """struct<recency, frequency, composite> of a memory; never accessed: null days."""
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - days_accessed / 30), F.lit(0.0))
    frequency = F.when(days_created > 0, F.least(F.lit(1.0), access_count / days_created / 2)).otherwise(F.when(access_count == 0, 0.0).otherwise(0.5))
    return F.struct(recency.alias("recency"), frequency.alias("frequency"), (0.6 * recency + 0.4 * frequency).alias("composite"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def escalated_tier(tier: Column, access_count: Column, strength: Column) -> Column:
    """Tier after reinforcement: by accesses first, then by strength."""
    by_access = F.when((access_count >= 20) & (tier != "L0"), "L0").when((access_count >= 5) & (tier == "L2"), "L1").otherwise(tier)
    return F.when((strength >= 0.8) & (by_access != "L0"), "L0").when((strength >= 0.5) & (by_access == "L2"), "L1").when((strength < 0.2) & (by_access != "L2"), "L2").otherwise(by_access)


def urgency(trust: Column, feedback: Column, days: Column) -> Column:
    """How soon a memory of low trust should be looked at, 1 at most."""
    age = F.when(days < 1, 1.5).when(days < 7, 1.2).when(days < 30, 1.0).otherwise(0.8)
    penalty = F.when((feedback >= 3) & (trust < 0.3), 1.5).when((feedback >= 5) & (trust < 0.5), 1.2).otherwise(1.0)
    return F.least(F.lit(1.0), (1 - trust) * age * penalty)


def recommended_action(trust: Column, feedback: Column, days: Column) -> Column:
    return F.when((feedback >= 3) & (trust < 0.3), "discard").when((feedback == 0) & (trust < 0.5) & (days > 7), "reinforce").otherwise("review")


def predicted_strength(confidence: Column, days: Column, ahead: float = 30.0, kind: str = "linear") -> Column:
    """struct<now, then, delta>: confidence by decay with age, now and `ahead` days later."""
    decay = (lambda d: F.when(d > 90, 0.1).otherwise(clamp(1 - 0.005 * d, 0.1, 1.0))) if kind == "linear" else (lambda d: clamp(F.exp(-F.pow(d / 30.0, F.lit(0.8))), 0.05, 1.0))
    now, then = confidence * decay(days), confidence * decay(days + ahead)
    return F.struct(now.alias("now"), then.alias("then"), (then - now).alias("delta"))


def cramming(confidence: Column, days: Column, reviews: tuple[int, ...] = (1, 7, 30), horizon: int = 90) -> Column:
    """struct<plain, reviewed, boost>: strength after `horizon` days without reviews, and with them on the given days.

    A review raises the strength by .3 of what it lacks, as a share of itself; reviewed memories
    decay half as fast, from the first day on. Each memory has all of the reviews.
    """
    plain = confidence * F.when(days + horizon > 90, 0.1).otherwise(clamp(1 - 0.005 * (days + horizon), 0.1, 1.0))
    strength = F.aggregate(F.array(*[F.lit(d) for d in sorted(reviews) if d <= horizon]), confidence, lambda s, _: F.least(F.lit(1.0), s * (1.0 + 0.3 * (1.0 - s))))
    reviewed = strength * (0.1 if horizon > 90 else max(0.1, 1 - 0.0025 * horizon))
    return F.struct(plain.alias("plain"), reviewed.alias("reviewed"), (reviewed - plain).alias("boost"))


def card_step(card: Column, grade: Column, now: Column) -> Column:
    """The next state struct<ef, reps, lapses, interval, next> of a card; times in seconds.

    Grades of 0 to 2 are lapses, retried after 600 seconds: a card never recalled starts anew
    with its easiness, another counts a lapse. Higher grades: 1 day, 6 days, then the last interval times
    the easiness.
    """
    q = 5 - grade
    ef = F.greatest(F.lit(1.3), card["ef"] + (0.1 - q * (0.08 + q * 0.02)))
    lapsed, new = grade <= 2, card["reps"] == 0
    reps = card["reps"] + 1
    days = F.when(reps <= 1, 1.0).when(reps == 2, 6.0).otherwise(F.greatest(F.lit(1.0), card["interval"] * ef))
    return F.struct(
        F.when(lapsed & new, card["ef"]).otherwise(ef).alias("ef"),
        F.when(lapsed, F.lit(0).cast("long")).otherwise(reps).alias("reps"),
        (card["lapses"] + (lapsed & ~new).cast("long")).alias("lapses"),
        F.when(lapsed, 0.0).otherwise(days).alias("interval"),
        (now + F.when(lapsed, 600).otherwise(F.floor(days * 86400))).cast("long").alias("next"),
    )


def card_fold(reviews: Column) -> Column:
    """The state after reviews array<struct<at, grade>> (seconds) in order, from a new card's."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(2.5).alias("ef"), zero.alias("reps"), zero.alias("lapses"), F.lit(0.0).alias("interval"), zero.alias("next"))
    return F.aggregate(reviews, start, lambda card, r: card_step(card, r["grade"], r["at"]))


def add_days(now: Column, days: Column) -> Column:
    """A time `days` days on, in microseconds."""
    return now + days * DAY
