"""Batch changes of memory tables: each takes a table and returns the changed one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import scoring
from quillion.functions.scoring import DAY

DEFAULTS = {"tier": "L1", "strength": 0.5, "trust_score": 0.5, "version": 1, "is_active": True, "access_count": 0, "feedback_count": 0, "expires_at": 0}


def changed(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """df with values where the condition holds."""
    return df.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def insert(current: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """current with the incoming memories, their defaults filled in."""
    rows = incoming
    for name, value in DEFAULTS.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    for name in ("created_at", "updated_at"):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(now)) if name in rows.columns else F.lit(now))
    return current.unionByName(rows, allowMissingColumns=True)


def update(current: DataFrame, updates: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(the table, the revisions): updates (id and new values; null keeps the old) raise the version."""
    fields = [c for c in updates.columns if c != "id"]
    new = updates.select("id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = current.join(new, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    values = {c: F.coalesce(f"_{c}", c) for c in fields} | {"version": F.col("version") + 1, "updated_at": F.lit(now)}
    revisions = joined.where(hit).select(F.col("id").alias("memory_id"), *fields, "version", F.lit(now).alias("changed_at"))
    return changed(joined, hit, values).select(*current.columns), revisions


def deactivate(df: DataFrame, ids: DataFrame, now: int, into: str | None = None) -> DataFrame:
    """Rows of ids (id) inactive, with the row that they went into."""
    joined = df.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    values = {"is_active": F.lit(False), "updated_at": F.lit(now)}
    if into is not None and "consolidated_to" in df.columns:
        values["consolidated_to"] = F.lit(into)
    return changed(joined, F.coalesce("_hit", F.lit(False)), values).select(*df.columns)


def expire(df: DataFrame, now: int) -> DataFrame:
    return changed(df, (F.col("expires_at") > 0) & (F.col("expires_at") < now), {"is_active": F.lit(False)})


def decay_weak(df: DataFrame, now: int, least: float = 0.3, stale_days: int = 7) -> DataFrame:
    """Active memories below a strength that nobody touched for days become inactive."""
    return changed(df, F.col("is_active") & (F.col("strength") < least) & (F.col("updated_at") < now - stale_days * DAY), {"is_active": F.lit(False)})


def decay_trust(df: DataFrame, now: int, kind: str = "linear", **options) -> DataFrame:
    days = scoring.days_between(now, F.col("updated_at"))
    decayed = scoring.linear_decay(F.col("trust_score"), days, **options) if kind == "linear" else scoring.weibull_decay(F.col("trust_score"), days, **options)
    return changed(df, F.col("is_active"), {"trust_score": decayed})


def reinforce(df: DataFrame, accesses: DataFrame, now: int) -> DataFrame:
    """Accesses (id, n) raise counts and strength (.05 each, 1 at most) and may raise the tier."""
    joined = df.join(accesses.groupBy("id").agg(F.sum("n").alias("_n")), "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    count, strength = F.col("access_count") + F.col("_n"), F.least(F.lit(1.0), F.col("strength") + 0.05 * F.col("_n"))
    values = {"tier": scoring.escalated_tier(F.col("tier"), count, strength), "access_count": count, "strength": strength, "updated_at": F.lit(now)}
    hit = F.col("_n") > 0
    return joined.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def escalate(df: DataFrame, l2_to_l1: int = 5, l1_to_l0: int = 20) -> DataFrame:
    tier = F.when((F.col("tier") == "L2") & (F.col("access_count") >= l2_to_l1), "L1").when((F.col("tier") == "L1") & (F.col("access_count") >= l1_to_l0), "L0").otherwise(F.col("tier"))
    return changed(df, F.col("is_active"), {"tier": tier})


def promotions(df: DataFrame, now: int, most: int = 20, days: int = 7) -> DataFrame:
    """(id, tier, new_tier): L2 with 3 accesses and L1 with 10, accessed within days; L2 first, `most` in all."""
    recent = F.col("is_active") & (F.col("updated_at") >= now - days * DAY)
    new = F.when((F.col("tier") == "L2") & (F.col("access_count") >= 3), "L1").when((F.col("tier") == "L1") & (F.col("access_count") >= 10), "L0")
    rows = df.where(recent).select("id", "tier", new.alias("new_tier"), "access_count").where("new_tier is not null")
    return rows.orderBy(F.desc("tier"), F.desc("access_count"), "id").limit(most).select("id", "tier", "new_tier")


def evictions(df: DataFrame, now: int, keep: int = 50, idle_days: int = 30) -> DataFrame:
    """(id, score) of the L0 memories of each workspace to evict: the lowest beyond `keep`, idle or never accessed."""
    idle = scoring.days_between(now, F.col("updated_at"))
    recency = F.greatest(F.lit(0.0), 1 - idle / 30)
    score = 0.5 * recency + 0.3 * F.least(F.lit(1.0), F.col("access_count") / 50) + 0.2 * F.col("confidence")
    w = Window.partitionBy("workspace_id")
    rows = df.where(F.col("is_active") & (F.col("tier") == "L0")).select("id", "workspace_id", "access_count", score.alias("score"), idle.alias("idle"), F.count("*").over(w).alias("n"))
    rows = rows.withColumn("r", F.row_number().over(w.orderBy("score", "id")))
    return rows.where((F.col("r") <= F.col("n") - keep) & ((F.col("idle") > idle_days) | (F.col("access_count") == 0))).select("id", "workspace_id", "score")


def consolidate(df: DataFrame, groups: DataFrame, now: int) -> DataFrame:
    """Members of groups (group_id, id) go inactive, and each group has one new memory of their texts, in order of id."""
    member = df.join(groups, "id")
    new = member.groupBy("group_id", "workspace_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"]), "\n").alias("content"), F.max("confidence").alias("confidence"), F.max("strength").alias("strength")
    )
    new = new.select(F.concat(F.lit("consolidated-"), F.col("group_id").cast("string")).alias("id"), "workspace_id", F.lit("consolidated").alias("memory_type"), "content", "confidence", "strength")
    gone = df.join(groups.select("id", "group_id"), "id", "left")
    out = changed(gone, F.col("group_id").isNotNull(), {"is_active": F.lit(False), "updated_at": F.lit(now)}).select(*df.columns)
    return insert(out, new, now).select(*df.columns)


def full_maintenance(df: DataFrame, now: int) -> DataFrame:
    """Expire, then decay."""
    return decay_weak(expire(df, now), now)


def snapshot_as_of(versions: DataFrame, at: int, key: str = "id", time: str = "updated_at") -> DataFrame:
    """The newest version of each row at a time, of an append-only log of versions."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.desc("version")))
    return versions.where(F.col(time) <= at).withColumn("_r", r).where("_r = 1").drop("_r")


class Pipeline:
    """Named stages, DataFrame to DataFrame, applied in order; hooks run on what each stage returns."""

    def __init__(self, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]] = (), hooks: list[Callable[[str, DataFrame], DataFrame]] = ()):
        self.stages, self.hooks = list(stages), list(hooks)

    def add(self, name: str, stage: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline([*self.stages, (name, stage)], self.hooks)

    def hook(self, call: Callable[[str, DataFrame], DataFrame]) -> Pipeline:
        return Pipeline(self.stages, [*self.hooks, call])

    def run(self, df: DataFrame) -> DataFrame:
        for name, stage in self.stages:
            df = df.transform(stage)
            for call in self.hooks:
                df = call(name, df)
        return df


REGISTRY: dict[str, Callable[..., DataFrame]] = {"expire": expire, "decay_weak": decay_weak, "decay_trust": decay_trust, "escalate": escalate, "full_maintenance": full_maintenance}


def registered(name: str, **config) -> Callable[[DataFrame], DataFrame]:
    """A registered operation with its configuration, as a stage."""
    return lambda df: REGISTRY[name](df, **config)
