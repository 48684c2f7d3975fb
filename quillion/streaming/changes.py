"""Change data: logs, cursors, current state, windows, replication, debouncing. Batch forms and streams share their logic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillion.schemas import SCHEMAS


def change_rows(df: DataFrame, table: str, operation: str, key: str = "id", now: int = 0) -> DataFrame:
    """A change event with a JSON snapshot for each row."""
    return df.select(
        F.concat_ws("-", F.lit(table), F.col(key).cast("string"), F.lit(operation), F.lit(now).cast("string")).alias("id"), F.lit(table).alias("table_name"), F.lit(operation).alias("operation"),
        F.col(key).cast("string").alias("record_id"), F.to_json(F.struct("*")).alias("data_json"), F.lit(now).cast("long").alias("created_at"), (F.col("workspace_id") if "workspace_id" in df.columns else F.lit(None).cast("string")).alias("workspace_id"),
    )


def append(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").parquet(path)


def stream(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The log as a stream; offsets take the place of cursors."""
    return spark.readStream.schema(schema or SCHEMAS["change_event"]).parquet(path)


def matching(changes: DataFrame, table: str = "*", operation: str = "*", workspace_id: str | None = None) -> DataFrame:
    """Changes of a table and an operation; "*" takes all."""
    if table != "*":
        changes = changes.where(F.col("table_name") == table)
    if operation != "*":
        changes = changes.where(F.col("operation") == operation)
    return changes.where(F.col("workspace_id") == workspace_id) if workspace_id is not None else changes


def since(changes: DataFrame, cursor: int, tie: str = "") -> DataFrame:
    """Changes after (created_at, id) in order, so that none of one microsecond is lost."""
    return changes.where((F.col("created_at") > cursor) | ((F.col("created_at") == cursor) & (F.col("id") > tie))).orderBy("created_at", "id")


def latest_cursor(changes: DataFrame) -> DataFrame:
    return changes.agg(F.max("created_at").alias("cursor"))


def retained(changes: DataFrame, cutoff: int) -> DataFrame:
    return changes.where(F.col("created_at") >= cutoff)


def dispatch(changes: DataFrame, handlers: dict[tuple[str, str], Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """Run the stream to its end; each batch's rows go to the handlers of their (table, operation)."""

    def run(batch: DataFrame, _: int) -> None:
        for (table, operation), handler in handlers.items():
            handler(matching(batch, table, operation))

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(changes: DataFrame) -> DataFrame:
    """(table_name, record_id, data_json, created_at): each record's last change, deleted ones left out."""
    last = changes.groupBy("table_name", "record_id").agg(F.max_by(F.struct("operation", "data_json", "created_at"), F.struct("created_at", "id")).alias("x")).select("table_name", "record_id", "x.*")
    return last.where("operation <> 'delete'").select("table_name", "record_id", "data_json", "created_at")


def replicate(local: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """local after remote changes (operation, key, updated_at and values): the last writer wins, an equal time keeps the local row."""
    values = [c for c in local.columns if c != key]
    mine = local.select(key, F.struct(F.lit(True).alias("here"), *values).alias("m"))
    theirs = remote.groupBy(key).agg(F.max_by(F.struct("operation", *values), F.struct("updated_at", "operation")).alias("t"))
    joined = mine.join(theirs, key, "full")
    newer = F.col("t").isNotNull() & (F.col("m").isNull() | (F.col("t.updated_at") > F.col("m.updated_at")))
    gone = newer & (F.col("t.operation") == "delete")
    return joined.where(~gone).select(key, *[F.when(newer, F.col(f"t.{c}")).otherwise(F.col(f"m.{c}")).alias(c) for c in values])


def unsynced(log: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """(peer_id, pending): log rows (id, peer_id) that the peer hasn't acknowledged."""
    return log.join(acknowledged, ["id", "peer_id"], "left_anti").groupBy("peer_id").agg(F.count("*").alias("pending"))


def debounced(jobs: DataFrame, window: int) -> DataFrame:
    """Jobs (dedup_key, created_at, id) that come `window` or more microseconds after the last one of their key that was kept.

    Whether a job is kept depends on all kept before it, so a key's jobs pass one task in order
    of time, in Arrow batches: it holds a batch and, for its keys, the last time kept.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for rows in batches:
            stay = []
            for k, at in zip(rows["dedup_key"].tolist(), rows["created_at"].tolist(), strict=True):
                new = k != key or last is None or at - last >= window
                if new:
                    key, last = k, at
                stay.append(new)
            yield rows[stay]

    ordered = jobs.select("dedup_key", "created_at", "id").repartition("dedup_key").sortWithinPartitions("dedup_key", "created_at", "id")
    return ordered.mapInPandas(keep, ordered.schema)


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """Pending jobs to take: highest priority, then oldest."""
    return jobs.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(n)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """(start, end, event_type, n, total) by event time; as a stream, rows later than `late` are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def session_windows(events: DataFrame, gap: str, by: str = "user_id", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """(by, start, end, n) of runs of events without a gap; a stream drops rows later than `late`."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(by, "w.start", "w.end", "n")


def sessions_by_gap(events: DataFrame, seconds: int, by: str = "user_id", time: str = "ts") -> DataFrame:
    """(by, session, start, end, n) by a running count of gaps: the batch form with numbers."""
    w = Window.partitionBy(by).orderBy(time)
    new = F.coalesce((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp")) > seconds * 1_000_000).cast("int"), F.lit(0))
    rows = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return rows.groupBy(by, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))
