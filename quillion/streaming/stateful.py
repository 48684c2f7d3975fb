"""Keyed state with timers: current records and debounced jobs as streams.

Both are in event time. Rows wait in state until the watermark has passed them, so that late and
repeated rows give what the batch forms in changes.py give; what is left in state is bounded by
the watermark's delay, the debouncing window, the time that deleted records are remembered for,
and the records that there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORD = "operation string, data_json string, created_at long, id string"
CURRENT = f"table_name string, record_id string, {RECORD}"
JOB = "dedup_key string, created_at long, id string"


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind, with timers, needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class CurrentRecord(StatefulProcessor):
    """Each record's last change by (created_at, id): a row whenever it changes; a deleted record's state goes after keep_ms."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", RECORD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = best = tuple(self.last.get()) if self.last.exists() else None
        for part in rows:
            for row in part[["operation", "data_json", "created_at", "id"]].itertuples(index=False):
                mine = (row.operation, row.data_json, int(row.created_at), row.id)
                if best is None or (mine[2], mine[3]) > (best[2], best[3]):
                    best = mine
        if best is None or best == before:
            return
        self.last.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best[0] == "delete":
            self.handle.registerTimer(best[2] // 1000 + self.keep_ms)
        yield pd.DataFrame([(*key, *best)], columns=["table_name", "record_id", "operation", "data_json", "created_at", "id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def current_state(changes: DataFrame, late: str = "10 minutes", keep_ms: int = 86_400_000) -> DataFrame:
    """CURRENT rows of a change stream, one whenever a record changes; the last row of a record is its state.

    Changes older than the watermark are dropped. A deleted record is remembered for keep_ms of
    event time, longer than changes can be late, so that a late change doesn't bring it back.
    """
    rows = changes.select("table_name", "record_id", "operation", "data_json", "created_at", "id").withColumn("at", F.timestamp_micros("created_at")).withWatermark("at", late)
    return rows.groupBy("table_name", "record_id").transformWithStateInPandas(CurrentRecord(keep_ms), CURRENT, "Update", "EventTime")


class Debounce(StatefulProcessor):
    """Jobs of a key in order of (created_at, id), each once, once the watermark has passed them; kept `window` microseconds after the last kept one or later."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "created_at long, id string", "seen boolean")
        self.last = handle.getValueState("last", "created_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, job in set(zip(part["created_at"].tolist(), part["id"].tolist(), strict=True)):
                self.waiting.updateValue((at, job), (True,))
                self.handle.registerTimer(at // 1000 + 1)  # a millisecond holds a thousand times
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for at, job in sorted(tuple(k) for k in self.waiting.keys() if k[0] < passed):
            if last is None or at - last >= self.window:
                last = at
                kept.append((key[0], at, job))
            self.waiting.removeKey((at, job))
        if kept:
            self.last.update((last,))
            self.handle.registerTimer((last + self.window) // 1000 + 1)
            yield pd.DataFrame(kept, columns=["dedup_key", "created_at", "id"])
        elif last is not None and passed > last + self.window and not any(True for _ in self.waiting.keys()):
            self.last.clear()  # the window is over and nothing waits: any later job is kept anyway

    def close(self) -> None:
        pass


def debounced(jobs: DataFrame, window: int, late: str = "10 minutes") -> DataFrame:
    """The kept JOB rows of a stream of jobs, when the watermark has passed them; jobs older than the watermark are dropped."""
    rows = jobs.select("dedup_key", "created_at", "id").withColumn("at", F.timestamp_micros("created_at")).withWatermark("at", late)
    return rows.groupBy("dedup_key").transformWithStateInPandas(Debounce(window), JOB, "Append", "EventTime")
