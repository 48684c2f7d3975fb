"""Stateful streams equal their batch forms, over late and repeated rows and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from quillion.streaming import changes, stateful

SECOND = 1_000_000
CHANGE = "id string, table_name string, operation string, record_id string, data_json string, created_at long, workspace_id string"


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def fed(spark, rows, schema, path, transform, name, batches, mode):
    """Run a query over one file a batch, with a restart after each file; the rows it gave."""
    source, target, state = (str(path / x) for x in ("in", "out", "state"))
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(source)

        def put(batch, _):
            batch.write.mode("append").parquet(target)

        stream = transform(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(target)


def test_current_state_with_late_and_repeated_rows(spark, tmp_path):
    draw = random.Random(3)
    rows = []
    for i in range(120):
        at = (100 + i * 2 - draw.randrange(0, 30)) * SECOND
        rows.append((f"c{i:03d}", "memory", draw.choice(["insert", "update", "update", "delete"]), f"m{draw.randrange(9)}", f'{{"v":{i}}}', at, "w"))
    rows += rows[60:70]
    got = fed(spark, rows, CHANGE, tmp_path, lambda s: stateful.current_state(s, "5 minutes"), "now", 3, "update").collect()
    last = {}
    for r in got:
        best = last.get((r.table_name, r.record_id))
        if best is None or (r.created_at, r.id) > (best.created_at, best.id):
            last[r.table_name, r.record_id] = r
    want = changes.current_state(spark.createDataFrame(rows, CHANGE)).collect()
    assert {(r.table_name, r.record_id, r.data_json, r.created_at) for r in last.values() if r.operation != "delete"} == {tuple(r) for r in want}
    assert len(got) < len(rows)  # rows that change nothing give nothing


def test_debounced_stream_is_the_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = [(f"k{draw.randrange(4)}", (1000 + i * 3 - draw.randrange(0, 40)) * SECOND + draw.randrange(1000), f"j{i:03d}") for i in range(150)]
    rows += rows[20:30] + [("k1", rows[10][1], "tie")]
    end = [("end", 10_000_000 * SECOND, "end")]
    window = 25 * SECOND
    got = fed(spark, rows + end, stateful.JOB, tmp_path, lambda s: stateful.debounced(s, window, "20 minutes"), "jobs", 3, "append")
    want = changes.debounced(spark.createDataFrame(rows, stateful.JOB).distinct(), window)
    assert sorted(map(tuple, got.where("dedup_key <> 'end'").collect())) == sorted(map(tuple, want.collect()))
    assert 0 < got.count() < len(rows)
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state"))
    assert state.where(F.col("key.dedup_key") != "end").count() == 0 if "dedup_key" in str(state.schema) else state.count() <= 1
