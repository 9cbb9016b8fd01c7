"""Logs that are tailed and appended to across restarts and failures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetmatch.sources import event_log as L

LOG = "shard_id int, offset_value long, event_id string"


def run(spark, rows, schema, source, stream):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    q = stream()
    q.awaitTermination()


def test_tail_starts_at_checkpoints_and_goes_on(spark, tmp_path):
    from fleetmatch.streaming.streams import update_log

    rng, source, out = random.Random(1), str(tmp_path / "log"), str(tmp_path / "out")
    rows = [(s, o, f"e{s}-{o}") for s in range(4) for o in range(60)]
    known = spark.createDataFrame([(0, 25), (1, 0), (2, 200)], "shard_id int, offset_value long")  # shard 3 has none
    steps = [[r for r in rows if r[1] < 30], [r for r in rows if 30 <= r[1] < 45], [r for r in rows if r[1] >= 45]]
    for step in steps:
        tail = lambda: update_log(L.tail_event_log(spark, source, "parquet", LOG, known), out, str(tmp_path / "checkpoint"), "append")
        run(spark, rng.sample(step, len(step)), LOG, source, tail)
        known = known.withColumn("offset_value", F.col("offset_value"))
    got = sorted((r.shard_id, r.offset_value) for r in spark.read.parquet(out).collect())
    want = L.read_from_positions(spark.createDataFrame(rows, LOG), known)
    assert got == sorted((r.shard_id, r.offset_value) for r in want.collect()) and len(got) == 35 + 60 + 60
    assert not {r.event_id for r in spark.read.parquet(f"{out}/batch=1").collect()} & {r.event_id for r in spark.read.parquet(f"{out}/batch=0").collect()}
    no_positions = L.tail_event_log(spark, source, "parquet", LOG, known.limit(0))
    update_log(no_positions, out + "2", str(tmp_path / "checkpoint2"), "append").awaitTermination()
    assert spark.read.parquet(out + "2").count() == 240


def test_appended_offsets_stay_dense_after_failures(spark, tmp_path, monkeypatch):
    """A crash after the records are written and ahead of the ledger: nothing is seen of it, and the batch is done again."""
    source, path, checkpoint, schema = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "checkpoint"), "event_id string, seq long, key string"
    read = lambda: sorted(tuple(r) for r in L.read_appended(spark, path, f"{schema}, shard_id int, offset_value long").select("shard_id", "offset_value", "event_id").collect())
    stream = lambda: L.append_stream(spark.readStream.schema(schema).parquet(source), path, ["seq", "event_id"], checkpoint, "key", [0, 1, 2])
    run(spark, [("a", 5, "1"), ("b", 3, "1"), ("c", 1, "2"), ("d", 9, "other")], schema, source, stream)
    first = [(0, 0, "d"), (1, 0, "b"), (1, 1, "a"), (2, 0, "c")]
    assert read() == first

    calls = [0]
    real = L._appended

    def failing(ends, new, order_by):
        out = real(ends, new, order_by)
        calls[0] += 1
        if calls[0] == 1:  # leaves records of a batch without ledger entry
            out.withColumn("offset_value", F.lit(99).cast("long")).write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/batch=1")
            raise RuntimeError("executor lost")
        return out

    monkeypatch.setattr(L, "_appended", failing)
    with pytest.raises(Exception, match="executor lost"):
        run(spark, [("e", 1, "1"), ("f", 1, "2"), ("g", 0, "1")], schema, source, stream)
    assert read() == first
    stream().awaitTermination()
    assert read() == sorted([*first, (1, 2, "g"), (1, 3, "e"), (2, 1, "f")])
    run(spark, [], schema, source, stream)
    run(spark, [("h", 0, "2")], schema, source, stream)
    assert read() == sorted([*first, (1, 2, "g"), (1, 3, "e"), (2, 1, "f"), (2, 2, "h")])
