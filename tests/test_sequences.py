"""Operators whose answer for a row depends on what was decided for the rows before it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetmatch.operators import batches as B
from fleetmatch.operators import checkpoints as K
from fleetmatch.sources.event_log import tail_event_log
from fleetmatch.streaming import streams as S


@pytest.mark.parametrize(("block", "size", "wait"), [(7, 5, 10), (16, 16, 3), (64, 3, 1000), (9, 4, 1)])
def test_batches_by_count_and_wait(spark, monkeypatch, block, size, wait):
    """Shards of several blocks, pauses, records of one moment; batches that reach across blocks."""
    monkeypatch.setattr(B, "BLOCK", block)
    rng, rows, want = random.Random(block), [], {}
    for shard in (0, 3, 4):
        at, number, first, held = 1000, -1, None, 0
        for offset in range({0: 90, 3: 1, 4: 33}[shard]):
            at += rng.choice([0, 0, 1, 2, 4, 11])
            if first is None or held == size or at >= first + wait:
                number, first, held = number + 1, at, 0
            held += 1
            rows.append((shard, offset, at))
            want[shard, offset] = number
    frame = spark.createDataFrame(rows, "shard_id int, offset_value long, arrived_at long").repartition(5)
    out = B.micro_batches(frame, size, wait)
    assert {(r.shard_id, r.offset_value): r.batch_no for r in out.collect()} == want and out.columns == [*frame.columns, "batch_no"]
    assert B.micro_batches(frame.limit(0), size, wait).count() == 0


def test_checkpoints_in_sequence(spark):
    rng = random.Random(4)
    columns = "consumer_name string, topic string, shard_id int, offset_value long, epoch long, node_id int, updated_at long"
    stored = [("c", "t", s, 5, 2, 1, 0) for s in range(3)]
    new = [("c", rng.choice("tu"), rng.randrange(5), rng.randrange(-1, 40), rng.randrange(0, 6), rng.choice([0, 1, 2, 3]), n) for n in range(400)]
    state, want = {r[:3]: r for r in stored}, []
    for r in new:
        had = state.get(r[:3])
        error = "invalid" if r[3] < 0 or r[4] <= 0 or r[5] <= 0 else "stale" if had and (r[3] < had[3] or r[4] < had[4]) else None
        if error:
            want.append((*r, error))
        else:
            state[r[:3]] = r
    saved, bad = K.save_checkpoints_in_sequence(spark.createDataFrame(stored, columns), spark.createDataFrame(new, columns).repartition(6), "updated_at")
    assert sorted(map(tuple, saved.collect())) == sorted(state.values())
    assert sorted(map(tuple, bad.collect())) == sorted(want)


def steps(spark, tmp_path, frames, stream, mode="update"):
    """Rows that a stream tells in each step; it starts anew for every one."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in frames:
        rows.coalesce(1).write.mode("append").parquet(source)
        S.update_log(stream(tail_event_log(spark, source, "parquet", rows.schema)), out, str(tmp_path / "checkpoint"), mode).awaitTermination()
    return spark.read.parquet(out)


def test_owners_die_and_come_back(spark, tmp_path):
    """Dead exactly a TTL after the last beat; owners never heard die too, nodes that own nothing don't."""
    beats = lambda *rows: spark.createDataFrame([(n, s) for n, s in rows], "node_id int, s long").select("node_id", F.timestamp_seconds("s").alias("ts"))
    owners = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "node_id int, since long")
    frames = [beats((1, 5), (2, 5), (9, 5)), beats((1, 14), (9, 14)), beats((9, 15)), beats((2, 18), (9, 24)), beats((9, 25))]
    out = steps(spark, tmp_path, frames, lambda rows: S.stream_dead_owners(rows, owners, 9.2, "0 seconds"))
    got = sorted((r.node_id, r.changes, r.dead, r["at"]) for r in out.collect())
    # the TTL is 10 s: node 3 dies at 10; node 2 at 15 and is back with the beat at 18; node 1 is heard at 14 and dies at 24
    assert got == [(1, 1, True, 24_000), (2, 1, True, 15_000), (2, 2, False, 18_000), (3, 1, True, 10_000)]


def test_counter_rates_across_restarts_and_resets(spark, tmp_path):
    rows = lambda *s: spark.createDataFrame([(m, t, v) for m, t, v in s], "metric string, s long, value double").select("metric", F.timestamp_seconds("s").alias("ts"), "value")
    frames = [rows(("a", 10, 5.0), ("a", 70, 9.0), ("b", 20, 1.0)), rows(("a", 110, 2.0), ("a", 115, 3.0), ("b", 80, 1.0)), rows(("a", 90, 100.0), ("a", 200, 4.0)), rows(("b", 9000, 1.5))]
    out = steps(spark, tmp_path, frames, lambda r: S.stream_counter_rates(r, "60 seconds", "0 seconds"), "append")
    got = sorted((r.metric, r.s, r.increase) for r in out.select("metric", F.unix_timestamp("window_start").alias("s"), "increase").collect())
    assert got == [("a", 0, 0.0), ("a", 60, 4.0 + 2.0 + 1.0), ("a", 180, 1.0), ("b", 0, 0.0), ("b", 60, 0.0)]


def test_stream_dedupe_forgets(spark, tmp_path):
    events = lambda *rows: spark.createDataFrame(rows, "event_id string, occurred_at long")
    frames = [events(("a", 0), ("b", 1), ("a", 2)), events(("b", 1), ("c", 100)), events(("d", 1000)), events(("c", 100), ("e", 990))]
    out = steps(spark, tmp_path, frames, lambda r: B.stream_dedupe(r, "50 seconds"), "append")
    assert sorted(r.event_id for r in out.collect()) == ["a", "b", "c", "d", "e"]
