"""Operators and queries that must cover every row of their input."""

from __future__ import annotations

import random

import pytest

from fleetmatch.functions.spatial import Layout
from fleetmatch.operators import matching as M
from fleetmatch.plans.catalog import ORACLES, QUERIES
from fleetmatch.streaming import streams as S
from tests.conftest import assert_same

ROWS = "is_order boolean, seq long, order_id long, x int, y int, load long"


def matched_stream(spark, tmp_path, lay, steps):
    """Outcomes of a stream to which ``steps`` arrive one after the other."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step in steps:
        spark.createDataFrame(step, ROWS).write.mode("append").parquet(source)
        S.stream_match(spark.readStream.schema(ROWS).parquet(source), lay, out, str(tmp_path / "checkpoint")).awaitTermination()
    return [tuple(r) for r in spark.read.schema(M.OUTCOME).parquet(out).select("order_id", "rider_id", "score", "home_shard").collect()]


def test_stream_match_is_match_orders(spark, tmp_path):
    rng = random.Random(4)
    lay = Layout(area=1000, cell=60, shards=9)
    # riders in the left third only: home shards further right are empty, the last ones out of reach
    riders = [(False, 0, i, rng.randrange(330), rng.randrange(1000), 0) for i in range(25)]
    orders = [(True, i, 1000 + i, rng.randrange(1000), rng.randrange(1000), 0) for i in range(120)]
    r = spark.createDataFrame([(u, x, y, True, 0) for _, _, u, x, y, _ in riders], S.RIDERS)
    o = lambda rows: spark.createDataFrame([(i, x, y, seq) for _, seq, i, x, y, _ in rows], "order_id long, x int, y int, seq long")
    first = [tuple(x) for x in M.match_orders(o(orders[:60]), r, lay).collect()]
    load: dict[int, int] = {}
    for _, rider, *_ in first:
        load[rider] = load.get(rider, 0) + 1
    held = spark.createDataFrame([(u, x, y, True, load.get(u, 0)) for _, _, u, x, y, _ in riders], S.RIDERS)
    want = first + [tuple(x) for x in M.match_orders(o(orders[60:]), held, lay).collect()]
    got = matched_stream(spark, tmp_path, lay, [riders, orders[:60], orders[60:]])
    assert sorted(x[0] for x in got) == [x[2] for x in orders]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    homes = {x[3] for x in M.match_orders(o([(True, 0, u, x, y, 0) for _, _, u, x, y, _ in riders]), r, lay).collect()}
    assert any(rider is not None and home not in homes for _, rider, _, home in got)  # matched across shards
    assert any(rider is None for _, rider, *_ in got)


LARGER = "/root/testdata/sf0.01"  # 15,000 orders


@pytest.mark.parametrize("name", ["a4_order_result_summary_all", "a12_capacity_report_all", "w4_list_missed_for_retry_all", "w6_pending_outbox_all", "a8_placement_balance_all"])
def test_whole_tables(spark, name):
    assert_same(QUERIES[name](spark, LARGER), ORACLES[name], LARGER)


def test_every_order_is_counted(spark):
    orders = spark.read.parquet(f"{LARGER}/orders.parquet").count()
    assert QUERIES["a4_order_result_summary_all"](spark, LARGER).first()["created"] == orders > 10_000
