"""Literal fixtures of cells, rings, tiers, ranking and placement."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetmatch.functions import spatial as S
from fleetmatch.operators import candidates as C
from fleetmatch.operators import placement as P

RING = [(1, 50, 50), (2, 60, 50), (3, 70, 50), (4, 80, 80), (5, 90, 50), (6, 130, 50), (7, 140, 50)]


def riders(spark, rows, count=0):
    return spark.createDataFrame([(u, x, y, True, count) for u, x, y in rows], "uid long, x int, y int, online boolean, count long")


def orders(spark, *rows):
    return spark.createDataFrame([(i, x, y, i) for i, (x, y) in enumerate(rows)], "order_id long, x int, y int, seq long")


def ids(df):
    return sorted(r["rider_id"] for r in df.collect())


def test_rings_are_differences_of_discs(spark):
    o, r = orders(spark, (50, 50)), riders(spark, RING)
    disc = {n: set(ids(C.radius_join(o, r, 10, n))) for n in (1, 3, 8)}
    assert disc[1] == {1, 2}
    assert set(ids(C.ring_join(o, r, 10, 1, 3))) == disc[3] - disc[1] == {3, 4}
    assert set(ids(C.ring_join(o, r, 10, 3, 8))) == disc[8] - disc[3] == {5, 6}


def test_empty_rings(spark):
    o, r = orders(spark, (50, 50)), riders(spark, RING)
    for inner, outer in ((1, 1), (3, 1), (-1, -1)):
        assert ids(C.ring_join(o, r, 10, inner, outer)) == []


def test_cell_ids_do_not_collide(spark):
    r = riders(spark, [(1, 0, 100_000), (2, 1, 0)])
    assert ids(C.radius_join(orders(spark, (1, 0)), r, 1, 0)) == [2]
    assert len({x["cell_id"] for x in S.with_cell(r, 1).collect()}) == 2


def test_cells_truncate_toward_zero(spark):
    row = S.with_cell(riders(spark, [(1, -7, 7)]), 2).first()
    assert (row["cell_x"], row["cell_y"]) == (-3, 3)


def test_rank_by_load_then_distance(spark):
    lay = S.Layout(area=100, cell=10, shards=4)
    r = spark.createDataFrame([(1, 2, 2, True, 1), (2, 8, 8, True, 0)], "uid long, x int, y int, online boolean, count long")
    pool = C.with_score(C.tiered_candidate_join(orders(spark, (1, 1)), r, lay), lay.cell, 1000)
    top = C.top_k_candidates(pool, 2).orderBy("rank").collect()
    assert [x["rider_id"] for x in top] == [2, 1]
    assert C.top_k_candidates(pool, 0).count() == 0


def test_tiers_stop_at_the_first_that_is_not_empty(spark):
    lay = S.Layout(area=1000, cell=10, shards=4)  # shards of 500 x 500
    o = orders(spark, (490, 10))
    near_other, far_home = (1, 505, 10), (2, 440, 10)
    assert ids(C.tiered_candidate_join(o, riders(spark, [near_other, far_home]), lay)) == [2]
    assert ids(C.tiered_candidate_join(o, riders(spark, [near_other]), lay)) == [1]
    active = spark.createDataFrame([(0,)], "shard_id int")
    assert C.tiered_candidate_join(o, riders(spark, [near_other]), lay, active=active).count() == 0


def test_neighbours_of_an_incomplete_grid(spark):
    lay = S.Layout(area=100, cell=10, shards=5)  # three columns, two rows, id 5 missing
    at = spark.createDataFrame([(1,), (9,), (-1,)], "shard_id int")
    assert sorted(r["neighbor"] for r in S.neighbor_shards(at, lay).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r["other"] for r in S.other_shards(spark.createDataFrame([(0,)], "shard_id int"), lay).collect()) == [2]


def test_default_cell_size():
    assert [S.default_cell_size(n) for n in (0, 100, 1000, 10_000)] == [100_000, 44_721, 14_142, 4472]


def test_ring_assignment_by_brute_force(spark):
    import zlib

    names = ["a", "b", "c"]
    points = sorted({zlib.crc32(f"{i}{n}".encode()): n for n in names for i in range(32)}.items())
    keys = spark.range(500).withColumnRenamed("id", "key")
    nodes = spark.createDataFrame([(n,) for n in reversed(names)], "node string")
    for r in P.assign_by_ring(keys, nodes).collect():
        h = zlib.crc32(str(r["key"]).encode())
        assert r["node"] == next((n for p, n in points if p >= h), points[0][1])
    assert {r["node"] for r in P.assign_by_ring(keys, nodes.limit(0)).collect()} == {""}


def test_placement_keeps_owners_on_first_fill(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    target = {r["key"]: r["node"] for r in P.assign_by_ring(spark.range(50).withColumnRenamed("id", "key"), nodes).collect()}
    rows = [(k, None if k % 3 == 0 else "gone" if k % 3 == 1 else n, 4) for k, n in target.items()]
    moves = P.placement_diff(spark.createDataFrame(rows, "key long, node string, epoch long"), nodes).collect()
    assert {m["key"] for m in moves} == {k for k in target if k % 3 != 2}
    assert all(m["to_node"] == target[m["key"]] and m["epoch"] == 5 for m in moves)
    assert sorted(m["rank"] for m in moves if m["kind"] == "fill") == list(range(1, 18))


def test_null_keys_and_many_points_on_the_ring(spark):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(40)], "node string")
    keys = spark.range(300).selectExpr("if(id = 7, null, id) as key", "id")
    out = P.assign_by_ring(keys, nodes, hash_expr=P.md5_prefix).collect()
    assert len(out) == 300 and all(r["node"] for r in out)


def test_nodes_are_checked(spark):
    keyed = spark.createDataFrame([(1, "a", 1)], "key long, node string, epoch long")
    for names in (["a", "a"], ["a", ""], ["a", None]):
        with pytest.raises(ValueError):
            P.placement_diff(keyed, spark.createDataFrame([(n,) for n in names], "node string"))


def test_bad_moves_are_rejected(spark):
    current = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "key long, node string")
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    moves = [(1, "a", "b"), (-1, "a", "b"), (1, "", "b"), (1, "a", None), (1, "a", "a"), (1, "c", "b"), (1, "a", "c"), (3, "a", "b"), (2, "a", "b"), (9, "a", "b")]
    good, bad = P.validate_moves(spark.createDataFrame(moves, "key long, from_node string, to_node string"), current, nodes)
    assert [tuple(r) for r in good.collect()] == [(1, "a", "b")]
    assert sorted((r["key"], r["error"]) for r in bad.collect()) == sorted([
        (-1, "bad key"), (1, "no source node"), (1, "no target node"), (1, "target is the source"), (1, "source node is not alive"), (1, "target node is not alive"),
        (3, "source is not the owner"), (2, "key has no owner"), (9, "key has no owner"),
    ])


def test_shards_are_replaced_and_removed(spark, tmp_path):
    from fleetmatch.sources import shards as H

    lay, path = S.Layout(area=100, cell=10, shards=4), str(tmp_path / "riders")
    H.write_shards(riders(spark, [(1, 5, 5), (2, 15, 15), (3, 95, 5), (4, 95, 95)]), lay, path)
    at = lambda *s: sorted((r["home_shard"], r["uid"]) for r in H.read_shards(spark, path, *s).collect())
    assert at() == [(0, 1), (0, 2), (1, 3), (3, 4)]
    H.replace_shard(riders(spark, [(7, 5, 5)]), path, 0)
    assert at() == [(0, 7), (1, 3), (3, 4)] and at(0) == [(0, 7)]
    H.remove_shard(spark, path, 1)
    H.replace_shard(riders(spark, []), path, 3)
    H.remove_shard(spark, path, 2)
    assert at() == [(0, 7)]


@pytest.mark.parametrize(("weight", "k"), [(10_000, 1), (10_000, 10), (1, 3), (0, 1), (-2, 4), (3, 200)])
def test_bounds_lose_no_candidate(spark, weight, k):
    """Any weight, crowded and empty cells, ties, places on both sides of zero."""
    rng = random.Random(weight + k)
    place = lambda: rng.choice([rng.randrange(-60, 200), rng.randrange(20, 30)])
    orders = spark.createDataFrame([(i, place(), place()) for i in range(120)], "order_id long, x int, y int")
    riders = spark.createDataFrame([(i, place(), place(), rng.choice([0, 0, 1, 5])) for i in range(150)], "uid long, x int, y int, count long")
    cell, keep = 13, ["order_id", "rider_id", "score"]
    rows = lambda df: sorted(map(tuple, df.select(*keep).collect()))
    whole = C.with_score(C.radius_join(orders, riders, cell, 3), cell, weight)
    o, r = C.with_cell(orders, cell), C.with_cell(riders, cell)
    some = C.within_bounds(o, r, C.cell_pairs(o, r, -1, 3), cell, k, weight)
    assert rows(C.top_k_candidates(some, k)) == rows(C.top_k_candidates(whole, k))
    assert some.count() < whole.count() or k == 200
    if k == 1:
        assert rows(C.nearest(orders, riders, cell, 3, weight)) == rows(C.best_rider(whole))


def sent(spark, df):
    """Rows shuffled by the stages that count ``df`` where no join is a broadcast, and the rows there are."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, *[getattr(store, f"stageList$default${i}")() for i in range(2, 6)])
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    rows = df().count()
    new = stages()
    return sum(s.shuffleWriteRecords() for s in map(new.apply, range(new.size())) if s.stageId() not in before), rows


def crowd(spark, n_orders, n_riders, side=60):
    rng = random.Random(5)
    place = lambda: rng.randrange(side)
    o = spark.createDataFrame([(i, place(), place()) for i in range(n_orders)], "order_id long, x int, y int")
    return o, spark.createDataFrame([(i, place(), place(), i % 2) for i in range(n_riders)], "uid long, x int, y int, count long")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.usefixtures("no_broadcast")
@pytest.mark.parametrize(("find", "cells"), [
    (lambda o, r: C.nearest(o, r, 10, 3), 36), (lambda o, r: C.nearest(o, r, 10, 3, inner=1), 36),
    (lambda o, r: C.ranked_pool(o, r, S.Layout(area=60, cell=10, shards=4)), 36), (lambda o, r: C.radius_join(o, r, 10, 1), 9),
])
def test_orders_are_not_copied_to_the_cells_they_see(spark, find, cells):
    o, r = crowd(spark, 3000, 200)
    shuffled, rows = sent(spark, lambda: find(o, r))
    assert rows >= 3000 and shuffled < 3 * (3000 + cells * 200)


@pytest.mark.parametrize(("weight", "k"), [(10_000, 1), (10_000, 10), (1, 3), (0, 1), (-2, 4), (3, 200)])
def test_parts_of_crowds_are_ranked_as_one(spark, monkeypatch, weight, k):
    monkeypatch.setattr(C, "ORDERS", 16)
    o, r = crowd(spark, 300, 200, 30)
    o, r, rows = C.with_cell(o, 10), C.with_cell(r, 10), lambda df: sorted(map(tuple, df.select("order_id", "rider_id", "score", "rank").collect()))
    pairs = C.cell_pairs(o, r, -1, 1)
    want = rows(C.top_k_candidates(C.within_bounds(o, r, pairs, 10, k, weight), k))
    assert rows(C.best_within(o, r, pairs, 10, k, weight)) == want
    monkeypatch.setattr(C, "POOL", 20)
    assert rows(C.best_within(o, r, pairs, 10, k, weight)) == want


@pytest.mark.parametrize(("orders_a_part", "pool", "tile"), [(4096, 65_536, 256), (16, 20, 7), (1, 1, 1), (300, 200, 1000)])
def test_parts_of_crowds_are_paired_as_one(spark, monkeypatch, orders_a_part, pool, tile):
    for name, n in (("ORDERS", orders_a_part), ("POOL", pool), ("TILE", tile)):
        monkeypatch.setattr(C, name, n, raising=False)
    o, r = crowd(spark, 60, 45, 30)
    o, r = o.unionByName(o.limit(5)), r.unionByName(r.limit(5))  # rows that come twice count twice
    ring = lambda a, b: max(abs(a["x"] // 10 - b["x"] // 10), abs(a["y"] // 10 - b["y"] // 10))
    want = sorted((a["order_id"], b["uid"], b["count"], ring(a, b)) for a in o.collect() for b in r.collect() if ring(a, b) <= 1)
    assert sorted(map(tuple, C.radius_join(o, r, 10, 1).select("order_id", "rider_id", "load", "ring").collect())) == want


def test_pairs_of_a_crowd_are_few_bytes_and_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(C, "ORDERS", 500)
    o, r = crowd(spark, 3000, 600, 3000)
    pairs = C.with_score(C.radius_join(o, r, 3000, 1), 3000).select("order_id", "rider_id", "score")
    assert max(x["count"] for x in pairs.groupBy(F.spark_partition_id()).count().collect()) < 0.7 * 3000 * 600
    pairs.write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.35 * 3000 * 600


def test_no_candidates_without_riders_or_places(spark):
    o, r = crowd(spark, 20, 5)
    assert C.nearest(o, r.limit(0), 10, 3).count() == C.nearest(o.limit(0), r, 10, 3).count() == 0
    assert C.ranked_pool(o, r, S.Layout(area=60, cell=10, shards=4), 0).count() == 0
