"""Queries of the spatial operators, candidate joins and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmatch.functions import spatial as S
from fleetmatch.operators import candidates as C
from fleetmatch.operators import placement as P
from fleetmatch.plans.catalog import query
from fleetmatch.sources.fixtures import Inputs
from fleetmatch.sources.shards import read_shards, remove_shard, replace_shard, write_shards
from fleetmatch.sources.tables import scratch, written

RING_CELL = 2000
SIZE = "SELECT CAST(trunc(least(greatest(100000 / sqrt(count(*) / 20.0), 1), 100000)) AS BIGINT) AS s FROM riders"
LAYOUT = f"size AS ({SIZE}), layout AS (SELECT s, (100000 + s - 1) // s AS pa, ((100000 + s - 1) // s + 7) // 8 AS w FROM size)"
SHARD = "CAST(least(63, least(7, greatest(0, least({y} // s, pa - 1)) // w) * 8 + least(7, greatest(0, least({x} // s, pa - 1)) // w)) AS INT)"


def layout(fx: Inputs) -> S.Layout:
    return S.Layout(cell=fx.cell())


@query("g1_with_cell", f"WITH size AS ({SIZE}) SELECT uid, x // s AS cell_x, y // s AS cell_y, ((x // s) << 32) | ((y // s) & 4294967295) AS cell_id FROM riders, size")
def with_cell(fx: Inputs) -> DataFrame:
    return S.with_cell(fx("riders"), fx.cell()).select("uid", "cell_x", "cell_y", "cell_id")


@query("g4_with_shard", f"WITH {LAYOUT} SELECT uid, {SHARD.format(x='x', y='y')} AS home_shard FROM riders, layout")
def with_shard(fx: Inputs) -> DataFrame:
    return S.with_shard(fx("riders"), layout(fx)).select("uid", "home_shard")


NEAR = "SELECT a.shard_id, b.shard_id AS neighbor FROM shards a, shards b WHERE abs(a.shard_id // 8 - b.shard_id // 8) <= 1 AND abs(a.shard_id % 8 - b.shard_id % 8) <= 1"
USED = f"used AS (SELECT DISTINCT {SHARD.format(x='x', y='y')} AS shard_id FROM riders, layout)"


@query("g5_neighbor_shards", f"WITH {LAYOUT}, {USED}, near AS ({NEAR}) SELECT shard_id, neighbor FROM near JOIN used USING (shard_id)")
def neighbor_shards(fx: Inputs) -> DataFrame:
    lay = layout(fx)
    used = S.with_shard(fx("riders"), lay).select(F.col("home_shard").alias("shard_id")).distinct()
    return S.neighbor_shards(used, lay)


@query("g6_other_shards", f"WITH {LAYOUT}, {USED}, near AS ({NEAR}) SELECT u.shard_id, s.shard_id AS other FROM used u, shards s WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.shard_id = u.shard_id AND n.neighbor = s.shard_id)")
def other_shards(fx: Inputs) -> DataFrame:
    lay = layout(fx)
    used = S.with_shard(fx("riders"), lay).select(F.col("home_shard").alias("shard_id")).distinct()
    return S.other_shards(used, lay)


@query("g7_riders_by_shard", f"WITH {LAYOUT} SELECT {SHARD.format(x='x', y='y')} AS home_shard, count(*) AS riders, CAST(sum(CAST(online AS INT)) AS BIGINT) AS online, CAST(sum(uid) AS BIGINT) AS uid_sum FROM riders, layout GROUP BY 1")
def riders_by_shard(fx: Inputs) -> DataFrame:
    return S.with_shard(fx("riders"), layout(fx)).groupBy("home_shard").agg(F.count(F.lit(1)).alias("riders"), F.count_if("online").alias("online"), F.sum("uid").alias("uid_sum"))


@query("g7_replace_shards", f"""WITH {LAYOUT}, p AS (SELECT uid, online, {SHARD.format(x='x', y='y')} AS home_shard FROM riders, layout), e AS (SELECT min(home_shard) AS low, max(home_shard) AS high FROM p)
SELECT uid, home_shard, online AND home_shard <> low AS online FROM p, e WHERE home_shard <> high AND (home_shard <> low OR uid % 2 = 0)""")
def replace_shards(fx: Inputs) -> DataFrame:
    """The first shard's riders replaced by its even ones, gone offline; the last shard removed."""
    lay, path = layout(fx), scratch(fx.spark, "riders")
    write_shards(fx("riders"), lay, path)
    ends = read_shards(fx.spark, path).agg(F.min("home_shard").alias("low"), F.max("home_shard").alias("high")).first()
    new = read_shards(fx.spark, path, ends["low"]).filter("uid % 2 = 0").withColumn("online", F.lit(False))
    replace_shard(written(new), path, ends["low"])
    remove_shard(fx.spark, path, ends["high"])
    return read_shards(fx.spark, path).select("uid", "home_shard", "online")


# pairs of orders and riders in the nine cells around, by plain arithmetic on cells
PAIR = """SELECT o.order_id, o.x, o.y, r.uid AS rider_id, r.x AS rx, r.y AS ry, r.count AS load, greatest(abs(o.x // 2000 - r.x // 2000), abs(o.y // 2000 - r.y // 2000)) AS ring
  FROM match_orders o JOIN riders r ON r.online AND greatest(abs(o.x // 2000 - r.x // 2000), abs(o.y // 2000 - r.y // 2000)) <= 3"""


def online(fx: Inputs) -> DataFrame:
    return fx("riders").filter("online")


@query("j1_ring_join", f"WITH p AS ({PAIR}) SELECT order_id, rider_id FROM p WHERE ring > 1")
def ring_join(fx: Inputs) -> DataFrame:
    return C.ring_join(fx("match_orders"), online(fx), RING_CELL, 1, 3).select("order_id", "rider_id")


@query("j2_radius_join", f"WITH p AS ({PAIR}) SELECT order_id, rider_id FROM p WHERE ring <= 1")
def radius_join(fx: Inputs) -> DataFrame:
    return C.radius_join(fx("match_orders"), online(fx), RING_CELL, 1).select("order_id", "rider_id")


@query("g8_score", f"WITH p AS ({PAIR}) SELECT order_id, rider_id, CAST((abs(x - rx) + abs(y - ry)) // 2000 + load * 10000 AS BIGINT) AS score FROM p WHERE ring <= 1")
def score(fx: Inputs) -> DataFrame:
    pairs = C.radius_join(fx("match_orders"), online(fx), RING_CELL, 1)
    return C.with_score(pairs, RING_CELL).select("order_id", "rider_id", "score")


@query("a1_best_rider", f"WITH p AS ({PAIR}), s AS (SELECT order_id, rider_id, CAST((abs(x - rx) + abs(y - ry)) // 2000 + load * 10000 AS BIGINT) AS score FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY score, rider_id) AS k FROM s) SELECT order_id, rider_id, score FROM n WHERE k = 1")
def best_rider(fx: Inputs) -> DataFrame:
    return C.nearest(fx("match_orders"), online(fx), RING_CELL, 3)


@query("a2_merge_best", f"WITH p AS ({PAIR}), s AS (SELECT order_id, rider_id, CAST((abs(x - rx) + abs(y - ry)) // 2000 + load * 10000 AS BIGINT) AS score FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY score, rider_id) AS k FROM s) SELECT order_id, rider_id, score FROM n WHERE k = 1")
def merge_best(fx: Inputs) -> DataFrame:
    orders, riders = fx("match_orders"), online(fx)
    return C.merge_best(*[C.nearest(orders, riders, RING_CELL, b, inner=a) for a, b in ((-1, 1), (1, 3))])


@query("a3_online_count", "SELECT CAST(sum(CAST(online AS INT)) AS BIGINT) AS online FROM riders")
def online_count(fx: Inputs) -> DataFrame:
    return C.online_count(fx("riders"))


TIERS = f"""{LAYOUT},
oc AS (SELECT DISTINCT x // s AS ox, y // s AS oy FROM match_orders, layout),
rc AS (SELECT DISTINCT x // s AS rcx, y // s AS rcy FROM riders, layout WHERE online),
cp AS (SELECT ox, oy, rcx, rcy, greatest(abs(ox - rcx), abs(oy - rcy)) AS ring, {SHARD.format(x='(ox * s)', y='(oy * s)')} AS h, {SHARD.format(x='(rcx * s)', y='(rcy * s)')} AS a FROM oc, rc, layout),
ct AS (SELECT *, CASE WHEN h = a THEN 0 WHEN abs(h // 8 - a // 8) <= 1 AND abs(h % 8 - a % 8) <= 1 THEN 3 ELSE 6 END + CASE WHEN ring <= 1 THEN 0 WHEN ring <= 3 THEN 1 ELSE 2 END AS tier FROM cp WHERE ring <= 8),
cm AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY ox, oy) AS low FROM ct) WHERE tier = low),
pool AS (SELECT o.order_id, r.uid AS rider_id, tier, CAST((abs(o.x - r.x) + abs(o.y - r.y)) // s + r.count * 10000 AS BIGINT) AS score
  FROM match_orders o CROSS JOIN layout JOIN cm ON cm.ox = o.x // s AND cm.oy = o.y // s JOIN riders r ON r.online AND r.x // s = rcx AND r.y // s = rcy)"""


@query("j3_tiered_candidate_join", f"WITH {TIERS} SELECT order_id, CAST(min(tier) AS INT) AS tier, count(*) AS candidates, CAST(sum(rider_id) AS BIGINT) AS rider_sum FROM pool GROUP BY order_id")
def tiered_candidate_join(fx: Inputs) -> DataFrame:
    pool = C.tiered_candidate_join(fx("match_orders"), online(fx), layout(fx))
    return pool.groupBy("order_id").agg(F.min("tier").cast("int").alias("tier"), F.count(F.lit(1)).alias("candidates"), F.sum("rider_id").alias("rider_sum"))


@query("w1_top_k_candidates", f"WITH {TIERS}, n AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY score, rider_id) AS k FROM pool) SELECT order_id, rider_id, score, CAST(k AS INT) AS rank FROM n WHERE k <= 10")
def top_k_candidates(fx: Inputs) -> DataFrame:
    return C.ranked_pool(fx("match_orders").drop("seq"), online(fx), layout(fx), 10).select("order_id", "rider_id", "score", "rank")


@query("j4_fence_filter", "SELECT shard_id, (shard_id, node_id, epoch) IN (SELECT (shard_id, node_id, epoch) FROM ownership) AS kept, count(*) AS writes FROM (SELECT l.shard_id, CAST(l.shard_id % 4 + 1 AS INT) AS node_id, CAST(l.shard_id % 3 + 1 AS BIGINT) AS epoch FROM lifecycle l) GROUP BY ALL")
def fence_filter(fx: Inputs) -> DataFrame:
    writes = fx("lifecycle").withColumns({"node_id": F.col("shard_id") % 4 + 1, "epoch": (F.col("shard_id") % 3 + 1).cast("long")})
    kept, rejected = C.fence_filter(writes, fx("ownership"))
    both = kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)))
    return both.groupBy("shard_id", "kept").agg(F.count(F.lit(1)).alias("writes"))


HASH = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
RING = f"""pt AS (SELECT {HASH.format("CAST(i AS VARCHAR) || node")} AS point, node, i FROM nodes, (SELECT range AS i FROM range(32))),
ring AS (SELECT point, arg_max(node, node || lpad(CAST(i AS VARCHAR), 3, '0')) AS node FROM pt GROUP BY point),
kh AS (SELECT key, node AS from_node, epoch, {HASH.format("CAST(key AS VARCHAR)")} AS h FROM keyed),
target AS (SELECT key, from_node, epoch, coalesce((SELECT arg_min(node, point) FROM ring WHERE point >= h), (SELECT arg_min(node, point) FROM ring)) AS to_node FROM kh)"""


@query("j7_assign_by_ring", f"WITH {RING} SELECT key, to_node AS node FROM target")
def assign_by_ring(fx: Inputs) -> DataFrame:
    return P.assign_by_ring(fx("keyed").select("key"), fx("nodes"), hash_expr=P.md5_prefix)


@query("j8_placement_diff", f"""WITH {RING}, d AS (SELECT key, from_node, to_node, CASE WHEN from_node IS NULL THEN 'fill' WHEN from_node NOT IN (SELECT node FROM nodes) THEN 'failover' WHEN from_node <> to_node THEN 'rebalance' END AS kind, epoch + 1 AS epoch FROM target)
SELECT key, from_node, to_node, kind, epoch, row_number() OVER (PARTITION BY kind ORDER BY key) AS rank FROM d WHERE kind IS NOT NULL""")
def placement_diff(fx: Inputs) -> DataFrame:
    return P.placement_diff(fx("keyed"), fx("nodes"), hash_expr=P.md5_prefix)


# every proposal that goes wrong in some way: unknown, equal and dead nodes, other owners, keys without one
PROPOSED = """SELECT CASE WHEN key % 101 = 0 THEN -key ELSE key END AS key, CASE WHEN key % 5 = 0 THEN 'node-' || CAST(key % 7 AS STRING) WHEN key % 103 = 0 THEN '' ELSE coalesce(node, 'node-0') END AS from_node,
  CASE WHEN key % 107 = 0 THEN NULL ELSE 'node-' || CAST(key % 8 AS STRING) END AS to_node FROM keyed"""


@query("j8_validate_moves", f"""WITH m AS ({PROPOSED})
SELECT m.key, from_node, to_node, CASE WHEN m.key < 0 THEN 'bad key' WHEN from_node = '' THEN 'no source node' WHEN coalesce(to_node, '') = '' THEN 'no target node' WHEN from_node = to_node THEN 'target is the source'
  WHEN from_node NOT IN (SELECT node FROM nodes) THEN 'source node is not alive' WHEN to_node NOT IN (SELECT node FROM nodes) THEN 'target node is not alive'
  WHEN k.node IS NULL THEN 'key has no owner' WHEN k.node <> from_node THEN 'source is not the owner' ELSE 'good' END AS result FROM m LEFT JOIN keyed k ON k.key = m.key""".replace("AS STRING", "AS VARCHAR"))
def validate_moves(fx: Inputs) -> DataFrame:
    keyed = fx("keyed")
    good, bad = P.validate_moves(fx.spark.sql(PROPOSED.replace("FROM keyed", "FROM {k}"), k=keyed), keyed, fx("nodes"))
    return good.withColumn("result", F.lit("good")).unionByName(bad.withColumnRenamed("error", "result")).select("key", "from_node", "to_node", "result")


@query("a8_placement_balance_all", """WITH o AS (SELECT node, count(*) AS owned FROM keyed WHERE node IS NOT NULL GROUP BY node), t AS (SELECT count(DISTINCT key) FILTER (node IS NOT NULL) AS d, max(key) + 1 AS n FROM keyed)
SELECT n.node, coalesce(owned, 0) AS owned, d AS distinct_owned, greatest(0, t.n - d) AS without_owner, (SELECT count(*) FROM nodes) AS alive FROM nodes n LEFT JOIN o ON o.node = n.node, t""")
def placement_balance_all(fx: Inputs) -> DataFrame:
    n = (fx("keyed").agg(F.max("key")).first()[0] or 0) + 1
    return P.placement_balance(fx("keyed"), fx("nodes"), n)
