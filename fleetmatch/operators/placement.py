"""Buckets for keyed tables on a consistent-hash ring: assignment, differences, balance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmatch.operators.ranks import with_place
from fleetmatch.sources.tables import written

REPLICAS = 32


def crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def md5_prefix(text: Column) -> Column:
    """First 32 bits of the MD5 sum: the same in every SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def ring_points(nodes: DataFrame, replicas: int, hash_expr: Callable[[Column], Column]) -> DataFrame:
    """``point, node``; of nodes on one point the last (by number, then name) counts."""
    many = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("i"))
    hashed = many.select("node", "i", hash_expr(F.concat(F.col("i").cast("string"), F.col("node"))).alias("point"))
    return hashed.groupBy("point").agg(F.max_by("node", F.struct("node", "i")).alias("node"))


SPAN = 1 << 32  # ring hashes have 32 bits


def ring_intervals(points: list[tuple[int, str]], buckets: int) -> list[tuple[int, int, int, str]]:
    """``bucket, low, high, node``: hashes in [low, high] of a bucket of the hash space belong to the node."""
    width, out, low = SPAN // buckets, [], 0
    for point, node in [*points, (SPAN - 1, points[0][1])]:  # past the last point the ring goes on at the first
        for bucket in range(low // width, point // width + 1) if point >= low else ():
            out.append((bucket, max(low, bucket * width), min(point, (bucket + 1) * width - 1), node))
        low = point + 1
    return out


def assign_by_ring(keys: DataFrame, nodes: DataFrame, replicas: int = REPLICAS, hash_expr: Callable[[Column], Column] = crc32) -> DataFrame:
    """``keys`` (column ``key``) with ``node``: the first ring point at or after the key's hash, around the ring.

    '' on an empty ring; a null key has hash 0.  Each key is hashed once and meets the ring by an
    equality join on the top bits of its hash, with as many buckets as points or more, so
    it is compared with one or two intervals.  The ring has nodes times replicas points;
    whether it is broadcast is left to its size.
    """
    points = sorted(tuple(r) for r in ring_points(nodes, replicas, hash_expr).collect())  # nodes times replicas rows
    if not points:
        return keys.withColumn("node", F.lit(""))
    buckets = 1 << max(4, len(points).bit_length())
    ring = keys.sparkSession.createDataFrame(ring_intervals(points, buckets), "_bucket long, _low long, _high long, node string")
    own = F.coalesce(hash_expr(F.col("key").cast("string")), F.lit(0).cast("long"))
    hashed = keys.withColumn("_hash", own).withColumn("_bucket", F.expr(f"_hash div {SPAN // buckets}L"))
    met = hashed.join(ring, (hashed["_bucket"] == ring["_bucket"]) & F.col("_hash").between(F.col("_low"), F.col("_high")))
    return met.select(*[hashed[c] for c in keys.columns], "node")


def check_nodes(nodes: DataFrame) -> None:
    """An error for a ring with nameless or repeated nodes."""
    bad = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or coalesce(node, '') = ''").limit(1).collect()
    if bad:
        raise ValueError(f"node {bad[0]['node']!r} is {'repeated' if bad[0]['node'] else 'nameless'}")


def validate_moves(moves: DataFrame, current: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves (key, from_node, to_node) that can be made, and the others with ``error``.

    A move needs a key of 0 or more, two different nodes that are alive, and the first
    must be the key's current owner.
    """
    alive = nodes.select("node").distinct()
    source, target = (alive.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}")) for c in ("from_node", "to_node"))
    owner = current.filter("node is not null").select("key", F.col("node").alias("_owner"))
    rows = moves.join(source, "from_node", "left").join(target, "to_node", "left").join(owner, "key", "left")
    error = (
        F.when(F.coalesce(F.col("key") < 0, F.lit(True)), "bad key")
        .when(F.coalesce("from_node", F.lit("")) == "", "no source node")
        .when(F.coalesce("to_node", F.lit("")) == "", "no target node")
        .when(F.col("from_node") == F.col("to_node"), "target is the source")
        .when(F.col("_from_node").isNull(), "source node is not alive")
        .when(F.col("_to_node").isNull(), "target node is not alive")
        .when(F.col("_owner").isNull(), "key has no owner")
        .when(F.col("_owner") != F.col("from_node"), "source is not the owner")
    )
    rows = rows.withColumn("error", error)
    return rows.filter("error is null").select(*moves.columns), rows.filter("error is not null").select(*moves.columns, "error")


def placement_diff(current: DataFrame, nodes: DataFrame, replicas: int = REPLICAS, hash_expr: Callable[[Column], Column] = crc32) -> DataFrame:
    """Moves for ``current`` (key, node or null, epoch) to the ring over ``nodes``: key, from_node, to_node, kind, epoch, rank.

    Keys without a node are filled, keys of nodes that are gone fail over, keys whose
    node is not the ring's are rebalanced, in key order; the epoch goes up by one.
    """
    check_nodes(nodes)
    target = assign_by_ring(current.withColumnRenamed("node", "from_node"), nodes, replicas, hash_expr).withColumnRenamed("node", "to_node")
    alive = nodes.select(F.col("node").alias("from_node"), F.lit(True).alias("_alive"))
    rows = target.join(alive, "from_node", "left")
    kind = F.when(F.coalesce("from_node", F.lit("")) == "", "fill").when(F.col("_alive").isNull(), "failover").when(F.col("from_node") != F.col("to_node"), "rebalance")
    rows = written(rows.withColumn("kind", kind).filter("kind is not null and to_node <> ''").select("key", "from_node", "to_node", "kind", (F.coalesce("epoch", F.lit(0)) + 1).cast("long").alias("epoch")))
    return with_place(rows, ["kind"], "key", "rank")


def placement_balance(current: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Per alive node its owned keys, with totals: ``node, owned, distinct_owned, without_owner, alive``."""
    valid = current.filter(F.col("key").between(0, n - 1) & F.col("node").isNotNull())
    owned = current.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("owned"))
    distinct = valid.agg(F.count_distinct("key")).first()[0]
    alive = nodes.agg(F.count_distinct("node")).first()[0]
    per_node = nodes.join(owned, "node", "left").select("node", F.coalesce("owned", F.lit(0)).cast("long").alias("owned"))
    totals = {"distinct_owned": distinct, "without_owner": max(0, n - distinct), "alive": alive}
    return per_node.withColumns({k: F.lit(v).cast("long") for k, v in totals.items()})
