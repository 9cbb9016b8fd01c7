"""Matching inputs derived from the star-schema tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetmatch.functions.spatial import default_cell_size
from fleetmatch.sources.tables import table

TABLES = ("customer", "supplier", "orders", "events")
_PLACE = "CAST(({k} * 7919 + 17) % 100000 AS INT) AS x, CAST(({k} * 104729 + 29) % 100000 AS INT) AS y"

#: Later ones may use earlier ones by name.
SQL = {
    "shards": "SELECT CAST(id AS INT) AS shard_id FROM {numbers}",
    "riders": f"SELECT c_custkey + 1 AS uid, {_PLACE.replace('{k}', 'c_custkey')}, c_custkey % 10 <> 9 AS online, CAST(c_custkey % 4 AS BIGINT) AS count FROM {{customer}}",
    "riders_small": f"SELECT s_suppkey + 1 AS uid, {_PLACE.replace('{k}', 's_suppkey')}, true AS online, CAST(0 AS BIGINT) AS count FROM {{supplier}}",
    "match_orders": "SELECT o_orderkey + 1 AS order_id, CAST((o_orderkey * 1543 + 71) % 100000 AS INT) AS x, CAST((o_orderkey * 3253 + 83) % 100000 AS INT) AS y, o_orderkey AS seq FROM {orders}",
    "order_status": """SELECT o_orderkey + 1 AS order_id, CAST(o_orderkey % 64 AS INT) AS shard_id,
        CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'missed' ELSE 'match_pending' END AS status,
        CAST((o_orderkey * 1543 + 71) % 100000 AS INT) AS x, CAST((o_orderkey * 3253 + 83) % 100000 AS INT) AS y,
        CAST(o_orderkey % 4 AS INT) AS attempt, CAST(0 AS BIGINT) AS rider_id, CAST(0 AS INT) AS score, '' AS miss_reason, o_orderkey AS updated_at FROM {orders}""",
    "lifecycle": f"""SELECT 'event-' || CAST(event_id AS STRING) AS event_id, event_id AS seq, user_id + 1 AS order_id, CAST(user_id % 64 AS INT) AS shard_id,
        CAST(row_number() OVER (PARTITION BY user_id % 64 ORDER BY event_id) - 1 AS BIGINT) AS offset_value,
        CASE event_type WHEN 'signup' THEN 'order_created' WHEN 'click' THEN 'order_cancelled' WHEN 'view' THEN 'order_retry_request' WHEN 'purchase' THEN 'order_matched' ELSE 'order_missed' END AS event_type,
        'order' AS aggregate_type, CAST(user_id + 1 AS STRING) AS aggregate_id, {{epoch}} AS occurred_at, {_PLACE.replace('{k}', 'event_id')},
        CAST(event_id % 4 AS INT) AS attempt, 'because ' || event_type AS reason, event_id % 1500 + 1 AS rider_id, CAST(event_id % 1000 AS INT) AS score FROM {{events}}""",
    "lifecycle_dup": "SELECT * FROM lifecycle UNION ALL SELECT event_id, seq, order_id, shard_id, offset_value + 1000000 AS offset_value, event_type, aggregate_type, aggregate_id, occurred_at, x, y, attempt, reason, rider_id, score FROM lifecycle WHERE seq % 7 = 0",
    "rider_events": f"""SELECT event_id AS seq, user_id + 1 AS uid, CASE WHEN event_type IN ('signup', 'click') THEN 'online' WHEN event_type IN ('view', 'purchase') THEN 'move' ELSE 'offline' END AS type,
        {_PLACE.replace('{k}', 'event_id')} FROM {{events}}""",
    "checkpoints": """SELECT 'order-worker' AS consumer_name, 'order-events' AS topic, shard_id, CAST(floor((max(offset_value) + 1) / 2) AS BIGINT) AS offset_value,
        CAST(shard_id % 3 + 1 AS BIGINT) AS epoch, CAST(shard_id % 4 + 1 AS INT) AS node_id, CAST(0 AS BIGINT) AS updated_at FROM lifecycle GROUP BY shard_id""",
    "new_checkpoints": """SELECT consumer_name, topic, shard_id, offset_value + shard_id % 5 - 2 AS offset_value, epoch + shard_id % 4 - 1 AS epoch, node_id,
        CAST(shard_id AS BIGINT) AS updated_at FROM checkpoints WHERE shard_id % 9 <> 0 UNION ALL
        SELECT 'matcher-worker' AS consumer_name, topic, shard_id, offset_value, epoch, node_id, updated_at FROM checkpoints""",
    "ownership": "SELECT CAST(id AS INT) AS shard_id, CAST(id % 4 + 1 AS INT) AS node_id, CAST(id % 3 + 1 + CASE WHEN id % 16 = 0 THEN 1 ELSE 0 END AS BIGINT) AS epoch FROM {numbers}",
    "outbox": """SELECT event_id, event_type, aggregate_type, aggregate_id, shard_id, occurred_at, 'p' AS payload, CASE WHEN seq % 3 = 0 THEN NULL ELSE occurred_at END AS published_at,
        CASE WHEN seq % 50 = 0 THEN 'lost-topic' WHEN event_type = 'order_created' THEN 'match-requests' ELSE 'order-events' END AS topic, aggregate_id AS message_key,
        CASE WHEN seq % 5 = 0 THEN 'other' ELSE '' END AS claimed_by, CAST(CASE WHEN seq % 5 = 0 THEN 4000000000 ELSE 0 END AS BIGINT) AS claimed_until, CAST(0 AS INT) AS attempts, '' AS last_error
        FROM lifecycle WHERE event_type IN ('order_created', 'order_retry_request')""",
    "inbox": "SELECT 'order-worker' AS consumer_name, event_id, shard_id, offset_value FROM lifecycle WHERE seq % 4 = 0 UNION ALL SELECT 'matcher-worker' AS consumer_name, event_id, shard_id, offset_value FROM lifecycle WHERE seq % 3 = 0",
    "heartbeats": "SELECT CAST(user_id % 4 + 1 AS INT) AS node_id, ts FROM {events}",
    "counter_samples": "SELECT event_type AS metric, date_trunc('hour', ts) AS ts, CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS DOUBLE) AS value FROM {events} GROUP BY event_type, date_trunc('hour', ts)",
    "keyed": "SELECT o_orderkey + 1 AS key, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'node-' || CAST(o_orderkey % 6 AS STRING) END AS node, CAST(o_orderkey % 3 AS BIGINT) AS epoch FROM {orders}",
    "nodes": "SELECT 'node-' || CAST(id AS STRING) AS node FROM {numbers} WHERE id < 5",
}


def _needed(name: str) -> list[str]:
    uses = [n for n in SQL if n != name and f"FROM {n}" in SQL[name]]
    return [m for n in uses for m in [*_needed(n), n]]


class Inputs:
    """The fixtures over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        parts = dict.fromkeys(_needed(name))
        text = "".join(f"{n} AS ({SQL[n]}), " for n in parts)
        text = (f"WITH {text[:-2]} " if text else "") + SQL[name]
        tables = {t: table(self.spark, self.sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
        if "{numbers}" in text:
            tables["numbers"] = self.spark.range(64)
        return self.spark.sql(text.replace("{epoch}", "unix_timestamp(ts)"), **tables)

    def cell(self) -> int:
        """Default cell size for the number of riders there are."""
        return default_cell_size(self("riders").count())


def duckdb(query: str) -> str:
    """``query`` over the fixtures as one DuckDB statement."""
    parts = ", ".join(f"{n} AS ({s})" for n, s in SQL.items())
    names = {t: t for t in TABLES} | {"numbers": "(SELECT range AS id FROM range(64)) numbers", "epoch": "CAST(floor(epoch(ts)) AS BIGINT)"}
    for k, v in names.items():
        parts = parts.replace(f"{{{k}}}", v)
    return f"WITH RECURSIVE {parts}, {query.strip()[5:]}" if query.strip().upper().startswith("WITH ") else f"WITH RECURSIVE {parts} {query}"
