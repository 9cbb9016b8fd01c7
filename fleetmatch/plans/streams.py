"""Queries of the streaming operators, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmatch import schemas
from fleetmatch.operators.matching import OUTCOME
from fleetmatch.plans.catalog import query
from fleetmatch.plans.events import NOW
from fleetmatch.plans.reports import INCREASE
from fleetmatch.plans.spatial import layout, online
from fleetmatch.plans.state import ONCE, RIDERS, folded
from fleetmatch.sources.event_log import tail_event_log
from fleetmatch.sources.fixtures import Inputs
from fleetmatch.sources.runs import ddl
from fleetmatch.sources.tables import scratch, written
from fleetmatch.streaming import streams as S


#: Files that each step of arrivals is written to, side by side.
FILES = 4


KNOWN = [schemas.MATCH_REQUESTS, schemas.ORDER_EVENTS]


def arrivals(fx: Inputs, rows: DataFrame, parts: list[str], *key: str, checkpoints: DataFrame | None = None, files: int = FILES) -> DataFrame:
    """``rows`` as a stream that gets the rows of one condition after the other; rows of a ``key`` lie in one file."""
    path = scratch(fx.spark, "arrivals")
    for condition in parts:
        rows.filter(condition).repartition(files, *key).write.mode("append").parquet(path)
    return tail_event_log(fx.spark, path, "parquet", rows.schema, checkpoints, maxFilesPerTrigger=str(files))


def files_for(fx: Inputs, rows: int) -> int:
    """Files of a step of ``rows`` rows or more: one a core, where each gets thousands, so that none stays empty."""
    return max(FILES, min(fx.spark.sparkContext.defaultParallelism, rows // 10_000))


def changes(fx: Inputs, stream: DataFrame, mode: str = "update") -> DataFrame:
    path = scratch(fx.spark, "changes")
    done = S.update_log(stream, path, scratch(fx.spark, "stream"), mode)
    done.awaitTermination()
    return fx.spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def latest(rows: DataFrame, key: str) -> DataFrame:
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("s"))
    return best.select(key, *[F.col(f"s.{c}").alias(c) for c in rows.columns if c not in (key, "version")])


def halves(fx: Inputs, name: str, column: str) -> tuple[DataFrame, list[str]]:
    rows = fx(name)
    cut = (rows.agg(F.max(column)).first()[0] or 0) // 2
    return rows, [f"{column} <= {cut}", f"{column} > {cut}"]


def order_log(fx: Inputs) -> DataFrame:
    """The log of orders as a stream: each half, and then the events of it that come a second time."""
    rows = written(fx("lifecycle_dup"))  # put in sequence once, not for each step
    cut = (rows.agg(F.max("seq")).first()[0] or 0) // 2
    again = [f"(seq {half} {cut}) and offset_value {sign} 1000000" for half in ("<=", ">") for sign in ("<", ">=")]
    return arrivals(fx, rows, again, "order_id", files=files_for(fx, rows.count() // 16))


@query("t1_stream_order_state", folded(ONCE, True))
def stream_order_state(fx: Inputs) -> DataFrame:
    columns = [f.split()[0] for f in S.ORDER_ROW.split(", ")]
    return latest(changes(fx, S.stream_order_state(order_log(fx))).filter("changed").select(*columns), "order_id")


APPLIED = f"""WITH n AS (SELECT *, first(event_type) OVER (PARTITION BY order_id ORDER BY shard_id, offset_value) AS opening FROM ({ONCE})),
c AS (SELECT *, last(CASE WHEN event_type = 'order_created' AND k = 1 THEN seq END IGNORE NULLS) OVER (PARTITION BY order_id ORDER BY k) AS placed FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY offset_value) AS k FROM n WHERE opening <> 'order_retry_request'))
SELECT event_id || '-match-requested' AS event_id, 'match-requests' AS topic, CAST(order_id AS VARCHAR) AS message_key, shard_id, occurred_at,
  '{{"OrderID":' || order_id || ',"X":' || CASE WHEN placed IS NULL THEN 0 ELSE (placed * 7919 + 17) % 100000 END || ',"Y":' || CASE WHEN placed IS NULL THEN 0 ELSE (placed * 104729 + 29) % 100000 END || ',"Attempt":' || CASE WHEN event_type = 'order_retry_request' THEN attempt ELSE 0 END || '}}' AS payload
FROM c WHERE event_type IN ('order_created', 'order_retry_request')"""


def applied(fx: Inputs, table: str, schema: str) -> DataFrame:
    path = scratch(fx.spark, "applied")
    S.apply_order_stream(order_log(fx), path, scratch(fx.spark, "stream")).awaitTermination()
    return fx.spark.read.schema(schema).parquet(f"{path}/{table}")


@query("t1_stream_match_requests", APPLIED)
def stream_match_requests(fx: Inputs) -> DataFrame:
    return applied(fx, "outbox", S.OUTBOX_ROW).select("event_id", "topic", "message_key", "shard_id", "occurred_at", "payload")


@query("t1_stream_positions", "SELECT shard_id, max(offset_value) + 1 AS offset_value FROM lifecycle_dup GROUP BY shard_id")
def stream_positions(fx: Inputs) -> DataFrame:
    return applied(fx, "positions", S.POSITION_ROW).groupBy("shard_id").agg(F.max("offset_value").alias("offset_value"))


@query("t3_stream_rider_state", RIDERS + "online IS NOT NULL")
def stream_rider_state(fx: Inputs) -> DataFrame:
    rows, parts = halves(fx, "rider_events", "seq")
    files = files_for(fx, rows.select("uid").distinct().count() // 2)
    return latest(changes(fx, S.stream_rider_state(arrivals(fx, rows, parts, "uid", files=files))), "uid")


@query("t2_stream_match")
def stream_match(fx: Inputs) -> DataFrame:
    orders, path = fx("match_orders"), scratch(fx.spark, "matches")
    load = F.lit(0).cast("long").alias("load")
    left = orders.select(F.lit(True).alias("is_order"), "seq", "order_id", "x", "y", load)
    right = online(fx).select(F.lit(False).alias("is_order"), F.lit(0).cast("long").alias("seq"), F.col("uid").alias("order_id"), "x", "y", load)
    cut = (orders.agg(F.max("seq")).first()[0] or 0) // 2
    files = files_for(fx, min(left.count() // 2, right.count()))
    rows = arrivals(fx, right.unionByName(left), ["not is_order", f"is_order and seq <= {cut}", f"is_order and seq > {cut}"], "order_id", files=files)
    S.stream_match(rows, layout(fx), path, scratch(fx.spark, "stream")).awaitTermination()
    return fx.spark.read.schema(OUTCOME).parquet(path).select("order_id", "rider_id", "score", "home_shard")


@query("t5_publish_outbox_stream", "SELECT topic, count(*) AS events, count(DISTINCT event_id) AS ids FROM outbox WHERE published_at IS NULL AND topic <> 'lost-topic' GROUP BY topic")
def publish_outbox_stream(fx: Inputs) -> DataFrame:
    rows, path = fx("outbox"), scratch(fx.spark, "topics")
    stream = arrivals(fx, rows, ["shard_id < 32", "shard_id >= 32"], "event_id")
    late = lambda: 5_000_000_000  # noqa: E731  when every lease has run out
    S.publish_outbox_stream(stream, path, KNOWN, scratch(fx.spark, "stream"), clock=late).awaitTermination()
    return fx.spark.read.parquet(path).groupBy("topic").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"))


@query("t5_outbox_after_publishing", f"""WITH c AS (SELECT *, published_at IS NULL AND claimed_until < {NOW} AS free FROM outbox)
SELECT event_id, CASE WHEN free AND topic <> 'lost-topic' THEN {NOW} ELSE published_at END AS published_at, CASE WHEN free THEN '' ELSE claimed_by END AS claimed_by,
  CASE WHEN free AND topic = 'lost-topic' THEN 'unknown topic lost-topic' ELSE last_error END AS last_error FROM c""")
def outbox_after_publishing(fx: Inputs) -> DataFrame:
    rows, path = fx("outbox"), scratch(fx.spark, "topics")
    stream = arrivals(fx, rows, ["shard_id < 32", "shard_id >= 32"], "event_id")
    S.publish_outbox_stream(stream, path, KNOWN, scratch(fx.spark, "stream"), clock=lambda: NOW).awaitTermination()
    return S.kept_outbox(fx.spark, path, ddl(rows)).rows().select("event_id", "published_at", "claimed_by", "last_error")


@query("t7_stream_sustained_breach", f"""WITH {INCREASE}, b AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts) - row_number() OVER (PARTITION BY metric, increase >= 3 ORDER BY ts) AS island FROM i)
SELECT metric AS series, CAST(min(epoch(ts)) AS BIGINT) AS start FROM b WHERE increase >= 3 GROUP BY metric, island HAVING max(epoch(ts)) - min(epoch(ts)) >= 7200""")
def stream_sustained_breach(fx: Inputs) -> DataFrame:
    from fleetmatch.operators.metrics import counter_increases

    rows = counter_increases(fx("counter_samples"), ["metric"]).select(F.col("metric").alias("series"), "ts", (F.col("increase") >= 3).alias("bad"))
    cut = rows.agg(F.expr("percentile_approx(ts, 0.5)").alias("t")).first()["t"]
    stream = arrivals(fx, rows, [f"ts <= timestamp '{cut}'", f"ts > timestamp '{cut}'"], "series")
    out = changes(fx, S.stream_sustained_breach(stream, 7200, "0 seconds"), "append")
    return out.groupBy("series", F.unix_timestamp("start").alias("start")).agg(F.max("samples").alias("_n")).drop("_n")


@query("s7_upsert_stream", "SELECT order_id, max_by(status, v) AS status, max(v) AS updated_at FROM (SELECT order_id, status, seq AS v FROM (SELECT order_id, event_type AS status, seq FROM lifecycle)) GROUP BY order_id")
def upsert_stream(fx: Inputs) -> DataFrame:
    from fleetmatch.sources.event_log import read_upserted, upsert_stream

    rows, parts = halves(fx, "lifecycle", "seq")
    rows = rows.select("order_id", F.col("event_type").alias("status"), F.col("seq").alias("updated_at"))
    stream = arrivals(fx, rows, [p.replace("seq", "updated_at") for p in parts], "order_id")
    path = scratch(fx.spark, "orders")
    upsert_stream(stream, path, ["order_id"], "updated_at", scratch(fx.spark, "stream")).awaitTermination()
    return read_upserted(fx.spark, path, "order_id long, status string, updated_at long", ["order_id"], "updated_at")


@query("s3_tail_event_log", "SELECT shard_id, count(*) AS events, max(offset_value) AS last_offset FROM lifecycle GROUP BY shard_id")
def tail(fx: Inputs) -> DataFrame:
    got = changes(fx, arrivals(fx, fx("lifecycle").select("shard_id", "offset_value", "event_id"), ["shard_id < 32", "shard_id >= 32"]), "append")
    return got.groupBy("shard_id").agg(F.count(F.lit(1)).alias("events"), F.max("offset_value").alias("last_offset"))


@query("s3_tail_from_positions", "SELECT l.shard_id, l.offset_value, l.event_id FROM lifecycle l LEFT JOIN checkpoints c ON c.shard_id = l.shard_id AND l.shard_id % 5 <> 0 WHERE l.offset_value >= coalesce(c.offset_value, 0)")
def tail_from_positions(fx: Inputs) -> DataFrame:
    """Checkpoints of four shards in five; the log arrives in two steps."""
    rows, parts = halves(fx, "lifecycle", "seq")
    rows, known = rows.select("shard_id", "offset_value", "event_id", "seq"), fx("checkpoints").filter("shard_id % 5 <> 0")
    return changes(fx, arrivals(fx, rows, parts, checkpoints=known), "append").drop("seq")


@query("s5_append_stream", "SELECT event_id, shard_id, CAST(row_number() OVER (PARTITION BY shard_id ORDER BY seq) - 1 AS BIGINT) AS offset_value FROM lifecycle")
def append_stream(fx: Inputs) -> DataFrame:
    from fleetmatch.sources.event_log import append_stream as appended, read_appended

    rows, parts = halves(fx, "lifecycle", "seq")
    rows, path = rows.select("event_id", "seq", F.col("shard_id").cast("string").alias("key")), scratch(fx.spark, "log")
    appended(arrivals(fx, rows, parts), path, ["seq"], scratch(fx.spark, "stream"), "key", list(range(64))).awaitTermination()
    return read_appended(fx.spark, path, "event_id string, seq long, key string, shard_id int, offset_value long").select("event_id", "shard_id", "offset_value")


@query("t6_stream_event_rates", "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_event_rates(fx: Inputs) -> DataFrame:
    from fleetmatch.sources.tables import table

    rows = table(fx.spark, fx.sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    cut = (rows.agg(F.max("event_id")).first()[0] or 0) // 2
    stream = arrivals(fx, rows, [f"event_id <= {cut}", f"event_id > {cut}"])
    # windows change until the watermark passes them: the last count of each is the greatest
    out = changes(fx, S.stream_event_rates(stream, "1 hour", "2 hours"))
    return out.groupBy(F.unix_timestamp("window_start").alias("window_start"), "event_type").agg(F.max("events").alias("events"))


@query("j5_stream_dedupe", "SELECT event_id, shard_id, occurred_at FROM lifecycle")
def stream_dedupe(fx: Inputs) -> DataFrame:
    from fleetmatch.operators.batches import stream_dedupe as deduped

    rows, parts = halves(fx, "lifecycle_dup", "seq")
    again = [f"({p}) and offset_value {sign} 1000000" for p in parts for sign in ("<", ">=")]
    return changes(fx, deduped(arrivals(fx, rows, again), "40 days"), "append").select("event_id", "shard_id", "occurred_at")


@query("t6_stream_counter_rates", f"WITH {INCREASE} SELECT metric, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start, CAST(sum(increase) AS DOUBLE) AS increase FROM i GROUP BY ALL")
def stream_counter_rates(fx: Inputs) -> DataFrame:
    """A sample of another counter, weeks later, moves the watermark past all windows."""
    rows = written(fx("counter_samples").select("metric", F.col("ts").cast("timestamp").alias("ts"), "value"))  # events are read once, not for each step
    facts = rows.agg(F.expr("percentile_approx(ts, 0.5)").alias("cut"), F.max("ts").alias("last")).first()
    late = fx.spark.range(1).select(F.lit("clock").alias("metric"), (F.lit(facts["last"]) + F.expr("interval 30 days")).alias("ts"), F.lit(0.0).alias("value"))
    parts = [f"ts <= timestamp '{facts['cut']}'", f"ts > timestamp '{facts['cut']}' and metric <> 'clock'", "metric = 'clock'"]
    out = changes(fx, S.stream_counter_rates(arrivals(fx, rows.unionByName(late), parts), "1 day", "0 seconds"), "append")
    return out.filter("metric <> 'clock'").select("metric", F.unix_timestamp("window_start").alias("window_start"), "increase")
