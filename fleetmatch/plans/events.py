"""Queries of event logs, codecs, inbox, outbox and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmatch import schemas
from fleetmatch.functions import codec
from fleetmatch.functions.spatial import Layout, shard_of, divided
from fleetmatch.operators import batches as B
from fleetmatch.operators import checkpoints as K
from fleetmatch.operators import outbox as X
from fleetmatch.plans.catalog import query
from fleetmatch.sources import event_log as L
from fleetmatch.sources.fixtures import Inputs
from fleetmatch.sources.tables import scratch

EVENT = ["event_id", "event_type", "aggregate_type", "aggregate_id", "shard_id", "occurred_at", "payload"]
NOW = 1_800_000_000


def log(fx: Inputs) -> DataFrame:
    """The lifecycle log with the payload each event type has."""
    fields = {"order_id": "OrderID", "x": "X", "y": "Y", "attempt": "Attempt", "reason": "Reason", "rider_id": "RiderID", "score": "Score"}
    rows = fx("lifecycle").withColumnsRenamed(fields)
    body = F.lit(None).cast("string")
    for kind in schemas.PAYLOADS:
        body = F.when(F.col("event_type") == kind, codec.payload_json(kind)).otherwise(body)
    return rows.withColumn("payload", body).select("offset_value", *EVENT)


@query("s1_read_event_log", "SELECT shard_id, offset_value, event_id, event_type, aggregate_id, occurred_at FROM lifecycle")
def read_event_log(fx: Inputs) -> DataFrame:
    path = scratch(fx.spark, "log")
    L.write_event_log(log(fx), path)
    return L.read_event_log(fx.spark, path).select("shard_id", "offset_value", "event_id", "event_type", "aggregate_id", "occurred_at")


@query("s2_read_from_positions", "SELECT l.shard_id, l.offset_value, l.event_id FROM lifecycle l LEFT JOIN checkpoints c ON l.shard_id = c.shard_id WHERE l.offset_value >= coalesce(c.offset_value, 0)")
def read_from_positions(fx: Inputs) -> DataFrame:
    return L.read_from_positions(fx("lifecycle"), fx("checkpoints")).select("shard_id", "offset_value", "event_id")


@query("s4_end_offsets", "SELECT s.shard_id, coalesce(max(offset_value) + 1, 0) AS end_offset FROM shards s LEFT JOIN lifecycle l ON l.shard_id = s.shard_id GROUP BY s.shard_id")
def end_offsets(fx: Inputs) -> DataFrame:
    return L.end_offsets(fx("lifecycle"), fx("shards"))


@query("s5_append_events", """WITH c AS (SELECT shard_id, count(*) AS n FROM lifecycle GROUP BY shard_id)
SELECT l.event_id, l.shard_id, n + row_number() OVER (PARTITION BY l.shard_id ORDER BY seq) - 1 AS offset_value FROM lifecycle l JOIN c ON c.shard_id = l.shard_id WHERE seq % 2 = 1""")
def append_events(fx: Inputs) -> DataFrame:
    new = fx("lifecycle").filter("seq % 2 = 1").drop("offset_value")
    return L.append_events(fx("lifecycle"), new, "seq").select("event_id", "shard_id", "offset_value")


@query("s6_route_by_shard_key", "SELECT event_id, key, CASE WHEN TRY_CAST(key AS INT) BETWEEN 3 AND 40 THEN TRY_CAST(key AS INT) ELSE 3 END AS partition FROM (SELECT event_id, CASE WHEN seq % 11 = 0 THEN 'x' || shard_id ELSE CAST(shard_id AS VARCHAR) END AS key FROM lifecycle)")
def route_by_shard_key(fx: Inputs) -> DataFrame:
    key = F.when(F.col("seq") % 11 == 0, F.concat(F.lit("x"), F.col("shard_id"))).otherwise(F.col("shard_id").cast("string"))
    return L.route_by_shard_key(fx("lifecycle").select("event_id", key.alias("key")), list(range(3, 41)))


@query("s7_upsert_orders", """WITH u AS (SELECT order_id, 'created' AS status, max(seq) AS updated_at FROM lifecycle GROUP BY order_id)
SELECT coalesce(u.order_id, o.order_id) AS order_id, coalesce(u.status, o.status) AS status, coalesce(u.updated_at, o.updated_at) AS updated_at FROM order_status o FULL JOIN u ON u.order_id = o.order_id""")
def upsert_orders(fx: Inputs) -> DataFrame:
    existing = fx("order_status").select("order_id", "status", "updated_at")
    updates = fx("lifecycle").select("order_id", F.lit("created").alias("status"), F.col("seq").alias("updated_at"))
    return L.upsert(existing, updates, ["order_id"], "updated_at")


@query("s7_upsert_riders", """WITH e AS (SELECT uid, x, y, row_number() OVER (PARTITION BY uid ORDER BY seq DESC) AS k FROM rider_events)
SELECT coalesce(e.uid, r.uid) AS uid, coalesce(e.x, r.x) AS x, coalesce(e.y, r.y) AS y FROM riders r FULL JOIN (SELECT * FROM e WHERE k = 1) e ON e.uid = r.uid""")
def upsert_riders(fx: Inputs) -> DataFrame:
    existing = fx("riders").select("uid", "x", "y", F.lit(-1).cast("long").alias("seq"))
    return L.upsert(existing, fx("rider_events").select("uid", "x", "y", "seq"), ["uid"], "seq").drop("seq")


@query("s8_lookup_orders", "SELECT DISTINCT l.order_id, o.status FROM lifecycle l LEFT JOIN order_status o ON o.order_id = l.order_id * 100")
def lookup_orders(fx: Inputs) -> DataFrame:
    keys = fx("lifecycle").select((F.col("order_id") * 100).alias("order_id"))
    found = L.lookup(fx("order_status").select("order_id", "status"), keys, ["order_id"], "left")
    return found.select((F.col("order_id") / 100).cast("long").alias("order_id"), "status")


@query("s8_lookup_riders", "SELECT uid, x, y FROM riders WHERE uid IN (SELECT rider_id FROM lifecycle)")
def lookup_riders(fx: Inputs) -> DataFrame:
    return L.lookup(fx("riders").select("uid", "x", "y"), fx("lifecycle").select(F.col("rider_id").alias("uid")), ["uid"])


def raw(fx: Inputs) -> DataFrame:
    """Encoded log with some broken values, as a broker would deliver it."""
    seq = F.substring_index("event_id", "-", -1).cast("long")
    value = F.when(seq % 13 == 0, F.lit(None)).when(seq % 17 == 0, F.lit("not json")).when(seq % 19 == 0, F.regexp_replace("value", '"Type":"[a-z_]*"', '"Type":""')).otherwise(F.col("value"))
    rows = codec.encode_events(log(fx))
    return rows.select(F.col("shard_id").alias("partition"), F.col("offset_value").alias("offset"), value.alias("value"))


ERROR = "CASE WHEN seq % 13 = 0 THEN 'null value' WHEN seq % 17 = 0 THEN 'bad json' WHEN seq % 19 = 0 THEN 'empty type' END"


@query("d1_decode_envelopes", f"SELECT shard_id, coalesce({ERROR}, 'good') AS result, count(*) AS events FROM lifecycle GROUP BY ALL")
def decode_envelopes(fx: Inputs) -> DataFrame:
    good, bad = codec.decode_envelopes(raw(fx))
    both = good.select("shard_id", F.lit("good").alias("result")).unionByName(bad.select(F.col("partition").alias("shard_id"), F.col("error").alias("result")))
    return both.groupBy("shard_id", "result").agg(F.count(F.lit(1)).alias("events"))


@query("d2_decode_payloads", """SELECT event_id, order_id AS "OrderID", CASE WHEN event_type = 'order_created' THEN x END AS "X", CASE WHEN event_type = 'order_created' THEN y END AS "Y",
  CASE WHEN event_type = 'order_retry_request' THEN attempt END AS "Attempt", CASE WHEN event_type IN ('order_cancelled', 'order_missed', 'order_retry_request') THEN reason END AS "Reason",
  CASE WHEN event_type = 'order_matched' THEN rider_id END AS "RiderID", CASE WHEN event_type = 'order_matched' THEN score END AS "Score" FROM lifecycle WHERE seq % 10 <> 0 AND seq % 10 <> 1""")
def decode_payloads(fx: Inputs) -> DataFrame:
    seq = F.substring_index("event_id", "-", -1).cast("long")
    rows = log(fx).withColumn("event_type", F.when(seq % 10 == 0, "rider_moved").otherwise(F.col("event_type"))).withColumn("payload", F.when(seq % 10 == 1, "{broken").otherwise(F.col("payload")))
    good, _ = codec.decode_payloads(rows)
    return good.select("event_id", "OrderID", "X", "Y", "Attempt", "Reason", "RiderID", "Score")


@query("d3_encode_events", "SELECT event_id, event_type, aggregate_id, shard_id, occurred_at, offset_value FROM lifecycle")
def encode_events(fx: Inputs) -> DataFrame:
    rows = codec.encode_events(log(fx)).select(F.col("shard_id").alias("partition"), F.col("offset_value").alias("offset"), "value")
    good, _ = codec.decode_envelopes(rows)
    return good.select("event_id", "event_type", "aggregate_id", "shard_id", "occurred_at", "offset_value")


CREATED_SHARD = "CAST(least(63, least(7, greatest(0, least(y // 10000, 9)) // 2) * 8 + least(7, greatest(0, least(x // 10000, 9)) // 2)) AS INT)"


@query("d4_orders_to_created_events", f"""SELECT 'order-' || order_id || '-created' AS event_id, 'order_created' AS event_type, CAST(order_id AS VARCHAR) AS aggregate_id, {CREATED_SHARD} AS shard_id, seq + 1 AS occurred_at,
  '{{"OrderID":' || order_id || ',"X":' || x || ',"Y":' || y || '}}' AS payload FROM match_orders""")
def orders_to_created_events(fx: Inputs) -> DataFrame:
    lay = Layout()
    shard = shard_of(divided("x", lay.cell), divided("y", lay.cell), lay)
    return codec.orders_to_created_events(fx("match_orders"), shard, F.col("seq") + 1).drop("aggregate_type")


@query("d5_build_retry_events", """SELECT 'order-' || order_id || '-retry-2' AS event_id, shard_id, CAST(7 AS BIGINT) AS occurred_at, '{"OrderID":' || order_id || ',"Attempt":2,"Reason":"timeout"}' AS payload FROM order_status WHERE status = 'missed' AND attempt < 2""")
def build_retry_events(fx: Inputs) -> DataFrame:
    from fleetmatch.operators.state import list_missed_for_retry

    missed = list_missed_for_retry(fx("order_status"), 1, 10**12, 2)
    return codec.build_retry_events(missed, 2, "timeout", F.lit(7)).select("event_id", "shard_id", "occurred_at", "payload")


@query("d6_build_match_requests", """SELECT l.event_id || '-match-requested' AS event_id, 'match_requested' AS event_type, l.shard_id, l.occurred_at, 'match-requests' AS topic, CAST(l.order_id AS VARCHAR) AS message_key,
  '{"OrderID":' || l.order_id || ',"X":' || o.x || ',"Y":' || o.y || ',"Attempt":' || CASE WHEN l.event_type = 'order_retry_request' THEN l.attempt ELSE 0 END || '}' AS payload
  FROM lifecycle l JOIN match_orders o ON o.order_id = l.order_id WHERE l.event_type IN ('order_created', 'order_retry_request')""")
def build_match_requests(fx: Inputs) -> DataFrame:
    good, _ = codec.decode_payloads(log(fx))
    out = codec.build_match_requests(good, fx("match_orders"))
    return out.select("event_id", "event_type", "shard_id", "occurred_at", "topic", "message_key", "payload")


@query("d7_build_result_events", """SELECT event_id || '-' || CASE WHEN attempt = 0 THEN 'order_missed' ELSE 'order_matched' END AS event_id, CASE WHEN attempt = 0 THEN 'order_missed' ELSE 'order_matched' END AS event_type, topic,
  CASE WHEN attempt = 0 THEN '{"OrderID":' || order_id || ',"Reason":"no_available_rider"}' ELSE '{"OrderID":' || order_id || ',"RiderID":' || rider_id || ',"Score":' || least(CAST(score AS BIGINT) * 10000000, 2147483647) || '}' END AS payload FROM (SELECT *, 'order-events' AS topic FROM lifecycle)""")
def build_result_events(fx: Inputs) -> DataFrame:
    outcomes = fx("lifecycle").withColumns({"rider_id": F.when(F.col("attempt") > 0, F.col("rider_id")), "score": F.col("score").cast("long") * 10_000_000})
    return codec.build_result_events(outcomes).select("event_id", "event_type", "topic", "payload")


@query("j5_dedupe_inbox", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY shard_id, offset_value) AS k FROM lifecycle_dup)
SELECT event_id, shard_id, offset_value FROM n WHERE k = 1 AND event_id NOT IN (SELECT event_id FROM inbox WHERE consumer_name = 'order-worker')""")
def dedupe_inbox(fx: Inputs) -> DataFrame:
    new, _ = B.dedupe_inbox(fx("lifecycle_dup"), fx("inbox"), "order-worker")
    return new.select("event_id", "shard_id", "offset_value")


@query("w2_validate_batches", """WITH r AS (SELECT shard_id, offset_value, CASE WHEN seq % 23 = 0 THEN '' ELSE event_id END AS event_id, CASE WHEN seq % 29 = 0 THEN shard_id + 1 ELSE shard_id END AS event_shard_id FROM lifecycle WHERE seq % 31 <> 5),
g AS (SELECT *, offset_value - lag(offset_value) OVER (PARTITION BY shard_id ORDER BY offset_value) AS step FROM r),
e AS (SELECT shard_id, offset_value, CASE WHEN event_id = '' THEN 'empty event id' WHEN shard_id >= 60 THEN 'shard not owned' WHEN event_shard_id <> shard_id THEN 'event of another shard' WHEN step <> 1 THEN 'offset gap' END AS error FROM g)
SELECT * FROM e WHERE error IS NOT NULL""")
def validate_batches(fx: Inputs) -> DataFrame:
    rows = fx("lifecycle").filter("seq % 31 <> 5").select(
        "shard_id", "offset_value", F.when(F.col("seq") % 23 == 0, "").otherwise(F.col("event_id")).alias("event_id"),
        F.when(F.col("seq") % 29 == 0, F.col("shard_id") + 1).otherwise(F.col("shard_id")).alias("event_shard_id"),
    )
    return B.validate_batches(rows, fx("shards").filter("shard_id < 60"))


@query("w3_micro_batches", "SELECT shard_id, (offset_value // 100) AS batch_no, count(*) AS events FROM lifecycle GROUP BY ALL")
def micro_batches(fx: Inputs) -> DataFrame:
    return B.micro_batches(fx("lifecycle"), 100).groupBy("shard_id", "batch_no").agg(F.count(F.lit(1)).alias("events"))


# records come 3 to 7 ms apart, by their number: batches end by the wait of 10 ms, or by the size
TIMED = """SELECT *, CAST(sum(2 + seq % 5 * CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY shard_id ORDER BY offset_value) AS BIGINT) AS arrived_at FROM lifecycle"""


@query("w3_micro_batches_wait", f"""WITH t AS ({TIMED}), r AS (
  SELECT shard_id, offset_value, arrived_at AS first, CAST(0 AS BIGINT) AS batch_no, 1 AS n FROM t WHERE offset_value = 0
  UNION ALL
  SELECT t.shard_id, t.offset_value, CASE WHEN cut THEN t.arrived_at ELSE first END, batch_no + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN 1 ELSE n + 1 END
  FROM (SELECT r.*, r.offset_value + 1 AS next FROM r) r JOIN t ON t.shard_id = r.shard_id AND t.offset_value = r.next, LATERAL (SELECT n >= 4 OR t.arrived_at >= first + 10 AS cut)
) SELECT shard_id, offset_value, batch_no FROM r""")
def micro_batches_wait(fx: Inputs) -> DataFrame:
    rows = fx.spark.sql(TIMED.replace("FROM lifecycle", "FROM {rows}"), rows=fx("lifecycle"))
    return B.micro_batches(rows, 4, 10).select("shard_id", "offset_value", "batch_no")


@query("w5_claim_outbox", f"SELECT event_id, 'w1' AS claimed_by, CAST({NOW + 30} AS BIGINT) AS claimed_until, attempts + 1 AS attempts FROM outbox WHERE published_at IS NULL AND claimed_until < {NOW} ORDER BY occurred_at, event_id LIMIT 100")
def claim_outbox(fx: Inputs) -> DataFrame:
    return X.claim_outbox(fx("outbox"), "w1", NOW).select("event_id", "claimed_by", "claimed_until", "attempts")


@query("w6_pending_outbox_all", "SELECT event_id, aggregate_id FROM outbox WHERE published_at IS NULL")
def pending_outbox_all(fx: Inputs) -> DataFrame:
    return X.pending_outbox(fx("outbox")).select("event_id", "aggregate_id")


@query("x1_split_by_topic", "SELECT topic, CASE WHEN topic = 'lost-topic' THEN 'unknown topic lost-topic' ELSE '' END AS error, count(*) AS events FROM outbox GROUP BY ALL")
def split_by_topic(fx: Inputs) -> DataFrame:
    good, bad = X.split_by_topic(fx("outbox"), [schemas.MATCH_REQUESTS, schemas.ORDER_EVENTS])
    return good.withColumn("error", F.lit("")).unionByName(bad).groupBy("topic", "error").agg(F.count(F.lit(1)).alias("events"))


@query("j6_mark_outbox_published", "SELECT event_id, CASE WHEN claimed_by = 'other' AND attempts = 0 AND CAST(aggregate_id AS BIGINT) % 2 = 0 THEN 77 ELSE published_at END AS published_at, claimed_by = 'other' AND CAST(aggregate_id AS BIGINT) % 2 = 0 AS updated FROM outbox")
def mark_outbox_published(fx: Inputs) -> DataFrame:
    box = fx("outbox")
    ids = box.filter(F.col("aggregate_id").cast("long") % 2 == 0).select("event_id")
    return X.mark_outbox_published(box, ids, "other", 77).select("event_id", "published_at", "updated")


@query("f9_mark_outbox_failed", "SELECT event_id, CASE WHEN claimed_by = 'other' AND CAST(aggregate_id AS BIGINT) % 2 = 0 THEN '' ELSE claimed_by END AS claimed_by, CASE WHEN claimed_by = 'other' AND CAST(aggregate_id AS BIGINT) % 2 = 0 THEN 'append failed' ELSE '' END AS last_error FROM outbox")
def mark_outbox_failed(fx: Inputs) -> DataFrame:
    box = fx("outbox")
    ids = box.filter(F.col("aggregate_id").cast("long") % 2 == 0).select("event_id")
    return X.mark_outbox_failed(box, ids, "other", "append failed").select("event_id", "claimed_by", "last_error")


@query("f8_create_outbox", "SELECT event_id, topic FROM outbox WHERE shard_id < 30 UNION ALL SELECT DISTINCT event_id, 'again' AS topic FROM outbox WHERE shard_id >= 30")
def create_outbox(fx: Inputs) -> DataFrame:
    box = fx("outbox")
    new = box.withColumn("topic", F.lit("again"))
    return X.create_outbox(box.filter("shard_id < 30"), new.unionByName(new)).select("event_id", "topic")


SAVED = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY consumer_name, topic, shard_id ORDER BY epoch DESC, updated_at DESC) AS k FROM new_checkpoints)
SELECT consumer_name, topic, shard_id, CASE WHEN n.epoch >= coalesce(c.epoch, n.epoch) THEN n.offset_value ELSE c.offset_value END AS offset_value, CASE WHEN n.epoch >= coalesce(c.epoch, n.epoch) THEN n.epoch ELSE c.epoch END AS epoch
FROM checkpoints c FULL JOIN (SELECT * FROM n WHERE k = 1) n USING (consumer_name, topic, shard_id)"""


@query("f10_save_checkpoints", SAVED.replace("THEN n.offset_value ELSE", "THEN n.offset_value ELSE").replace("CASE WHEN n.epoch >= coalesce(c.epoch, n.epoch) THEN n.offset_value", "CASE WHEN n.epoch IS NOT NULL AND n.epoch >= coalesce(c.epoch, n.epoch) THEN n.offset_value"))
def save_checkpoints(fx: Inputs) -> DataFrame:
    return K.save_checkpoints(fx("checkpoints"), fx("new_checkpoints"), "updated_at").select("consumer_name", "topic", "shard_id", "offset_value", "epoch")


@query("f11_save_checkpoints_strict", """SELECT n.consumer_name, n.shard_id, n.offset_value, n.epoch, CASE WHEN n.offset_value < 0 OR n.epoch <= 0 THEN 'invalid' WHEN n.offset_value < c.offset_value OR n.epoch < c.epoch THEN 'stale' ELSE 'saved' END AS result
FROM new_checkpoints n LEFT JOIN checkpoints c USING (consumer_name, topic, shard_id)""")
def save_checkpoints_strict(fx: Inputs) -> DataFrame:
    saved, rejected = K.save_checkpoints_strict(fx("checkpoints"), fx("new_checkpoints"))
    new = saved.join(fx("new_checkpoints").select(*K.KEY), K.KEY, "left_semi").join(rejected.select(*K.KEY), K.KEY, "left_anti")
    both = new.withColumn("error", F.lit("saved")).unionByName(rejected)
    return both.select("consumer_name", "shard_id", "offset_value", "epoch", F.col("error").alias("result"))


# many saves a shard: offsets and epochs that mostly rise
SAVES = """SELECT 'order-worker' AS consumer_name, 'order-events' AS topic, shard_id, offset_value + (seq * 7919) % 11 - 5 AS offset_value,
  CAST(1 + floor(offset_value / 7) + (seq * 31) % 4 - 1 AS BIGINT) AS epoch, CAST(shard_id % 4 + 1 AS INT) AS node_id, CAST(0 AS BIGINT) AS updated_at, seq FROM lifecycle"""
SAVED = f"""WITH s AS ({SAVES}), v AS (SELECT *, offset_value < 0 OR epoch <= 0 AS bad, row_number() OVER (PARTITION BY shard_id ORDER BY seq) AS k FROM s), r AS (
  SELECT shard_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, CASE WHEN shard_id % 2 = 0 THEN CAST(10 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS o, CASE WHEN shard_id % 2 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS e, '' AS result FROM v WHERE k = 1
  UNION ALL
  SELECT v.shard_id, v.k, v.seq, CASE WHEN ok THEN offset_value ELSE o END, CASE WHEN ok THEN epoch ELSE e END, CASE WHEN bad THEN 'invalid' WHEN ok THEN 'saved' ELSE 'stale' END
  FROM r JOIN v ON v.shard_id = r.shard_id AND v.k = r.k + 1, LATERAL (SELECT NOT bad AND offset_value >= o AND epoch >= e AS ok)
) """


def _saves(fx: Inputs) -> tuple[DataFrame, DataFrame]:
    new = fx.spark.sql(SAVES.replace("FROM lifecycle", "FROM {rows}"), rows=fx("lifecycle"))
    stored = new.filter("shard_id % 2 = 0").dropDuplicates(["shard_id"]).drop("seq").withColumns({"offset_value": F.lit(10).cast("long"), "epoch": F.lit(2).cast("long")})
    return stored, new


@query("f11_save_in_sequence", SAVED + "SELECT shard_id, seq, result FROM r WHERE k > 0 AND result <> 'saved'")
def save_in_sequence(fx: Inputs) -> DataFrame:
    return K.save_checkpoints_in_sequence(*_saves(fx), "seq")[1].select("shard_id", "seq", F.col("error").alias("result"))


@query("f11_saved_in_sequence", SAVED + "SELECT shard_id, o AS offset_value, e AS epoch FROM (SELECT *, max(k) OVER (PARTITION BY shard_id) AS last FROM r) WHERE k = last AND (o > 0 OR e > 0)")
def saved_in_sequence(fx: Inputs) -> DataFrame:
    return K.save_checkpoints_in_sequence(*_saves(fx), "seq")[0].select("shard_id", "offset_value", "epoch")


@query("f12_load_checkpoints", "SELECT shard_id, offset_value, epoch FROM new_checkpoints WHERE consumer_name = 'matcher-worker' AND topic = 'order-events'")
def load_checkpoints(fx: Inputs) -> DataFrame:
    return K.load_checkpoints(fx("new_checkpoints"), "matcher-worker", "order-events").select("shard_id", "offset_value", "epoch")
