"""Queries of state folds, conditional updates and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmatch.operators import matching as M
from fleetmatch.operators import state as T
from fleetmatch.plans.catalog import query
from fleetmatch.plans.spatial import layout
from fleetmatch.sources.fixtures import Inputs


def folded(source: str, pending: bool) -> str:
    """The sequential fold of the transition table, one event of every order per recursion step."""
    again = "WHEN e.event_type IN ('order_created', 'order_retry_request') THEN 'match_pending'" if pending else ""
    ok = """CASE e.event_type WHEN 'order_created' THEN r.status NOT IN ('submitted', 'match_pending', 'matched', 'missed', 'cancelled')
      WHEN 'order_retry_request' THEN r.status NOT IN ('cancelled', 'matched') WHEN 'order_missed' THEN r.status NOT IN ('cancelled', 'matched') ELSE true END"""
    kept = lambda column, event, value: f"CASE WHEN {ok} AND e.event_type = '{event}' THEN {value} ELSE r.{column} END AS {column}"
    return f"""WITH e AS (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY shard_id, offset_value) AS n, first(event_type) OVER (PARTITION BY order_id ORDER BY shard_id, offset_value) AS opening, count(*) OVER (PARTITION BY order_id) AS total FROM ({source})
), r AS (
  SELECT order_id, 0 AS n, any_value(total) AS total, min(shard_id) AS shard_id, '' AS status, 0 AS x, 0 AS y, 0 AS attempt, '' AS cancel_reason, '' AS retry_reason, '' AS miss_reason, CAST(0 AS BIGINT) AS rider_id, 0 AS score, '' AS last_event_id, CAST(0 AS BIGINT) AS updated_at
  FROM e WHERE opening <> 'order_retry_request' GROUP BY order_id
  UNION ALL
  SELECT r.order_id, r.n + 1, r.total, r.shard_id,
    CASE {again} WHEN {ok} THEN CASE e.event_type WHEN 'order_created' THEN 'created' WHEN 'order_cancelled' THEN 'cancelled' WHEN 'order_retry_request' THEN 'retry_requested' WHEN 'order_matched' THEN 'matched' ELSE 'missed' END ELSE r.status END,
    {kept("x", "order_created", "e.x")}, {kept("y", "order_created", "e.y")}, {kept("attempt", "order_retry_request", "e.attempt")},
    {kept("cancel_reason", "order_cancelled", "e.reason")}, {kept("retry_reason", "order_retry_request", "e.reason")}, {kept("miss_reason", "order_missed", "e.reason")},
    {kept("rider_id", "order_matched", "e.rider_id")}, {kept("score", "order_matched", "e.score")},
    CASE WHEN {ok} THEN e.event_id ELSE r.last_event_id END, CASE WHEN {ok} THEN e.occurred_at ELSE r.updated_at END
  FROM r JOIN e ON e.order_id = r.order_id AND e.n = r.n + 1
) SELECT * EXCLUDE (n, total) FROM r WHERE n = total"""


ONCE = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY shard_id, offset_value) AS k FROM lifecycle_dup) WHERE k = 1"


@query("f1_fold_order_state", folded("SELECT * FROM lifecycle", False))
def fold_order_state(fx: Inputs) -> DataFrame:
    return T.fold_order_state(fx("lifecycle"))[0]


@query("f2_fold_order_state_tx", folded(ONCE, True))
def fold_order_state_tx(fx: Inputs) -> DataFrame:
    from fleetmatch.operators.batches import dedupe_inbox

    new, _ = dedupe_inbox(fx("lifecycle_dup"), fx("inbox").limit(0), "order-worker")
    return T.fold_order_state_tx(new)[0]


RIDERS = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY seq) AS n, count(*) OVER (PARTITION BY uid) AS total FROM rider_events), r AS (
  SELECT uid, 0 AS n, any_value(total) AS total, CAST(NULL AS BOOLEAN) AS online, CAST(NULL AS INT) AS x, CAST(NULL AS INT) AS y FROM e GROUP BY uid
  UNION ALL
  SELECT r.uid, r.n + 1, r.total, CASE type WHEN 'online' THEN true WHEN 'offline' THEN CASE WHEN r.online IS NULL THEN NULL ELSE false END ELSE r.online END,
    CASE WHEN type = 'online' OR type = 'move' AND r.online THEN e.x ELSE r.x END, CASE WHEN type = 'online' OR type = 'move' AND r.online THEN e.y ELSE r.y END
  FROM r JOIN e ON e.uid = r.uid AND e.n = r.n + 1
) SELECT uid, x, y, online FROM r WHERE n = total AND """


@query("f3_fold_rider_lifecycle", RIDERS + "online")
def fold_rider_lifecycle(fx: Inputs) -> DataFrame:
    return T.fold_rider_lifecycle(fx("rider_events"))


@query("f4_soft_delete_riders", RIDERS + "online IS NOT NULL")
def soft_delete_riders(fx: Inputs) -> DataFrame:
    return T.fold_rider_lifecycle(fx("rider_events"), soft_delete=True)


ASKED = "SELECT order_id AS request_id, order_id % 200 + 1 AS rider_id FROM match_orders"


@query("f5_reserve_riders", f"""WITH q AS (SELECT request_id, rider_id, row_number() OVER (PARTITION BY rider_id ORDER BY request_id) AS k FROM ({ASKED}))
SELECT request_id, rider_id, r.count + k AS count FROM q JOIN riders r ON r.uid = q.rider_id AND r.online WHERE r.count + k <= 3""")
def reserve_riders(fx: Inputs) -> DataFrame:
    asked = fx("match_orders").select(F.col("order_id").alias("request_id"), (F.col("order_id") % 200 + 1).alias("rider_id"))
    return M.reserve_riders(fx("riders"), asked)[1]


@query("f7_mark_matched", "SELECT order_id, CASE WHEN status = 'match_pending' AND order_id % 2 = 0 THEN 'matched' ELSE status END AS status, CASE WHEN status = 'match_pending' AND order_id % 2 = 0 THEN order_id + 7 ELSE 0 END AS rider_id FROM order_status")
def mark_matched(fx: Inputs) -> DataFrame:
    results = fx("order_status").filter("order_id % 2 = 0").select("order_id", (F.col("order_id") + 7).alias("rider_id"), F.lit(5).alias("score"))
    return T.mark_matched(fx("order_status"), results).select("order_id", "status", "rider_id")


@query("f7_mark_missed", "SELECT order_id, CASE WHEN status = 'match_pending' AND order_id % 2 = 0 THEN 'missed' ELSE status END AS status, CASE WHEN status = 'match_pending' AND order_id % 2 = 0 THEN 'no_available_rider' ELSE '' END AS miss_reason FROM order_status")
def mark_missed(fx: Inputs) -> DataFrame:
    return T.mark_missed(fx("order_status"), fx("order_status").filter("order_id % 2 = 0"), "no_available_rider").select("order_id", "status", "miss_reason")


@query("w4_list_missed_for_retry_all", "SELECT order_id, shard_id FROM order_status WHERE status = 'missed' AND attempt < 3")
def list_missed_for_retry_all(fx: Inputs) -> DataFrame:
    last = fx("order_status").agg(F.max("order_id")).first()[0] or 0
    return T.list_missed_for_retry(fx("order_status"), 1, last, 3)


def _all_riders(fx: Inputs) -> DataFrame:
    return fx("riders").withColumn("count", F.lit(0).cast("long"))


@query("f13_match_orders")
def match_orders(fx: Inputs) -> DataFrame:
    return M.match_orders(fx("match_orders"), _all_riders(fx), layout(fx))


@query("f13_match_orders_rounds")
def match_orders_rounds(fx: Inputs) -> DataFrame:
    return M.match_orders(fx("match_orders"), _all_riders(fx), layout(fx), mode="rounds")


# every supplier has room for three, so as many are matched as there are orders or places
@query("f13_match_summary", """SELECT count(*) AS orders, CAST(least(count(*), (SELECT 3 * count(*) FROM riders_small)) AS BIGINT) AS matched FROM match_orders WHERE (SELECT count(*) FROM riders_small) >= 0""")
def match_summary(fx: Inputs) -> DataFrame:
    from fleetmatch.functions.spatial import Layout, default_cell_size

    riders = fx("riders_small")
    out = M.match_orders(fx("match_orders"), riders, Layout(cell=default_cell_size(riders.count())))
    return out.agg(F.count(F.lit(1)).alias("orders"), F.count("rider_id").alias("matched"))


REQUESTS = """SELECT event_id, order_id, shard_id, offset_value, occurred_at, x, y FROM lifecycle_dup"""
CHECKED = f"""WITH q AS ({REQUESTS}), n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY shard_id, offset_value) AS k, event_id IN (SELECT event_id FROM inbox WHERE consumer_name = 'matcher-worker') AS known FROM q),
s AS (SELECT n.*, CASE o.status WHEN 'match_pending' THEN 1 ELSE 0 END AS pending, o.order_id IS NULL AS lost, k > 1 OR known AS seen FROM n LEFT JOIN (SELECT * FROM order_status WHERE order_id % 11 <> 0) o ON o.order_id = n.order_id),
r AS (SELECT *, row_number() OVER (PARTITION BY order_id, seen ORDER BY shard_id, offset_value) AS turn FROM s)
SELECT event_id, offset_value, CASE WHEN seen THEN 'seen' WHEN lost THEN 'missing' WHEN pending = 0 OR turn > 1 THEN 'not pending' ELSE 'match' END AS decision FROM r"""


@query("f13_check_requests", CHECKED)
def check_requests(fx: Inputs) -> DataFrame:
    asked = fx("lifecycle_dup").select("event_id", "order_id", "shard_id", "offset_value")
    return M.check_requests(asked, fx("order_status").filter("order_id % 11 <> 0"), fx("inbox"), "matcher-worker").select("event_id", "offset_value", "decision")


# every supplier has room for three and sees all orders, so what is missed at first is missed again in both retries
@query("f14_retry_summary", """WITH m AS (SELECT count(*) AS n, least(count(*), (SELECT 3 * count(*) FROM riders_small)) AS hit FROM match_orders)
SELECT 'matched' AS status, CAST(0 AS INT) AS attempt, CAST(hit AS BIGINT) AS orders FROM m WHERE hit > 0 UNION ALL SELECT 'missed', 2, CAST(n - hit AS BIGINT) FROM m WHERE n > hit""")
def retry_summary(fx: Inputs) -> DataFrame:
    from fleetmatch.functions.spatial import Layout, default_cell_size

    riders = fx("riders_small")
    out = M.retry_missed(fx("match_orders"), riders, Layout(cell=default_cell_size(riders.count())), 2)
    return out.groupBy("status", "attempt").agg(F.count(F.lit(1)).alias("orders"))


@query("f14_retry_missed")
def retry_missed(fx: Inputs) -> DataFrame:
    return M.retry_missed(fx("match_orders"), _all_riders(fx), layout(fx), 2)
