"""Queries of reports and time-series conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmatch.operators import metrics as R
from fleetmatch.plans.catalog import query
from fleetmatch.sources.event_log import end_offsets
from fleetmatch.sources.fixtures import Inputs


def last_order(fx: Inputs) -> int:
    return fx("order_status").agg(F.max("order_id")).first()[0] or 0


@query("a4_order_result_summary_all", """SELECT count(*) AS created, CAST(count(*) FILTER (status = 'matched') AS BIGINT) AS matched, CAST(count(*) FILTER (status = 'missed') AS BIGINT) AS missed, count(*) FILTER (status IN ('matched', 'missed')) AS terminal, max(attempt) AS max_attempt,
  round(count(*) FILTER (status = 'matched') / greatest(count(*), 1), 6) AS match_rate FROM order_status""")
def order_result_summary_all(fx: Inputs) -> DataFrame:
    return R.order_result_summary(fx("order_status"), 1, last_order(fx))


@query("a5_retry_progress", "SELECT CAST(k AS INT) AS retry_round, count(*) FILTER (status = 'matched' OR status = 'missed' AND attempt >= k) AS terminal FROM order_status, (SELECT range AS k FROM range(4)) GROUP BY k")
def retry_progress(fx: Inputs) -> DataFrame:
    return R.retry_progress(fx("order_status"), 3)


def lags(fx: Inputs) -> DataFrame:
    shards = fx("shards")
    return R.shard_lag(shards, end_offsets(fx("lifecycle"), shards), fx("checkpoints"), fx("ownership").filter("shard_id < 50"))


LAG = """l AS (SELECT s.shard_id, coalesce(e.n, 0) AS end_offset, coalesce(c.offset_value, 0) AS checkpoint, greatest(0, coalesce(e.n, 0) - coalesce(c.offset_value, 0)) AS lag, coalesce(o.epoch, 0) AS epoch FROM shards s
  LEFT JOIN (SELECT shard_id, max(offset_value) + 1 AS n FROM lifecycle GROUP BY shard_id) e ON e.shard_id = s.shard_id LEFT JOIN checkpoints c ON c.shard_id = s.shard_id LEFT JOIN ownership o ON o.shard_id = s.shard_id AND o.shard_id < 50)"""


@query("a6_shard_lag", f"WITH {LAG} SELECT * FROM l")
def shard_lag(fx: Inputs) -> DataFrame:
    return lags(fx)


@query("a6_max_shard_lag", f"WITH {LAG} SELECT max(lag) AS max_lag FROM l")
def max_shard_lag(fx: Inputs) -> DataFrame:
    return R.max_shard_lag(lags(fx))


@query("a7_shard_progress", f"WITH {LAG} SELECT CAST(sum(end_offset) AS BIGINT) AS total_end_offset, CAST(sum(checkpoint) AS BIGINT) AS total_checkpoint, bool_and(checkpoint >= end_offset) AS caught_up FROM l")
def shard_progress(fx: Inputs) -> DataFrame:
    return R.shard_progress(lags(fx))


@query("a9_event_counts", "SELECT shard_id % 4 + 1 AS node_id, shard_id, event_type, count(*) AS events FROM lifecycle GROUP BY ALL")
def event_counts(fx: Inputs) -> DataFrame:
    return R.event_counts(fx("lifecycle").withColumn("node_id", F.col("shard_id") % 4 + 1), "node_id", "shard_id", "event_type")


# progress samples: orders terminal by each attempt, sampled every half second
SAMPLES = "SELECT 500.0 * (k + 1) AS elapsed_ms, 0 AS retry_round, (SELECT count(*) FROM order_status WHERE status IN ('matched', 'missed') AND order_id % 20 <= k) AS terminal FROM (SELECT id AS k FROM {n} WHERE id < 20)"


def samples(fx: Inputs) -> DataFrame:
    done = fx("order_status").filter("status in ('matched', 'missed')").groupBy((F.col("order_id") % 20).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    ticks = fx.spark.range(20).join(done.withColumnRenamed("k", "d"), F.col("d") <= F.col("id"), "left")  # twenty rows each
    return ticks.groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("terminal")).select((F.lit(500.0) * (F.col("id") + 1)).alias("elapsed_ms"), F.lit(0).alias("retry_round"), "terminal")


@query("a10_completion_percentile", f"""WITH s AS ({SAMPLES.replace('{n}', '(SELECT range AS id FROM range(64))')}), t AS (SELECT count(*) AS n FROM order_status), q AS (SELECT unnest([50.0, 90.0]) AS p)
SELECT CAST(p AS DOUBLE) AS percent, CAST(coalesce((SELECT min(elapsed_ms) FROM s WHERE terminal >= ceil(p / 100 * n)), (SELECT max(elapsed_ms) FROM s)) AS DOUBLE) AS elapsed_ms FROM q, t""")
def completion_percentile(fx: Inputs) -> DataFrame:
    total, rows = fx("order_status").count(), samples(fx)
    out = [R.completion_percentile(rows, total, p).withColumn("percent", F.lit(p)) for p in (50.0, 90.0)]
    return out[0].unionByName(out[1])


@query("a11_throughput", "SELECT shard_id, count(*) FILTER (status IN ('matched', 'missed')) / 22.5 AS orders_per_second FROM order_status GROUP BY shard_id")
def throughput(fx: Inputs) -> DataFrame:
    done = fx("order_status").groupBy("shard_id").agg(F.count_if(F.col("status").isin("matched", "missed")).alias("n"))
    return done.select("shard_id", R.throughput(F.col("n").cast("double"), F.lit(22.5)).alias("orders_per_second"))


@query("a12_capacity_report_all", """WITH c AS (SELECT (SELECT count(*) FROM riders_small) AS riders, CAST(2.0 AS DOUBLE) AS seconds UNION ALL SELECT (SELECT count(*) FROM riders), 20.0)
SELECT CAST(riders AS INT) AS riders, CAST((SELECT max(order_id) FROM order_status) AS INT) AS orders, m AS matched, k AS missed, round(m / greatest(n, 1), 6) AS match_rate, CAST((m + k) / seconds AS DOUBLE) AS orders_per_second
FROM c, (SELECT count(*) AS n, count(*) FILTER (status = 'matched') AS m, count(*) FILTER (status = 'missed') AS k FROM order_status)""")
def capacity_report_all(fx: Inputs) -> DataFrame:
    status, last = fx("order_status"), last_order(fx)
    return R.capacity_report([(fx("riders_small").count(), last, status, 2.0), (fx("riders").count(), last, status, 20.0)])


INCREASE = "i AS (SELECT metric, ts, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS increase FROM counter_samples WINDOW w AS (PARTITION BY metric ORDER BY ts))"


@query("t6_event_rate_windows", f"WITH {INCREASE} SELECT metric, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start, CAST(sum(increase) AS DOUBLE) AS increase FROM i GROUP BY ALL")
def event_rate_windows(fx: Inputs) -> DataFrame:
    out = R.event_rate_windows(fx("counter_samples"), "1 day")
    return out.select("metric", F.unix_timestamp("window_start").alias("window_start"), "increase")


@query("t6_event_rate_sliding", f"WITH {INCREASE} SELECT metric, CAST(floor(epoch(ts) / 21600) * 21600 - 21600 * k AS BIGINT) AS window_start, CAST(sum(increase) AS DOUBLE) AS increase FROM i, (SELECT range AS k FROM range(4)) GROUP BY ALL")
def event_rate_sliding(fx: Inputs) -> DataFrame:
    out = R.event_rate_windows(fx("counter_samples"), "1 day", "6 hours")
    return out.select("metric", F.unix_timestamp("window_start").alias("window_start"), "increase")


@query("t7_sustained_breach", f"""WITH {INCREASE}, b AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts) - row_number() OVER (PARTITION BY metric, increase >= 3 ORDER BY ts) AS island FROM i)
SELECT metric, CAST(min(epoch(ts)) AS BIGINT) AS start, CAST(max(epoch(ts)) AS BIGINT) AS "end", count(*) AS samples FROM b WHERE increase >= 3 GROUP BY metric, island HAVING max(epoch(ts)) - min(epoch(ts)) >= 7200""")
def sustained_breach(fx: Inputs) -> DataFrame:
    rows = R.counter_increases(fx("counter_samples"), ["metric"])
    out = R.sustained_breach(rows, F.col("increase") >= 3, 7200, ["metric"])
    return out.select("metric", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "samples")


@query("t8_caught_up_stable", """WITH p AS (SELECT shard_id, seq AS poll, seq % 5 <> 0 AND (seq // 10) % 3 <> 0 AS up, seq // 40 AS e FROM lifecycle), n AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY poll) AS k FROM p)
SELECT a.shard_id, min(d.poll) AS stable_at FROM n a JOIN n b ON b.shard_id = a.shard_id AND b.k = a.k + 1 JOIN n c ON c.shard_id = a.shard_id AND c.k = a.k + 2 JOIN n d ON d.shard_id = a.shard_id AND d.k = a.k + 3
WHERE a.up AND b.up AND c.up AND d.up AND a.e = b.e AND b.e = c.e AND c.e = d.e GROUP BY a.shard_id""".replace("seq % 5 <> 0 AND (seq // 10) % 3 <> 0", "seq % 7 <> 0").replace("seq // 40", "seq // 4000"))
def caught_up_stable(fx: Inputs) -> DataFrame:
    polls = fx("lifecycle").select("shard_id", F.col("seq").alias("poll"), (F.col("seq") % 7 != 0).alias("caught_up"), F.expr("seq div 4000").alias("end_offset"))
    return R.caught_up_stable(polls, ["shard_id"])


@query("t9_liveness_sessions", """WITH h AS (SELECT node_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 900 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM heartbeats WINDOW w AS (PARTITION BY node_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY node_id ORDER BY ts) AS k FROM h)
SELECT node_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_beat, count(*) AS beats FROM s GROUP BY node_id, k""")
def liveness_sessions(fx: Inputs) -> DataFrame:
    out = R.liveness_sessions(fx("heartbeats"), 900)
    return out.select("node_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("last_beat").alias("last_beat"), "beats")


@query("t9_dead_owners", """WITH o AS (SELECT DISTINCT node_id FROM ownership UNION ALL SELECT 9), l AS (SELECT node_id, max(ts) AS last FROM heartbeats GROUP BY node_id)
SELECT CAST(o.node_id AS INT) AS node_id FROM o LEFT JOIN l ON l.node_id = o.node_id WHERE last IS NULL OR last + INTERVAL 900 SECOND <= (SELECT max(ts) FROM heartbeats)""")
def dead_owners(fx: Inputs) -> DataFrame:
    """At the time of the last heartbeat of all; node 9 owns shards and was never heard."""
    beats = fx("heartbeats")
    owners = fx("ownership").select("node_id").unionByName(fx.spark.range(1).select(F.lit(9).alias("node_id")))
    now = F.lit(beats.agg(F.max("ts")).first()[0])
    return R.dead_owners(owners, R.liveness_sessions(beats, 900), now, 900)
