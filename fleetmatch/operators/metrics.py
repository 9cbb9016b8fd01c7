"""Reports over orders, logs and samples, and time-series conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_result_summary(orders: DataFrame, start: int, end: int) -> DataFrame:
    """One row: created, matched, missed, terminal, max_attempt, match_rate of orders with ids in [start, end]."""
    some = orders.filter(F.col("order_id").between(start, end))
    sums = some.agg(
        F.count(F.lit(1)).alias("created"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "missed").alias("missed"),
        F.coalesce(F.max("attempt"), F.lit(0)).alias("max_attempt"),
    )
    rate = F.round(F.col("matched") / F.greatest("created", F.lit(1)), 6)
    return sums.select("created", "matched", "missed", (F.col("matched") + F.col("missed")).alias("terminal"), "max_attempt", rate.alias("match_rate"))


def retry_progress(orders: DataFrame, attempts: int) -> DataFrame:
    """``retry_round, terminal`` for rounds 0 to ``attempts``: matched, or missed after that many attempts."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(attempts))).alias("retry_round")
    counts = orders.groupBy("status", "attempt").agg(F.count(F.lit(1)).alias("n")).select("*", rounds)
    hit = (F.col("status") == "matched") | ((F.col("status") == "missed") & (F.col("attempt") >= F.col("retry_round")))
    return counts.groupBy("retry_round").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("terminal"))


def shard_lag(shards: DataFrame, ends: DataFrame, checkpoints: DataFrame, ownership: DataFrame) -> DataFrame:
    """``shard_id, end_offset, checkpoint, lag, epoch`` of all shards; lag is 0 at least, epoch 0 without an owner."""
    rows = shards.join(ends, "shard_id", "left")
    rows = rows.join(checkpoints.select("shard_id", F.col("offset_value").alias("_cp")), "shard_id", "left")
    rows = rows.join(ownership.select("shard_id", F.col("epoch").alias("_epoch")), "shard_id", "left")
    end, cp = F.coalesce("end_offset", F.lit(0)).cast("long"), F.coalesce("_cp", F.lit(0)).cast("long")
    return rows.select("shard_id", end.alias("end_offset"), cp.alias("checkpoint"), F.greatest(F.lit(0), end - cp).cast("long").alias("lag"), F.coalesce("_epoch", F.lit(0)).cast("long").alias("epoch"))


def max_shard_lag(lags: DataFrame) -> DataFrame:
    return lags.agg(F.greatest(F.lit(0), F.coalesce(F.max("lag"), F.lit(0))).cast("long").alias("max_lag"))


def shard_progress(lags: DataFrame) -> DataFrame:
    """Totals of end offsets and checkpoints, and whether every shard has caught up."""
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}") for c in ("end_offset", "checkpoint")]
    return lags.agg(*total, F.coalesce(F.bool_and(F.col("checkpoint") >= F.col("end_offset")), F.lit(True)).alias("caught_up"))


def event_counts(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))


def completion_percentile(samples: DataFrame, total: int, percent: float) -> DataFrame:
    """Elapsed time of the first round-0 sample with the nearest-rank share of ``total`` terminal; else the last sample's; else 0."""
    target = F.ceil(F.lit(percent / 100.0) * F.lit(total))
    first = F.min(F.when((F.col("retry_round") == 0) & (F.col("terminal") >= target), F.col("elapsed_ms")))
    last = F.max("elapsed_ms")
    return samples.agg(F.coalesce(first, last, F.lit(0.0)).alias("elapsed_ms"))


def throughput(done: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, done / seconds).otherwise(F.lit(0.0))


def capacity_report(scenarios: list[tuple[int, int, DataFrame, float]]) -> DataFrame:
    """One row per scenario (riders, orders, outcome table, seconds)."""
    rows = []
    for riders, orders, table, seconds in scenarios:
        one = order_result_summary(table, 1, orders)
        rows.append(one.select(F.lit(riders).alias("riders"), F.lit(orders).alias("orders"), "matched", "missed", "match_rate", throughput(F.col("terminal").cast("double"), F.lit(seconds)).alias("orders_per_second")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def write_report(report: DataFrame, path: str) -> None:
    """One small table as CSV with a header."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def counter_increases(samples: DataFrame, series: list[str], at: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``increase`` over the sample before in its series; after a reset the new value counts."""
    order = Window.partitionBy(*series).orderBy(at)
    step = F.col(value) - F.lag(value).over(order)
    return samples.withColumn("increase", F.when(step.isNull(), 0.0).when(step < 0, F.col(value)).otherwise(step))


def event_rate_windows(samples: DataFrame, width: str, slide: str | None = None, series: tuple[str, ...] = ("metric",), at: str = "ts", value: str = "value") -> DataFrame:
    """Increase of each counter series per window of event time: series, window_start, window_end, increase."""
    rows = counter_increases(samples, list(series), at, value)
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = rows.groupBy(*series, window.alias("w")).agg(F.sum("increase").alias("increase"))
    return out.select(*series, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "increase")


def sustained_breach(samples: DataFrame, condition: Column, seconds: int, series: list[str], at: str = "ts") -> DataFrame:
    """Stretches of samples where ``condition`` holds throughout, at least ``seconds`` long: series, start, end, samples.

    Gaps and islands: the number of failing samples so far names the island.
    """
    order = Window.partitionBy(*series).orderBy(at)
    rows = samples.withColumn("_bad", condition).withColumn("_island", F.sum((~F.col("_bad")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.filter("_bad").groupBy(*series, "_island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("samples"))
    return runs.filter(F.unix_timestamp("end") - F.unix_timestamp("start") >= seconds).drop("_island")


def caught_up_stable(polls: DataFrame, series: list[str], n: int = 3) -> DataFrame:
    """First poll of each series after which it stayed caught up with the same end offset for ``n`` further polls.

    ``polls`` has poll, caught_up, end_offset; any other poll starts the count anew.
    """
    order = Window.partitionBy(*series).orderBy("poll")
    same = F.col("caught_up") & F.lag("caught_up").over(order) & (F.col("end_offset") == F.lag("end_offset").over(order))
    rows = polls.withColumn("_goes_on", F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("_run", F.sum((~F.col("_goes_on")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*series, "_run").orderBy("poll")) - 1)
    return rows.filter(F.col("caught_up") & (F.col("_nth") == n)).groupBy(*series).agg(F.min("poll").alias("stable_at"))


def liveness_sessions(heartbeats: DataFrame, ttl_seconds: float, at: str = "ts") -> DataFrame:
    """Sessions of each node while heartbeats are at most the TTL (whole seconds, 1 at least) apart: node_id, start, last_beat, beats.

    A beat exactly the TTL after the one before starts a new session.
    """
    ttl = max(1, -int(-ttl_seconds // 1))
    rows = heartbeats.withColumn("_at", F.col(at))
    out = rows.groupBy("node_id", F.session_window(at, f"{ttl} seconds").alias("s")).agg(F.max("_at").alias("last_beat"), F.count(F.lit(1)).alias("beats"))
    return out.select("node_id", F.col("s.start").alias("start"), "last_beat", "beats")


def dead_owners(ownership: DataFrame, sessions: DataFrame, now: Column, ttl_seconds: float) -> DataFrame:
    """Owners whose last heartbeat is at least the TTL ago, or who never sent one."""
    ttl = max(1, -int(-ttl_seconds // 1))
    last = sessions.groupBy("node_id").agg(F.max("last_beat").alias("last"))
    owners = ownership.select("node_id").distinct().join(last, "node_id", "left")
    alive = F.unix_micros(F.col("last").cast("timestamp")) + ttl * 1_000_000 > F.unix_micros(now.cast("timestamp"))
    return owners.filter(~F.coalesce(alive, F.lit(False))).select("node_id")
