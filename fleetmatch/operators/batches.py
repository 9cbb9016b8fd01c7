"""Inbox deduplication, batch validation and cutting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetmatch.operators.ranks import with_place, with_previous
from fleetmatch.sources.tables import written


def dedupe_inbox(events: DataFrame, inbox: DataFrame, consumer: str) -> tuple[DataFrame, DataFrame]:
    """Events new to the consumer (first by shard, offset), and the inbox rows they add."""
    first = Window.partitionBy("event_id").orderBy("shard_id", "offset_value")
    seen = inbox.filter(F.col("consumer_name") == consumer).select("event_id")
    new = events.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth").join(seen, "event_id", "left_anti")
    rows = new.select(F.lit(consumer).alias("consumer_name"), "event_id", "shard_id", "offset_value")
    return new, rows


def validate_batches(records: DataFrame, owned: DataFrame) -> DataFrame:
    """Violations ``shard_id, offset_value, error``: empty ids, shards not owned, other shards in the event, gaps."""
    gap = F.col("offset_value") - F.col("_previous")
    mine = owned.select("shard_id", F.lit(True).alias("_owned"))
    checked = with_previous(records, ["shard_id"], "offset_value", "_previous").withColumn("_gap", gap).join(mine, "shard_id", "left")
    error = (
        F.when(F.coalesce("event_id", F.lit("")) == "", "empty event id")
        .when(F.col("_owned").isNull(), "shard not owned")
        .when(F.col("event_shard_id") != F.col("shard_id"), "event of another shard")
        .when(F.col("_gap") != 1, "offset gap")
    )
    return checked.withColumn("error", error).filter("error is not null").select("shard_id", "offset_value", "error")


#: Records that are cut in one task; what a batch can reach beyond them comes along.
BLOCK = 65_536


def micro_batches(records: DataFrame, size: int = 100, wait: int | None = None, at: str = "arrived_at") -> DataFrame:
    """Adds ``batch_no``: consecutive records of a shard in batches of at most ``size``.

    With ``wait`` a batch also ends ahead of the first record that comes ``wait`` or more
    after its first one, by the whole-number column ``at``, which does not fall along a
    shard.  Where a batch ends depends on where it began; so every block of records says
    for each place a batch can begin in it where one begins in the next block, these are
    followed from block to block, and then each block is cut from its own beginning.
    """
    placed = with_place(records, ["shard_id"], "offset_value", "_nth")
    if wait is None:
        return placed.withColumn("batch_no", F.floor((F.col("_nth") - 1) / size).cast("long")).drop("_nth")
    at_, block = F.col("_nth") - 1, max(BLOCK, size)
    rows = placed.withColumns({"_block": F.floor(at_ / block).cast("long"), "_at": (at_ % block).cast("long")})
    lean = rows.select("shard_id", "_block", "_at", F.col(at).cast("long").alias("_time"))
    ahead = lean.filter((F.col("_block") > 0) & (F.col("_at") < size)).withColumns({"_block": F.col("_block") - 1, "_at": F.col("_at") + block})
    parts = written(lean.unionByName(ahead)).groupBy("shard_id", "_block")
    kind = dict(lean.dtypes)["shard_id"]

    def ways(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, follows = _follows(part, block, size, wait)
        end = np.arange(len(follows) + 1)
        for i in range(n - 1, -1, -1):
            end[i] = follows[i] if follows[i] >= n else end[follows[i]]
        return pd.DataFrame([[*key, (end[: min(size, n)] - n).tolist()]], columns=["shard_id", "_block", "_ends"])

    leads = written(parts.applyInPandas(ways, f"shard_id {kind}, _block long, _ends array<long>"))
    chain = F.array_sort(F.collect_list(F.struct("_block", "_ends")))  # a row a block
    follow = lambda acc, b: F.concat(acc, F.array(F.get(b["_ends"], F.element_at(acc, -1).cast("int"))))
    begins = leads.groupBy("shard_id").agg(F.aggregate(chain, F.array(F.lit(0).cast("long")), follow).alias("_begins"))
    begins = begins.select("shard_id", F.posexplode("_begins").alias("_block", "_begin")).filter("_begin is not null")
    begins = begins.select("shard_id", F.col("_block").cast("long").alias("_block"), F.lit(None).cast("long").alias("_at"), F.col("_begin").alias("_time"))

    def cut(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        begin, part = part[part._at.isna()], part[part._at.notna()]
        n, follows = _follows(part, block, size, wait)
        first = np.zeros(n, dtype="int64")
        i = int(begin._time.iloc[0]) if len(begin) else n
        while i < n:
            first[i] = 1
            i = int(follows[i])
        return pd.DataFrame({"shard_id": key[0], "_block": key[1], "_at": np.arange(n), "_own": np.cumsum(first)})

    own = written(written(lean.unionByName(ahead).unionByName(begins)).groupBy("shard_id", "_block").applyInPandas(cut, f"shard_id {kind}, _block long, _at long, _own long"))
    counts = own.groupBy("shard_id", "_block").agg(F.max("_own").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # a row a block
    joined = rows.join(own, ["shard_id", "_block", "_at"]).join(counts.select("shard_id", "_block", before.alias("_before")), ["shard_id", "_block"])
    return joined.select(*records.columns, (F.col("_before") + F.col("_own") - 1).cast("long").alias("batch_no"))


def _follows(part: pd.DataFrame, block: int, size: int, wait: int) -> tuple[int, np.ndarray]:
    """Number of a block's own records, and for each record of ``part`` the first one that its batch would not hold."""
    part = part.sort_values("_at")
    time = part._time.to_numpy(dtype="int64")
    n = int((part._at < block).sum())
    return n, np.minimum(np.arange(len(time)) + size, np.searchsorted(time, time + wait, side="left"))


def stream_dedupe(events: DataFrame, late: str) -> DataFrame:
    """Each event id of a stream once: the first to come.  An id is forgotten when the watermark is ``late`` past its event's time (occurred_at); events later than that are dropped."""
    rows = events.withColumn("_ts", F.timestamp_seconds("occurred_at")).withWatermark("_ts", late)
    return rows.dropDuplicatesWithinWatermark(["event_id"]).drop("_ts")
