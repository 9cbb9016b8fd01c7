"""Consumer checkpoints: guarded upserts and lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetmatch.sources.tables import written

KEY = ["consumer_name", "topic", "shard_id"]


def save_checkpoints(stored: DataFrame, new: DataFrame, arrival: str, key: list[str] = KEY) -> DataFrame:
    """Stored rows after an upsert that lower epochs cannot overwrite.

    Within ``new`` the row of the highest epoch wins, of those the last by ``arrival``;
    it replaces a stored row of the same or a lower epoch, whatever the offsets.
    """
    last = Window.partitionBy(*key).orderBy(F.col("epoch").desc(), F.col(arrival).desc())
    best = new.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1")
    every = stored.select(*stored.columns, F.lit(0).alias("_new")).unionByName(best.select(*stored.columns, F.lit(1).alias("_new")))
    guard = Window.partitionBy(*key).orderBy(F.col("epoch").desc(), F.col("_new").desc())
    return every.withColumn("_nth", F.row_number().over(guard)).filter("_nth = 1").select(*stored.columns)


def save_checkpoints_strict(stored: DataFrame, new: DataFrame, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Table after the upsert, and rejected rows with ``error``; one new row per key and call.

    Lower offsets or epochs than stored are stale; negative shards or offsets and
    epochs or nodes below 1 are invalid.
    """
    old = stored.select(*key, F.col("offset_value").alias("_offset"), F.col("epoch").alias("_epoch"))
    invalid = (F.col("shard_id") < 0) | (F.col("offset_value") < 0) | (F.col("epoch") <= 0) | (F.col("node_id") <= 0)
    stale = (F.col("offset_value") < F.col("_offset")) | (F.col("epoch") < F.col("_epoch"))
    judged = new.join(old, key, "left").withColumn("error", F.when(invalid, "invalid").when(stale, "stale"))
    good = judged.filter("error is null").select(*stored.columns)
    kept = stored.join(good.select(*key), key, "left_anti").select(*stored.columns)
    return kept.unionByName(good), judged.filter("error is not null").select(*new.columns, "error")


def save_checkpoints_in_sequence(stored: DataFrame, new: DataFrame, arrival: str, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """``save_checkpoints_strict`` for any number of rows a key, one after the other by ``arrival``: table after, and rejected rows with ``error``.

    A row counts only if it reaches the offset and the epoch of the last *accepted* row, so
    rows of a key are read in order, with that row alone in memory; what the stored row
    already rules out is left out before.  Of rows of one arrival the lower offset is first.
    """
    old = stored.select(*key, F.col("offset_value").alias("_offset"), F.col("epoch").alias("_epoch"))
    invalid = (F.col("shard_id") < 0) | (F.col("offset_value") < 0) | (F.col("epoch") <= 0) | (F.col("node_id") <= 0)
    stale = (F.col("offset_value") < F.col("_offset")) | (F.col("epoch") < F.col("_epoch"))
    judged = written(new.join(old, key, "left").withColumn("error", F.when(invalid, "invalid").when(stale, "stale")).drop("_offset", "_epoch"))
    columns = [*new.columns, "error"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, offset, epoch = None, 0, 0
        for frame in frames:
            errors = []
            for *k, o, e in zip(*(frame[c] for c in (*key, "offset_value", "epoch")), strict=True):
                if k != last:
                    last, offset, epoch = k, o, e
                good = o >= offset and e >= epoch
                if good:
                    offset, epoch = o, e
                errors.append(None if good else "stale")
            yield frame.assign(error=pd.Series(errors, dtype=object, index=frame.index))

    open_ = judged.filter("error is null").repartition(*key).sortWithinPartitions(*key, arrival, "offset_value", "epoch")
    done = written(open_.mapInPandas(read, judged.schema).select(*columns))
    best = done.filter("error is null").groupBy(*key).agg(F.max_by(F.struct(*[c for c in stored.columns if c not in key]), F.struct(arrival, "offset_value", "epoch")).alias("_row"))
    good = best.select(*key, "_row.*").select(*stored.columns)
    kept = stored.join(good.select(*key), key, "left_anti").select(*stored.columns)
    return kept.unionByName(good), done.unionByName(judged.select(*columns)).filter("error is not null")


def load_checkpoints(stored: DataFrame, consumer: str, topic: str) -> DataFrame:
    return stored.filter((F.col("consumer_name") == consumer) & (F.col("topic") == topic))
