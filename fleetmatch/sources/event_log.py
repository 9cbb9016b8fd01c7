"""Per-shard event logs: scan, resume, tail, end offsets, append and routing; keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from fleetmatch.operators.ranks import with_place
from fleetmatch.schemas import EVENT_LOG
from fleetmatch.sources.runs import Runs, ddl
from fleetmatch.sources.tables import temporary, written


def write_event_log(log: DataFrame, path: str, fmt: str = "json") -> None:
    """Writes the log as one folder per shard; a large shard is several files, by ranges of offsets."""
    log.repartitionByRange("shard_id", "offset_value").sortWithinPartitions("shard_id", "offset_value").write.mode("overwrite").partitionBy("shard_id").format(fmt).save(path)


def read_event_log(spark: SparkSession, path: str, fmt: str = "json", schema: str = EVENT_LOG) -> DataFrame:
    """The records under ``path``; a filter on shard_id prunes folders."""
    return spark.read.schema(schema).format(fmt).load(path)


def tail_event_log(spark: SparkSession, path: str, fmt: str = "json", schema: str = EVENT_LOG, checkpoints: DataFrame | None = None, **options: str) -> DataFrame:
    """The same as a stream: records there are and those that arrive; with ``checkpoints`` (shard_id, offset_value) from there on.

    Positions are read once, when the stream is made: where it begins without a checkpoint
    of its own.  They are as many as shards, so they travel in the plan; the least of them
    reaches the scan.
    """
    rows = spark.readStream.schema(schema).options(**options).format(fmt).load(path)
    if checkpoints is None:
        return rows
    start = {r["shard_id"]: r["offset_value"] for r in checkpoints.select("shard_id", "offset_value").collect()}  # a row a shard
    known = F.create_map(*[F.lit(v) for s, o in start.items() for v in (s, o)]) if start else F.create_map().cast("map<int,bigint>")
    from_here = F.col("offset_value") >= F.coalesce(F.try_element_at(known, F.col("shard_id").cast("int")), F.lit(0))
    others = ~F.col("shard_id").isin(list(start))  # shards without a position are read from 0
    return rows.filter(((F.col("offset_value") >= min(start.values(), default=0)) | others) & from_here)


def read_from_positions(log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Records at or after the shard's checkpoint ``offset_value``; from 0 without one."""
    start = checkpoints.select("shard_id", F.col("offset_value").alias("start"))
    return log.join(start, "shard_id", "left").filter(F.col("offset_value") >= F.coalesce("start", F.lit(0))).drop("start")


def end_offsets(log: DataFrame, shards: DataFrame) -> DataFrame:
    """``shard_id, end_offset``: the next offset of every shard asked for, 0 where there is no record."""
    ends = log.groupBy("shard_id").agg((F.max("offset_value") + 1).alias("end_offset"))
    return shards.select("shard_id").join(ends, "shard_id", "left").select("shard_id", F.coalesce("end_offset", F.lit(0)).cast("long").alias("end_offset"))


def append_events(log: DataFrame, new: DataFrame, order_by: str | list[str]) -> DataFrame:
    """``new`` with dense ``offset_value`` per shard that go on from the log, in the order of ``order_by``."""
    return _appended(log.groupBy("shard_id").agg((F.max("offset_value") + 1).alias("end_offset")), new, order_by)


def append_to_ends(ends: DataFrame, new: DataFrame, order_by: str | list[str]) -> DataFrame:
    """The same for a log that ends at ``ends`` (shard_id, end_offset; none for empty shards)."""
    return _appended(ends, new, order_by)


def _appended(ends: DataFrame, new: DataFrame, order_by: str | list[str]) -> DataFrame:
    ends = ends.select("shard_id", F.col("end_offset").alias("_end"))
    placed = with_place(new, ["shard_id"], order_by, "_nth").join(ends, "shard_id", "left")
    return placed.withColumn("offset_value", (F.coalesce("_end", F.lit(0)) + F.col("_nth") - 1).cast("long")).drop("_end", "_nth")


ENDS = "shard_id int, end_offset long"


def append_stream(events: DataFrame, path: str, order_by: list[str], checkpoint: str, key: str | None = None, shards: list[int] | None = None) -> StreamingQuery:
    """Appends a stream of events to the log under ``path``: dense offsets per shard, batch after batch, in each by ``order_by``.

    With ``key`` the shard is ``route_by_shard_key`` of that column over ``shards``.  A batch
    writes its records to batch=N/shard_id=..., and then the ends of all shards to the ledger
    beside it; what has no ledger entry is not part of the log (``read_appended``).  A batch
    that is run again after a failure starts from the ledger of the batch before and
    replaces whatever it had left.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if key is not None:
            batch = route_by_shard_key(batch.withColumn("key", F.col(key)), shards or [0]).withColumn("shard_id", F.col("partition")).drop("partition", *([] if key == "key" else ["key"]))
        with temporary(spark):
            ends = spark.read.schema(ENDS).parquet(f"{path}-ledger/batch={number - 1}") if number else spark.createDataFrame([], ENDS)
            placed = written(_appended(ends, batch, order_by))
            out = placed.repartitionByRange("shard_id", "offset_value").sortWithinPartitions("shard_id", "offset_value")
            out.write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/batch={number}")
            new = placed.groupBy("shard_id").agg((F.max("offset_value") + 1).alias("end_offset"))
            after = ends.unionByName(new).groupBy("shard_id").agg(F.max("end_offset").alias("end_offset"))  # a row a shard
            after.coalesce(1).write.mode("overwrite").parquet(f"{path}-ledger/batch={number}")

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log that ``append_stream`` keeps: records of the batches that the ledger has."""
    done = spark.read.schema(f"{ENDS}, batch long").parquet(f"{path}-ledger").select("batch").distinct()  # a row a batch
    return spark.read.schema(f"{schema}, batch long").parquet(path).join(done, "batch", "left_semi").drop("batch")


def route_by_shard_key(messages: DataFrame, partitions: list[int]) -> DataFrame:
    """Adds ``partition``: the numeric ``key`` if such a partition exists, else the first one."""
    number = F.col("key").try_cast("int")
    return messages.withColumn("partition", F.when(number.isin(partitions), number).otherwise(F.lit(partitions[0])))


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``existing`` with the latest update of each key (by ``version``, ties by the later table) in place of its row."""
    columns = existing.columns
    every = existing.select(*columns, F.lit(0).alias("_late")).unionByName(updates.select(*columns, F.lit(1).alias("_late")))
    latest = Window.partitionBy(*keys).orderBy(F.col("_late").desc(), F.col(version).desc())
    return every.withColumn("_nth", F.row_number().over(latest)).filter("_nth = 1").select(*columns)


def upserted(spark: SparkSession, path: str, schema: str, keys: list[str], version: str) -> Runs:
    """The table that ``upsert_stream`` keeps under ``path``."""
    return Runs(spark, path, schema, keys, order=F.col(version))


def read_upserted(spark: SparkSession, path: str, schema: str, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key in a table that ``upsert_stream`` keeps."""
    runs = upserted(spark, path, schema, keys, version)
    return runs.rows(runs.batches())


def upsert_stream(updates: DataFrame, path: str, keys: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest row of each key (by ``version``, of equal ones the later) under ``path``; a batch writes its own keys only (``sources.runs``)."""

    def merge(batch: DataFrame, number: int) -> None:
        runs = upserted(batch.sparkSession, path, ddl(batch), keys, version)
        runs.merge(number)
        runs.add(upsert(batch.limit(0), batch, keys, version), number)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookup(table: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows of the keys asked for; ``how="left"`` keeps keys that aren't found, with nulls."""
    return keys.select(*on).distinct().join(table, on, how)
