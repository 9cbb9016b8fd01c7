"""Riders kept as one folder per shard: select, replace or remove a shard wholesale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmatch.functions.spatial import Layout, with_shard


def write_shards(riders: DataFrame, layout: Layout, path: str) -> None:
    """Writes ``riders`` (uid, x, y, ...) under ``path``/home_shard=..., a large shard in several files."""
    placed = with_shard(riders, layout)
    placed.repartitionByRange("home_shard", "uid").write.mode("overwrite").partitionBy("home_shard").parquet(path)


def read_shards(spark: SparkSession, path: str, *shards: int) -> DataFrame:
    """Riders of the shards asked for (all by default); only their folders are read."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("home_shard").isin(*shards)) if shards else rows


def replace_shard(riders: DataFrame, path: str, shard: int) -> None:
    """``riders`` in place of all riders of ``shard``; other shards' folders stay.  None empties the shard."""
    if riders.limit(1).count():
        rows = riders.drop("home_shard").withColumn("home_shard", F.lit(shard))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("home_shard").parquet(path)
    else:
        remove_shard(riders.sparkSession, path, shard)


def remove_shard(spark: SparkSession, path: str, shard: int) -> None:
    """Deletes the shard's folder, if there is one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/home_shard={shard}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
