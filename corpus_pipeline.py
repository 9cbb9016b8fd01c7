"""The corpus pipeline: reject toxic texts, deduplicate, decontaminate, mix and shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmatch.llm import decontamination, mixing, near_dedup, sharding, toxicity
from fleetmatch.llm.store import importable, mark, release, table, written
from fleetmatch.sources.tables import scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5.

    Null and empty texts have no evidence and stay; long texts are scored whole; repeated
    rows are scored alike; all columns keep their values, one called ``score`` as well.
    """
    importable(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id.

    Texts without words (null, empty) are in no group and stay; repeated rows are copies,
    so one stays; of rows with one id or none, the first by a hash of the text.
    """
    importable(spark)
    return near_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out; those hit over more than half leave.

    Null and empty texts and texts without a hit stay as they are; repeated rows are
    treated alike; a benchmark without words cuts nothing.
    """
    importable(spark)
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none to three times.

    Null and empty texts have no words and stay once; repeated rows count one by one; a
    null source is a source.
    """
    importable(spark)
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ``size``, ``old`` shard, new ``shard`` and ``slot`` in it, read from the rewritten shards.

    Shards that gain or lose rows are written anew to the shared folder.  Null and empty
    texts take the overhead of a row; repeated rows have a slot each; columns of the added
    names are replaced.
    """
    importable(spark)
    placed = written(sharding.resharded(docs, sharding.old_shard(F.col("source"))))
    return sharding.rewrite_affected(placed, scratch(spark, "shards"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Similarity groups, automata and flows have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all STAGES, each written as Parquet and read again.

    Once a stage's output is written, its input and the tables it made on the way are deleted.
    """
    docs, began = table(spark, sf_dir, "documents"), mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
            release(spark, began, keep=1)
    return docs
