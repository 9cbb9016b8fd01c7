"""Outbox rows: create, claim, split by topic, mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def create_outbox(outbox: DataFrame, new: DataFrame) -> DataFrame:
    """``outbox`` with the rows of ``new`` whose event_id it does not have; repeats in ``new`` count once."""
    fresh = new.dropDuplicates(["event_id"]).join(outbox.select("event_id"), "event_id", "left_anti")
    return outbox.unionByName(fresh.select(*outbox.columns))


def pending_outbox(outbox: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Unpublished rows, of numeric aggregate ids in [low, high] if given."""
    out = outbox.filter("published_at is null")
    if low is None or high is None:
        return out
    return out.filter(F.col("aggregate_id").rlike("^[0-9]+$") & F.col("aggregate_id").try_cast("long").between(low, high))


def claimable(now: int) -> Column:
    return F.col("published_at").isNull() & (F.col("claimed_until") < now)


def claim_outbox(outbox: DataFrame, worker: str, now: int, lease: int = 30, n: int | None = 100) -> DataFrame:
    """The ``n`` oldest claimable rows (by occurred_at, event_id; None: all) as claimed by ``worker``."""
    oldest = outbox.filter(claimable(now))
    oldest = oldest if n is None else oldest.orderBy("occurred_at", "event_id").limit(n)
    return oldest.withColumns({"claimed_by": F.lit(worker), "claimed_until": F.lit(now + lease).cast("long"), "attempts": F.col("attempts") + 1})


def claim_outbox_split(outbox: DataFrame, workers: list[str], now: int, lease: int = 30, n: int = 100) -> DataFrame:
    """Disjoint claims of several workers: every row falls to one by a hash of its id."""
    part = F.pmod(F.xxhash64("event_id"), F.lit(len(workers)))
    claims = [claim_outbox(outbox.filter(part == k), w, now, lease, n) for k, w in enumerate(workers)]
    out = claims[0]
    for more in claims[1:]:
        out = out.unionByName(more)
    return out


def apply_claims(outbox: DataFrame, claimed: DataFrame) -> DataFrame:
    """``outbox`` with the claimed rows in place of theirs."""
    return outbox.join(claimed.select("event_id"), "event_id", "left_anti").select(*outbox.columns).unionByName(claimed.select(*outbox.columns))


def split_by_topic(claimed: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of known topics, and the rest with ``error``."""
    good = F.coalesce(F.col("topic").isin(known), F.lit(False))
    return claimed.filter(good), claimed.filter(~good).withColumn("error", F.concat(F.lit("unknown topic "), F.coalesce("topic", F.lit(""))))


def _marked(outbox: DataFrame, ids: DataFrame, worker: str) -> tuple[DataFrame, Column]:
    listed = ids.select("event_id").distinct().withColumn("_listed", F.lit(True))
    return outbox.join(listed, "event_id", "left"), F.col("_listed") & (F.col("claimed_by") == worker)


def mark_outbox_published(outbox: DataFrame, ids: DataFrame, worker: str, at: int) -> DataFrame:
    """Sets published_at and clears claim and error of the listed rows that ``worker`` holds; adds ``updated``."""
    rows, hit = _marked(outbox, ids, worker)
    hit = F.coalesce(hit, F.lit(False))
    return rows.withColumn("updated", hit).withColumns({
        "published_at": F.when(F.col("updated"), F.lit(at).cast("long")).otherwise(F.col("published_at")),
        "claimed_by": F.when(F.col("updated"), "").otherwise(F.col("claimed_by")),
        "claimed_until": F.when(F.col("updated"), F.lit(0).cast("long")).otherwise(F.col("claimed_until")),
        "last_error": F.when(F.col("updated"), "").otherwise(F.col("last_error")),
    }).drop("_listed")


def checked_updates(marked: DataFrame, wanted: int) -> int:
    """Rows updated; an error if they aren't as many as wanted."""
    n = marked.filter("updated").count()
    if n != wanted:
        raise ValueError(f"marked {n} of {wanted} rows")
    return n


def mark_outbox_failed(outbox: DataFrame, ids: DataFrame, worker: str, error: str) -> DataFrame:
    """Clears the claim and sets last_error of the listed rows that ``worker`` holds; adds ``updated``."""
    rows, hit = _marked(outbox, ids, worker)
    hit = F.coalesce(hit, F.lit(False))
    return rows.withColumn("updated", hit).withColumns({
        "claimed_by": F.when(F.col("updated"), "").otherwise(F.col("claimed_by")),
        "claimed_until": F.when(F.col("updated"), F.lit(0).cast("long")).otherwise(F.col("claimed_until")),
        "last_error": F.when(F.col("updated"), error).otherwise(F.col("last_error")),
    }).drop("_listed")
