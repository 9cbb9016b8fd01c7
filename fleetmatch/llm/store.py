"""What the corpus operators share: intermediate tables, names that are free, numbered rows, joins on hot keys."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmatch.sources.tables import importable, mark, release, table, written

__all__ = ["Numbered", "fresh", "hot_join", "importable", "mark", "numbered", "others", "release", "table", "written"]

#: Keys with more than one in HOT of all rows are spread over WAYS tasks each; there are fewer than HOT of them.
HOT, WAYS = 1000, 64


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, added: list[str]) -> list[str]:
    """Columns of ``df`` but for those that have one of the ``added`` names, in whatever case."""
    return [c for c in df.columns if c.lower() not in {a.lower() for a in added}]


class Numbered(NamedTuple):
    rows: DataFrame
    name: str  # of the column that tells rows apart
    is_id: bool  # whether that is the id itself


def numbered(docs: DataFrame, id_: str, *more: str) -> Numbered:
    """``docs`` and a long column that tells rows apart and orders them as ``id_`` does.

    That is ``id_`` itself where it is an integer, unique and never null (checked on that
    column alone).  Otherwise rows are sorted by it (nulls first), then by a hash of the
    columns ``more``, which also spreads an id that many rows share, and numbered.
    """
    name = fresh(docs, "_row")
    if dict(docs.dtypes)[id_] in ("bigint", "int", "smallint", "tinyint"):
        ids = docs.groupBy(id_).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.max(F.col(id_).isNull()).alias("null")).first()
        if (ids["n"] or 0) <= 1 and not ids["null"]:
            return Numbered(docs.withColumn(name, F.col(id_).cast("long")), name, True)
    order = docs.orderBy(id_, F.xxhash64(*[F.col(c) for c in more]) if more else F.lit(0))
    return Numbered(written(order.withColumn(name, F.monotonically_increasing_id())), name, False)


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, by: Column) -> DataFrame:
    """``rows`` inner-joined to ``keyed`` (one row per key, ``count`` rows each), with hot keys spread out.

    A key that more than one row in HOT has is dealt over WAYS tasks by the column ``by``
    of ``rows``, against as many copies of its row of ``keyed``.  Fewer than HOT keys can
    be hot, so their list is safe to broadcast.  ``keyed`` should be written; keys are not null.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    ways, part = fresh(rows, "_ways"), fresh(rows, "_part")
    is_hot = F.col(count) * HOT > F.lit(total)
    hot = F.broadcast(keyed.filter(is_hot).select(*on, F.lit(WAYS).alias(ways)))
    left = rows.join(hot, on, "left").withColumn(part, F.pmod(F.xxhash64(by), F.coalesce(F.col(ways), F.lit(1))).cast("int"))
    right = keyed.withColumn(part, F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(WAYS - 1)).otherwise(F.lit(0)))))
    return left.drop(ways).join(right, [*on, part]).drop(part)
