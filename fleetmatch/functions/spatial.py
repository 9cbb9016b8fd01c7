"""Cells, shards and scores on an integer plane, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AREA = 100_000
SHARDS = 64
LOAD_WEIGHT = 10_000
RADII = (1, 3, 8)
RIDERS_PER_CELL = 20


@dataclass(frozen=True)
class Layout:
    """A square of ``area`` cut into cells, and the cells dealt over a grid of shards."""

    area: int = AREA
    cell: int = 10_000
    shards: int = SHARDS

    def __post_init__(self) -> None:
        for name in ("area", "cell", "shards"):
            object.__setattr__(self, name, max(1, getattr(self, name)))

    @property
    def cols(self) -> int:
        return math.isqrt(self.shards - 1) + 1

    @property
    def rows(self) -> int:
        return -(-self.shards // self.cols)

    @property
    def per_axis(self) -> int:
        return -(-self.area // self.cell)

    @property
    def wide(self) -> int:
        """Cells of a shard along x."""
        return -(-self.per_axis // self.cols)

    @property
    def high(self) -> int:
        """Cells of a shard along y."""
        return -(-self.per_axis // self.rows)


def default_cell_size(riders: int, area: int = AREA) -> int:
    """About RIDERS_PER_CELL riders a cell if they lie evenly."""
    return area if riders <= 0 else int(min(max(area / math.sqrt(riders / RIDERS_PER_CELL), 1), area))


def divided(a: str, n: int) -> Column:
    """Integer division of column ``a``, truncating toward zero."""
    return F.expr(f"cast(`{a}` as bigint) div {n}L")


def with_cell(df: DataFrame, cell: int) -> DataFrame:
    """Adds ``cell_x, cell_y`` and the packed ``cell_id`` of columns x and y."""
    cell = max(1, cell)
    out = df.withColumns({"cell_x": divided("x", cell), "cell_y": divided("y", cell)})
    return out.withColumn("cell_id", F.shiftleft("cell_x", 32).bitwiseOR(F.col("cell_y").bitwiseAND(F.lit(0xFFFFFFFF))))


def shard_of(cell_x: Column, cell_y: Column, layout: Layout) -> Column:
    """Shard of a cell; cells outside the square count as its border cells."""

    def along(cell: Column, per_shard: int, shards: int) -> Column:
        inside = F.greatest(F.lit(0), F.least(cell, F.lit(layout.per_axis - 1)))
        return F.least(F.floor(inside / per_shard), F.lit(shards - 1))

    place = along(cell_y, layout.high, layout.rows) * layout.cols + along(cell_x, layout.wide, layout.cols)
    return F.least(place, F.lit(layout.shards - 1)).cast("int")


def with_shard(df: DataFrame, layout: Layout, out: str = "home_shard") -> DataFrame:
    """Adds the shard of columns x and y."""
    return df.withColumn(out, shard_of(divided("x", layout.cell), divided("y", layout.cell), layout))


def neighbor_shards(shards: DataFrame, layout: Layout) -> DataFrame:
    """``shard_id`` -> pairs ``shard_id, neighbor``: the 3 x 3 block around it, itself included; none for unknown ids."""
    at = shards.select("shard_id").filter(F.col("shard_id").between(0, layout.shards - 1))
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    near = at.withColumn("step", F.explode(steps))
    row = divided("shard_id", layout.cols) + F.col("step.r")
    col = F.col("shard_id") % layout.cols + F.col("step.c")
    inside = (row >= 0) & (row < layout.rows) & (col >= 0) & (col < layout.cols)
    pairs = near.filter(inside).select("shard_id", (row * layout.cols + col).cast("int").alias("neighbor"))
    return pairs.filter(F.col("neighbor") < layout.shards)


def other_shards(shards: DataFrame, layout: Layout) -> DataFrame:
    """``shard_id`` -> pairs with every shard that is neither itself nor a neighbour."""
    pairs = shards.select("shard_id", F.explode(F.sequence(F.lit(0), F.lit(layout.shards - 1))).alias("other"))
    near = neighbor_shards(shards, layout).select("shard_id", F.col("neighbor").alias("other"))
    return pairs.join(near, ["shard_id", "other"], "left_anti").filter("other <> shard_id")


def score(cell: int, load_weight: int = LOAD_WEIGHT) -> Column:
    """Cost of a rider (x, y, count as rx, ry, load) for an order (x, y): cells of Manhattan distance, and load."""
    return F.expr(f"(abs(cast(x as bigint) - rx) + abs(cast(y as bigint) - ry)) div {max(1, cell)}L + load * {load_weight}L")
