"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them.

Equal vectors of a label are one weighted vector from here on.  A label's vectors are split
into cells by spherical k-means, and large cells again, until they have about CELL members.
Centroids are trained cell by cell in tasks, each on a bounded sample of the cell.  A vector
lies in the cell of its nearest centroid and visits every other cell that a vector within the
cosine limit of it could lie in: those whose bisecting plane is no farther than the largest
chord that the limit allows.  So no pair is missed, whatever the centroids.  Visits are
copies, so a split must pay: of ever fewer parts, the first is taken that makes at most
GROWTH rows of one and halves the products, while the copies over all levels stay under
COPIES.  A cell for which there is none stays whole.
Within a cell visitors and members are compared with members, block against block, as matrix
products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmatch.llm.components import components
from fleetmatch.llm.store import hot_join, numbered, table, written

COSINE = 0.98
#: Members of a cell that is not split; the most parts of one split, and the least.
CELL, FAN, LEAST = 2048, 64, 4
#: k-means of a cell is fitted on about this many of its vectors a part at most; every vector is indexed.
SAMPLE = 64
#: Bytes of vectors in one task that splits, and in one side of a block pair: a cell that stays whole is copied to as many tasks as it has blocks.
BLOCK_BYTES, PAIR_BYTES = 8 << 20, 24 << 20
#: Rows that one split may make of one, and all splits of a cell together.
GROWTH, COPIES = 3.0, 8.0
PLACE = ["label", "d", "cell"]


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors ``x``; starts from evenly spaced rows, empty cells keep their centroid."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centre)
    return centre


def _units(vectors: DataFrame, id_: str, embedding: str, label: str) -> DataFrame:
    """``id, label, unit``: vectors that can link, scaled to length 1 in double precision."""
    wide = F.transform(embedding, lambda v: v.cast("double"))
    usable = F.col(label).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)
    rows = vectors.filter(usable).select(F.col(id_).alias("id"), F.col(label).alias("label"), wide.alias("v"))
    finite = ~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    top = F.array_max(F.transform("v", lambda v: F.abs(v)))
    rows = rows.filter(finite).withColumn("top", top).filter("top > 0").withColumn("v", F.transform("v", lambda v: v / F.col("top")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v))
    return rows.withColumn("norm", norm).select("id", "label", F.transform("v", lambda v: v / F.col("norm")).alias("unit"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _visited(x: np.ndarray, centre: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, and which cells it visits (its own included)."""
    near = x @ centre.T
    own = np.argmax(near, axis=1)
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (centre @ centre.T)))
    return own, near[np.arange(len(x)), own][:, None] - near <= chord * apart[own] + 1e-12


def _centroids(rows: DataFrame, large: DataFrame, chord: float) -> DataFrame:
    """PLACE, ``n, k, by`` (rows that the split makes of one), ``centre`` (flat) of the cells in ``large`` that are split to advantage."""
    k = F.least(F.lit(FAN), F.greatest(F.lit(LEAST), F.ceil(F.col("n") / F.lit(CELL)))).cast("int")
    wanted = large.withColumn("k", k)
    chance = F.lit(2**31 - 1) * F.least(F.lit(1.0), F.col("k") * SAMPLE / F.col("n"))
    some = rows.join(wanted, PLACE).filter(F.pmod(F.xxhash64("unit", "cell"), F.lit(2**31 - 1)) < chance).select(*PLACE, "n", "k", "grown", "head", "unit")

    def train(part: pa.Table) -> pa.Table:
        part = part.sort_by("head")
        x, k, grown = _matrix(part.column("unit")), part.column("k")[0].as_py(), part.column("grown")[0].as_py()
        kept = part.slice(0, 1).select([*PLACE, "n"])
        while k > 1:
            centre = k_means(x, k) if len(x) >= k else None
            visits = float(_visited(x, centre, chord)[1].mean()) if centre is not None else 1.0
            if visits < 0.5 and k * visits <= GROWTH and grown * k * visits <= COPIES:
                flat = pa.array([centre.ravel()], pa.list_(pa.float64()))
                return kept.append_column("k", pa.array([k], pa.int32())).append_column("by", pa.array([k * visits])).append_column("centre", flat)
            k //= 2
        none = [("k", pa.int32()), ("by", pa.float64()), ("centre", pa.list_(pa.float64()))]
        return kept.slice(0, 0).append_column(*_none(*none[0])).append_column(*_none(*none[1])).append_column(*_none(*none[2]))

    kind = dict(rows.dtypes)["label"]
    return some.groupBy(*PLACE).applyInArrow(train, f"label {kind}, d int, cell long, n long, k int, by double, centre array<double>")


def _none(name: str, kind: pa.DataType) -> tuple[str, pa.Array]:
    return name, pa.array([], kind)


def _celled(distinct: DataFrame, cosine: float) -> DataFrame:
    """One row per vector and cell: PLACE, ``home, head, weight, unit, grown`` (about the copies that the splits have made of a row)."""
    chord = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    kind = dict(distinct.dtypes)["label"]
    columns = [*PLACE, "home", "head", "weight", "unit", "grown"]
    open_ = distinct.select("label", F.size("unit").alias("d"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "head", "weight", "unit", F.lit(1.0).alias("grown"))
    done = None
    for _ in range(10):  # a cell's number has room for as many levels; what is left then stays whole
        sizes = open_.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
        large = written(sizes)
        if not large.limit(1).count():
            break
        centres = written(_centroids(open_, large, chord))
        rest = open_.join(centres.select(*PLACE), PLACE, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if not centres.limit(1).count():
            return done
        blocks = F.ceil(F.col("n") * F.col("d") * 8 / F.lit(BLOCK_BYTES)).cast("long")
        dealt = centres.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        rows = open_.join(centres.select(*PLACE, blocks.alias("blocks")), PLACE)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("head"), F.col("blocks"))).select(*columns, "block")

        def split(key: tuple, part: pa.Table, centre: pa.Table) -> pa.Table:
            if not part.num_rows or not centre.num_rows:
                return part.slice(0, 0).select(columns)
            x = _matrix(part.column("unit"))
            own, visits = _visited(x, centre.column("centre")[0].values.to_numpy().reshape(centre.column("k")[0].as_py(), -1), chord)
            r, c = np.nonzero(visits)
            out = part.take(pa.array(r)).select(columns)
            cell = part.column("cell").to_numpy()[r] * FAN + c + 1
            home = part.column("home").to_numpy(zero_copy_only=False)[r] & (c == own[r])
            grown = part.column("grown").to_numpy()[r] * centre.column("by")[0].as_py()
            return out.set_column(2, "cell", pa.array(cell)).set_column(3, "home", pa.array(home)).set_column(7, "grown", pa.array(grown))

        both = rows.groupBy(*PLACE, "block").cogroup(dealt.groupBy(*PLACE, "block"))
        open_ = written(both.applyInArrow(split, f"label {kind}, d int, cell long, home boolean, head long, weight long, unit array<double>, grown double"))
    return open_ if done is None else done.unionByName(open_)


def linked(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors of one label are linked at a cosine of ``cosine`` or more, in double
    precision.  Null, empty and zero vectors, null labels and vectors with null, NaN or
    infinite components have no links; vectors of different dimensions don't link.
    Rows that share an id or have none are vectors of their own; a component's id is that of
    its first row, by id (nulls first).  Equal vectors link as often as they are there.
    Other columns play no part; an empty table gives an empty one.
    """
    every, row, is_id = numbered(vectors, id_, embedding)
    units = written(_units(every, row, embedding, label))
    distinct = written(units.groupBy("label", "unit").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("weight")))
    placed = written(_celled(distinct, cosine))
    # blocks of members and of visitors; every pair of a block of one and a block of the other is a task's group
    rows_a_block = F.greatest(F.lit(1), F.floor(F.lit(PAIR_BYTES) / (F.col("d") * 8)))
    blocks = placed.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("own")).filter("own > 0")
    blocks = written(blocks.select(*PLACE, F.ceil(F.col("n") / rows_a_block).cast("int").alias("all"), F.ceil(F.col("own") / rows_a_block).cast("int").alias("members")))
    rows = placed.join(blocks, PLACE)
    rows = rows.withColumn("x", F.pmod(F.xxhash64("head", F.lit(1)), F.col("all"))).withColumn("y", F.pmod(F.xxhash64("head", F.lit(2)), F.col("members")))
    asking = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("members").cast("long") - 1))).withColumn("asks", F.lit(True))
    asked = rows.filter("home").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("all").cast("long") - 1))).withColumn("asks", F.lit(False))
    columns = [*PLACE, "x", "y", "asks", "head", "weight", "unit"]
    dealt = asking.select(*columns).unionByName(asked.select(*columns))

    def compare(part: pa.Table) -> pa.Table:
        asks = part.column("asks").to_numpy(zero_copy_only=False)
        a, b = part.filter(pa.array(asks)), part.filter(pa.array(~asks))
        if not a.num_rows or not b.num_rows:
            return LINKS.empty_table()
        x, y = _matrix(a.column("unit")), _matrix(b.column("unit"))
        heads, ids, weight = a.column("head").to_numpy(), b.column("head").to_numpy(), b.column("weight").to_numpy()
        step, out = max(1, (4 << 20) // len(ids)), [LINKS.empty_table()]
        for k in range(0, len(heads), step):
            own = heads[k : k + step]
            near = (x[k : k + step] @ y.T >= cosine) & (own[:, None] != ids[None, :])
            links = near @ weight
            hit = np.flatnonzero(links)
            if len(hit):
                low = np.where(near[hit], ids[None, :], np.iinfo(np.int64).max).min(axis=1)
                out += [_table(own[hit], links[hit], low), _chained(near, own, ids)]
        return pa.concat_tables(out)

    found = written(dealt.groupBy(*PLACE, "x", "y").applyInArrow(compare, "head long, links long, low long"))
    groups = components(found.select(F.col("head").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("head").agg(F.sum("links").alias("links"))
    per_head = distinct.select("label", "unit", "head", "weight").join(links, "head", "left").join(groups.withColumnRenamed("node", "head"), "head", "left")
    per_head = per_head.select("head", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id"))
    own = units.join(distinct.select("label", "unit", "head"), ["label", "unit"]).select(F.col("id").alias("_id"), "head")
    known = own.join(per_head, "head").select("_id", "n_links", "component_id")
    out = every.select(F.col(row).alias("row"), F.col(id_).alias("own")).join(known, F.col("row") == F.col("_id"), "left")
    out = out.select("row", "own", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "row").cast("long").alias("component"))
    kept = (F.col("row") == F.col("component")).alias("kept")
    if is_id:
        return out.select(F.col("own").alias(id_), "n_links", F.col("component").alias("component_id"), kept)
    out = written(out)
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    heads = written(sizes.join(out.select(F.col("row").alias("component"), F.col("own").alias("component_id")), "component"))
    return hot_join(out, heads, ["component"], "n", F.col("row")).select(F.col("own").alias(id_), "n_links", "component_id", kept)


LINKS = pa.schema([("head", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])


def _table(head: np.ndarray, links: np.ndarray, low: np.ndarray) -> pa.Table:
    return pa.table([pa.array(c.astype(np.int64)) for c in (head, links, low)], schema=LINKS)


def _chained(near: np.ndarray, heads: np.ndarray, ids: np.ndarray) -> pa.Table:
    """Edges, without links, that join all neighbours of a row: to the first row that has that neighbour."""
    rows, columns = np.nonzero(near)
    first = np.full(len(ids), -1)
    first[columns[::-1]] = rows[::-1]  # the first row of each column
    to = heads[first[columns]]
    pair = np.unique(np.stack([heads[rows], to]), axis=1)
    used = np.flatnonzero(first >= 0)
    head, low = np.concatenate([pair[0], ids[used]]), np.concatenate([pair[1], heads[first[used]]])
    return _table(head, np.zeros(len(head)), low)


def op2_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS node, vec_id AS low FROM v
  UNION
  SELECT l.b, r.low FROM r JOIN l ON r.node = l.a WHERE r.low < l.b
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.low AS component_id, c.low = v.vec_id AS kept
FROM v JOIN (SELECT node, min(low) AS low FROM r GROUP BY node) c ON c.node = v.vec_id
"""
