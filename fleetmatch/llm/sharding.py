"""Resharding by minimum-cost flow.

Given where rows lie now and what each shard may hold, a transport problem between
shards (a few dozen nodes, solved on the driver) says how many bytes each old shard
sends to each new one so that the fewest bytes move.  Rows then follow in blocks:
an old shard is laid out block after block, largest rows first, and each
destination takes one stretch of that layout.  What stays is the front of the
layout, so the stretches that move are cut among small rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetmatch.llm.store import fresh, numbered, others, table, written

SHARDS = 24
OVERHEAD = 8  # bytes a row takes besides its text


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def min_cost_flow(supply: list[int], demand: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Cheapest transport of ``supply`` into ``demand`` (equal sums): {(i, j): amount}.

    Successive shortest augmenting paths over the residual graph, found with
    Bellman-Ford; each path saturates a supply, a demand or a residual arc.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand must have the same sum")
    flow: dict[tuple[int, int], int] = {}
    left, open_ = list(supply), list(demand)
    n, m = len(supply), len(demand)
    while any(left):
        far = [0 if left[i] else None for i in range(n)]
        to = [None] * m
        via_j, via_i = [None] * m, [None] * n
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if far[i] is None:
                    continue
                for j in range(m):
                    d = far[i] + cost(i, j)
                    if to[j] is None or d < to[j]:
                        to[j], via_j[j], changed = d, i, True
            for (i, j), amount in flow.items():  # backwards, where something flows
                if amount and to[j] is not None and (far[i] is None or to[j] - cost(i, j) < far[i]):
                    far[i], via_i[i], changed = to[j] - cost(i, j), j, True
        end = min((j for j in range(m) if open_[j]), key=lambda j: (to[j], j))
        path, j = [], end
        while True:
            i = via_j[j]
            path.append((i, j, 1))
            if via_i[i] is None:
                break
            path.append((i, via_i[i], -1))
            j = via_i[i]
        amount = min([left[i], open_[end], *(flow[a, b] for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a, b] = flow.get((a, b), 0) + sign * amount
        left[i] -= amount
        open_[end] -= amount
    return {k: v for k, v in flow.items() if v}


def stretches(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, new, start, end) in bytes of the old shard's layout; what stays comes first."""
    out = []
    for i in sorted({i for i, _ in flow}):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            out.append((i, j, at, at + flow[i, j]))
            at += flow[i, j]
    return out


def placements(lean: DataFrame, shards: int = SHARDS, block_rows: int = 4096) -> DataFrame:
    """``row`` (unique, long), ``old, size`` (written) -> the same with ``shard`` int and ``slot`` long.

    Rows of an old shard are grouped into blocks of about ``block_rows`` rows of
    like size; only blocks are sorted and summed as a whole, so a shard that holds
    a third of all rows is spread over many tasks.  Within a shard slots run from 0
    without gaps.  Rows of one size are laid out by ``row``.  An empty table gives an empty table.
    """
    spark = lean.sparkSession
    rows = lean.withColumn("band", F.floor(F.log2(F.col("size"))).cast("int"))
    classes = rows.groupBy("old", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    rows = rows.join(classes, ["old", "band"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")
    block = ["old", "band", "block"]
    in_block = Window.partitionBy(*block).orderBy(F.col("size").desc(), "row")
    rows = rows.withColumns({"nth": F.row_number().over(in_block), "before": F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    blocks = written(rows.groupBy(*block).agg(F.sum("size").alias("bytes")))
    layout = Window.partitionBy("old").orderBy(F.col("band").desc(), "block").rowsBetween(Window.unboundedPreceding, 0)
    starts = blocks.withColumn("start", F.sum("bytes").over(layout) - F.col("bytes")).drop("bytes")
    held = {r["old"]: r["bytes"] for r in blocks.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}  # one row a shard
    supply = [held.get(i, 0) for i in range(max([shards - 1, *held]) + 1)]
    cuts = stretches(min_cost_flow(supply, capacities(sum(supply), shards)))
    cut = spark.createDataFrame(cuts, "old int, shard int, low long, high long")  # at most shards x shards rows
    middle = F.col("start") + F.col("before") + F.floor(F.col("size") / 2)
    placed = rows.join(starts, block).withColumn("middle", middle)
    placed = placed.join(F.broadcast(cut), (placed["old"] == cut["old"]) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")))
    placed = written(placed.select("row", rows["old"], "size", "band", "block", "nth", "shard"))
    pieces = placed.groupBy(*block, "shard").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    filled = Window.partitionBy("shard").orderBy("old", F.col("band").desc(), "block").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("from", F.sum("n").over(filled) - F.col("n") - F.col("first"))
    out = placed.join(pieces.select(*block, "shard", "from"), [*block, "shard"])
    return out.select("row", "old", "size", "shard", (F.col("from") + F.col("nth")).cast("long").alias("slot"))


def old_shard(source: Column, shards: int = SHARDS) -> Column:
    """Where rows lie before: the sources dealt over the shards, so shards differ much in size."""
    return F.pmod(F.crc32(F.coalesce(source.cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


ADDED = ["size", "old", "shard", "slot"]


def resharded(docs: DataFrame, old: Column, shards: int = SHARDS, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``size`` long, ``old`` int, ``shard`` int and ``slot`` long.

    Null texts take OVERHEAD bytes, as empty ones do; a text of any length is one row of
    its size.  Input columns of these names are replaced.  Repeated rows, repeated and null
    ids are rows with a slot each.  Texts are shuffled once, in the last join; all
    decisions are made on row numbers and sizes.
    """
    rows, row, _ = numbered(docs, id_, text)
    lean = written(rows.select(F.col(row).alias("row"), old.alias("old"), row_size(F.col(text)).alias("size")))
    own = fresh(rows, "_own")
    placed = placements(lean, shards).select(F.col("row").alias(row), F.struct(*ADDED).alias(own))
    joined = rows.join(placed, row)
    return joined.select(*others(docs, ADDED), *[F.col(own)[c].alias(c) for c in ADDED])


def rewrite_affected(placed: DataFrame, path: str, rows_per_file: int = 100_000) -> DataFrame:
    """Writes the shards that gain or lose rows under ``path``/shard=N; ``placed`` with their rows read from there.

    Shards that stay as they are aren't written.  ``placed`` should be written, as it is read more than once.
    """
    moved = placed.filter(F.col("old") != F.col("shard"))
    hit = moved.select(F.explode(F.array("old", "shard")).alias("s")).distinct().collect()  # at most one row a shard
    affected = sorted(r["s"] for r in hit)
    if not affected:
        return placed
    chunk = fresh(placed, "_chunk")
    out = placed.filter(F.col("shard").isin(affected)).withColumn(chunk, F.floor(F.col("slot") / rows_per_file))
    out = out.repartition("shard", chunk).sortWithinPartitions("shard", "slot").drop(chunk)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    read = placed.sparkSession.read.schema(placed.schema).parquet(path).filter(F.col("shard").isin(affected))
    return read.select(*placed.columns).unionByName(placed.filter(~F.col("shard").isin(affected)))


def op3_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, row, _ = numbered(table(spark, sf_dir, "documents"), "doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    lean = written(rows.select(F.col(row).alias("row"), "doc_id", old_shard(F.col("source")).alias("old"), row_size(F.col("text")).alias("size"), crc))
    placed = lean.select("row", "doc_id", "text_crc32").join(placements(lean.select("row", "old", "size")), "row")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )
