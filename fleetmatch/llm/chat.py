"""Chat logs: collapse of cumulative snapshots, then rendering.

Chat services often log a conversation after every turn, so the log holds each
conversation many times, as prefixes of its last state.  A rolling hash over the
turns gives every prefix of every conversation a key; conversations whose whole key
is a proper prefix of another one leave by an anti-join, and of equal conversations
the one with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetmatch.llm.store import table, written


def prefix_keys(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> one row per turn: ``conv_id, nth, n_turns, h1, h2``.

    The key of the first ``nth`` turns is the exclusive-or of a hash of (position, role,
    text) of each, 128 bits in all: it rolls in a window, in constant space per row.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("nth", F.row_number().over(order))
    parts = [p for c in ("role", "text") for p in (F.col(c).isNull(), F.col(c))]  # a hash passes over nulls
    rows = rows.select("conv_id", "nth", F.xxhash64("nth", *parts).alias("a"), F.xxhash64(*parts[::-1], F.lit(1), "nth").alias("b"))
    rolling = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    return rows.select(
        "conv_id", "nth", F.max("nth").over(whole).alias("n_turns"), F.bit_xor("a").over(rolling).alias("h1"), F.bit_xor("b").over(rolling).alias("h2")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations that stay.

    Null roles and texts equal only nulls.  Rows without conv_id form one conversation.
    Turns of one number come in order of role and text, and a turn that is there twice is
    two turns.  Empty texts are turns; long ones are hashed whole.  Other columns play no
    part, whatever their names; an empty table gives an empty one.
    """
    keys = written(prefix_keys(turns))
    full = keys.filter(F.col("nth") == F.col("n_turns")).groupBy("n_turns", "h1", "h2")
    full = full.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    parts = keys.filter(F.col("nth") < F.col("n_turns")).select(F.col("nth").alias("n_turns"), "h1", "h2").distinct()
    return full.join(parts, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def rendered(turns: DataFrame) -> DataFrame:
    """Maximal conversations as ``conv_id, n_turns, n_copies, chat``; missing roles read ``user``."""
    kept = written(maximal(turns))
    mine = turns.alias("t").join(kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")), "left_semi")
    lines = mine.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    chat = F.array_join(F.transform("all", lambda t: rendered_turn(t["role"], t["text"])), "")
    texts = lines.select(F.col("conv_id").alias("_id"), chat.alias("chat"))
    return kept.join(texts, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", "n_turns", "n_copies", "chat")


def op8_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rendered(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "chat")


OP8_SQL = r"""
WITH r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line,
    coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) AS part
  FROM conversations
), p AS (
  SELECT *, string_agg(part, '') OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM r
), f AS (
  SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE nth = n_turns GROUP BY prefix, n_turns
)
SELECT f.conv_id, f.n_turns, f.n_copies, string_agg(r.line, '' ORDER BY r.nth) AS chat
FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id
WHERE f.prefix NOT IN (SELECT prefix FROM p WHERE nth < n_turns)
GROUP BY f.conv_id, f.n_turns, f.n_copies
"""
