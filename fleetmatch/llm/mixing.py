"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, as close as possible in relative entropy to taking each
document once, such that the rates' words add up to the target of its source and no
rate is above MAX_COPIES.  The convex dual has one multiplier per source, and its
optimum tilts documents exponentially: ``rate = min(MAX_COPIES, exp(lambda * size))``.
So a source that must grow does so by its long documents first, and one that must
shrink keeps its short ones.  Newton steps on the dual are Spark aggregations over the
(source, size) histogram; rates are then rounded into whole copies systematically, down
the sizes of a source, from the one of STARTS starting points that comes nearest the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetmatch.llm.store import fresh, numbered, others, table, written

MAX_COPIES = 3
#: Rates are rounded to whole parts of a copy, so sums of them are exact and reruns and engines agree.
PARTS = 1_000_000
STARTS = 64
#: Files of the (source, size) histogram, which every Newton step reads.
FILES = 16
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def water_filled(sources: DataFrame) -> DataFrame:
    """``source, source_size`` -> with ``target``: shares by weight, capped at MAX_COPIES times the size.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  What a cap cuts off
    is shared again by weight; the fixed point is ``min(weight * level, cap)`` with
    one level for all, found by sorting sources by cap / weight.  A window over all
    sources is in order here: there is one row per source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(MAX_COPIES)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    own = ranked.withColumn("level", level)
    fits = F.col("weight") * F.col("level") <= F.col("cap")
    common = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return own.select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.col("weight") * F.coalesce(common, F.lit(0.0)))).alias("target"),
    )


def newton_multipliers(histogram: DataFrame, targets: DataFrame, tolerance: float = 1e-12, most: int = 100) -> DataFrame:
    """``source, size, n`` and ``source, source_size, target`` -> the latter with ``lam`` and ``scale``.

    Minimises, per source, ``sum n phi(lam x) - lam T`` with ``phi' = min(MAX_COPIES, exp)``,
    where sizes x and the target T are in units of ``scale``, the source's mean size.
    Gradient and Hessian of all sources are one grouped aggregation of the histogram a
    step.  The optimum lies between two known bounds; a Newton step that leaves what is
    still open between them is replaced by its middle.  A source without words stays at 0.
    """
    limit = math.log(MAX_COPIES)
    shape = histogram.filter("size > 0").groupBy(F.col("source").alias("_s")).agg(F.min("size").alias("_least"), F.sum("n").alias("_docs"))
    known = targets.join(shape, F.col("source").eqNullSafe(F.col("_s")), "left")
    known = known.withColumn("scale", F.coalesce(F.col("source_size") / F.col("_docs"), F.lit(1.0))).withColumn("_x", F.col("_least") / F.col("scale"))
    has = (F.col("target") > 0) & F.col("_x").isNotNull()
    low = F.when(has, F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / F.col("_x"))).otherwise(0.0)
    high = F.when(has, F.lit(limit) / F.col("_x")).otherwise(0.0)
    start = F.when(F.col("target") >= F.col("source_size") * F.lit(float(MAX_COPIES)), F.col("high")).otherwise(0.0)
    state = known.withColumns({"low": low, "high": high}).withColumn("lam", start).select("source", "source_size", "target", "scale", "low", "high", "lam")
    state = written(state.coalesce(1))
    x, n, at = F.col("h.size") / F.col("s.scale"), F.col("h.n"), F.col("s.lam")
    rate = F.least(F.lit(float(MAX_COPIES)), F.exp(at * x))
    keys = ["source", "source_size", "target", "scale", "low", "high", "lam"]
    for _ in range(most):
        sums = (
            histogram.filter("size > 0").alias("h").join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy(*[f"s.{k}" for k in keys])
            .agg(F.sum(n * x * rate).alias("words"), F.sum(F.when(at * x < F.lit(limit), n * x * x * rate).otherwise(0.0)).alias("bend"))
        )
        slope = F.col("words") - F.col("target") / F.col("scale")
        sums = sums.withColumn("slope", slope)
        sums = sums.withColumns({"low": F.when(F.col("slope") < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(F.col("slope") > 0, F.col("lam")).otherwise(F.col("high"))})
        newton = F.when(F.col("bend") > 0, F.col("lam") - F.col("slope") / F.col("bend"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        new = F.when(F.col("slope") == 0, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = written(sums.withColumn("new", new).select("source", "source_size", "target", "scale", "low", "high", F.col("new").alias("lam"), (F.abs(F.col("new") - F.col("lam")) / (F.abs("lam") + 1)).alias("off")).coalesce(1))  # a row a source
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    lams = state.select(F.col("source").alias("_name"), F.col("lam").alias("_lam"))
    out = known.join(lams, F.col("source").eqNullSafe(F.col("_name")), "left")
    return out.select("source", "source_size", "target", "scale", F.coalesce("_lam", F.lit(0.0)).alias("lam"))


def class_copies(histogram: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Per (source, size): ``source, size, n, source_size, target, rate`` and ``whole``, the copies that its documents share.

    Down the sizes of a source, the cumulated rates are cut at whole numbers, so the
    copies of a class are its n rates rounded up or down.  Of STARTS places to begin the
    count at, that whose words come nearest the target is taken.
    """
    rated = histogram.alias("h").join(multipliers.alias("m"), F.col("h.source").eqNullSafe(F.col("m.source")))
    parts = F.round(F.least(F.lit(float(MAX_COPIES)), F.exp(F.col("m.lam") * (F.col("h.size") / F.col("m.scale")))) * PARTS).cast("long")
    rated = rated.select("h.source", "h.size", "h.n", "m.source_size", "m.target", parts.alias("parts"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row a size
    rated = written(rated.withColumn("upto", F.sum(F.col("n") * F.col("parts")).over(down)))
    whole = F.expr(f"(upto + k * {PARTS} div {STARTS}) div {PARTS} - (upto - n * parts + k * {PARTS} div {STARTS}) div {PARTS}")
    tried = rated.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))).groupBy("source", "target", "k").agg(F.sum(whole * F.col("size")).alias("words"))
    best = tried.groupBy("source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")).alias("off"), "k")).alias("b")).select("source", "b.k")
    chosen = rated.alias("r").join(best.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))).select("r.*", "b.k")
    return chosen.select("source", "size", "n", "source_size", "target", (F.col("parts") / PARTS).alias("rate"), whole.cast("long").alias("whole"))


def ranked_copies(lean: DataFrame, row: str, rows: int = 8192) -> DataFrame:
    """``source, size`` and the unique long ``row`` -> ``row, source, size, source_size, target, rate, copies``.

    The whole copies of a (source, size) are spread evenly down its rows.  A row's place
    there is the count of those in earlier ranges of ``rows`` numbers and of those before
    it in its own range, so no class is sorted as a whole however many rows it has.
    """
    histogram = written(lean.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    histogram = written(histogram.coalesce(FILES))  # read once a step
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    classes = written(class_copies(histogram, newton_multipliers(histogram, written(water_filled(sizes).coalesce(1)))))
    ranges = lean.select(F.col(row).alias("row"), "source", "size", F.floor(F.col(row) / F.lit(rows)).alias("range"))
    key = ["source", "size", "range"]
    counts = written(ranges.groupBy(*key).agg(F.count(F.lit(1)).alias("here")))
    earlier = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # one row a range
    offsets = counts.withColumn("before", F.sum("here").over(earlier) - F.col("here")).drop("here")
    offsets = offsets.alias("a").join(classes.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("source", "size")])
    offsets = offsets.select("a.*", "b.n", "b.source_size", "b.target", "b.rate", "b.whole")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("row"))
    placed = ranges.withColumn("nth", nth).alias("a").join(offsets.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key])
    copies = F.expr("(b.whole * (b.before + a.nth)) div b.n - (b.whole * (b.before + a.nth - 1)) div b.n")
    return placed.select("a.row", "a.source", "a.size", "b.source_size", "b.target", "b.rate", copies.cast("long").alias("copies"))


ADDED = ["size", "source_size", "target", "rate", "copies"]


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` with ``size, source_size, target, rate, copies`` (long) added.

    Null texts and texts without words have size 0 and a rate of 1; an empty table gives
    an empty table.  Input columns that carry one of the added names are replaced.
    Repeated rows, repeated and null ids are rows of their own; a null source is a
    source.  Of texts of a source with as many words, copies go down the ids evenly.
    Texts are read for their word counts alone, however long, and shuffled once.
    """
    rows, row, _ = numbered(docs, doc_id, source, text)
    lean = written(rows.select(F.col(row).alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    own = ranked_copies(lean, "row").select(F.col("row").alias(row), F.struct(*ADDED).alias(fresh(rows, "_own")))
    joined = rows.join(own, row)
    return joined.select(*others(docs, ADDED), *[F.col(own.columns[1])[c].alias(c) for c in ADDED])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: none to MAX_COPIES times; all columns stay as they are."""
    rows, row, _ = numbered(docs, doc_id, source, text)
    lean = written(rows.select(F.col(row).alias("row"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    times = fresh(rows, "_times")
    taken = ranked_copies(lean, "row").filter("copies > 0").select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(times))
    return rows.join(taken, row).withColumn(times, F.explode(times)).select(*docs.columns)


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, row, is_id = numbered(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text")
    lean = written(rows.select(F.col(row).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")))
    out = ranked_copies(lean, "row")
    if not is_id:
        out = out.join(lean.select("row", "doc_id"), "row")
    return out.select((F.col("row") if is_id else F.col("doc_id")).alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The multipliers by bisection, everything else as above.
OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), h AS (
  SELECT source, size, count(*) AS n FROM d GROUP BY source, size
), s AS (
  SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size, sum(n) FILTER (size > 0) AS docs, min(size) FILTER (size > 0) AS least,
    list(CAST(size AS DOUBLE)) FILTER (size > 0) AS sizes, list(CAST(n AS DOUBLE)) FILTER (size > 0) AS counts FROM h GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * {MAX_COPIES}.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, coalesce(source_size / CAST(docs AS DOUBLE), 1.0) AS scale, least, sizes, counts,
    CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, weight * coalesce((SELECT level FROM l x WHERE x.weight * x.level <= x.cap ORDER BY x.cap / x.weight, x.source ASC NULLS LAST LIMIT 1), 0.0)) END AS target
  FROM l
), b AS (
  SELECT 0 AS step, source, CASE WHEN target > 0 THEN least(0.0, ln(target / source_size) / (least / scale)) ELSE 0.0 END AS low,
    CASE WHEN target > 0 THEN ln({MAX_COPIES}.0) / (least / scale) ELSE 0.0 END AS high FROM t
  UNION ALL
  SELECT step + 1, source, CASE WHEN words < target THEN middle ELSE low END, CASE WHEN words < target THEN high ELSE middle END FROM (
    SELECT b.*, (low + high) / 2 AS middle, t.target,
      list_sum(list_transform(list_zip(t.sizes, t.counts), lambda p: p[1] * p[2] * least({MAX_COPIES}.0, exp((b.low + b.high) / 2 * (p[1] / t.scale))))) AS words
    FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source WHERE step < 80
  )
), m AS (
  SELECT t.*, CASE WHEN target >= source_size * {MAX_COPIES}.0 THEN high ELSE (low + high) / 2 END AS lam FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source WHERE step = 80
), r AS (
  SELECT h.source, size, n, source_size, target, CAST(round(least({MAX_COPIES}.0, exp(lam * (size / scale))) * {PARTS}) AS BIGINT) AS parts
  FROM h JOIN m ON h.source IS NOT DISTINCT FROM m.source
), u AS (
  SELECT *, CAST(sum(n * parts) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM r
), k AS (
  SELECT source, target, k, sum(((upto + k * {PARTS} // {STARTS}) // {PARTS} - (upto - n * parts + k * {PARTS} // {STARTS}) // {PARTS}) * size) AS words
  FROM u, range({STARTS}) x(k) GROUP BY source, target, k
), c AS (
  SELECT source, arg_min(k, {{'off': abs(words - target), 'k': k}}) AS k FROM k GROUP BY source
), p AS (
  SELECT u.*, (upto + k * {PARTS} // {STARTS}) // {PARTS} - (upto - n * parts + k * {PARTS} // {STARTS}) // {PARTS} AS whole FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source
), e AS (
  SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY doc_id) AS nth FROM d
)
SELECT doc_id, e.size, source_size, target, CAST((whole * nth // n - whole * (nth - 1) // n) * e.size AS BIGINT) AS taken
FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.size = p.size
"""
