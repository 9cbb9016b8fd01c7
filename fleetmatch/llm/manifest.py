"""A Merkle manifest of a dataset: digests of rows, a tree over them, and proofs of single rows.

Rows are leaves, in a tree of their own for every group (a language); the roots of these
trees are the leaves of the tree on top.  The manifest is a store of records from a digest
to what lies below it.  A record holds the ``SEGMENT`` levels below its digest, so a tree
of n leaves has n / 2**SEGMENT records and is built and read in log(n) / SEGMENT rounds.

Proofs come by descent.  Requests start at the root with the digits of their rank; every
round looks the reached digests up in the store, follows the next digits and collects the
children that were not selected.  Requests with the same leading digits are one row until
their digits part, so a round has as many rows as the tree has records there.  A path is
gathered from the root down and reversed at the end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetmatch.llm.store import table, written

SEGMENT = 8  # binary digits of a rank that one record resolves
WIDTH = 1 << SEGMENT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""  # group of the tree over the groups' roots

STEP = "struct<sibling:string,left:boolean>"  # one level of a path: the other child, null if there is none, and its side


def field(value: Column) -> Column:
    """A value with its length in bytes ahead, so that fields put together can be told apart; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(columns: dict[str, Column]) -> Column:
    return digest_of(*[field(columns[c]) for c in FIELDS])


def group_key(value: Column) -> Column:
    """A key that is never null and sorts as ``value`` does, nulls first."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``grp``) and their ``rank``, from 0, in the group by ``order``, and the group's size ``n``; written.

    Rows are sorted over all tasks by ranges, so a large group lies in many of them; a
    row's rank is its place in its task's stretch of the group after the counts of the
    stretches before.
    """
    at = F.monotonically_increasing_id()
    placed = written(rows.orderBy("grp", *order).withColumn("_at", at)).withColumn("_task", F.shiftright("_at", 33))
    stretches = placed.groupBy("grp", "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("grp").orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # a row a task
    starts = stretches.select("grp", "_task", (before - F.col("_first")).alias("_start"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    return written(placed.join(starts, ["grp", "_task"]).withColumn("rank", (F.col("_start") + F.col("_at")).cast("long")).drop("_task", "_at", "_start"))


def _parents(level: Column) -> Column:
    """Digests of every two consecutive digests; a last one alone has its own."""
    pair = lambda p: digest_of(F.get(level, p * 2), F.coalesce(F.get(level, p * 2 + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)


class Tree(NamedTuple):
    """The records of the trees of all groups and their roots."""

    records: list[DataFrame]  # one table a round, lowest first: digest, levels (array of arrays of digests, the lowest first)
    roots: DataFrame  # grp, rounds, digest


def build(nodes: DataFrame) -> Tree:
    """Trees over ``nodes`` (grp, n, rank, digest), a tree a group of n nodes, ranks from 0 without gaps.

    A group of n nodes has ceil(log2 n) levels, none for a single node.  A round digests
    runs of ``WIDTH`` nodes in one row each, up to the root or ``SEGMENT`` levels; the rows'
    digests are the nodes of the next round.
    """
    n_levels = F.length(F.bin(F.col("n") - 1)) - F.when(F.col("n") == 1, 1).otherwise(0)
    rounds = F.greatest(F.lit(1), F.ceil(n_levels / SEGMENT)).cast("int")
    total = nodes.agg(F.max(rounds)).first()[0] or 1
    records, roots, here = [], None, nodes.select("grp", "n", "rank", "digest")
    for r in range(total):
        sorted_ = F.sort_array(F.collect_list(F.struct(F.col("rank").bitwiseAND(WIDTH - 1).alias("at"), "digest")))
        runs = here.groupBy("grp", "n", F.shiftright("rank", SEGMENT).alias("segment")).agg(F.transform(sorted_, lambda s: s["digest"]).alias("base"))
        up = F.least(F.lit(SEGMENT), F.greatest(F.lit(0), n_levels - SEGMENT * r))
        steps = F.slice(F.sequence(F.lit(1), F.lit(SEGMENT)), F.lit(1), up)
        every = F.aggregate(steps, F.array("base"), lambda acc, _: F.concat(acc, F.array(_parents(F.element_at(acc, -1)))))
        done = runs.withColumn("levels", every).withColumn("rounds", rounds)
        done = written(done.select("grp", "n", "segment", "rounds", F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"), "levels"))
        records.append(done.select("digest", "levels"))
        tops = done.filter(F.col("rounds") == r + 1).select("grp", "rounds", "digest")
        roots = tops if roots is None else roots.unionByName(tops)
        here = done.filter(F.col("rounds") > r + 1).select("grp", "n", F.col("segment").alias("rank"), "digest")
    return Tree(records, roots)


def _below(at: Column, levels: Column) -> Column:
    """The way from a record's digest down to the node ``at`` its lowest level: at each level the child not selected, and its side."""

    def step(i: Column) -> Column:
        level = F.size(levels) - i - 1
        mine = F.call_function("shiftright", at, level)
        return F.struct(F.get(F.get(levels, level), mine.bitwiseXOR(F.lit(1))).alias("sibling"), (mine.bitwiseAND(F.lit(1)) == 1).alias("left"))

    return F.transform(F.slice(F.sequence(F.lit(1), F.lit(SEGMENT)), F.lit(1), F.size(levels) - 1), step)


def descend(tree: Tree, start: DataFrame) -> DataFrame:
    """``start`` (grp, rounds, digest, path and others) led down to the lowest records: ``grp, segment, path, levels`` and others.

    Records are found by digest alone.  Equal digests have equal records, of which one is
    kept, so repeated rows multiply nothing.
    """
    others = [c for c in start.columns if c not in ("grp", "rounds", "digest", "path")]
    here = None
    for r in reversed(range(len(tree.records))):
        due = start.filter(F.col("rounds") == r + 1).select("grp", F.lit(0).cast("long").alias("segment"), "digest", "path", *others)
        here = due if here is None else here.unionByName(due)
        found = here.join(tree.records[r].dropDuplicates(["digest"]), "digest")
        if r == 0:
            return found.select("grp", "segment", "path", "levels", *others)
        rows = found.select("grp", "segment", *others, F.explode(_children()).alias("c"))
        here = written(rows.select("grp", (F.col("segment") * WIDTH + F.col("c.at")).cast("long").alias("segment"), "c.digest", "c.path", *others))
    return here


def _children() -> Column:
    """The nodes of a record's lowest level as an array of ``at, digest, path``."""
    levels = F.col("levels")
    return F.transform(F.get(levels, F.lit(0)), lambda d, i: F.struct(i.alias("at"), d.alias("digest"), F.concat("path", _below(i, levels)).alias("path")))


class Manifest(NamedTuple):
    leaves: DataFrame  # the rows given, with grp, rank and digest
    tree: Tree  # of all groups
    subroots: DataFrame  # grp, rounds, digest, rank among the n groups
    top: Tree  # over the groups' roots


def manifest(rows: DataFrame, order: list[str]) -> Manifest:
    """The manifest of ``rows`` (``grp``, ``digest`` and others), in each group by ``order``, then by digest."""
    leaves = ranked(rows, [*order, "digest"])
    tree = build(leaves)
    subroots = ranked(tree.roots.withColumnRenamed("grp", "_key").withColumn("grp", F.lit(TOP)), ["_key"])
    top = build(subroots)
    return Manifest(leaves, tree, subroots.drop("grp").withColumnRenamed("_key", "grp"), top)


def proofs(made: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (grp, rank and others) with ``leaf, subroot, root, path``; the path goes from the leaf to the root.

    A rank is asked for once at most; ranks that do not exist give no rows.
    """
    root = made.top.roots.select("grp", "rounds", "digest", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("root"))
    over = descend(made.top, root).select("root", "segment", F.explode(_children()).alias("c"))
    over = over.select("root", (F.col("segment") * WIDTH + F.col("c.at")).alias("rank"), "c.digest", "c.path", F.col("c.digest").alias("subroot"))
    low = descend(made.tree, written(over.join(made.subroots.select("grp", "rounds", "rank"), "rank").drop("rank")))
    asked = requests.withColumn("segment", F.shiftright("rank", SEGMENT)).withColumn("at", F.col("rank").bitwiseAND(WIDTH - 1).cast("int"))
    others = [c for c in requests.columns if c not in ("grp", "rank")]
    lists = asked.groupBy("grp", "segment").agg(F.collect_list(F.struct("rank", "at", *others)).alias("asked"))  # at most WIDTH
    ways = F.transform("asked", lambda q: F.struct(
        q.alias("q"), F.get(F.get("levels", F.lit(0)), q["at"]).alias("leaf"), F.reverse(F.concat("path", _below(q["at"], F.col("levels")))).alias("path")
    ))
    rows = lists.join(low, ["grp", "segment"]).select("grp", "subroot", "root", F.explode(ways).alias("w"))
    return rows.select("grp", "w.q.rank", *[F.col(f"w.q.{c}").alias(c) for c in others], "w.leaf", "subroot", "root", "w.path").filter("leaf is not null")


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings, from the leaf up."""
    return digest_of(F.array_join(F.transform(path, lambda s: s["sibling"]), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` lead to."""

    def up(acc: Column, s: Column) -> Column:
        return digest_of(F.when(s["left"], F.coalesce(s["sibling"], F.lit(""))).otherwise(""), acc, F.when(s["left"], "").otherwise(F.coalesce(s["sibling"], F.lit(""))))

    return F.aggregate(path, leaf, up)


def tampered(docs: DataFrame) -> Column:
    """The leaf digest of a row with one more in ``n_chars`` where 7 divides crc32 of its id; else null."""
    cells = {c: F.col(c) for c in FIELDS}
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return F.when(hit & F.col("n_chars").isNotNull(), leaf_digest(cells | {"n_chars": more}))


def audited(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    Nulls in any column have their own mark in a digest; null languages are a group and
    come first, as do null ids in theirs.  Empty and long texts are digested whole.  Rows
    of one id are ordered by their digests, repeated rows are leaves each.  Other columns
    play no part, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(group_key(F.col("lang")).alias("grp"), "doc_id", leaf_digest({c: F.col(c) for c in FIELDS}).alias("digest"), tampered(docs).alias("altered"))
    made = manifest(rows, ["doc_id"])
    got = proofs(made, made.leaves.select("grp", "rank", "doc_id", "altered"))
    got = got.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


def _sql_leaf(more: str = "") -> str:
    parts = [f"coalesce(strlen(CAST({c}{more if c == 'n_chars' else ''} AS VARCHAR)) || ':' || CAST({c}{more if c == 'n_chars' else ''} AS VARCHAR), '-')" for c in FIELDS]
    return f"sha256({' || '.join(parts)})"


OP13_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS txt, 0 AS s, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, txt, s + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT *, CASE WHEN s % 8 = 0 THEN xor(c, CAST(ord(substr(txt, s // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE s < 8 * length(txt))
), crcs AS (
  SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) % 7 = 0 AS hit FROM crc WHERE s = 8 * length(txt)
), rows_ AS (
  SELECT d.doc_id, d.lang, {_sql_leaf()} AS leaf, CASE WHEN hit THEN {_sql_leaf(' + 1')} ELSE NULL END AS altered
  FROM (SELECT *, row_number() OVER () AS k FROM documents) d LEFT JOIN (SELECT doc_id AS id, hit FROM crcs) c ON d.doc_id = c.id
), l AS (
  SELECT *, coalesce('1' || lang, '0') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM rows_
), t AS (
  SELECT g, 0 AS lvl, i, leaf AS digest, n FROM l
  UNION ALL
  SELECT g, lvl + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lvl, i // 2
), subroots AS (
  SELECT g, lvl AS depth, digest, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lvl, i, digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2
), steps AS (
  SELECT l.g, l.i, a.lvl, (l.i >> a.lvl) & 1 AS side, b.digest AS sibling
  FROM l JOIN t a ON a.g = l.g AND a.i = l.i >> a.lvl AND a.n > 1 LEFT JOIN t b ON b.g = a.g AND b.lvl = a.lvl AND b.i = xor(a.i, 1)
  UNION ALL
  SELECT l.g, l.i, s.depth + a.lvl, (s.i >> a.lvl) & 1, b.digest
  FROM l JOIN subroots s ON s.g = l.g JOIN u a ON a.i = s.i >> a.lvl AND a.n > 1 LEFT JOIN u b ON b.lvl = a.lvl AND b.i = xor(a.i, 1)
), ways AS (
  SELECT g, i, sha256(coalesce(string_agg(sibling, '' ORDER BY lvl), '')) AS proof_sha256, count(*) AS n_steps FROM steps GROUP BY g, i
), fold AS (
  SELECT g, i, 0 AS lvl, coalesce(altered, leaf) AS acc FROM l
  UNION ALL
  SELECT f.g, f.i, f.lvl + 1, sha256(CASE WHEN side = 1 THEN coalesce(sibling, '') || acc ELSE acc || coalesce(sibling, '') END)
  FROM fold f JOIN steps s ON s.g = f.g AND s.i = f.i AND s.lvl = f.lvl
), ends AS (
  SELECT g, i, max_by(acc, lvl) AS folded_root FROM fold GROUP BY g, i
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(w.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.digest AS verified
FROM l JOIN subroots s ON s.g = l.g CROSS JOIN (SELECT digest FROM u WHERE n = 1) r LEFT JOIN ways w ON w.g = l.g AND w.i = l.i JOIN ends e ON e.g = l.g AND e.i = l.i
"""
