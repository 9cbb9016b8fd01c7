"""Near-duplicate documents by SuperMinHash.

1.  Texts become sets of 5-word shingles (hashed); equal sets are one class from here
    on, so copies cost nothing.
2.  SuperMinHash: every shingle draws a random permutation of the slots, step by step,
    with a fresh uniform number at each step; slot = least (step + number) that reached
    it.  All shingles of a text take step 0, then step 1, ..., until every slot holds a
    value below the next step: nothing later can win.
3.  Bands of slots are looked up.  In each bucket every class is linked with the least
    class if their full shingle sets agree (star), so a bucket of n costs n checks.
4.  Buckets whose members are then still in different groups are searched again, across
    groups only: their members' rarest shingles are looked up, which is complete for pairs at
    the limit, and sizes, places and a sketch rule out most others ahead of the check on full
    sets.
5.  Groups are joined up (union-find by joins).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetmatch.llm import flat
from fleetmatch.llm.components import components
from fleetmatch.llm.store import hot_join, numbered, table, written

SHINGLE = 5
PERCENT = 75
SLOTS = 256
BANDS, ROWS = 32, 4  # bands of slots: a pair at 0.75 is missed by all once in 10**5 or less
#: A sketch holds two bits of every slot, in longs of 32 slots.
SKETCH = SLOTS // 32
#: Slots in which the sketches of a pair at 0.75 may differ: 48 expected, over 5 standard deviations more.
DIFFERENT = 80
#: Rows that ask for one shingle in one task.
SHARE = 4096
SKETCHES = [f"sketch_{k}" for k in range(SKETCH)]


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Of each text (words at[k]:at[k+1]) the distinct n-word shingles; shorter texts are one shingle whole."""
    sizes = np.diff(at)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + at[:-1][doc]
    prefix = flat.prefix_hashes(hashes)
    value = flat.range_hashes(prefix, start, np.minimum(start + n, at[doc + 1]))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(total, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def super_min_hash(doc: np.ndarray, value: np.ndarray, n: int, slots: int = SLOTS, table_bytes: int = 16 << 20) -> np.ndarray:
    """Signatures (n x slots): step in the high and a random number in the low half of a uint64.

    ``doc`` numbers the texts and doesn't fall.  A text without shingles keeps the
    greatest value in all slots.  A shingle's permutation is drawn by Fisher-Yates swaps:
    while many shingles are live, a place is traced back through the swaps drawn so far;
    once their permutations fit in ``table_bytes``, they are held as tables.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best, filled = np.full(n * slots, none), np.zeros(n, np.int64)
    live = np.arange(len(doc))
    drawn: list[np.ndarray] = []  # places drawn at earlier steps, by those still live
    table = rows = None
    for step in range(slots):
        if not len(live):
            break
        noise = flat.mix(value[live] + np.uint64((step + 1) * 0xD6E8FEB86659FD93 % 2**64))
        place = step + ((noise >> np.uint64(32)) % np.uint64(slots - step)).astype(np.int64)
        if table is None and len(live) * slots * 2 <= table_bytes:
            rows = np.arange(len(live))
            table = np.tile(np.arange(slots, dtype=np.uint16), (len(live), 1))
            for earlier, there in enumerate(drawn):
                table[rows, there] = table[:, earlier]
        if table is None:
            slot = place
            for earlier in range(step - 1, -1, -1):
                slot = np.where(slot == drawn[earlier], earlier, slot)
            drawn.append(place)
        else:
            slot = table[rows, place].astype(np.int64)
            table[rows, place] = table[rows, step]
        at = doc[live] * slots + slot
        np.add.at(filled, np.unique(at[best[at] == none]) // slots, 1)
        np.minimum.at(best, at, np.uint64(step) << np.uint64(32) | (noise & np.uint64(0xFFFFFFFF)))
        open_ = (filled < slots)[doc[live]]  # a filled slot has a value of this step or before: nothing later can win
        live = live[open_]
        if table is None:
            drawn = [d[open_] for d in drawn]
        else:
            rows = rows[open_]
    return best.reshape(n, slots)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel()))


def _signed(docs: DataFrame, row: str, text: str) -> DataFrame:
    """``row, n_shingles, set_a, set_b`` (128 bits of the shingle set), ``bands`` and the sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in flat.chunks(batches, text, 1 << 20):
            _, _, hashes, at = flat.words(data, offsets, flat.SPACED, True)
            n = batch.num_rows
            doc, value = shingle_hashes(hashes, at)
            first = np.searchsorted(doc, np.arange(n + 1))
            totals = []
            for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.mix(value ^ np.uint64(salt)))])
                totals.append(sums[first[1:]] - sums[first[:-1]])
            signature = super_min_hash(doc, value, n)
            bands = signature[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
            keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
            for k in range(ROWS):
                keys = flat.mix(keys * flat.BASE + bands[:, :, k])
            bits = np.stack([signature >> np.uint64(1) & np.uint64(1), signature & np.uint64(1)], axis=2).astype(np.uint8)
            sketch = np.packbits(bits.reshape(n, 2 * SLOTS), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(row).cast(pa.int64()), pa.array(np.diff(first).astype(np.int64)), *[pa.array(t.view(np.int64)) for t in totals], _lists(keys.view(np.int64)), *[pa.array(sketch[:, k]) for k in range(SKETCH)]],
                names=["row", "n_shingles", "set_a", "set_b", "bands", *SKETCHES],
            )

    schema = "row long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCHES)
    return docs.select(row, text).mapInArrow(sign, schema)


def _linked(pairs: DataFrame, docs: DataFrame, row: str, text: str) -> DataFrame:
    """Of the pairs ``a, b`` those whose full shingle sets agree, compared word by word."""
    texts = docs.select(F.col(row).alias("_r"), F.col(text).alias("_t"))
    with_a = pairs.join(texts.withColumnRenamed("_t", "text_a"), pairs["a"] == F.col("_r")).drop("_r")
    both = with_a.join(texts.withColumnRenamed("_t", "text_b"), with_a["b"] == F.col("_r")).drop("_r")

    def shingles(text: str | None) -> set[tuple[bytes, ...]]:
        words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII separators count
        return {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_a, set_a = object(), set()
        for batch in batches:
            linked = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last_a:
                    last_a, set_a = a, shingles(x.as_py())
                set_b = shingles(y.as_py())
                same = len(set_a & set_b)
                either = len(set_a) + len(set_b) - same
                linked.append(same > 0 and 100 * same >= PERCENT * either)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def _close(a: str, b: str) -> Column:
    """What sizes and sketches allow: never false for a pair at the limit or above, but for odds below 10**-6."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ = F.lit(0)
    for c in SKETCHES:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        differ += F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (differ <= DIFFERENT)


def _sets(rows: DataFrame, docs: DataFrame, row: str, text: str) -> DataFrame:
    """``row, shingles`` (distinct hashes) of the rows asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in flat.chunks(batches, text, 1 << 20):
            _, _, hashes, at = flat.words(data, offsets, flat.SPACED, True)
            doc, value = shingle_hashes(hashes, at)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(row).cast(pa.int64()), lists], names=["row", "shingles"])

    wanted = docs.select(row, text).join(rows.select(F.col("row").alias(row)), row, "left_semi")
    return wanted.mapInArrow(cut, "row long, shingles array<long>")


def _meeting(sets: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs ``x_row, y_row`` of ``open_`` rows in different components that sizes, places and sketches let pass.

    Shingles are ordered by how many rows of ``sets`` have them, rarest first.  Two sets of
    n and m shingles that agree must share ``least`` of them, so their first common one
    lies at most n - least down the one list and m - least down the other.  Of the two the
    one with fewer shingles (``short``) has its first common one within the first seventh,
    whatever the other's size.  A near miss has more shingles of its own than that and
    they come first, so rows of a family of near misses ask for nothing that they share.
    A shingle that many rows ask for is dealt over tasks of SHARE rows that ask.
    """
    single = sets.select("row", F.explode("shingles").alias("shingle"))
    common = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("df", "shingle")) - 1
    ranked = single.join(common, "shingle").withColumn("place", place).join(open_, "row")
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    spare = F.col("n_shingles") - F.ceil(F.col("n_shingles") * F.lit(PERCENT / 100))
    short = F.col("n_shingles") - F.ceil(F.col("n_shingles") * F.lit(2 * PERCENT / (100 + PERCENT)) - 1e-6)
    prefix = written(ranked.filter((F.col("place") <= spare) & (F.col("df") > 1)).withColumn("short", F.col("place") <= short))
    asked = written(prefix.filter("short").groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).cast("int").alias("ways")))
    x = prefix.filter("short").join(asked, "shingle").withColumn("part", F.pmod(F.xxhash64("row"), F.col("ways")).cast("int")).alias("x")
    y = prefix.join(asked, "shingle").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).alias("y")
    least = F.ceil((n + m) * F.lit(PERCENT / (100 + PERCENT)) - 1e-6)
    fits = (n - F.col("x.place") >= least) & (m - F.col("y.place") >= least)
    once = (n < m) | ((n == m) & (F.col("x.row") < F.col("y.row")))
    apart = (F.col("x.component") != F.col("y.component")) & (F.col("x.foreign") + F.col("y.foreign") > 0)
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") == F.col("y.part"))
    return x.join(y, same & once & apart & fits & _close("x", "y")).select(F.col("x.row").alias("x_row"), F.col("y.row").alias("y_row"))


def _across(open_: DataFrame, docs: DataFrame, row: str, text: str) -> DataFrame:
    """Links between components among ``open_`` (row, component, foreign, n_shingles, sketch), checked on full sets."""
    sets = written(_sets(open_, docs, row, text))
    pairs = _meeting(sets, open_).select(F.least("x_row", "y_row").alias("a"), F.greatest("x_row", "y_row").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("p")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("q")), "b")
    same = F.size(F.array_intersect("p", "q"))
    return both.filter(same * 100 >= (F.size("p") + F.size("q") - same) * PERCENT).select("a", "b")


def grouped(docs: DataFrame, row: str, text: str) -> DataFrame:
    """``row, n_shingles, component`` of every row; ``row`` must be unique."""
    signed = written(_signed(docs, row, text))
    same_set = ["n_shingles", "set_a", "set_b"]
    some = signed.filter("n_shingles > 0")
    classes = written(some.groupBy(*same_set).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")))
    own = hot_join(some.select("row", *same_set), classes, same_set, "copies", F.col("row")).select("row", "n_shingles", "first")
    members = written(own.unionByName(signed.filter("n_shingles = 0").select("row", "n_shingles", F.col("row").alias("first"))))
    heads = signed.join(classes.select(F.col("first").alias("row")), "row", "left_semi")
    bands = heads.select("row", F.explode("bands").alias("band"))
    leaders = bands.groupBy("band").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = written(bands.join(leaders.select("band", "leader"), "band"))
    sketches = written(heads.select("row", "n_shingles", *SKETCHES))

    star = buckets.filter("row <> leader").select(F.col("leader").alias("a"), F.col("row").alias("b")).distinct()
    star = star.join(sketches.alias("x"), F.col("a") == F.col("x.row")).join(sketches.alias("y"), F.col("b") == F.col("y.row")).filter(_close("x", "y"))
    links = written(_linked(star.select("a", "b"), docs, row, text))

    group = components(links)
    placed = buckets.join(group.withColumnRenamed("node", "row"), "row", "left").select("band", "row", F.coalesce("component", "row").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    open_ = written(placed.join(mixed.select("band", "low"), "band").groupBy("row").agg(F.first("component").alias("component"), F.max((F.col("component") != F.col("low")).cast("int")).alias("foreign")))
    more = _across(open_.join(sketches, "row"), docs, row, text)

    whole = components(links.unionByName(more)).select(F.col("node").alias("first"), "component")
    out = members.join(whole, "first", "left")
    return out.select("row", "n_shingles", F.coalesce("component", "first").alias("component"))


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``; other columns play no part.

    Rows whose shingle sets have a Jaccard similarity of 0.75 or more are linked (checked
    on full sets, texts of any length); a component's id is its smallest doc_id, and that
    row is kept.  Null texts and texts without words have no shingles and no links.  Rows
    without an id or with a repeated one are told apart: one row of a component is kept.
    """
    rows, row, is_id = numbered(docs, id_, text)
    found = grouped(rows, row, text)
    kept = (F.col("row") == F.col("component")).alias("kept")
    if is_id:
        return found.select(F.col("row").alias(id_), "n_shingles", F.col("component").alias("component_id"), kept)
    ids = rows.select(F.col(row).alias("row"), F.col(id_).alias("own"))
    found = written(found)
    sizes = written(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    heads = written(sizes.join(ids.select(F.col("row").alias("component"), F.col("own").alias("head")), "component"))
    out = hot_join(found.join(ids, "row"), heads, ["component"], "n", F.col("row"))
    return out.select(F.col("own").alias(id_), "n_shingles", F.col("head").alias("component_id"), kept)


def one_of_each(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the smallest id; all columns stay."""
    rows, row, _ = numbered(docs, id_, text)
    gone = grouped(rows, row, text).filter("row <> component").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def op1_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
