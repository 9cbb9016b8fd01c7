"""Windows of symbols that occur more than once in a corpus, exactly and at scale.

1.  Every window of ``window`` symbols has an anchor: the ``gram`` of symbols in it
    whose hash is least.  Equal windows have equal anchors, so only anchors (about two
    for every window-length of text) are shuffled: gram hash, hash of the context (all
    symbols of windows that could hold the gram), row and position.
2.  Anchors with equal gram and context repeat as a whole.  The rest of those whose
    gram occurs in several contexts, one of each context, are requested from the texts.
3.  Contexts of a gram are sorted as suffixes to the right and to the left of the
    anchor.  A window with ``o`` symbols left of its anchor repeats where two contexts
    share ``o`` symbols to the left and ``window - o`` to the right: the runs of the two
    sorted orders with long enough common extensions.
4.  Stretches are gathered per row and joined to the texts.

With ``blocks`` the anchors are others: every text is cut into reference blocks of
``gram`` symbols that do not overlap, and every rolling gram of every text probes them.
A window of two blocks less one symbol or more holds a whole block, so where a window
occurs again, a block of the one text meets a probe of the other at the same place.
Chunks of texts send each distinct gram once, sorted and packed, to a bucket of the
hash space; those that are a block and occur again come back to the chunk as anchors.

Grams and contexts are compared by 64 and 128 bits of hash (two independent ones); what
is sorted is verified symbol by symbol besides.  Keys that many rows share are spread
over tasks (``hot_join``).

With ``earlier`` a window counts only if an equal one starts earlier (in row order);
else any other start counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmatch.llm import flat
from fleetmatch.llm.store import hot_join, mark, release, written
from fleetmatch.llm.suffixes import Text

#: Symbols in contexts of one gram that are sorted in one task (a symbol takes about 100 bytes there); grams with
#: more have their windows counted one by one.
CROWD = 2_000_000
#: Bytes of text whose grams one bucket holds on average, so a bucket fits in a task's memory whatever the corpus.
BUCKET_BYTES = 8 << 20
#: Bits of the running number of a text that are dropped for its chunk's number: 512 texts a chunk.
CHUNK_BITS = 9
ANCHORS = "gram long, context long, check long, row long, at long"
SET = ["gram", "context", "check"]
#: From the bytes and offsets of texts: the symbols and where each text's symbols begin.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Spec:
    window: int
    gram: int
    earlier: bool
    symbols: Symbols
    width: int  # bytes of a symbol in a shipped context
    blocks: bool = False  # anchors are probes that hit a reference block, instead of least grams
    bits: int = 64  # of the first hash of a context or window; tests take few, so that it collides


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data.astype(np.uint64) + np.uint64(1), offsets


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, at = flat.words(data, offsets, flat.SPACED, False)
    return hashes, at


def anchors(symbols: np.ndarray, offsets: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of all texts, where their anchors are: text and position in it."""
    n, w = len(symbols), spec.window - spec.gram + 1
    lengths = np.diff(offsets)
    if n < spec.window or not (lengths >= spec.window).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = flat.prefix_hashes(symbols)
    at = np.arange(n - spec.gram + 1)
    grams = flat.range_hashes(prefix, at, at + spec.gram)
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    blocks = -(-len(keyed) // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keyed)] = keyed
    square = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - spec.window + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & np.uint64(0xFFFFFFFF)
    valid = np.zeros(count + 1, np.int32)  # windows within one text
    long = lengths >= spec.window
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - spec.window + 1, -1)
    chosen = np.zeros(n, bool)
    chosen[least[np.cumsum(valid[:-1]) > 0].astype(np.int64)] = True
    place = np.flatnonzero(chosen)
    text = np.searchsorted(offsets, place, "right") - 1
    return text, place - offsets[text]


def _rows_at(text: np.ndarray, position: np.ndarray, ids: np.ndarray, symbols: np.ndarray, offsets: np.ndarray, spec: Spec) -> pa.RecordBatch:
    """ANCHORS of anchors at the positions in texts; ``at`` packs position, symbols left of the anchor and context length."""
    at = offsets[text] + position
    low = np.maximum(offsets[text], at - (spec.window - spec.gram))
    high = np.minimum(offsets[text + 1], at + spec.window)
    prefix, second = flat.prefix_hashes(symbols), flat.second_hashes(symbols)
    left = (at - low).astype(np.uint64)
    gram = flat.range_hashes(prefix, at, at + spec.gram)
    context = flat.mix(flat.range_hashes(prefix, low, high) + left) >> np.uint64(64 - spec.bits)
    check = flat.mix(flat.range_hashes(second, low, high, flat.SECOND) ^ left)
    packed = position << 32 | (at - low) << 16 | (high - low)
    return pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (gram, context, check)], pa.array(ids[text], pa.int64()), pa.array(packed)], names=[*SET, "row", "at"])


def _anchor_rows(docs: DataFrame, spec: Spec, row: str, text: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in flat.chunks(batches, text, 1 << 19):
            symbols, begin = spec.symbols(data, offsets)
            yield _rows_at(*anchors(symbols, begin, spec), batch.column(row).to_numpy(zero_copy_only=False), symbols, begin, spec)

    return docs.select(row, text).mapInArrow(rows, ANCHORS)


def _contexts(texts: DataFrame, spec: Spec, row: str, text: str) -> DataFrame:
    """Rows with ``wanted`` (gram, at, crowded) -> the context of each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in flat.chunks(batches, text, 1 << 19):
            symbols, begin = spec.symbols(data, offsets)
            wanted = batch.column("wanted")
            grams = wanted.flatten().field("gram").to_numpy()
            at = wanted.flatten().field("at").to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            low = begin[doc] + (at >> 32) - (at >> 16 & 0xFFFF)
            n = at & 0xFFFF
            first = np.cumsum(n) - n
            index = np.repeat(low - first, n) + np.arange(int(n.sum()))
            flat_symbols = (symbols[index] - np.uint64(1)).astype(np.uint8) if spec.width == 1 else symbols[index].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : spec.width]
            ends = np.zeros(len(n) + 1, np.int32)
            ends[1:] = np.cumsum(n * spec.width)
            blobs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat_symbols.tobytes())])
            ids = batch.column(row).to_numpy(zero_copy_only=False)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(ids, pa.int64()), pa.array(at), blobs, wanted.flatten().field("crowded")], names=["gram", "row", "at", "blob", "crowded"])

    return texts.mapInArrow(cut, "gram long, row long, at long, blob binary, crowded boolean")


def _shipped(data: np.ndarray, width: int) -> np.ndarray:
    """Symbols of shipped contexts: bytes, or the low ``width`` bytes of word hashes."""
    if width == 1:
        return data.astype(np.uint64) + np.uint64(1)
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = data.reshape(-1, width)
    return wide.view("<u8").ravel()


def solved(group: np.ndarray, row: np.ndarray, at: np.ndarray, blobs: pa.Array, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated stretches (row, start, end) among contexts; ``group`` numbers the grams and doesn't fall."""
    position, left = at >> 32, at >> 16 & 0xFFFF
    order = np.lexsort((position, row, group))  # earlier first within a gram
    group, row, at, position, left = group[order], row[order], at[order], position[order], left[order]
    data, offsets = flat.texts(blobs.take(pa.array(order)))
    symbols = _shipped(data, spec.width)
    offsets = offsets // spec.width
    n, total = len(group), len(symbols)
    anchor = offsets[:-1] + left
    right = offsets[1:] - anchor
    forward, forward_shared = Text(symbols).sort(anchor, right, group)
    backward, backward_shared = Text(np.ascontiguousarray(symbols[::-1])).sort(total - anchor, left, group)
    spread = spec.window - spec.gram + 1
    repeated = np.zeros((n, spread + 2), bool)
    rid, lid = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(spread):
        fits = np.flatnonzero((left >= o) & (right >= spec.window - o))
        if len(fits) < 2:
            continue
        rid[forward] = np.cumsum(forward_shared < spec.window - o)
        lid[backward] = np.cumsum(backward_shared < o)
        key = rid[fits] * (n + 1) + lid[fits]
        by_key = np.argsort(key, kind="stable")
        same = key[by_key][1:] == key[by_key][:-1]
        hit = fits[by_key]
        repeated[hit[1:][same], o + 1] = True
        if not spec.earlier:
            repeated[hit[:-1][same], o + 1] = True
    edges = np.diff(repeated.view(np.int8), axis=1)
    which, first = np.nonzero(edges == 1)  # runs of o from first to last - 1
    _, last = np.nonzero(edges == -1)
    return row[which], position[which] - (last - 1), position[which] - first + spec.window


def _solve(contexts: DataFrame, spec: Spec, rows: int = 3_000) -> DataFrame:
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(batch: pa.Table) -> pa.RecordBatch:
            grams = batch.column("gram").to_numpy()
            group = np.cumsum(np.concatenate([[0], (grams[1:] != grams[:-1]).astype(np.int64)])) if len(grams) else grams
            columns = [batch.column(c).to_numpy() for c in ("row", "at")]
            out = solved(group, *columns, batch.column("blob").combine_chunks(), spec)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["row", "start", "end"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                whole = pa.Table.from_batches(held)
                grams = whole.column("gram").to_numpy()
                cut = int(np.flatnonzero(grams == grams[-1])[0])  # sorted: the last gram can go on
                if cut:
                    yield flush(whole.slice(0, cut))
                    held = whole.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    dealt = contexts.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(solve, "row long, start long, end long")


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches whose rows have one ``chunk``, with its number."""
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield int(chunk[a]), batch.slice(a, b - a)


def _grams(data: np.ndarray, offsets: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where texts begin in them, and of every rolling gram of a text as long as a window: text, position, hash."""
    symbols, at = spec.symbols(data, offsets)
    sizes = np.diff(at)
    counts = np.where(sizes >= spec.window, sizes - spec.gram + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = at[:-1][doc] + place
    return symbols, at, doc, place, flat.range_hashes(flat.prefix_hashes(symbols), start, start + spec.gram)


def _keys(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the hash space in the high half, the hash's low half in the low half."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets)) & np.uint64(0xFFFFFFFF00000000) | grams & np.uint64(0xFFFFFFFF)


def _packed(low: np.ndarray, block: np.ndarray, again: np.ndarray) -> bytes:
    """Sorted distinct 32-bit numbers as differences, byte by byte from the highest, and two bits of each."""
    step = np.diff(low, prepend=np.uint32(0)).astype(">u4")
    return step.view(np.uint8).reshape(-1, 4).T.tobytes() + np.packbits(block).tobytes() + np.packbits(again).tobytes()


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    low = np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(">u4").ravel().astype(np.int64))
    width = -(-n // 8)
    bits = [np.unpackbits(raw[4 * n + k * width : 4 * n + (k + 1) * width], count=n).astype(bool) for k in (0, 1)]
    return low, bits[0], bits[1]


def _probes(texts: DataFrame, spec: Spec, text: str, buckets: int) -> DataFrame:
    """The distinct rolling grams of every chunk, ``bucket, chunk, n, blob``, marked where one is a reference block or repeats in the chunk.

    Every gram-th position of a text begins a block.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in _by_chunk(batches):
            for _, data, offsets in flat.chunks(iter([part]), text, 1 << 20):
                _, _, _, place, gram = _grams(data, offsets, spec)
                if not len(gram):
                    continue
                keys = _keys(gram, buckets)
                order = np.argsort(keys)
                keys, block = keys[order], place[order] % spec.gram == 0
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                n = np.diff(np.append(first, len(keys)))
                keys, block = keys[first], np.logical_or.reduceat(block, first)
                own = (keys >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
                low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                parts = [(int(own[a]), chunk, int(b - a), _packed(low[a:b], block[a:b], n[a:b] > 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "chunk", "n", "blob"])

    return texts.mapInArrow(probe, "bucket long, chunk long, n int, blob binary")


def _hits(probes: DataFrame) -> DataFrame:
    """``chunk, keys``: grams of a chunk that are a reference block somewhere and occur more than once.

    A bucket has at most one entry a chunk and gram, so copies and stock phrases within
    chunks cost nothing.  Keys of different grams can be equal; what follows compares all.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: int, held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            parts = [_unpacked(blob, n) for _, n, blob in held]
            low, block, again = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(low, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
            size = np.diff(np.append(first, len(low)))
            good = np.logical_or.reduceat(block[order], first) & ((size > 1) | np.logical_or.reduceat(again[order], first))
            hit = np.zeros(len(low), bool)
            hit[order] = np.repeat(good, size)
            ends = np.concatenate([[0], np.cumsum(hit)])[np.cumsum([0, *[n for _, n, _ in held]])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(low[hit] | bucket << 32, pa.int64()))
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in held], pa.int64()), lists], names=["chunk", "keys"])
            return out.filter(pa.array(np.diff(ends) > 0))

        last, held = None, []
        for batch in batches:
            for bucket, chunk, n, blob in zip(*[batch.column(c).to_pylist() for c in ("bucket", "chunk", "n", "blob")], strict=True):
                if bucket != last and held:
                    yield found(last, held)
                    held = []
                last = bucket
                held.append((chunk, n, blob))
        if held:
            yield found(last, held)

    dealt = probes.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "chunk long, keys array<long>")


def _block_rows(docs: DataFrame, spec: Spec, row: str, text: str) -> DataFrame:
    """ANCHORS at the grams that hit: each chunk's keys and texts are sorted together and met in one pass."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(8, int(total / BUCKET_BYTES))
    texts = written(docs.select(F.col(row).alias("row"), F.col(text).alias("text"), F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS).alias("chunk")))
    hits = written(_hits(_probes(texts, spec, "text", buckets)))
    release(docs.sparkSession, mark())  # the probes' shuffle
    none = F.lit(None)
    both = hits.select("chunk", F.lit(0).alias("kind"), none.cast("long").alias("row"), none.cast("string").alias("text"), "keys").unionByName(
        texts.select("chunk", F.lit(1).alias("kind"), "row", "text", none.cast("array<long>").alias("keys"))
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys = None, np.zeros(0, np.int64)
        for chunk, part in _by_chunk(batches):
            if chunk != last:
                last, keys = chunk, np.zeros(0, np.int64)
            n = int((part.column("kind").to_numpy() == 0).sum())  # these come first
            if n:
                keys = np.sort(np.concatenate([keys, part.slice(0, n).column("keys").flatten().to_numpy()]))
            if not len(keys):
                continue
            for batch, data, offsets in flat.chunks(iter([part.slice(n)]), "text", 1 << 19):
                symbols, begin, doc, place, gram = _grams(data, offsets, spec)
                own = _keys(gram, buckets).astype(np.int64)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == own)
                if len(hit):
                    yield _rows_at(doc[hit], place[hit], batch.column("row").to_numpy(zero_copy_only=False), symbols, begin, spec)

    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(rows, ANCHORS)


def stretches(docs: DataFrame, spec: Spec, row: str, text: str, crowd: int | None = None) -> DataFrame:
    """``row, parts``: repeated stretches (start, end) in symbols, unmerged; rows without any are left out.

    Grams and contexts are counted by grouped aggregates, which combine ahead of the
    shuffle, and joined back with hot ones spread, so a gram that a third of all rows
    hold is never gathered.  Grams with more than ``crowd`` contexts are those of CROWD symbols.
    """
    crowd = CROWD // (2 * spec.window - spec.gram) if crowd is None else crowd
    spark, began, place = docs.sparkSession, mark(), F.xxhash64("row", "at")
    if spec.blocks:
        shared = written(_block_rows(docs, spec, row, text))  # these occur again
    else:
        anchored = _anchor_rows(docs, spec, row, text)
        grams = written(anchored.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        shared = written(hot_join(anchored, grams, ["gram"], "n", place).drop("n"))
    release(spark, began, keep=1)
    classes = written(shared.groupBy(*SET).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "at")).alias("first")))
    # what a gram's contexts are compared for: any that is alone, or with `earlier` the first of each
    asking = classes.groupBy("gram").agg(F.min("copies").alias("least"), F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    asking = written(asking.filter((F.col("least") == 1) | F.lit(spec.earlier)).select("gram", "contexts", (F.col("contexts") > crowd).alias("crowded")))
    compared = hot_join(classes.select("gram", "first"), asking, ["gram"], "contexts", F.xxhash64("first"))
    wanted = compared.select("first.row", F.struct("gram", "first.at", "crowded").alias("w")).groupBy("row").agg(F.collect_list("w").alias("wanted"))

    again = classes.filter("copies > 1").select(*SET, "first", "copies")
    repeated = hot_join(shared, again, SET, "copies", place)
    if spec.earlier:
        repeated = repeated.filter(F.struct("row", "at") != F.col("first"))
    low = F.shiftright("at", 32) - F.shiftright("at", 16).bitwiseAND(0xFFFF)
    certain = repeated.select("row", low.alias("start"), (low + F.col("at").bitwiseAND(0xFFFF)).alias("end"))

    texts = docs.select(row, text).join(wanted.withColumnRenamed("row", row), row)
    contexts = _contexts(texts, spec, row, text)
    if asking.filter("crowded").limit(1).count():
        contexts = written(contexts)
        uncertain = _solve(contexts.filter("not crowded"), spec).unionByName(_counted(contexts.filter("crowded"), spec))
    else:
        uncertain = _solve(contexts, spec)
    uncertain = written(uncertain)
    del contexts, texts, wanted, compared
    release(spark, mark())  # the shuffles behind them
    parts = written(certain.unionByName(uncertain).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("parts")))
    release(spark, began, keep=1)
    return parts


def _counted(contexts: DataFrame, spec: Spec) -> DataFrame:
    """The exact way for grams with very many contexts: every window of a context by 128 bits of hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.texts(batch.column("blob"))
            symbols = _shipped(data, spec.width)
            offsets = offsets // spec.width
            at = batch.column("at").to_numpy()
            left = at >> 16 & 0xFFFF
            low = (at >> 32) - left
            n = np.maximum(np.minimum(np.diff(offsets) - spec.window, left) + 1, 0)  # those that hold the gram: the others have anchors of their own
            which = np.repeat(np.arange(len(n)), n)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = offsets[which] + step
            keys = flat.range_hashes(flat.prefix_hashes(symbols), start, start + spec.window) >> np.uint64(64 - spec.bits)
            checks = flat.range_hashes(flat.second_hashes(symbols), start, start + spec.window, flat.SECOND)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(checks.view(np.int64)), batch.column("row").take(pa.array(which)), pa.array(low[which] + step)], names=["key", "check", "row", "start"])

    every = written(contexts.mapInArrow(windows, "key long, check long, row long, start long").distinct())  # a window can hold two such grams
    counts = written(every.groupBy("key", "check").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start")).alias("first")).filter("n > 1"))
    again = hot_join(every, counts, ["key", "check"], "n", F.xxhash64("row", "start"))
    if spec.earlier:
        again = again.filter(F.struct("row", "start") != F.col("first"))
    return again.select("row", "start", (F.col("start") + spec.window).alias("end"))


def merged(parts: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((p["start"], p["end"]) for p in parts or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
