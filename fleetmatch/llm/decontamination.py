"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all substrings (in words) of the normalised benchmark items.
Training texts are streamed through it; at every word it gives the longest suffix
that occurs in some item.  Ten words or more are a hit, and so is a whole item that
has fewer.  Only stretches of words whose neighbouring pairs all occur in the
benchmark can hold a hit, so numpy finds these and the automaton reads no others.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmatch.llm import flat
from fleetmatch.llm.store import fresh, table, written

WINDOW = 10
#: Bytes of benchmark text in one automaton, which has about ten times as many; a larger benchmark takes more passes over the texts.
BLOCK_BYTES = 4 << 20
EXTRA = "n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,end:bigint>>"


def _united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches [start, end), in order; stretches that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Automaton:
    """Suffix automaton over word ids of several items, in flat arrays: built once, then shared as it is.

    Edges of a state lie side by side, sorted by word; the root has one for every word.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.window = window
        data, offsets = flat.texts(pa.array([text or "" for _, text in items], pa.string()))
        _, _, hashes, at = flat.words(data, offsets, flat.ALNUM, True)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        filled = [k for k in range(len(items)) if at[k + 1] > at[k]]
        self.names = [items[k][0] for k in filled]
        named = [ids[at[k] : at[k + 1]] for k in filled]
        self._built(named)
        pairs = [flat.mix(self.vocabulary[w[:-1]]) + self.vocabulary[w[1:]] for w in named]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.least = min([window, *map(len, named)])
        full, whole = (array("q"), array("i")), (array("q"), array("i"))  # states and items, of windows and of short items
        self.short: dict[int, int] = {}  # state of a whole short item -> its length
        for item, word_ids in enumerate(named):
            state, n = 0, 0
            for w in word_ids.tolist():
                state, n = self.step(state, n, w)
                if n >= window:
                    full[0].append(self._of_length(state, window)), full[1].append(item)
            if len(word_ids) < window:
                self.short[state] = n
                whole[0].append(state), whole[1].append(item)
        self.window_items, self.short_items = self._listed(*full), self._listed(*whole)
        above = np.full(len(self.length), -1, np.int32)  # nearest state on the way to the root that is a short item
        if self.short:
            for v in np.argsort(self.length, kind="stable")[1:].tolist():
                p = self.link[v]
                above[v] = p if p in self.short else above[p]
        self.above = above
        self._viewed()

    def _built(self, named: list[np.ndarray]) -> None:
        # a state's first edge is in two arrays, others in a dictionary of the few states that have them
        word, to, more = array("i", [-1]), array("i", [0]), {0: {}}
        link, length = array("i", [-1]), array("i", [0])

        def edge(s: int, w: int) -> int | None:
            return to[s] if word[s] == w else more[s].get(w) if s in more else None

        def put(s: int, w: int, t: int) -> None:
            if s and word[s] in (-1, w):
                word[s], to[s] = w, t
            else:
                more.setdefault(s, {})[w] = t

        def state(n: int) -> int:
            word.append(-1), to.append(0), link.append(0), length.append(n)
            return len(link) - 1

        def clone(p: int, q: int, w: int) -> int:
            twin = state(length[p] + 1)
            word[twin], to[twin] = word[q], to[q]
            if q in more:
                more[twin] = dict(more[q])
            link[twin], link[q] = link[q], twin
            while p >= 0 and edge(p, w) == q:
                put(p, w, twin)
                p = link[p]
            return twin

        for word_ids in named:
            last = 0
            for w in word_ids.tolist():
                q = edge(last, w)
                if q is not None:  # known from another item
                    last = q if length[q] == length[last] + 1 else clone(last, q, w)
                    continue
                new, p = state(length[last] + 1), last
                while p >= 0 and edge(p, w) is None:
                    put(p, w, new)
                    p = link[p]
                if p >= 0:
                    q = edge(p, w)
                    link[new] = q if length[q] == length[p] + 1 else clone(p, q, w)
                last = new
        first, single = np.array(word, np.int32), np.array(to, np.int32)
        has = np.flatnonzero(first >= 0)
        rest = np.array([(s, w, t) for s, edges in more.items() for w, t in edges.items()], np.int32).reshape(-1, 3)
        source = np.concatenate([has.astype(np.int32), rest[:, 0]])
        words, target = np.concatenate([first[has], rest[:, 1]]), np.concatenate([single[has], rest[:, 2]])
        order = np.lexsort((words, source))
        self.words, self.targets = words[order], target[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=len(first)))]).astype(np.int32)
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self._viewed()

    def _listed(self, states: array, items: array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct items by state: where each state's begin, and the items."""
        pair = np.unique(np.array(states, np.int64) << 32 | np.array(items, np.int64))
        begin = np.concatenate([[0], np.cumsum(np.bincount(pair >> 32, minlength=len(self.length)))]).astype(np.int32)
        return begin, (pair & 0xFFFFFFFF).astype(np.int32)

    def _viewed(self) -> None:
        self._views = tuple(memoryview(x) for x in (self.starts, self.words, self.targets, self.link, self.length))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_views"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({k: np.ascontiguousarray(v) if isinstance(v, np.ndarray) else v for k, v in state.items()})
        self._viewed()

    def _of_length(self, state: int, n: int) -> int:
        link, length = self._views[3], self._views[4]
        while length[link[state]] >= n:
            state = link[state]
        return state

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """State and length of the longest match after one more word, which some item has."""
        starts, words, targets, link, length = self._views
        while state:
            a, b = starts[state], starts[state + 1]
            k = a if b - a < 2 else bisect_left(words, w, a, b)
            if k < b and words[k] == w:
                return targets[k], n + 1
            state = link[state]
            n = length[state]
        return targets[w], 1  # the root's edges come first

    def _names(self, listed: tuple[np.ndarray, np.ndarray], state: int) -> list[str]:
        begin, items = listed
        return [self.names[i] for i in items[begin[state] : begin[state + 1]].tolist()]

    def hits(self, word_ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches [start, end) of words inside occurrences, and the items that occur."""
        state, n, spans, items = 0, 0, [], set()
        for i, w in enumerate(word_ids):
            state, n = self.step(state, n, w)
            longest = 0
            if n >= self.window:
                longest = self.window
                items.update(self._names(self.window_items, self._of_length(state, self.window)))
            u = state if state in self.short else int(self.above[state])
            while u > 0:
                if self.short[u] <= n:
                    longest = max(longest, self.short[u])
                    items.update(self._names(self.short_items, u))
                u = int(self.above[u])
            if longest:
                if spans and spans[-1][1] >= i + 1 - longest:
                    spans[-1] = (min(spans[-1][0], i + 1 - longest), i + 1)
                else:
                    spans.append((i + 1 - longest, i + 1))
        merged: list[tuple[int, int]] = []
        for a, b in spans:
            while merged and merged[-1][1] >= a:
                a = min(a, merged.pop()[0])
            merged.append((a, b))
        return merged, items

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]], tuple]:
        """Words per text; for texts with hits, their stretches of words and items; the words themselves."""
        starts, ends, hashes, at = flat.words(data, offsets, flat.ALNUM, True)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if len(hashes) and len(self.vocabulary):
            ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[ids] == hashes
            bound = np.flatnonzero(known[:-1] & known[1:])
            joined = np.zeros(len(hashes), bool)  # with the next word
            if len(bound) and len(self.pairs):
                pair = flat.mix(hashes[bound]) + hashes[bound + 1]
                k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                joined[bound] = self.pairs[k] == pair
            inner = at[1:-1]
            joined[inner[(inner > 0) & (inner <= len(hashes))] - 1] = False
            first = known.copy()
            first[1:] &= ~joined[:-1]
            a = np.flatnonzero(first)
            b = np.flatnonzero(known & ~joined) + 1
            long = b - a >= self.least
            for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True):
                spans, items = self.hits(ids[x:y].tolist())
                if spans:
                    doc = int(np.searchsorted(at, x, "right")) - 1
                    own = found.setdefault(doc, ([], set()))
                    for s, e in spans:
                        if own[0] and own[0][-1][1] == x + s:
                            own[0][-1] = (own[0][-1][0], x + e)
                        else:
                            own[0].append((x + s, x + e))
                    own[1].update(items)
        return np.diff(at), found, (starts, ends, at)


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Automaton]:
    """Automata of the items, in blocks of bounded size, one after the other."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = _n_blocks(benchmark, text)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield Automaton([(r["item"], r["text"]) for r in part.collect()], window)


def _n_blocks(benchmark: DataFrame, text: str) -> int:
    return -(-(benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BLOCK_BYTES) or 1


KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(found: dict, at: np.ndarray, rows: Iterable[int]) -> list[list[dict]]:
    """Stretches in words of their own text."""
    return [[{"start": a - int(at[k]), "end": b - int(at[k])} for a, b in sorted(found[k][0])] if k in found else [] for k in rows]


def _hits(rows: DataFrame, automata: Iterable[Automaton]) -> DataFrame:
    """``row, text`` -> ``row, items, spans`` of the rows that any automaton hits, written; one automaton is shared at a time."""
    spark, parts = rows.sparkSession, None
    for automaton in automata:
        shared = spark.sparkContext.broadcast(automaton)  # bounded by BLOCK_BYTES

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in flat.chunks(batches):
                _, found, (_, _, at) = shared.value.scan(data, offsets)
                ids, hit = batch.column("row").to_pylist(), sorted(found)
                items = [sorted(found[k][1]) for k in hit]
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in hit], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(_spans(found, at, hit), KIND)], names=["row", "items", "spans"])

        one = written(rows.select("row", "text").mapInArrow(scan, HITS))
        shared.destroy()
        parts = one if parts is None else parts.unionByName(one)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in _united((s["start"], s["end"]) for s in row)] for row in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("items"), pa.array(spans, KIND)], names=["row", "items", "spans"])

    merged = parts.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))  # a list a block
    return written(merged.mapInArrow(unite, HITS))


HITS = "row long, items array<string>, spans array<struct<start:bigint,end:bigint>>"
ADDED = ["n_words", "n_hit", "items", "spans"]


def scanned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_hit, items`` (ids as strings, sorted) and ``spans`` (words hit).

    Null and empty texts have no words; a benchmark without words hits nothing; texts of
    any length are scanned whole.  Repeated rows are scanned one by one; items that share
    an id count as one.  Columns of the added names are replaced, others stay.  One pass
    over the texts unless the benchmark has more than BLOCK_BYTES; then rows are numbered
    and the passes' hits merged by that number.
    """
    base = docs.drop(*ADDED)
    schema = T.StructType([*base.schema.fields, *T._parse_datatype_string(EXTRA).fields])
    if _n_blocks(benchmark, text) > 1:
        return _scanned_by_blocks(base, benchmark, text, item, window)
    shared = docs.sparkSession.sparkContext.broadcast(next(_blocks(benchmark, item, text, window)))  # bounded by BLOCK_BYTES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in flat.chunks(batches, text):
            n_words, found, (_, _, at) = shared.value.scan(data, offsets)
            rows = range(batch.num_rows)
            spans = _spans(found, at, rows)
            yield flat.added(batch, {
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array([sum(s["end"] - s["start"] for s in own) for own in spans], pa.int64()),
                "items": pa.array([sorted(found[k][1]) if k in found else [] for k in rows], pa.list_(pa.string())),
                "spans": pa.array(spans, KIND),
            })

    return base.mapInArrow(scan, schema)


def _scanned_by_blocks(base: DataFrame, benchmark: DataFrame, text: str, item: str, window: int) -> DataFrame:
    row, own = fresh(base, "_row"), fresh(base, "_own")
    rows = written(base.withColumn(row, F.monotonically_increasing_id()))
    hits = _hits(rows.select(F.col(row).alias("row"), F.col(text).alias("text")), _blocks(benchmark, item, text, window))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in flat.chunks(batches, text):
            yield flat.added(batch, {"n_words": pa.array(np.diff(flat.words(data, offsets, flat.ALNUM, True)[3]), pa.int64())})

    counted = rows.mapInArrow(count, T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType())]))
    joined = counted.join(hits.select(F.col("row").alias(row), F.struct("items", "spans").alias(own)), row, "left")
    n_hit = F.aggregate(F.col(own)["spans"], F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    empty = {"items": "array<string>", "spans": "array<struct<start:bigint,end:bigint>>"}
    lists = [F.coalesce(F.col(own)[c], F.array().cast(kind)).alias(c) for c, kind in empty.items()]
    return joined.select(*base.columns, "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), *lists)


CUT = "row long, text string, n_left long, whole long"


def _cut(raw: bytes, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> bytes:
    """``raw`` without the stretches of words."""
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : starts[a]])
        last = int(ends[b - 1])
    return b"".join([*out, raw[last:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """``docs`` without benchmark passages: hit words are cut out, and rows hit over more than ``coverage`` leave.

    A cut can bring words together that form a passage again, so a text is scanned
    until nothing is hit.  Texts without a hit are untouched; ``n_chars`` follows the text.
    Null and empty texts stay as they are; repeated rows are treated alike; columns besides
    these two never change.  A benchmark of several blocks gives the result of one: every
    round scans the texts for all blocks before it cuts, and coverage is of the words there
    were at first.
    """
    if _n_blocks(benchmark, text) > 1:
        return _cleaned_by_blocks(docs, benchmark, text, item, coverage, window)
    shared = docs.sparkSession.sparkContext.broadcast(next(_blocks(benchmark, item, text, window)))  # bounded by BLOCK_BYTES

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value

        def cut(raw: bytes) -> bytes | None:
            whole = None
            while True:
                n, found, (starts, ends, _) = automaton.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                whole = int(n[0]) if whole is None else whole
                if not found:
                    return raw if whole == 0 or int(n[0]) >= (1 - coverage) * whole and int(n[0]) else None
                raw = _cut(raw, found[0][0], starts, ends)

        for batch, data, offsets in flat.chunks(batches, text):
            _, found, _ = automaton.scan(data, offsets)
            if found:
                column, keep = batch.column(text).to_pylist(), np.ones(batch.num_rows, bool)
                for k in found:
                    left = cut(column[k].encode())
                    keep[k] = left is not None
                    column[k] = None if left is None else left.decode()
                names = {text: pa.array(column, batch.schema.field(text).type)}
                for name in [n for n in batch.schema.names if n.lower() == "n_chars"]:
                    chars = batch.column(name).to_pylist()
                    for k in found:
                        chars[k] = None if column[k] is None else len(column[k])
                    names[name] = pa.array(chars, batch.schema.field(name).type)
                batch = pa.RecordBatch.from_arrays([names.get(f.name, batch.column(f.name)) for f in batch.schema], schema=batch.schema)
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(clean, docs.schema)


def _cleaned_by_blocks(docs: DataFrame, benchmark: DataFrame, text: str, item: str, coverage: float, window: int) -> DataFrame:
    """``cleaned`` where the benchmark has several automata; only rows that are hit are cut and scanned again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                raw = r["text"].encode()
                starts, ends, _, _ = flat.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), flat.ALNUM, True)
                spans = _united((s["start"], s["end"]) for s in r["spans"])
                left = len(starts) - sum(b - a for a, b in spans)
                whole = len(starts) if r["whole"] is None else r["whole"]
                rows.append({"row": r["row"], "text": _cut(raw, spans, starts, ends).decode(), "n_left": left, "whole": whole})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row", pa.int64()), ("text", pa.string()), ("n_left", pa.int64()), ("whole", pa.int64())]))

    row, own = fresh(docs, "_row"), fresh(docs, "_own")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    open_ = rows.select(F.col(row).alias("row"), F.col(text).alias("text"), F.lit(None).cast("long").alias("whole"))
    done = None
    while True:
        hits = _hits(open_, _blocks(benchmark, item, text, window))
        still = hits.limit(1).count()
        if "n_left" in open_.columns:
            over = open_.join(hits.select("row"), "row", "left_anti") if still else open_
            done = over if done is None else done.unionByName(over)
        if not still:
            break
        open_ = written(open_.join(hits, "row").select("row", "text", "whole", "spans").mapInArrow(cut, CUT))
    if done is None:
        return rows.select(*docs.columns)
    stays = (F.col("n_left") > 0) & (F.col("n_left") >= (1 - coverage) * F.col("whole"))
    final = done.select(F.col("row").alias(row), F.struct("text", stays.alias("stays")).alias(own))
    out = rows.join(final, row, "left").filter(F.coalesce(F.col(own)["stays"], F.lit(True)))
    new = {text: F.coalesce(F.col(own)["text"], F.col(text))}
    for c in [c for c in docs.columns if c.lower() == "n_chars"]:
        new[c] = F.when(F.col(own).isNotNull(), F.length(F.col(own)["text"])).otherwise(F.col(c)).cast(docs.schema[c].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op6_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scanned(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k + 1 : k + least(len(w), 10)], ' ') AS s
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), p AS (
  SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS k FROM d, (SELECT DISTINCT n FROM g))
), m AS (
  SELECT doc_id, p.n, k, item FROM p JOIN g ON p.n = g.n AND p.s = g.s
), h AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS x FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
