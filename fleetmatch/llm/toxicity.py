"""Toxic passages as maximum-scoring segments.

Every word has log-odds between toxic and clean labelled text, counted in words, under a
Dirichlet prior (of two classes) that is centred on the word's first letters; a word that
was never seen has the log-odds of these alone.  Each word costs a constant besides, so
that clean text falls.  A linear scan finds all maximal scoring segments of a text; a
segment's significance follows the extreme-value law of such scans, E = n exp(-lambda S),
with lambda the root of sum_w p(w) exp(lambda s(w)) = 1, where p is the share of a word
in clean text under the same prior.  The best segment's log E-value is calibrated to a
probability on labelled rows that the log-odds did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmatch.llm import flat
from fleetmatch.llm.store import fresh, table, written

#: The classifier is fitted on a sample of labelled rows of about this many at most, whatever the corpus.
SAMPLE = 24_000
HEAD, HEAD_LEAST = 4, 6  # bytes of a word's head; words shorter than HEAD_LEAST have none
PRIOR, HEAD_PRIOR = 0.5, 20.0  # weight of the prior of a word and of a head, in words
COST = 3.0  # of every word
SIGNIFICANT = 1e-3  # E-value of a passage that is reported


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # hashes, sorted
    word_scores: np.ndarray
    heads: np.ndarray
    head_scores: np.ndarray
    rate: float  # lambda
    slope: float
    offset: float


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, heads (-1 for none) and where each text's words begin."""
    starts, ends, hashes, at = flat.words(data, offsets, flat.ALNUM, True)
    heads = np.full(len(starts), -1, np.int64)
    long = np.flatnonzero(ends - starts >= HEAD_LEAST)
    value = np.zeros(len(long), np.int64)
    for k in range(HEAD):
        value = value << 8 | flat.LOWER[data[starts[long] + k]]
    heads[long] = value
    return hashes, heads, at


def _counted(sample: DataFrame, text: str) -> DataFrame:
    """Words by class, ``head`` (whether it is a head's count), ``key, of`` (the word's head), ``a`` in toxic and ``b`` in clean text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in flat.chunks(batches, text):
            hashes, heads, at = _tokens(data, offsets)
            label = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))
            for is_head, key in ((False, hashes.view(np.int64)), (True, heads)):
                known, first, which = np.unique(key, return_index=True, return_inverse=True)
                n = [np.bincount(which[label == c], minlength=len(known)) for c in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), is_head)), pa.array(known), pa.array(heads[first]), *map(pa.array, n)], names=["head", "key", "of", "a", "b"])

    rows = sample.select(text, F.col("toxic").cast("long").alias("toxic")).mapInArrow(count, "head boolean, key long, of long, a long, b long")
    return rows.groupBy("head", "key").agg(F.max("of").alias("of"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def segments(position: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text.

    Given are the places of its words that score above 0, and the sums of all words'
    scores ahead of and up to each.  Linear: each new segment is merged leftwards while
    that raises its score.
    """
    held: list[list[float]] = []  # start, end, sum before, sum after
    for i, low, high in zip(position.tolist(), before.tolist(), after.tolist(), strict=True):
        new = [i, i + 1, low, high]
        while held:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
        held.append(new)
    return [(int(a), int(b), high - low) for a, b, low, high in held]


def _scores(model: Model, hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Log-odds of every word less its cost."""
    out = np.zeros(len(hashes))
    for known, value, key in ((model.heads, model.head_scores, heads), (model.words, model.word_scores, hashes)):
        if len(known) and len(key):
            k = np.minimum(np.searchsorted(known, key), len(known) - 1)
            out = np.where(known[k] == key, value[k], out)
    return out - COST


def _passages(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int, float]]]]:
    hashes, heads, at = _tokens(data, offsets)
    score = _scores(model, hashes, heads)
    sums = np.concatenate([[0.0], np.cumsum(score)])
    place = np.flatnonzero(score > 0)
    cuts = np.searchsorted(place, at)
    found = {}
    for d in np.flatnonzero(np.diff(cuts)).tolist():
        own = place[cuts[d] : cuts[d + 1]]
        start = sums[at[d]]
        found[d] = segments(own - at[d], sums[own] - start, sums[own + 1] - start)
    return np.diff(at), found


def _evidence(model: Model, n_words: np.ndarray, found: dict[int, list[tuple[int, int, float]]]) -> np.ndarray:
    """-log E of the best segment of each text."""
    best = np.zeros(len(n_words))
    for d, parts in found.items():
        best[d] = max(s for _, _, s in parts)
    return model.rate * best - np.log(n_words + 1.0)


def _exact(score: np.ndarray) -> np.ndarray:
    """To 20 binary places: sums of such scores are exact, so a text scores alike wherever it lies."""
    return np.round(score * 2.0**20) / 2.0**20


def _root(weights: np.ndarray, scores: np.ndarray) -> float:
    """lambda > 0 with sum of weights * exp(lambda * scores) = 1, for weights that add up to 1 and a mean score below 0."""
    value = lambda x: float((weights * np.exp(np.minimum(x * scores, 500))).sum())
    low, high = 1e-6, 1.0
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak prior that keeps separable data finite."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    ridge = np.diag([0.1, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", bound: int = SAMPLE) -> Model:
    """Model from labelled rows outside the held-out fold; a sample of about ``bound`` of them if there are more.

    Rows with a null label or id are left out, and of repeated labels the largest counts.
    Without labels of both classes nothing is toxic.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = F.lit(min(1.0, bound / max(total, 1)) * 1_000_000)
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    sample = docs.drop("toxic").join(F.broadcast(some), "doc_id")  # about `bound` pairs of numbers
    sample = written(sample.select("doc_id", text, "toxic", (fold(F.col("doc_id")) == 4).alias("calibrates")))
    counts = written(_counted(sample.filter(~F.col("calibrates")), text))
    n = {r["toxic"]: r["n"] for r in sample.filter(~F.col("calibrates")).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = np.zeros(0)
    if not n.get(1) or not n.get(0):
        return Model(empty.astype(np.uint64), empty, empty.astype(np.int64), empty, 1.0, 0.0, -10.0)
    rows = counts.toArrow().to_pandas().sort_values(["head", "key"])  # the words of a bounded sample
    heads, words = rows[rows["head"]], rows[~rows["head"]]
    toxic, clean = float(words.a.sum()), float(words.b.sum())
    base = min(max(toxic / max(toxic + clean, 1.0), 1e-6), 1 - 1e-6)
    odds = lambda p: np.log(p / (1 - p)) - np.log(base / (1 - base))
    share = ((heads.a + HEAD_PRIOR * base) / (heads.a + heads.b + HEAD_PRIOR)).to_numpy()
    share[heads.key.to_numpy() < 0] = base  # words without a head
    of = np.searchsorted(heads.key.to_numpy(), words.of.to_numpy())
    centre = share[np.minimum(of, len(share) - 1)] if len(share) else np.zeros(0)
    a, b = words.a.to_numpy() + PRIOR * centre, words.b.to_numpy() + PRIOR * (1 - centre)
    key, score = words.key.to_numpy().view(np.uint64), odds(a / (a + b))
    order = np.argsort(key)
    rate = _root(b / b.sum(), _exact(score) - COST) if len(key) else 1.0
    model = Model(key[order], _exact(score[order]), heads.key.to_numpy(), _exact(odds(share)), rate, 1.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in flat.chunks(batches, text):
            x = _evidence(shared.value, *_passages(shared.value, data, offsets))
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column("toxic").cast(pa.float64())], names=["x", "y"])

    points = sample.filter("calibrates").select(text, "toxic").mapInArrow(weigh, "x double, y double").toArrow().to_pandas()  # bounded
    slope, offset = _logistic(points.x.to_numpy(), points.y.to_numpy()) if points.y.nunique() == 2 else (1.0, 0.0)
    return Model(model.words, model.word_scores, model.heads, model.head_scores, rate, slope, offset)


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score", passages: str = "passages") -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``passages`` (start, end in words, log of 1/E).

    Null and empty texts have no passage and the score of no evidence; texts of any
    length are scored whole; equal texts score alike.  Columns of these names are replaced.
    """
    base = docs.drop(score, passages)
    more = [T.StructField(score, T.DoubleType()), T.StructField(passages, T._parse_datatype_string("array<struct<start:long,end:long,log_inverse_e:double>>"))]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log_inverse_e", pa.float64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, offsets in flat.chunks(batches, text):
            n_words, found = _passages(m, data, offsets)
            x = _evidence(m, n_words, found)
            value = 1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -500, 500)))
            spans = [
                [{"start": a, "end": b, "log_inverse_e": float(e)} for a, b, s in found.get(k, []) if (e := m.rate * s - np.log(n_words[k] + 1.0)) >= -np.log(SIGNIFICANT)]
                for k in range(batch.num_rows)
            ]
            yield flat.added(batch, {score: pa.array(value), passages: pa.array(spans, kind)})

    return base.mapInArrow(apply, T.StructType([*base.schema.fields, *more]))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``limit``, as they are."""
    score, passages = fresh(docs, "_score"), fresh(docs, "_passages")
    return scored(docs, fitted(docs, labels), score=score, passages=passages).filter(F.col(score) < limit).select(*docs.columns)


def op7_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
