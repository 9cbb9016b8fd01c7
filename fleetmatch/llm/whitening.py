"""Whitening of embeddings: directions of the covariance, found from a triangular factor of the rows.

Vectors are put on a grid of whole numbers, so that sums and deviations are exact.  The
directions are fitted on the distinct grid vectors: every task turns its centred rows block
by block into a triangular factor (QR), factors are merged in groups until one is left, and
that small matrix alone comes to the driver.  There Householder reflections make it
bidiagonal, the shifted differential qd algorithm finds its singular values, and a twisted
factorisation per value gives the direction.  The covariance itself is never formed: that
would square the condition of the problem.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmatch.llm.store import table, written

#: An entry c lies on the grid at floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this on the grid count as not finite: exact sums of them would not fit.
LARGEST = 1 << 40
COMPONENTS = 16
#: Bytes of rows that are factored at once, and factors merged in one task.
BLOCK_BYTES, MERGE = 8 << 20, 32
EPS = np.finfo(float).eps


# Singular values and vectors of one small matrix.


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U' r V for orthogonal U, V, and V; ``r`` is square."""
    a, d = r.astype(float).copy(), len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        u = x / norm
        u[0] += 1.0 if u[0] >= 0 else -1.0
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        u = reflector(a[k, k + 1 :]) if k + 1 < d else None
        if u is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One differential qd transformation; also the place of the first negative pivot, or -1."""
    d, qs, es = q[0] - shift, [], []
    for i, ei in enumerate(e):
        if d < 0:
            return qs, es, i
        pivot = d + ei
        qs.append(pivot)
        if pivot == 0:  # the matrix falls apart here
            es.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / pivot
            es.append(ei * t)
            d = d * t - shift
    qs.append(d)
    return qs, es, len(e) if d < 0 else -1


def squared_singular_values(diag: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by dqds.

    Negligible off-diagonal entries split the matrix, values leave at the bottom, and a
    shift that turns out too large is taken back.
    """
    found, blocks = [], [((diag * diag).tolist(), (over * over).tolist(), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        late = 0
        while q:
            cut = next((i for i in reversed(range(len(e))) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if len(q) == 1 or cut == len(e) - 1:
                found.append(q[-1] + moved)
                q, e = q[:-1], e[:-1]
                continue
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[-1] > 1.5 * q[0] and late % 8 == 0:  # graded the wrong way round
                q, e = q[::-1], e[::-1]
            half, product = (q[-2] + e[-1] + q[-1]) / 2, q[-2] * q[-1]
            shift = product / (half + np.sqrt(max(0.0, half * half - product))) if half > 0 else 0.0
            tries = 0
            while True:
                qs, es, failed = _qd_step(q, e, shift)
                if failed < 0:
                    break
                tries += 1
                shift = 0.0 if tries > 3 else shift * (0.9 if tries == 1 and failed == len(e) else 0.25)
            q, e, moved, late = qs, es, moved + shift, late + 1
    return np.sort(np.array(found))[::-1]


def _factors(d: np.ndarray, low: np.ndarray, at: float) -> tuple[np.ndarray, ...]:
    """L D L' - at as L+ D+ L+' (from the top) and U- D- U-' (from the bottom), and the twist values of all places."""
    n, tiny = len(d), EPS * EPS * max(float(np.max(d)), 1e-280)
    s, p, dp, lp, um = np.empty(n), np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
    s[0], p[n - 1] = -at, d[n - 1] - at
    for i in range(n):
        dp[i] = s[i] + d[i] or tiny
        if i + 1 < n:
            lp[i] = d[i] * low[i] / dp[i]
            s[i + 1] = lp[i] * low[i] * s[i] - at
    for i in reversed(range(n - 1)):
        dm = d[i] * low[i] * low[i] + p[i + 1] or tiny
        um[i] = d[i] * low[i] / dm
        p[i] = d[i] / dm * p[i + 1] - at
    return lp, um, s + p + at


def right_vectors(diag: np.ndarray, over: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix for ``squares`` (falling), as columns, by twisted factorisations.

    Each is the solution at the place of the least twist value.  Of values that agree to a
    thousandth the vectors may lean on each other or come out the same: those go on by
    inverse iteration, orthogonal to the ones before.
    """
    scale = float(np.max(np.abs(diag), initial=0.0)) or 1.0
    diag = np.where(np.abs(diag) < EPS * scale, EPS * scale, diag)
    d, low = diag * diag, over / diag[:-1]
    square = (b := np.diag(diag) + np.diag(over, 1)).T @ b
    out, rng = [], np.random.default_rng(0)
    for k, at in enumerate(squares):
        first = k
        while first and squares[first - 1] - at <= 1e-3 * squares[first - 1]:
            first -= 1
        with np.errstate(all="ignore"):
            lp, um, twist = _factors(d, low, float(at))
            r = int(np.nanargmin(np.abs(twist)))
            z = np.zeros(len(d))
            z[r] = 1.0
            for i in reversed(range(r)):
                z[i] = -lp[i] * z[i + 1]
            for i in range(r, len(d) - 1):
                z[i + 1] = -um[i] * z[i]
            z /= np.linalg.norm(z)
            before = np.array(out[first:k])
            for tries in range(8 if first < k else 0):
                rest = z - before.T @ (before @ z)
                kept = np.linalg.norm(rest)
                if not kept > 0.1:  # nothing new in it (or not a number)
                    rest = rng.standard_normal(len(d))
                rest -= before.T @ (before @ rest)
                z = rest / np.linalg.norm(rest)
                if tries >= 2 and kept > 0.9:
                    break
                if tries < 7:
                    z = np.linalg.solve(square - (at + (at or scale) * EPS * (tries + 1)) * np.eye(len(d)), z)
                    z /= np.linalg.norm(z)
        out.append(z)
    return np.array(out).T


class Whitening(NamedTuple):
    """What the fit list says: its size, its sums by dimension, and the leading directions."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    directions: np.ndarray  # unit columns
    trace: float


# Rows in blocks.


def on_grid(vectors: DataFrame, id_: str, embedding: str) -> DataFrame:
    """``id, x``: usable vectors as whole numbers.

    Null vectors, vectors with null or non-finite entries (or beyond LARGEST on the grid)
    and empty ones leave; so do vectors that have not the most common number of entries
    (of equally common ones, the larger).
    """
    wide = vectors.select(F.col(id_).alias("id"), F.transform(embedding, lambda v: v.cast("double") * SCALE).alias("v")).filter("v is not null and size(v) > 0")
    # a NaN is larger than any number
    rows = wide.filter(~F.exists("v", lambda v: v.isNull() | (F.abs(v) >= LARGEST)))
    rows = rows.select("id", F.transform("v", lambda v: (F.floor(v) + OFFSET).cast("long")).alias("x"))
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (size["d"] if size else 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut into blocks, and their ``x`` as rows of a matrix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d = len(batch.column("x").flatten()) // batch.num_rows
        step = max(1, BLOCK_BYTES // (8 * d))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x`` less the mean: the difference is taken in whole numbers (of any size), then rounded once."""
    if n * int(np.max(np.abs(x), initial=0)) < 2**62:
        return (n * x - sums) / n
    return ((n * x.astype(object) - sums.astype(object)) / n).astype(float)


def _array(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.int64 if all(abs(v) < 2**62 for v in values) else object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for _, x in _blocks(batches):
        total, n = x.sum(axis=0) + (0 if total is None else total), n + len(x)
    if n:
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "s": pa.array(total, pa.int64()), "n": pa.array([n] * len(total), pa.int64())})


def _triangle(rows: Iterator[np.ndarray]) -> np.ndarray | None:
    """Triangular factor of all ``rows``, a block at a time; square, zeros below."""
    r = None
    for block in rows:
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    if r is None:
        return None
    return np.vstack([r, np.zeros((max(0, r.shape[1] - r.shape[0]), r.shape[1]))])


def _factor(n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = _triangle(_centred(x, n, sums) for _, x in _blocks(batches))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    return run


def _merged(factors: DataFrame) -> np.ndarray:
    """One factor from those of all tasks, merged MERGE at a time by tasks, without regard to their order."""

    def merge(parts: pa.Table) -> pa.Table:
        rows = parts.sort_by("part").column("r").to_pylist()
        d = round(len(rows[0]) ** 0.5)
        r = _triangle(np.array(row).reshape(d, d) for row in rows)
        return pa.table({"part": pa.array([parts.column("part")[0].as_py() // MERGE], pa.int32()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    here = written(factors)
    while True:
        here = written(here.groupBy(F.expr(f"part div {MERGE}").alias("to")).applyInArrow(lambda _, t: merge(t), "part int, r array<double>"))
        if here.agg(F.max("part")).first()[0] == 0:
            [row] = here.select("r").collect()
            d = round(len(row["r"]) ** 0.5)
            return np.array(row["r"]).reshape(d, d)


def fitted(fit: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Whitening of the rows of ``fit`` (x); at most ``k`` directions, those without variance left out; None without rows."""
    totals = fit.mapInArrow(_sums, "dim int, s long, n long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()  # a row a dimension
    if not totals:
        return None
    n, sums = totals[0]["n"], [int(t["s"]) for t in totals]
    r = _merged(fit.mapInArrow(_factor(n, _array(sums)), "part int, r array<double>"))
    diag, over, v = bidiagonal(r)
    squares = squared_singular_values(diag, over)
    squares = squares[squares > (len(r) * EPS) ** 2 * squares[0]][:k] if squares[0] > 0 else squares[:0]
    z = right_vectors(diag, over, squares) if len(squares) else np.zeros((len(r), 0))
    return Whitening(n, sums, squares / n, v @ z, float(np.sum(r * r)) / n)


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity, from a pass over all its rows."""
    n, sums, scaled = w.n, _array(w.sums), w.directions / np.sqrt(w.values)
    k = len(w.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _blocks(batches):
            y = _centred(x, n, sums) @ scaled
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(k * k), pa.int32()), "s": pa.array(total.ravel(), pa.float64())})

    cells = fit.mapInArrow(products, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    unit = F.when(F.col("cell") % (k + 1) == 0, 1.0).otherwise(0.0)
    return cells.agg(F.max(F.abs(F.col("s") / n - unit))).first()[0]


def projected(rows: DataFrame, w: Whitening, error: float) -> DataFrame:
    """``rows`` (id, x) with ``deviation`` (null where it exceeds a long) and a row a direction: ``component, whitened`` and the fit's figures."""
    n, sums, scaled, k = w.n, _array(w.sums), w.directions / np.sqrt(w.values), len(w.values)
    explained = w.values / w.trace
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            y, far = _centred(x, n, sums), None
            if n * float(np.max(np.abs(y), initial=0.0)) < 2**30 / len(sums) ** 0.5 and n * int(np.max(np.abs(x))) < 2**62:
                gap = n * x - sums
                far = np.sum(gap * gap, axis=1).tolist()
            else:
                gap = n * x.astype(object) - sums.astype(object)
                far = [v if v < 2**63 else None for v in np.sum(gap * gap, axis=1).tolist()]
            index = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id").take(index), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), "n": pa.array([n] * (len(x) * k), pa.int64()),
                "deviation": pa.array(far, pa.int64()).take(index), "whitened": pa.array((y @ scaled).ravel(), pa.float64()),
                "explained": pa.array(np.tile(explained, len(x)), pa.float64()), "identity_error": pa.array([error] * (len(x) * k), pa.float64()),
            })

    return rows.mapInArrow(run, f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and direction: ``id_, component, n, deviation, whitened, explained, identity_error``.

    Unusable vectors (``on_grid``) give no rows; repeated ones count once in the fit and
    give rows each, as do rows that share an id or have none.  Directions without
    variance are left out, so vectors that are all the same give no rows.  Equal
    eigenvalues have some orthogonal directions of their space.  Other columns play no
    part, whatever their names; an empty table gives no rows.
    """
    rows = written(on_grid(vectors, id_, embedding))
    fit = written(rows.select("x").distinct())
    w = fitted(fit, k)
    if w is None or not len(w.values):
        return vectors.limit(0).select(id_, *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in RESULT.split(", "))])
    return projected(rows, w, identity_error(fit, w)).withColumnRenamed("id", id_)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
