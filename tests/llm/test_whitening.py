from __future__ import annotations

import math

import numpy as np
import pytest

from fleetmatch.llm import whitening


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(whitening, "MERGE", 2)


def plain(rows, k=16):
    """(id, component) -> n, deviation, |whitened|, explained, from the covariance's eigenvectors."""
    usable = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in usable]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in xs:
        far = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        row = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        out += [(i, j + 1, n, far, abs(row @ vectors[:, j]) / math.sqrt(values[j]), values[j] / (np.sum(centred**2) / n)) for j in range(len(values))]
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()], key=repr)


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:4] == y[:4] and x[4] == pytest.approx(y[4], rel=1e-8, abs=1e-8) and x[5] == pytest.approx(y[5], rel=1e-9)


def test_against_eigenvectors(spark):
    """Copies, nulls, non-finite entries, empty vectors, repeated and missing ids, clashing names."""
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(20, 20)) * np.linspace(1, 3, 20)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 20)) @ mix)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(None, rows[5][1]), (3, rows[3][1]), (3, rows[9][1])]
    bad = [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] * 20), (2004, [float("inf")] + [0.0] * 19), (2005, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, "a", 1, 2, 3) for i, v in rows + bad], "vec_id long, embedding array<float>, id string, x int, Component int, n int")
    want = plain([(i, [float(np.float32(c)) for c in v]) for i, v in rows])
    out = whitening.whitened(df.repartition(9))
    same(got(out), want)
    errors = {r.identity_error for r in out.select("identity_error").distinct().collect()}
    assert len(errors) == 1 and errors.pop() < 1e-9
    signs = out.groupBy("component").agg({"whitened": "min"}).count()
    assert signs == 16


def test_one_sign_for_all_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 4)) * [4, 3, 2, 1]
    rows = [(2 * i, [float(c) for c in v]) for i, v in enumerate(base)] + [(2 * i + 1, [float(c) for c in v]) for i, v in enumerate(base)]
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    seen = {(r.vec_id, r.component): r.whitened for r in out}
    assert len(seen) == 480 and all(seen[2 * i, c] == seen[2 * i + 1, c] for i in range(60) for c in range(1, 5))
    assert abs(sum(v for (i, c), v in seen.items() if c == 1)) < 1e-9


def test_degenerate_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None)], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0  # no variance
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], kind)).collect()
    assert {r.component for r in line} == {1} and all(r.explained == pytest.approx(1.0) for r in line)


def test_values_that_do_not_fit(spark):
    big = 2.0**33
    rows = [(1, [big, 0.0]), (2, [-big, 1.0]), (3, [0.0, 5.0])]
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in out if r.vec_id == 1} == {None} and {r.deviation for r in out if r.vec_id == 3} != {None}


@pytest.mark.parametrize("shape", ["gauss", "graded", "clusters", "few", "dependent"])
def test_singular_vectors(shape):
    rng = np.random.default_rng(7)
    q, u = np.linalg.qr(rng.normal(size=(60, 30)))[0], np.linalg.qr(rng.normal(size=(30, 30)))[0]
    a = {
        "gauss": rng.normal(size=(90, 30)), "graded": rng.normal(size=(90, 30)) * np.logspace(0, -6, 30), "few": rng.normal(size=(7, 30)),
        "clusters": q @ np.diag(np.r_[5 + 1e-9 * np.arange(10), [3.0] * 10, 1 + 1e-5 * np.arange(10)]) @ u.T,
        "dependent": np.hstack([np.zeros((40, 2)), *[rng.normal(size=(40, 10))] * 2]),
    }[shape]
    d = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((d - len(r), d))])
    diag, over, v = whitening.bidiagonal(r)
    squares = whitening.squared_singular_values(diag, over)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.max(np.abs(squares - want)) < 1e-13 * want[0]
    kept = squares[squares > (d * whitening.EPS) ** 2 * squares[0]]
    z = v @ whitening.right_vectors(diag, over, kept)
    assert np.max(np.abs(z.T @ z - np.eye(len(kept)))) < 1e-11
    assert np.max(np.abs(a.T @ (a @ z) - z * kept)) < 1e-13 * want[0]
