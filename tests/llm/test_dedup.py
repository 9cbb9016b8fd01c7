"""Near and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from fleetmatch.llm import embedding_dedup, exact_dedup, near_dedup, repeats, suffixes
from fleetmatch.llm.components import components
from tests.conftest import SF, assert_same
from tests.llm.conftest import documents


def brute_groups(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(texts):
    sets = [shingles(t) for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) > 0]
    group = brute_groups(alike, range(len(sets)))
    return {i: (len(s), group[i], group[i] == i) for i, s in enumerate(sets)}


def test_near_duplicates(spark, corpus):
    got = near_dedup.near_duplicates(documents(spark, corpus)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(corpus)


def test_near_duplicates_of_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert [d for d, _ in docs] == list(range(len(docs)))
    got = near_dedup.op1_super_minhash(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near([t for _, t in docs])


def test_near_duplicates_keep_other_kinds_of_ids(spark, corpus):
    docs = documents(spark, corpus)
    named = docs.selectExpr("concat('d', lpad(cast(doc_id as string), 4, '0')) as doc_id", "text", "_row")
    want = {f"d{i:04}": (n, f"d{c:04}", k) for i, (n, c, k) in brute_near(corpus).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(named).collect()} == want
    twice = near_dedup.near_duplicates(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(corpus)
    assert {r["doc_id"]: r["component_id"] for r in twice} == {i: c for i, (_, c, _) in brute_near(corpus).items()}


def test_one_of_each_with_repeated_and_null_ids(spark, corpus):
    docs = documents(spark, corpus)
    twice = docs.unionByName(docs).unionByName(docs.filter("doc_id = 40").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    kept = near_dedup.one_of_each(twice)
    assert kept.columns == docs.columns
    lone = sum(not shingles(t) for t in corpus)  # rows without words link with nothing
    groups = len({v[1] for v in brute_near(corpus).values()})
    assert kept.count() == groups + lone
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def family(spark, n, own):
    """Open rows of one family: 100 shingles each, all but ``own`` of them the family's, each in its own component."""
    sets = [(r, [*range(100 - own), *range(1000 * (r + 1), 1000 * (r + 1) + own)]) for r in range(n)]
    sets = spark.createDataFrame(sets, "row long, shingles array<long>")
    return sets, sets.selectExpr("row", "row as component", "1 as foreign", "100L as n_shingles", *[f"0L as {c}" for c in near_dedup.SKETCHES])


@pytest.mark.parametrize("share", [4096, 3])
def test_near_misses_ask_for_nothing_they_share(spark, monkeypatch, share):
    monkeypatch.setattr(near_dedup, "SHARE", share)
    at_limit = 14  # 86 shared of 114
    met = near_dedup._meeting(*family(spark, 12, at_limit)).distinct()
    assert {(r["x_row"], r["y_row"]) for r in met.collect()} == {(a, b) for a in range(12) for b in range(a + 1, 12)}
    sets, open_ = family(spark, 12, at_limit + 1)  # 85 of 115: 0.739
    asked = near_dedup._meeting(sets, open_)
    assert asked.count() == 0


def test_families_of_several_sizes(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    core = [word() for _ in range(120)]
    texts = []
    for _ in range(60):  # similarities from 0.6 to 0.9, lengths from three quarters to all
        w = core[rng.randrange(12) : len(core) - rng.randrange(18)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join([*w, *[word() for _ in range(rng.randint(0, 14))]]))
    got = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(texts)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    value = rng.integers(0, 2**63, 300).astype(np.uint64)
    both = np.concatenate([value[:200], value[100:]])
    signed = near_dedup.super_min_hash(np.repeat([0, 1], 200), both, 2)
    assert abs(float((signed[0] == signed[1]).mean()) - 1 / 3) < 0.12
    assert (signed >> np.uint64(32)).max() < near_dedup.SLOTS
    tiny = near_dedup.super_min_hash(np.zeros(1, np.int64), value[:1], 1)
    assert sorted((tiny[0] >> np.uint64(32)).tolist()) == list(range(near_dedup.SLOTS))  # one element reaches every slot once


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p} - {300}
    assert got == brute_groups([p for p in pairs if p[0] != p[1]], nodes)


def brute_bytes(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + window] for b in raw for k in range(len(b) - window + 1))
    out = {}
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def brute_words(texts, window):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def test_repeated_bytes(spark, corpus):
    got = exact_dedup.without_repeated_bytes(documents(spark, corpus)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got} == brute_bytes(corpus, 200)


def test_repeated_words(spark, corpus):
    got = exact_dedup.without_repeated_words(documents(spark, corpus)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_words(corpus, 20)


LEAST = repeats.Spec(window=20, gram=5, earlier=True, symbols=repeats.word_symbols, width=8)


def test_least_grams_as_anchors_of_words(spark, corpus):
    got = exact_dedup.without_repeated_words(documents(spark, corpus), spec=LEAST).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_words(corpus, 20)


def test_packed_probes_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 500):
        low = np.sort(rng.choice(2**32, n, replace=False)).astype(np.uint32)
        bits = rng.random((2, n)) < 0.3
        back = repeats._unpacked(repeats._packed(low, *bits), n)
        assert (back[0] == low).all() and (back[1] == bits[0]).all() and (back[2] == bits[1]).all()


@pytest.mark.parametrize("crowd", [2, None])
def test_colliding_hashes_do_no_harm(spark, corpus, monkeypatch, crowd):
    """Contexts and windows whose first hash has two bits: the second tells them apart."""
    real = repeats.stretches
    monkeypatch.setattr(exact_dedup, "stretches", lambda *a: real(*a, crowd=crowd))
    docs = documents(spark, corpus)
    got = exact_dedup.without_repeated_words(docs, spec=replace(exact_dedup.WORDS, bits=2)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_words(corpus, 20)
    got = exact_dedup.without_repeated_bytes(docs, spec=replace(exact_dedup.BYTES, bits=2)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {k: v[1] for k, v in brute_bytes(corpus, 200).items()}


def test_crowded_grams_are_counted_exactly(spark, corpus, monkeypatch):
    real = repeats.stretches
    monkeypatch.setattr(exact_dedup, "stretches", lambda *a: real(*a, crowd=2))
    docs = documents(spark, corpus)
    got = exact_dedup.without_repeated_words(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_words(corpus, 20)
    got = exact_dedup.without_repeated_bytes(docs).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {k: v[1] for k, v in brute_bytes(corpus, 200).items()}


def test_repeats_of_given_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = {r[0]: tuple(r[1:]) for r in exact_dedup.op5_suffix_dedup(spark, SF).collect()}
    assert got == brute_bytes(texts, 200)
    got = {r[0]: tuple(r[1:]) for r in exact_dedup.op9_anchor_dedup(spark, SF).collect()}
    assert got == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in brute_words(texts, 20).items()}


def test_repeats_with_repeated_ids_and_empty_table(spark, corpus):
    docs = documents(spark, corpus[6:30])
    twice = docs.unionByName(docs)
    for make in (exact_dedup.without_repeated_bytes, exact_dedup.without_repeated_words):
        assert make(docs.limit(0)).count() == 0
        assert make(twice).count() == 48
    got = exact_dedup.without_repeated_bytes(twice).agg({"n_removed": "sum", "n_bytes": "sum"}).first()
    assert got["sum(n_removed)"] == got["sum(n_bytes)"]  # every text is there twice and long enough
    nulls = docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:])
    assert exact_dedup.without_repeated_words(nulls).count() == 24


@pytest.mark.parametrize("seed", range(4))
def test_suffix_sort(seed):
    rng = np.random.default_rng(seed)
    symbols = rng.integers(1, 3, 400).astype(np.uint64)
    start = np.sort(rng.integers(0, 360, 90))
    length = rng.integers(0, 40, 90)
    group = np.sort(rng.integers(0, 4, 90))
    order, shared = suffixes.Text(symbols).sort(start, length, group)
    key = lambda k: (group[k], symbols[start[k] : start[k] + length[k]].tolist())
    assert [key(k) for k in order] == sorted(map(key, range(90)))
    for i in range(1, 90):
        a, b = key(order[i - 1]), key(order[i])
        same = next((n for n, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
        assert shared[i] == (same if a[0] == b[0] else -1)


def test_false_common_extensions_are_found():
    text = suffixes.Text(np.array([1, 2, 3, 1, 2, 4], np.uint64))
    assert text.verified(np.array([0]), np.array([3]), np.array([3])).tolist() == [2]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    spec = repeats.Spec(window=20, gram=5, earlier=False, symbols=repeats.byte_symbols, width=1)
    shared = rng.integers(1, 9, 20).astype(np.uint64)
    text = np.concatenate([rng.integers(1, 9, 37), shared, rng.integers(1, 9, 50), shared, rng.integers(1, 9, 11)]).astype(np.uint64)
    _, position = repeats.anchors(text, np.array([0, len(text)]), spec)
    inside = lambda at: {p - at for p in position.tolist() if at <= p <= at + 15}
    assert inside(37) & inside(107)


def brute_vectors(rows):
    links = []
    for i, a, la in rows:
        for j, b, lb in rows:
            if i != j and la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links.append((i, j))
    group = brute_groups(links, [r[0] for r in rows])
    n = Counter(i for i, _ in links)
    return {i: (n[i], group[i], group[i] == i) for i, _, _ in rows}


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("cell", [10_000, 12])
def test_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 7 * 8 * 8)
    monkeypatch.setattr(embedding_dedup, "PAIR_BYTES", 5 * 8 * 8)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(30):
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base + rng.normal(size=8) * rng.choice([0, 0.05, 0.1])).astype(np.float32).tolist(), k % 3))
    for v, label in ((None, 1), ([], 1), ([0.0] * 8, 1), ([float("nan")] * 8, 1), ([float("inf")] + [1.0] * 7, 1), ([None] + [1.0] * 7, 1), (rows[0][1], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e30] * 8, 2)):
        rows.append((len(rows), v, label))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.linked(frame).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute_vectors(rows)
    assert embedding_dedup.linked(frame.limit(0)).count() == 0


def test_vectors_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0, "mine", "mine") for i, v in rows], "vec_id long, embedding array<float>, label int, unit string, head string")
    got = embedding_dedup.linked(frame).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] == 2) == [(2, 0, 2, True)]
    linked = [r for r in got if r["vec_id"] != 2]  # all four are alike
    assert [r["n_links"] for r in linked] == [3] * 4 and sum(r["kept"] for r in linked) == 1 and {r["component_id"] for r in linked} == {None}


def test_given_vectors(spark):
    assert_same(embedding_dedup.op2_spherical_cells(spark, SF), embedding_dedup.OP2_SQL)


@pytest.mark.parametrize("shape", ["uniform", "clustered", "flat"])
def test_copies_of_vectors_stay_bounded(spark, monkeypatch, shape):
    """One label of vectors that lie evenly, in clusters, or in few dimensions: a split that does not pay is not made."""
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(embedding_dedup, "CELL", 100)
    rng = np.random.default_rng(2)
    n, d = 3000, 24
    x = {"uniform": rng.normal(size=(n, d)), "clustered": rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, d)), "flat": rng.normal(size=(n, 3)) @ rng.normal(size=(3, d))}[shape]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(0, i, 1, [float(c) for c in u]) for i, u in enumerate(unit)], "label int, head long, weight long, unit array<double>")
    placed = embedding_dedup._celled(rows, 0.98).groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    facts = placed.agg(F.sum("n"), F.min("homes"), F.max("homes"), F.count(F.lit(1))).first()
    assert facts[1:] == (1, 1, n)
    assert facts[0] <= 1.25 * embedding_dedup.COPIES * n and (facts[0] == n if shape == "uniform" else facts[0] > n)
