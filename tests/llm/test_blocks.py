"""A benchmark of many blocks gives the results of one."""

from __future__ import annotations

import random

import pytest

from fleetmatch.llm import decontamination
from tests.llm.conftest import documents

ITEMS = [" ".join(f"{c}{k}" for k in range(14)) for c in "abcdefgh"]


@pytest.fixture
def bench(spark):
    # overlapping items as well, and one that only a cut of others brings together
    more = [" ".join(["x9", *ITEMS[0].split()[:11]]), " ".join(f"y{k}" for k in range(12)), "lone"]
    return spark.createDataFrame([(str(k), t) for k, t in enumerate([*ITEMS, *more])], "item_id string, text string")


def test_cleaned_by_blocks_is_cleaned_at_once(spark, bench, monkeypatch):
    rng = random.Random(2)
    other = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    texts = [None, "", "lone", f"{other(20)} Lone, {other(20)}"]
    texts += [f"{a} {other(16)} {b}" for a, b in zip(ITEMS, ITEMS[1:], strict=False)]  # under half by each item, over half by both
    texts += [f"{other(30)} y0 y1 y2 y3 y4 y5 {a}, y6 y7 y8 y9 y10 y11 {other(30)}" for a in ITEMS]
    texts += [f"{other(30)} x9 {a}. {b} {other(30)}" for a in ITEMS for b in ITEMS[:3]]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs)
    rows = lambda: sorted(map(repr, decontamination.cleaned(docs, bench).collect()))
    want = rows()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    assert rows() == want
    assert 0 < len(want) < 2 * len(texts)


def test_repeated_rows_are_kept_by_blocks(spark, bench, monkeypatch):
    docs = documents(spark, [None, "", "lone", f"head {ITEMS[0]} {ITEMS[1]}. {ITEMS[2]} tail", "plain words"])
    docs = docs.unionByName(docs)
    rows = lambda: sorted(map(repr, decontamination.scanned(docs, bench).collect()))
    want = rows()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    assert rows() == want
    assert len(want) == 10
