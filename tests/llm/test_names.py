"""Columns whose names differ from an added one only in case are replaced, others keep their values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetmatch.llm import decontamination, mixing, secrets, sharding

NAMES = ["Size", "OLD", "Shard", "SLOT", "Found", "Spans", "N_Hit", "Source_Size", "Rate", "Copies", "TARGET", "Score"]


@pytest.fixture
def docs(spark, corpus):
    rows = [(i, t, "s" if i % 3 else None, len(t or ""), *[f"{n} of {i}" for n in NAMES]) for i, t in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, N_Chars long, " + ", ".join(f"{n} string" for n in NAMES))


CASES = {
    "secrets": (lambda d: secrets.scanned(d), ["found"]),
    "mixed": (lambda d: mixing.mixed(d), mixing.ADDED),
    "mix": (lambda d: mixing.mix(d), []),
    "resharded": (lambda d: sharding.resharded(d, sharding.old_shard(F.col("source"))), sharding.ADDED),
    "contamination": (lambda d: decontamination.scanned(d, d.select(F.lit("a").alias("item_id"), "text").filter("doc_id = 6")), decontamination.ADDED),
}


@pytest.mark.parametrize("case", CASES)
def test_names_in_any_case(docs, case):
    run, added = CASES[case]
    out = run(docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and set(added) <= set(out.columns)
    kept = [n for n in NAMES if n.lower() not in added]
    rows = out.collect()
    assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in kept)
    plain = run(docs.drop(*NAMES))
    assert sorted(map(repr, plain.select("doc_id", *added).collect())) == sorted(map(repr, out.select("doc_id", *added).collect()))


def test_length_follows_the_text_in_any_case(docs):
    bench = docs.filter("doc_id = 6").select(F.lit("a").alias("item_id"), F.substring_index("text", " ", 30).alias("text"))
    rows = decontamination.cleaned(docs, bench).collect()
    assert any(len(r["text"] or "") for r in rows) and all(r["N_Chars"] == len(r["text"] or "") for r in rows)


def test_pipeline_stage(spark, docs):
    import corpus_pipeline

    rows = corpus_pipeline.shard(spark, docs, "").collect()
    assert len(rows) == docs.count() and {"size", "old", "shard", "slot"} <= set(rows[0].asDict())
