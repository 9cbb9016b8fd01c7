"""The pipeline stage by stage against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from fleetmatch.llm.mixing import water_filled
from fleetmatch.llm.sharding import ADDED
from fleetmatch.llm.store import written
from tests.conftest import SF
from tests.llm.conftest import documents, untouched
from tests.llm.test_dedup import brute_near
from tests.llm.test_text import brute_hits


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        kept[name] = [r.asDict() for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept["toxicity"]}
    assert sum(t == 1 and i in left for i, t in labels.items()) < sum(t == 1 for t in labels.values()) / 2
    assert sum(t == 0 and i in left for i, t in labels.items()) >= 0.97 * sum(t == 0 for t in labels.values())
    before = sorted(kept["toxicity"], key=lambda r: r["doc_id"])
    want = {before[i]["doc_id"] for i, (_, _, keep) in brute_near([r["text"] for r in before]).items() if keep}
    assert {r["doc_id"] for r in kept["near_dedup"]} == want
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"]: r["text"] for r in kept["decontamination"]}
    for r in kept["near_dedup"]:
        n, hit, _ = brute_hits(r["text"], items)
        if not hit:
            assert clean[r["doc_id"]] == r["text"]
        else:
            assert r["doc_id"] not in clean or not brute_hits(clean[r["doc_id"]], items)[1]
    size = lambda text: len((text or "").encode().split())
    sizes: dict = {}
    for r in kept["decontamination"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    targets = {r["source"]: r["target"] for r in water_filled(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    taken: dict = {}
    for r in kept["mixing"]:
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
    for s, target in targets.items():
        largest = max(size(r["text"]) for r in kept["decontamination"] if r["source"] == s)
        assert abs(taken.get(s, 0) - target) <= max(0.1 * target, largest / 2)
    assert len(kept["sharding"]) == len(kept["mixing"])
    assert len({(r["shard"], r["slot"]) for r in kept["sharding"]}) == len(kept["sharding"])


def test_run_has_the_rows_of_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    assert out.count() == out.select(F.struct("shard", "slot")).distinct().count() > 0


def test_stages_on_edge_tables(spark, corpus):
    """Nulls, empty and long texts, repeated rows, null ids and columns of every internal name; then no rows at all."""
    docs = documents(spark, [*corpus, None, ""])
    more = docs.filter("doc_id < 12").unionByName(docs.filter("doc_id = 40").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    docs = written(docs.unionByName(more))
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        rows = out.collect()
        last = name == corpus_pipeline.STAGES[-1][0]
        assert rows and (last or out.columns == docs.columns)
        assert untouched([r for r in rows if r["doc_id"] is not None], ADDED if last else ())
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == out.columns and empty.count() == 0
        docs = out
    assert docs.count() == docs.select("shard", "slot").distinct().count()
