"""Exact removal of repeated passages: suffix sorting over bytes, anchored blocks over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmatch.llm import flat
from fleetmatch.llm.repeats import Spec, byte_symbols, merged, stretches, word_symbols
from fleetmatch.llm.store import fresh, numbered, table

BYTES = Spec(window=200, gram=32, earlier=False, symbols=byte_symbols, width=1)
#: Fixed reference blocks of ten words, probed by every rolling window.
WORDS = Spec(window=20, gram=10, earlier=True, symbols=word_symbols, width=6, blocks=True)


def _mapped(docs: DataFrame, spec: Spec, id_: str, names: str, make) -> DataFrame:
    """``docs`` with what ``make`` does with each text and its repeated stretches, in columns ``names``."""
    rows, row, _ = numbered(docs, id_, make.text)
    held = fresh(rows, "_parts")
    parts = stretches(rows, spec, row, make.text).select(F.col("row").alias(row), F.col("parts").alias(held))
    joined = rows.join(parts, row, "left").drop(row)
    fields = T._parse_datatype_string(names).fields
    base = docs.drop(*[f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])
    kept = base.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in flat.chunks(batches, make.text):
            parts = [merged(p) for p in batch.column(held).to_pylist()]
            raw = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(batch.num_rows)]
            yield flat.added(batch.select(kept), make(raw, parts))

    return joined.mapInArrow(apply, schema)


class _Bytes:
    def __init__(self, text: str) -> None:
        self.text = text

    def __call__(self, raw: list[bytes], parts: list[list[tuple[int, int]]]) -> dict[str, pa.Array]:
        kept = []
        for whole, cuts in zip(raw, parts, strict=True):
            ends = [0, *[b for _, b in cuts]]
            starts = [*[a for a, _ in cuts], len(whole)]
            kept.append(whole if not cuts else b"".join(whole[a:b] for a, b in zip(ends, starts, strict=True)))
        n = [len(x) for x in raw]
        return {
            "n_bytes": pa.array(n, pa.int64()),
            "n_removed": pa.array([a - len(b) for a, b in zip(n, kept, strict=True)], pa.int64()),
            "n_spans": pa.array([len(p) for p in parts], pa.int64()),
            "kept": pa.array(kept, pa.binary()),
        }


class _Words:
    def __init__(self, text: str) -> None:
        self.text = text

    def __call__(self, raw: list[bytes], parts: list[list[tuple[int, int]]]) -> dict[str, pa.Array]:
        n, removed, kept = [], [], []
        for whole, cuts in zip(raw, parts, strict=True):
            words = whole.split()  # at the six ASCII separators
            n.append(len(words))
            for a, b in reversed(cuts):
                del words[a:b]
            removed.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())}


def without_repeated_bytes(docs: DataFrame, id_: str = "doc_id", text: str = "text", spec: Spec = BYTES) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes, n_removed, n_spans`` (long) and ``kept`` (binary).

    A byte goes if it lies in a window of ``spec.window`` bytes that also starts anywhere
    else, in the same text or another; all copies go.  Null texts are empty; texts
    shorter than a window are kept, and longer ones are treated whole whatever their
    length.  Repeated rows, repeated and null ids are copies of one another.  Columns of
    the added names are replaced, others stay.
    """
    return _mapped(docs, spec, id_, "n_bytes long, n_removed long, n_spans long, kept binary", _Bytes(text))


def without_repeated_words(docs: DataFrame, id_: str = "doc_id", text: str = "text", spec: Spec = WORDS) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_removed`` (long) and ``kept`` (words joined by one space).

    A word goes if it lies in a window of ``spec.window`` words that also starts earlier: in
    a row with a smaller id, or earlier in the same row; the first copy stays.  Rows that
    share an id or have none come in the order of a hash of their texts.  Null and empty
    texts have no words; texts of any length are treated whole.  Columns of the added names
    are replaced, others stay.
    """
    return _mapped(docs, spec, id_, "n_words long, n_removed long, kept string", _Words(text))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
