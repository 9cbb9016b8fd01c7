"""Texts of an Arrow batch as one flat byte array, cut into words and hashed with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Base of the second, independent hash, over symbols that are mixed with SALT first.
SECOND, SALT = np.uint64(0xC2B2AE3D27D4EB4F | 1), np.uint64(0x165667B19E3779F9)

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _tables.get(int(base))
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for step in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            a = np.full(size, step, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        held = _tables[int(base)] = (out[0], out[1])
    return held[0][:n], held[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output (a bijection of 64 bits)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(symbols: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hashes of all prefixes of uint64 ``symbols``, one longer than it."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    power, _ = powers(len(symbols), base)
    np.cumsum(symbols * power, out=out[1:])
    return out


def second_hashes(symbols: np.ndarray) -> np.ndarray:
    """Prefix hashes that are independent of ``prefix_hashes``; for ``range_hashes`` with SECOND."""
    return prefix_hashes(mix(symbols ^ SALT), SECOND)


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hashes of symbols[start:end] that depend on their content alone."""
    _, inverse = powers(len(prefix), base)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256 booleans, true for bytes that belong to words."""
    word = np.ones(256, bool)
    for a, b in ranges:
        word[a : b + 1] = False
    return word


#: Words of ``[^\x20\x09-\x0D]+``, and of letters, digits and all that is not ASCII.
SPACED = separators([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins (one more entry than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``most`` bytes of text, each with its ``texts``."""
    for batch in batches:
        data, offsets = texts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes, hashes, and where each text's words begin (one more entry than texts)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = LOWER[data] if lower else data
    inside = word[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(last) + 1
    prefix = prefix_hashes(data.astype(np.uint64) + np.uint64(1))
    return starts, ends, range_hashes(prefix, starts, ends), np.searchsorted(starts, offsets)


def added(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns appended, in place of any of the same names."""
    keep = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *columns.values()], names=[*keep, *columns])
