"""Suffix sorting by hash comparison, vectorised over many small groups.

Two suffixes are compared by their longest common extension, found by binary search
over prefix polynomial hashes, so a comparison costs the logarithm of the length.
Groups are sorted by a bottom-up mergesort whose merges place every suffix by binary
search in the neighbouring run.  Common extensions that decide anything are verified
symbol by symbol afterwards.
"""

from __future__ import annotations

import numpy as np

from fleetmatch.llm.flat import powers, prefix_hashes


class Text:
    """Symbols (uint64) with prefix hashes."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = symbols
        self.prefix = prefix_hashes(symbols)
        self.inverse = powers(len(symbols) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extensions of the suffixes at ``a`` and ``b``, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        pa, pb, ia, ib = self.prefix[a], self.prefix[b], self.inverse[a], self.inverse[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[a + middle] - pa) * ia == (self.prefix[b + middle] - pb) * ib
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def verified(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``length`` cut to what symbols really share: hashes can collide."""
        out = length.copy()
        at = np.flatnonzero(length)
        for part in np.array_split(at, max(1, int(length.sum() >> 22))):
            n = length[part]
            total = int(n.sum())
            if not total:
                continue
            first = np.cumsum(n) - n
            step = np.arange(total) - np.repeat(first, n)
            differ = self.symbols[np.repeat(a[part], n) + step] != self.symbols[np.repeat(b[part], n) + step]
            if differ.any():
                wrong = np.flatnonzero(np.add.reduceat(differ, first) > 0)
                for k in wrong:
                    out[part[k]] = int(np.argmax(differ[first[k] : first[k] + n[k]]))
        return out

    def less(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether the suffix of na symbols at a is before that of nb symbols at b."""
        n = self.common(a, b, np.minimum(na, nb))
        ended = (n == na) | (n == nb)
        last = len(self.symbols) - 1
        return np.where(ended, na < nb, self.symbols[np.minimum(a + n, last)] < self.symbols[np.minimum(b + n, last)])

    def sort(self, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes within their groups, and common extensions with the one before.

        ``group`` must not fall.  The first of a group has -1.
        """
        n = len(start)
        order = np.arange(n)
        if not n:
            return order, np.zeros(0, np.int64)
        sizes = np.bincount(group)
        first = (np.cumsum(sizes) - sizes)[group]  # of each place
        size = sizes[group]
        place = np.arange(n) - first
        width, most = 1, int(sizes.max())
        while width < most:
            at = np.flatnonzero(size > width)
            mine = place[at]
            run = mine // width
            left = run % 2 == 0
            other = np.minimum(np.where(left, run + 1, run - 1) * width, size[at])
            end = np.minimum(other + width, size[at])
            low, high = other.copy(), np.where(left, end, other + width)
            own = order[at]
            base = first[at]
            for _ in range(width.bit_length()):
                open_ = low < high
                if not open_.any():
                    break
                middle = (low + high) >> 1
                seen = order[np.where(open_, base + middle, at)]
                # equal suffixes keep the left run first
                before = np.where(left, self.less(start[seen], start[own], length[seen], length[own]), ~self.less(start[own], start[seen], length[own], length[seen]))
                low = np.where(open_ & before, middle + 1, low)
                high = np.where(open_ & ~before, middle, high)
            to = base + np.minimum(run, np.where(left, run, run - 1)) * width + (mine - run * width) + (low - other)
            moved = order.copy()
            moved[to] = own
            order = moved
            width *= 2
        shared = np.full(n, -1, np.int64)
        inner = np.flatnonzero(place > 0)
        a, b = order[inner - 1], order[inner]
        shared[inner] = self.verified(start[a], start[b], self.common(start[a], start[b], np.minimum(length[a], length[b])))
        return order, shared
