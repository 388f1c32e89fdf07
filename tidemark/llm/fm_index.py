"""An FM-index over a sequence of word ids: wavelet matrix for ranks, sampled suffix positions for locating.

All searches run for many patterns at once, one numpy step for each symbol and level.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of the sorted suffixes; `text` ends with a symbol that occurs nowhere else and is the least."""
    n = len(text)
    bits = max(1, int(sigma - 1).bit_length())
    span = max(1, 60 // bits)
    padded = np.concatenate([text.astype(np.int64), np.zeros(span, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(span):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        later = np.zeros(n, np.int64)
        later[: max(0, n - span)] = rank[span:] + 1
        key, span = rank * (n + 1) + later, span * 2


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        n = len(text)
        sa = suffix_array(text, sigma)
        bwt = text[sa - 1]
        self.n, self.bits = n, max(1, int(sigma - 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.zeros, self.split, level = [], [], bwt.astype(np.int64)
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))
        marked = sa % sample == 0
        self.marked, self.marked_before, self.samples = marked, np.cumsum(marked) - marked, sa[marked]

    def _descend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for b, zeros, split in zip(reversed(range(self.bits)), self.zeros, self.split, strict=True):
            before = zeros[row]
            row = np.where((symbol >> b) & 1, split + row - before, before)
        return row

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows before those of suffixes that start with the symbol and go on as the rows before `row`."""
        return self.first[symbol] + self._descend(symbol, row) - self.begin[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and row after the last of the suffixes that start with each row of `patterns`."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[live, column]
            lo[live], hi[live] = self._step(symbol, lo[live]), self._step(symbol, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled position."""
        out, steps = np.zeros(len(rows), np.int64), 0
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            done = self.marked[at]
            out[live[done]] = self.samples[self.marked_before[at[done]]] + steps
            live, at = live[~done], at[~done]
            symbol, row = np.zeros(len(at), np.int64), at
            for zeros, split in zip(self.zeros, self.split, strict=True):
                bit = 1 - (zeros[row + 1] - zeros[row])
                row = np.where(bit, split + row - zeros[row], zeros[row])
                symbol = symbol << 1 | bit
            at = self.first[symbol] + row - self.begin[symbol]
            steps += 1
        return out % self.n
