"""Stable 64-bit hashes of words, word shingles and byte windows, for whole slices of text at once."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that are hashed at once; longer runs are hashed one by one.
_BLOCK, _LONG = 1 << 19, 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_BLOCK + _LONG, x)])) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def run_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes b[start:end]; starts ascend."""
    out = np.empty(len(start), np.uint64)
    for i in np.flatnonzero(end - start > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    power, inverse = _tables()
    short = np.flatnonzero(end - start <= _LONG)
    for own in np.split(short, np.flatnonzero(np.diff(start[short] // _BLOCK)) + 1) if len(short) else []:
        a = int(start[own[0]])
        x, y = start[own] - a, end[own] - a
        raw = b[a : a + int(y.max())]
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
        out[own] = mix((total[y] - total[x]) * inverse[x] + (y - x).astype(np.uint64))
    return out


def runs(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last place of each run of `inside`; no run reaches over one of the edges."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[edges] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.append(inside[1:], False) if len(inside) else inside
    return start, np.flatnonzero(inside & (~after | cut[1:])) + 1


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each run of bytes that are not ASCII white space."""
    b = np.frombuffer(raw, np.uint8)
    start, end = runs(~_SPACE[b], np.zeros(1, np.int64))
    return start, run_hashes(b, start, end)


def _multiplier(k: int, size: int) -> np.uint64:
    return mix(np.array([(k + 1) * 0x9E3779B97F4A7C15 + size & (1 << 64) - 1], np.uint64))[0] | np.uint64(1)


def join_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix(sum((words[k : k + n] * _multiplier(k, size) for k in range(size)), np.zeros(n, np.uint64)))


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """The distinct hashes, ascending as signed numbers, of each text's runs of `size` words, A-Z lower-cased.

    A text of fewer words is one shingle; a text without words has none.
    """
    raw = [t.encode().lower() for t in texts]
    start, words = word_hashes(b" ".join(raw))
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    edge = np.searchsorted(start, bounds)
    every = join_hashes(words, size).view(np.int64)
    out = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(every[lo : hi - size + 1]))
        else:
            out.append(join_hashes(words[lo:hi], hi - lo).view(np.int64) if hi > lo else np.zeros(0, np.int64))
    return out
