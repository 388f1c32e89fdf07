"""Texts cut into pieces that can be tokenised alone, whose ids are remembered by the hash of their bytes.

The pre-token pattern never lets a token reach over a single white-space character that stands before a visible one:
that character starts the next token, or is one itself. A text may therefore be cut before every space or line
feed that a visible character follows, and the pieces' ids be strung together. A full stop or comma after an ASCII letter
and before such a cut is a token of its own, so it is a piece too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from tidemark.llm.common import text_bytes
from tidemark.llm.hashing import run_hashes

#: Bytes of texts that are cut at once, about.
_BLOCK = 1 << 20
# Kinds of bytes, a bit each: where a text may be cut, white space, ASCII letters, stops, first bytes of all other white space.
_CUT, _BLANK, _LETTER, _STOP, _WIDE = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
for _bit, _own in ((_CUT, (10, 32)), (_BLANK, (9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 32)), (_LETTER, (*range(65, 91), *range(97, 123))), (_STOP, (0x2C, 0x2E)), (_WIDE, (0xC2, 0xE1, 0xE2, 0xE3))):
    _KIND[list(_own)] |= _bit


def piece_starts(b: np.ndarray, edges: np.ndarray, stops: bool = True) -> np.ndarray:
    """First byte of each piece of the texts that lie between `edges` in b; without stops only those that what stands before can't change."""
    n = len(b)
    kind = np.zeros(n + 1, np.uint8)
    np.take(_KIND, b, out=kind[:-1])
    kind[-1] = _BLANK
    wide = np.flatnonzero(kind & _WIDE)
    if len(wide):
        ahead = np.concatenate([b, np.zeros(2, np.uint8)])
        x, y, z = ahead[wide], ahead[wide + 1], ahead[wide + 2]
        two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        general = (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
        three = general | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
        kind[wide[two | three]] = _BLANK
    after = kind[1:].copy()
    after[edges[1:][edges[1:] > 0] - 1] = _BLANK  # what follows the end of a text is another text
    starts = np.append((kind[:-1] & _CUT) > (after & _BLANK), False)
    starts[edges] = True
    stop = np.flatnonzero(kind & _STOP) if stops else wide[:0]
    stop = stop[stop > 0]
    starts[stop[((kind[stop - 1] & _LETTER) > 0) & starts[stop + 1]]] = True
    return np.flatnonzero(starts[:-1])


class PieceIds:
    """The ids of texts, piece by piece. A table of open addressing holds the entry of each piece by a 64-bit hash of its bytes; it is
    emptied when it holds `most` pieces. Pieces of over `longest` bytes aren't kept. encode: the ids of a pre-token, as bytes;
    encode_words: of many words with a space before each, strung together, and how many each has."""

    def __init__(self, encode: Callable[[str], bytes], encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], pattern: str, most: int = 1 << 21, longest: int = 64, dtype: str = "<u4"):
        self.encode, self.encode_words, self.find = encode, encode_words, regex.compile(pattern).findall
        self.most, self.longest, self.dtype = most, longest, np.dtype(dtype)
        self.forget()

    def forget(self) -> None:
        """Give the memory back, for a worker that goes on to other stages."""
        self.keys, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, self.dtype)
        self.bare: dict[str, bytes] = {}
        self._slot(12)

    def _slot(self, bits: int) -> None:
        """A table of 2 ** bits slots with all entries."""
        self.bits = bits
        self.slot_key, self.slot_entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self._place(self.keys, np.arange(len(self.keys), dtype=np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        out, left, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slots(keys)
        while len(left):
            held = self.slot_key[slot]
            hit = held == keys[left]
            out[left[hit]] = self.slot_entry[slot[hit]]
            further = ~hit & (held != 0)
            left, slot = left[further], (slot[further] + 1) & ((1 << self.bits) - 1)
        return out

    def _place(self, keys: np.ndarray, entry: np.ndarray) -> None:
        """Different keys that aren't there."""
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.slot_key[slot] == 0
            self.slot_key[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            won = self.slot_key[slot] == keys[left]
            self.slot_entry[slot[won]] = entry[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def pre_token(self, text: str) -> bytes:
        ids = self.bare.get(text)
        if ids is None:
            ids = self.encode(text)
            if len(text) <= self.longest:
                if len(self.bare) > 1 << 16:
                    self.bare.clear()
                self.bare[text] = ids
        return ids

    def chunk(self, text: str) -> bytes:
        """The ids of a text, pre-token by pre-token."""
        return b"".join(map(self.pre_token, self.find(text)))

    def _values(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the pieces in an order that has words first, strung together; how many each has; that order."""
        plain = np.fromiter((p[:1] == " " and p[1:].isalpha() for p in pieces), bool, len(pieces))
        order = np.argsort(~plain, kind="stable")
        n_words = int(plain.sum())
        words, n = self.encode_words([pieces[i][1:] for i in order[:n_words].tolist()]) if n_words else (np.zeros(0, self.dtype), np.zeros(0, np.int32))
        rest = [self.chunk(pieces[i]) for i in order[n_words:].tolist()]
        sizes = np.fromiter(map(len, rest), np.int32, len(rest)) // self.dtype.itemsize
        return np.concatenate([words, np.frombuffer(b"".join(rest), self.dtype)]), np.concatenate([n, sizes]), order

    def _block(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, strung together, and how many each has."""
        long = end - start > self.longest
        keys = np.maximum(run_hashes(b, start, np.where(long, start, end)), np.uint64(1))
        entry = np.where(long, -1, self._find(keys))
        new, at = np.unique(keys[(entry < 0) & ~long], return_index=True)
        if len(self.size) and len(self.size) + len(new) > self.most:
            bare = self.bare
            self.forget()
            self.bare = bare
            return self._block(b, start, end)
        first_new, missing, longs = len(self.size), np.flatnonzero((entry < 0) & ~long)[at], np.flatnonzero(long)
        raw = b.tobytes()
        piece = lambda i: [raw[x:y].decode() for x, y in zip(start[i].tolist(), end[i].tolist(), strict=True)]
        ids, sizes, order = self._values(piece(missing))
        more = [self.chunk(p) for p in piece(longs)]
        more_sizes = np.fromiter(map(len, more), np.int32, len(more)) // self.dtype.itemsize
        size = np.concatenate([self.size, sizes, more_sizes])
        pool = np.concatenate([self.pool, ids, np.frombuffer(b"".join(more), self.dtype)])
        of_new = np.empty(len(new), np.int32)
        of_new[order] = first_new + np.arange(len(new), dtype=np.int32)
        if len(new) <= self.most:
            of_entry = np.empty(len(new), np.uint64)
            of_entry[of_new - first_new] = new
            self.keys = np.concatenate([self.keys, of_entry])
            if 2 * len(self.keys) > 1 << self.bits:
                self._slot((4 * len(self.keys) - 1).bit_length())
            else:
                self._place(new, of_new)
            self.size, self.pool = size[: first_new + len(new)], pool[: len(self.pool) + len(ids)]
        open_ = (entry < 0) & ~long
        entry[open_] = of_new[np.searchsorted(new, keys[open_])]
        entry[longs] = first_new + len(new) + np.arange(len(longs))
        n = size[entry]
        total = np.cumsum(n) - n
        place = np.repeat(((np.cumsum(size) - size)[entry] - total).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        return pool[place], n

    def many(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, strung together, and how many each has; null is empty."""
        b, edges = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        start = piece_starts(b, edges)
        end = np.append(start[1:], len(b)) if len(start) else start
        cuts = np.flatnonzero(np.diff(start // _BLOCK)) + 1
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int32)]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)], strict=True):
            if hi > lo:
                a, z = int(start[lo]), int(end[hi - 1])
                found, n = self._block(b[a:z], start[lo:hi] - a, end[lo:hi] - a)
                ids.append(found)
                sizes.append(n)
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        return np.concatenate(ids), np.diff(before[np.searchsorted(start, edges)])


def is_start(text: str) -> bool:
    """Whether a text can be cut off from whatever stands before it."""
    return len(text) > 1 and text[0] in " \n" and not (text[1].isspace() or text[1] in "\x1c\x1d\x1e\x1f\x85")
