"""Benchmark decontamination (operator 4): an FM-index for each training shard.

A shard is a slice of the documents. Its words become ids of the benchmark's vocabulary; a word that no benchmark item has
can be in no match, so it only separates, and runs shorter than the shortest window are left out. The index of what is
left is made once and searched backwards for all windows of the benchmark, by ranks in a wavelet matrix;
occurrences are located by sampled suffix positions; the words they cover merge into spans.

The benchmark is the stated query set. It is read in blocks of bounded size, each a broadcast of its own, and all
blocks are searched in every shard before the next shard is indexed; the result doesn't depend on their number.

Defined results: words are maximal runs of ASCII letters and digits and all other non-ASCII characters, A-Z
lower-cased, compared by 64-bit hashes; a null text or item has no words; an item without words is in no document; items with
one item_id are one item, and so are those with a null id; an item shorter than WINDOW is one window; each row of docs has its row in the
result, repeated ones too; extra columns are ignored; a row without a doc_id is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import slices, small_batches, text_bytes, texts
from tidemark.llm.fm_index import FMIndex
from tidemark.llm.hashing import join_hashes, run_hashes, runs

WINDOW = 10
#: Benchmark text in a block.
BLOCK_CHARS = 16 << 20
SHARD_BYTES = 3 << 20
_WORD_BYTES = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_IN_WORD = np.zeros(256, bool)
_IN_WORD[_WORD_BYTES] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PAIR = pa.struct([("start", pa.int64()), ("end", pa.int64())])
SEPARATOR, FIRST_WORD = 1, 2


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and how many each text has."""
    b, edges = text_bytes(column)
    start, end = runs(_IN_WORD[b], edges)
    return run_hashes(_LOWER[b], start, end), np.diff(np.searchsorted(start, edges))


@dataclass
class Block:
    """The different windows of some benchmark items, by length: where each begins among the words, and its items."""

    words: np.ndarray
    ids: pa.Array
    starts: dict[int, np.ndarray]
    first_item: dict[int, np.ndarray]
    items: dict[int, np.ndarray]

    def windows(self, size: int) -> np.ndarray:
        return self.words[self.starts[size][:, None] + np.arange(size)]


def block_of(vocabulary: np.ndarray, texts: pa.Array, ids: pa.Array) -> Block:
    hashes, counts = hashed_words(texts)
    words = np.searchsorted(vocabulary, hashes).astype(np.int32) + FIRST_WORD
    coded = ids.dictionary_encode(null_encoding="encode")
    item = np.repeat(coded.indices.to_numpy(zero_copy_only=False), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words up to the end of the item
    size = np.minimum(WINDOW, np.repeat(counts, counts))
    block = Block(words, coded.dictionary, {}, {}, {})
    for n in np.unique(size).tolist():
        at = np.flatnonzero((size == n) & (left >= n))
        _, first, window = np.unique(join_hashes(hashes, n)[at], return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([window, item[at]]), axis=1)
        block.starts[n], block.items[n] = at[first], pairs[1]
        block.first_item[n] = np.searchsorted(pairs[0], np.arange(len(first) + 1))
    return block


def _expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of size[i] numbers, for all i."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def search_shard(ids: np.ndarray, doc_end: np.ndarray, symbols: int, blocks: list[Block]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which of the shard's words are hit, and for each block the pairs (document, item) that occur. ids: the words of the
    documents, strung together with one separator after each, where doc_end says; symbols: how many ids there are."""
    edge = np.zeros(len(ids) + 1, np.int64)
    none = np.zeros((2, 0), np.int64)
    shortest = min((n for b in blocks for n in b.starts), default=0)
    known = np.concatenate([[False], ids >= FIRST_WORD, [False]])
    turns = np.flatnonzero(known[1:] != known[:-1])
    run, length = turns[::2], turns[1::2] - turns[::2]
    run, length = run[length >= shortest], length[length >= shortest]
    if not shortest or not len(run):
        return edge[:-1] > 0, [none for _ in blocks]
    place = _expand(run, length + 1)  # each run and the separator behind it
    index = FMIndex(np.concatenate([ids[place], [0]]), symbols)
    out = []
    for block in blocks:
        found = [none]
        for size in block.starts:
            lo, hi = index.search(block.windows(size))
            at = np.flatnonzero(hi > lo)
            if not len(at):
                continue
            position = place[index.locate(_expand(lo[at], (hi - lo)[at]))]
            window = np.repeat(at, (hi - lo)[at])
            np.add.at(edge, position, 1)
            np.add.at(edge, position + size, -1)
            first = block.first_item[size]
            per_hit = first[window + 1] - first[window]
            document = np.repeat(np.searchsorted(doc_end, position, side="right"), per_hit)
            found.append(np.stack([document, block.items[size][_expand(first[window], per_hit)]]))
        out.append(np.unique(np.concatenate(found, axis=1), axis=1))
    return np.cumsum(edge[:-1]) > 0, out


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """values as n lists; of: the list of each, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def _search(vocabulary, blocks, item_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SHARD_BYTES):
            hashes, counts = hashed_words(part.column("text"))
            known = vocabulary.value
            at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            doc_end = np.cumsum(counts + 1)
            ids = np.full(len(hashes) + len(counts), SEPARATOR, np.int64)
            is_word = np.ones(len(ids), bool)
            is_word[doc_end - 1] = False
            if len(known):
                ids[is_word] = np.where(known[at] == hashes, at + FIRST_WORD, SEPARATOR)
            own = [b.value for b in blocks]
            hit, pairs = search_shard(ids, doc_end, len(known) + FIRST_WORD, own)
            turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            doc = np.searchsorted(doc_end, turns[::2], side="right")
            begin = doc_end[doc] - counts[doc] - 1
            spans = pa.StructArray.from_arrays([pa.array(turns[::2] - begin), pa.array(turns[1::2] - begin)], fields=list(_PAIR))
            holders = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in pairs)])
            items = pa.concat_arrays([pa.array([], item_kind), *(b.ids.take(pa.array(p[1])).cast(item_kind) for b, p in zip(own, pairs, strict=True))])
            order = np.argsort(holders, kind="stable")
            n = part.num_rows
            columns = [part.column("doc_id"), part.column("body"), pa.array(counts, pa.int64()), _lists(doc, n, spans), _lists(holders[order], n, items.take(pa.array(order)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "body", "n_words", "spans", "items"])

    return run


def _word_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashed_words(part.column("text"))[0]).view(np.int64))], names=["word"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, body (hash of the text), n_words, spans of hit words (start, end) and the item_ids that occur, for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", "text")
    words = items.select("text").mapInArrow(_word_list, "word long").distinct().toPandas()["word"]  # of the stated query set
    vocabulary = np.sort(words.to_numpy(np.int64).view(np.uint64))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    blocks = []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow().combine_chunks()
        one = lambda name: pa.concat_arrays(rows.column(name).chunks) if rows.num_rows else pa.array([], rows.schema.field(name).type)  # noqa: B023, E731
        blocks.append(spark.sparkContext.broadcast(block_of(vocabulary, one("text"), one("item_id"))))
    kind = items.schema["item_id"].dataType
    ddl = f"doc_id long, body long, n_words long, spans array<struct<start:long,end:long>>, items array<{kind.simpleString()}>"
    run = _search(spark.sparkContext.broadcast(vocabulary), blocks, to_arrow_type(kind))
    return texts(docs).withColumn("body", F.xxhash64("text")).mapInArrow(run, ddl)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without its words start..end of each span and what stands between them."""
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : words[start][0]])
        at = words[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()
