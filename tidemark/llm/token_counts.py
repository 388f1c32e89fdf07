"""Token counts (operator 7) that follow edits.

Each document keeps a segment tree over its pre-tokens: a leaf is a run of pre-tokens between two places where a text may
be cut (a space or line feed before a visible character), inner nodes sum the characters and tokens of their leaves. The
leaves are kept in a table, `build_trees`, one row a document: characters and tokens of each leaf. It is the only
step that encodes whole texts. A batch of edits takes the trees of the documents it touches, finds the leaves of
each edit by descending on characters, joins them, takes the leaf before as context where the cut between them no longer
holds, re-encodes only these leaves, updates the sums above them, and gives the next version of text and tree, on
which the next batch works.

Edits are (start, end, text) in code points of the version they are made for, not overlapping. Defined results: a null text is empty; a
document without edits has the same count before and after, and its tree isn't touched; edits of documents that are not
there are ignored; rows with one doc_id and different texts are different documents (`version` tells them apart, a hash of the first
text), repeated rows are reported each; extra columns are ignored; a row without a doc_id is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import _default_pattern, encoder, vocabulary
from tidemark.llm.chunks import is_start, piece_starts
from tidemark.llm.common import attach, slices, small_batches, staged, text_bytes, text_list, texts
from tidemark.llm.secret_ledger import find_secrets

#: Pieces in a leaf.
LEAF = 16
#: What a redacted secret becomes.
MARK = "<SECRET>"
KEY = ["doc_id", "version"]
_EDITS = "array<struct<start long, end long, text string>>"
_EDIT_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
_TREE = "leaf_chars array<int>, leaf_tokens array<int>"

Edit = tuple[int, int, str]


class SegmentTree:
    """Sums of characters and tokens over the leaves of one document."""

    def __init__(self, text: str, leaf_chars: list[int], leaf_tokens: list[int]):
        ends = np.cumsum([0, *leaf_chars]).tolist()
        self.leaves = [text[a:b] for a, b in zip(ends, ends[1:])] or [""]  # noqa: B905
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + len(leaf_chars)], self.tokens[self.width : self.width + len(leaf_tokens)] = leaf_chars, leaf_tokens
        for sums in (self.chars, self.tokens):
            for n in range(self.width - 1, 0, -1):
                sums[n] = sums[2 * n] + sums[2 * n + 1]
        self.stale: set[int] = set()

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and the characters before that leaf; the last leaf with text for the end."""
        at, before, n = min(at, max(0, self.chars[1] - 1)), 0, 1
        while n < self.width:
            n *= 2
            if at - before >= self.chars[n]:
                before, n = before + self.chars[n], n + 1
        return n - self.width, before

    def _set(self, sums: list[int], leaf: int, value: int) -> None:
        n = self.width + leaf
        change = value - sums[n]
        while n:
            sums[n] += change
            n //= 2

    def replace(self, start: int, end: int, text: str) -> None:
        """Characters start..end become `text`; the leaf that holds them is stale until `count_stale`."""
        first, before = self._find(start)
        last, _ = self._find(max(start, end - 1))
        joined = "".join(self.leaves[first : last + 1])
        joined = joined[: start - before] + text + joined[end - before :]
        while first and not is_start(joined):
            first -= 1
            joined = self.leaves[first] + joined
        for leaf in range(first, last + 1):
            own = joined if leaf == first else ""
            self.leaves[leaf] = own
            self._set(self.chars, leaf, len(own))
            self.stale.add(leaf)

    def set_tokens(self, leaf: int, tokens: int) -> None:
        self._set(self.tokens, leaf, tokens)

    def kept(self) -> tuple[str, list[int], list[int]]:
        """The text, and the characters and tokens of the leaves that have any."""
        live = [i for i, x in enumerate(self.leaves) if x]
        return "".join(self.leaves), [self.chars[self.width + i] for i in live], [self.tokens[self.width + i] for i in live]


def count_stale(trees: list[SegmentTree], count: Callable[[list[str]], list[int]]) -> list[int]:
    """Encode the stale leaves of all trees at once and update the sums; the characters that were encoded, by tree."""
    at = [(t, leaf) for t in trees for leaf in sorted(t.stale)]
    for (t, leaf), n in zip(at, count([t.leaves[leaf] for t, leaf in at]) if at else [], strict=True):
        t.set_tokens(leaf, n)
    encoded = [sum(len(t.leaves[leaf]) for leaf in t.stale) for t in trees]
    for t in trees:
        t.stale.clear()
    return encoded


def repeated_lines(text: str) -> list[Edit]:
    """Later copies of a line go with the line feed before them."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            edits.append((at - 1, at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    return edits


def redactions(text: str) -> list[Edit]:
    """Secrets become MARK; of those that overlap the first."""
    edits, reach = [], 0
    for _, start, end in find_secrets(text):
        if start >= reach:
            edits.append((start, end, MARK))
            reach = end
    return edits


def first_versions(docs: DataFrame) -> DataFrame:
    """doc_id, version and text of each row of docs(doc_id, text)."""
    return texts(docs).select("doc_id", F.xxhash64("text").alias("version"), "text")


def _leaves(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The leaves of all texts, their characters, and where each text's leaves begin and the last end."""
    b, edges = text_bytes(column)
    start = piece_starts(b, edges, stops=False)
    first = np.searchsorted(start, edges)
    place = np.arange(len(start)) - np.repeat(first[:-1], np.diff(first))
    leaf = start[place % LEAF == 0]
    ends = np.append(leaf, len(b))
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    strings = pa.Array.from_buffers(pa.large_string(), len(leaf), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(b))])
    return strings, np.diff(chars[ends]), np.searchsorted(leaf, edges)


def build_trees(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, version, n_tokens, leaf_chars and leaf_tokens of each row of docs(doc_id, version, text)."""
    small_batches(docs.sparkSession)
    ranks, pattern = vocabulary(docs, ranks_path), pattern or _default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for part in slices(batches):
            leaves, chars, of_text = _leaves(part.column("text"))
            _, tokens = enc.pieces.many(leaves)
            before = np.concatenate([[0], np.cumsum(tokens)])
            lists = [pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), pa.array(x, pa.int32())) for x in (chars, tokens)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(np.diff(before[of_text]), pa.int64()), *lists], names=[*KEY, "n_tokens", "leaf_chars", "leaf_tokens"])
        enc.pieces.forget()

    return docs.select(*KEY, "text").mapInArrow(run, f"doc_id long, version long, n_tokens long, {_TREE}")


def find_edits(docs: DataFrame, edits_of: Callable[[str], list[Edit]]) -> DataFrame:
    """doc_id, version and edits of the rows of docs(doc_id, version, text) that have any."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [[{"start": s, "end": e, "text": t} for s, e, t in edits_of(x)] for x in text_list(part)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(found, _EDIT_LIST)], names=[*KEY, "edits"])

    return docs.select(*KEY, "text").mapInArrow(run, f"doc_id long, version long, edits {_EDITS}").filter(F.size("edits") > 0)


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, version, text, leaf_chars, leaf_tokens, n_tokens, n_edits and chars_encoded of the documents that edits(doc_id, version, edits) change."""
    small_batches(docs.sparkSession)
    ranks, pattern = vocabulary(docs, ranks_path), pattern or _default_pattern()
    edits = staged(edits.select(*KEY, "edits").dropDuplicates(KEY), "edits")
    touched = attach(docs.select(*KEY, "text"), edits.select(*KEY), KEY, row_bytes=40, how="left_semi")
    touched = touched.join(edits.hint("shuffle_hash"), KEY).dropDuplicates(KEY)
    own_trees = trees.join(edits.select(*KEY), KEY, "left_semi").select(*KEY, "leaf_chars", "leaf_tokens").dropDuplicates(KEY)
    names = [*KEY, "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_edits", "chars_encoded"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        count = lambda leaves: enc.pieces.many(leaves)[1].tolist()
        for part in slices(batches):
            grown = []
            for text, chars, tokens, changes in zip(text_list(part), *(part.column(c).to_pylist() for c in ("leaf_chars", "leaf_tokens", "edits")), strict=True):
                tree = SegmentTree(text, chars, tokens)
                for c in sorted(changes, key=lambda c: (c["start"], c["end"]), reverse=True):
                    tree.replace(c["start"], c["end"], c["text"] or "")
                grown.append(tree)
            encoded = count_stale(grown, count)
            n_edits = [len(x) for x in part.column("edits").to_pylist()]
            rows = list(zip(part.column("doc_id").to_pylist(), part.column("version").to_pylist(), *zip(*(t.kept() for t in grown), strict=True), [t.total for t in grown], n_edits, encoded, strict=True)) if grown else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
        enc.pieces.forget()

    joined = touched.join(own_trees.hint("shuffle_hash"), KEY)
    return joined.mapInArrow(run, f"doc_id long, version long, text string, {_TREE}, n_tokens long, n_edits long, chars_encoded long")


def next_version(docs: DataFrame, trees: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, version, text) and their trees after the edits of a staged `changed`; the texts that stay as they are don't move where that is safe."""
    tree = [*KEY, "n_tokens", "leaf_chars", "leaf_tokens"]
    keys = changed.select(*KEY)
    left = attach(docs.select(*KEY, "text"), keys, KEY, row_bytes=40, how="left_anti")
    old = attach(trees.select(*tree), keys, KEY, row_bytes=40, how="left_anti")
    return left.unionByName(changed.select(*KEY, "text")), old.unionByName(changed.select(*tree))


def recount(docs: DataFrame, passes: list[Callable[[str], list[Edit]]], ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after and chars_encoded_again of each row of docs(doc_id, text), after one batch of edits a pass."""
    first = versions = first_versions(docs)
    trees = built = staged(build_trees(first, ranks_path, pattern), "token-trees")
    done = None
    for k, edits_of in enumerate(passes):
        changed = staged(apply_edits(versions, trees, find_edits(versions, edits_of), ranks_path, pattern), "edited-documents")
        rows = changed.select(*KEY, F.lit(k).alias("pass"), "n_tokens", "n_edits", "chars_encoded")
        done = rows if done is None else done.unionByName(rows)
        if k + 1 < len(passes):
            versions, trees = next_version(versions, trees, changed)
    if done is None:
        return built.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("n_edits"), F.col("n_tokens").alias("n_tokens_after"), F.lit(0).cast("long").alias("chars_encoded_again"))
    after = done.groupBy(*KEY).agg(F.max_by("n_tokens", "pass").alias("after"), F.sum("n_edits").alias("n_edits"), F.sum("chars_encoded").alias("chars_encoded_again"))
    after = staged(after, "edit-counts")
    rows = attach(built.select(*KEY, "n_tokens"), after, KEY, row_bytes=64)
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("doc_id", "n_tokens", none("n_edits"), F.coalesce("after", "n_tokens").alias("n_tokens_after"), none("chars_encoded_again"))


#: A usual cleaning: repeated lines go, then secrets are redacted.
CLEANING = [repeated_lines, redactions]
