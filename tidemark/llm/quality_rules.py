"""Quality rules (operator 10): rules on each document, and lines that too many documents of a host share.

Method: cross-document line frequency. Lines are normalised (lower case, runs of white space as one space, digits as 0) and
hashed together with their host. The distinct documents of each hashed line are counted. A line in more than `max_docs`
documents of its host is removed from all of them, with `keep_first` from all but the one with the smallest doc_id, so that
one of many copies stays whole. A document that keeps less than `min_left` of its words is depleted and rejected.
`lost_lines` names the lines that go, `quality_rules` gives the texts without them.

Defined results: a null or empty text has zero words and fails the base rules; a null host is a host of its own; a document
is a doc_id: rows that share one count once for a line, and each row is reported, repeated ones too; extra columns are ignored; a row
without a doc_id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, body_of, slices, small_batches, staged, text_list, texts

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_DDL = "doc_id long, body long, " + ", ".join(f"{c} long" for c in _STATS) + ", removed_words long, cleaned string"


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each document, the words that lie in windows of WINDOW words found twice or more in it."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    if total < WINDOW:
        return np.zeros(len(words), np.int64)
    h = np.fromiter((hash(w) for doc in words for w in doc), np.int64, total).astype(np.uint64)
    doc = np.repeat(np.arange(len(words)), sizes)
    n = total - WINDOW + 1
    key = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        key = (key ^ h[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    starts = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = starts[np.argsort(key[starts], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(words))


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def without_lines(text: str, spans: list[tuple[int, int]]) -> str:
    """text without its lines start..end of each span."""
    gone = {i for start, end in spans for i in range(start, end)}
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = text_list(part)
        words = [t.encode().split() for t in texts]
        lost = part.column("spans").to_pylist()
        cleaned = [without_lines(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts, lost, strict=True)]
        columns = (
            [len(w) for w in words],
            [len(t) - sum(map(t.count, SPACES)) for t in texts],
            [sum(map(t.count, SYMBOLS)) for t in texts],
            [dup_lines(t) for t in texts],
            repeated_words(words),
            [len(w) - len(c.encode().split()) if s else 0 for w, c, s in zip(words, cleaned, lost, strict=True)],
        )
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("body"), *(pa.array(c, pa.int64()) for c in columns), pa.array(cleaned, pa.string())], names=[x.split(" ")[0] for x in _DDL.split(", ")])


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[ \t\x0B\f\r]+", " "), "[0-9]", "0"))


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """One row for each line with a word of each document: doc_id, body, place (0-based line) and line (hash with host)."""
    line = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "raw")
    lines = texts(docs, F.col(host).alias("host")).select("doc_id", "host", body_of(), line)
    lines = lines.select("doc_id", "body", "host", "place", _normalised(F.col("raw")).alias("norm")).filter("norm != ''")
    return lines.select("doc_id", "body", "place", F.xxhash64("host", "norm").alias("line"))


def lost_lines(docs: DataFrame, host: str = "source", max_docs: int = 50, keep_first: bool = True) -> DataFrame:
    """doc_id, body and place (0-based line) of the lines that the line rule removes."""
    lines = staged(host_lines(docs, host), "host-lines")
    of_line = lines.select("line", "doc_id").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
    frequent = staged(of_line.filter(F.col("n_docs") > max_docs), "frequent-lines")
    lost = attach(lines, frequent, "line", row_bytes=40, how="inner")
    return (lost.filter(F.col("doc_id") != F.col("first_doc")) if keep_first else lost).select("doc_id", "body", "place")


def removed_spans(lost: DataFrame) -> DataFrame:
    """doc_id, body and spans (start, end: line numbers, sorted) of the rows that lose lines."""
    span = F.struct(F.col("place").alias("start"), (F.col("place") + 1).alias("end"))
    return lost.groupBy("doc_id", "body").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = 50, min_left: float = 0.3, keep_first: bool = True, spans: DataFrame | None = None) -> DataFrame:
    """doc_id, body (hash of the text), the counts, removed_words, cleaned (the text without the removed lines), base_failed and kept of each row of docs(doc_id, text, host).

    spans: the staged `removed_spans` of docs, if known.
    """
    small_batches(docs.sparkSession)
    spans = staged(removed_spans(lost_lines(docs, host, max_docs, keep_first)), "removed-lines") if spans is None else spans
    width = 64 + 16 * int(spans.agg(F.max(F.size("spans"))).first()[0] or 0)
    rows = attach(texts(docs).select("doc_id", body_of(), "text"), spans, ["doc_id", "body"], row_bytes=width)
    found = rows.select("doc_id", "body", "text", "spans").mapInArrow(_measure, _DDL)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < min_left * F.col("n_words")
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
