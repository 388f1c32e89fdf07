"""Suffix-array dedup (operator 3): repeated byte strings, by bucket-pointer refinement.

Every byte that lies in a string of LENGTH bytes that also starts earlier in the corpus (smaller
doc_id, or the same document and an earlier start) is removed. Suffixes are sorted into buckets only as far as that
question needs:

1. Initial buckets. Within a text, the identifier of a q-gram at i is made from those of the halves at i and
   i + q/2. Of the q-grams in each window of LENGTH bytes the one with the least identifier is sampled, so two equal
   windows sample the same q-gram at the same distance, and only about one suffix in 35 is sorted. Each
   run of windows with the same sample is one suffix row of that q-gram's bucket.
2. Refinement. Buckets of one row are dropped. The others are sorted on bucket identifiers of later offsets: those of
   the LENGTH-grams at the first and last window of the run, which are in turn refined from 64-grams. A sub-bucket's
   first row is its pointer; the windows of all later rows are repeats. Equal rows of one block of text are sent as one.
3. Recursion. Where a bucket still holds different sub-buckets, their first rows (the ends of repeated
   passages) are refined again with the same identifiers: first by the HALF-grams to the right and to the left of the
   sample, one of which every window holds; sides that are alone are dropped. What is left is refined window by window.

Work and shuffles grow with the sampled rows; a group of copies costs its size. Identifiers have 64 bits and every
comparison uses two of them.

Defined results: texts are UTF-8 bytes, null is empty; texts of fewer than LENGTH bytes lose nothing; a document is a
doc_id and its text, so repeated rows count as one and rows that share a doc_id but not the text are documents of their own, in the order of
a hash of their texts; extra columns are ignored; a row without a doc_id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, body_of, slices, small_batches, staged, text_list, texts
from tidemark.llm.hashing import mix

LENGTH = 100
Q = 32
SPAN = LENGTH - Q + 1  # q-grams in a window
#: A window that starts up to LEFT bytes before its sample holds the HALF bytes from the sample on; one that starts LEFT or
#: more before it holds the HALF bytes that end with the sample.
HALF, LEFT = 66, 34
#: Longer texts are worked on in blocks of so many window starts.
BLOCK = 2 << 20
_LEFT, _RIGHT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def refined(ids: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of the buckets refined by the buckets `offset` later."""
    out = ids[:-offset] * _LEFT + ids[offset:] * _RIGHT
    out ^= out >> np.uint64(32)
    return out * _LEFT


def gram_ids(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket identifiers of the Q-gram, the HALF-gram and the LENGTH-gram at each byte."""
    ids = mix(np.arange(1, 257, dtype=np.uint64))[raw]
    for offset in (1, 2, 4, 8, 16):
        ids = refined(ids, offset)
    wide = refined(ids, 32)
    return ids, refined(wide, HALF - 64), refined(wide, LENGTH - 64)


def pack(start: np.ndarray, more: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """One number for a run of windows: its first, how many follow, and how far behind the first the sample is."""
    return start << 14 | more << 7 | sample


def unpack(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans >> 14, spans >> 7 & 127, spans & 127


def sampled_rows(raw: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, windows that follow, distance of the sample, bucket and refined identifier of each run of valid windows with the same sampled Q-gram."""
    q, _, whole = gram_ids(raw)
    # the least identifier wins, the leftmost of equals: both are in one number
    least = (mix(q) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(q), dtype=np.uint64)
    for offset in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-offset], least[offset:])
    least = np.minimum(least[: len(whole)], least[SPAN - 64 :][: len(whole)])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    shape = ((last - first) * 128 + at[first] - first).astype(np.uint64)
    content = mix(whole[first] * _LEFT + whole[last] * _RIGHT + mix(shape))
    return first, last - first, at[first] - first, q[at[first]], content


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, whether a window of one text starts there, number of the text, its byte offset), texts strung together up to BLOCK bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        raw = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        lengths = np.array([len(t) for _, _, t in held])
        text = np.repeat([i for i, _, _ in held], lengths)
        start = np.cumsum(lengths) - lengths
        offset = np.arange(len(raw)) - np.repeat(start - np.array([o for _, o, _ in held]), lengths)
        end = np.repeat(start + lengths, lengths)
        valid = (np.arange(len(raw)) + LENGTH <= end)[: max(0, len(raw) - LENGTH + 1)]
        return raw, valid, text, offset

    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for o in range(0, len(t) - LENGTH + 1, BLOCK):
            piece = t[o : o + BLOCK + LENGTH - 1]
            if size and size + len(piece) > BLOCK:
                yield joined()
                held, size = [], 0
            held.append((i, o, piece))
            size += len(piece)
    if held:
        yield joined()


_PLACE = pa.struct([("doc_id", pa.int64()), ("span", pa.int64())])
_ROWS = pa.schema([("bucket", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("span", pa.int64()), ("later", pa.list_(_PLACE))])
_ROWS_DDL = "bucket long, content long, doc_id long, span long, later array<struct<doc_id long, span long>>"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix rows; of rows of a block with the same bucket and content the first, with the places of the others in `later`."""
    for part in slices(batches, limit=BLOCK):
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        for raw, valid, text, offset in blocks([t.encode() for t in text_list(part)]):
            first, more, sample, bucket, content = sampled_rows(raw, valid)
            doc, span = ids[text[first]].astype(np.int64), pack(offset[first], more, sample)
            order = np.lexsort((span, doc, content, bucket))
            bucket, content, doc, span = bucket[order], content[order], doc[order], span[order]
            fresh = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (content[1:] != content[:-1])])
            tied = np.concatenate([[False], ~fresh[1:] & (doc[1:] == doc[:-1]) & (span[1:] == span[:-1])])
            head, rest = np.flatnonzero(fresh), np.flatnonzero(~fresh & ~tied)
            places = pa.StructArray.from_arrays([pa.array(doc[rest]), pa.array(span[rest])], fields=list(_PLACE))
            later = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, np.append(head, len(order))), pa.int32()), places)
            columns = (bucket[head].view(np.int64), content[head].view(np.int64), doc[head], span[head])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), later], schema=_ROWS)


def _in_blocks(part: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, tuple[np.ndarray, ...]]]:
    """(doc_id, first byte in the block, offset in the text, unpacked spans, identifiers) of each piece of text in each block; spans that start outside the piece are left out."""
    ids = part.column("doc_id").to_pylist()
    of_text = [np.array(s or (), np.int64) for s in part.column("spans").to_pylist()]
    for raw, _, text, offset in blocks([t.encode() for t in text_list(part)]):
        grams = gram_ids(raw)
        lo = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        for a, b in zip(lo.tolist(), [*lo[1:].tolist(), len(text)], strict=True):
            spans, at = of_text[text[a]], int(offset[a])
            start = spans >> 14
            yield ids[text[a]], a, at, spans[(start >= at) & (start < at + b - a - LENGTH + 1)], grams


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The HALF-grams on either side of the samples of each document's open spans, with the part of the span that each stands for."""
    for part in slices(batches):
        out: list[list[np.ndarray]] = [[], [], [], []]
        for doc, a, at, spans, (q, half, _) in _in_blocks(part):
            start, more, sample = unpack(spans)
            p = a + start - at + sample
            right, left = more >= sample - LEFT, sample >= LEFT
            skip = np.maximum(0, sample - LEFT)
            rows = ((half[p[right]], q[p[right]], pack(start + skip, more - skip, sample - skip)[right]), (half[p[left] - LEFT], q[p[left]], pack(start, np.minimum(more, sample - LEFT), sample)[left]))
            for gram, check, span in rows:
                for column, values in zip(out, (gram.view(np.int64), check.view(np.int64), np.full(len(span), doc), span), strict=True):
                    column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["gram", "check", "doc_id", "span"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The LENGTH-gram identifiers of the windows in each document's open spans."""
    for part in slices(batches):
        out: list[list[np.ndarray]] = [[], [], [], []]
        for doc, a, at, spans, (q, _, whole) in _in_blocks(part):
            start, more, _ = unpack(spans)
            n = more + 1
            starts = np.unique(np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
            w = a + starts - at
            w, starts = w[w < len(whole)], starts[w < len(whole)]
            check = mix(q[w] + _LEFT * q[w + LENGTH - Q])
            for column, values in zip(out, (whole[w].view(np.int64), check.view(np.int64), np.full(len(w), doc), starts), strict=True):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["gram", "check", "doc_id", "start"])


def _by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, starts and spans: the windows of docs(doc_id, text) that also start earlier, alone or as
    packed runs; documents without such windows are left out."""
    small_batches(docs.sparkSession)
    rows = docs.mapInArrow(_sample, _ROWS_DDL).repartition("bucket")
    sub_bucket = Window.partitionBy("bucket", "content").orderBy("doc_id", "span")
    bucket = Window.partitionBy("bucket")
    # rank, not row number: a row that the table repeats ties with itself and is no repeat
    rows = rows.withColumn("place", F.rank().over(sub_bucket))
    rows = rows.withColumn("size", F.count(F.lit(1)).over(bucket)).filter("size > 1 OR size(later) > 0")
    rows = rows.withColumn("open", F.min("content").over(bucket) != F.max("content").over(bucket))
    here = lambda repeat: F.array(F.struct("doc_id", "span", F.lit(repeat).alias("repeat")))
    none = F.array().cast("array<struct<doc_id:long,span:long,repeat:boolean>>")
    own = F.when(F.col("place") > 1, here(True)).when(F.col("open"), here(False)).otherwise(none)
    later = F.transform("later", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["span"].alias("span"), F.lit(True).alias("repeat")))
    sorted_rows = staged(rows.select(F.inline(F.concat(own, later))), "refined-buckets")

    texts = attach(docs, _by_document(sorted_rows.filter("NOT repeat")), "doc_id", None, how="inner")
    sides = texts.mapInArrow(_sides, "gram long, check long, doc_id long, span long")
    shared = F.count(F.lit(1)).over(Window.partitionBy("gram", "check")) > 1
    open_sides = staged(sides.withColumn("shared", shared).filter("shared").select("doc_id", "span"), "open-sides")

    texts = attach(docs, _by_document(open_sides), "doc_id", None, how="inner")
    windows = texts.mapInArrow(_windows, "gram long, check long, doc_id long, start long")
    order = Window.partitionBy("gram", "check").orderBy("doc_id", "start")
    later = windows.withColumn("place", F.rank().over(order)).filter("place > 1").select("doc_id", "start")
    later = staged(later, "repeated-windows").groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    return _by_document(sorted_rows.filter("repeat")).join(later, "doc_id", "full")


def removal_mask(n_bytes: int, starts: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the bytes the repeated windows cover."""
    edge = np.zeros(n_bytes + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)
    first, more, _ = unpack(spans)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + more + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def one_text_an_id(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs(doc_id, text), and None where each doc_id has one text; else docs with a number for each doc_id and text in its place, in
    their order, and the table of number and own_id."""
    rows = docs.select("doc_id", body_of())
    if not rows.groupBy("doc_id").agg(F.min("body").alias("a"), F.max("body").alias("z")).filter("a != z").take(1):
        return docs, None
    numbers = rows.distinct().orderBy("doc_id", "body").withColumn("number", F.monotonically_increasing_id())
    numbers = staged(numbers.select(F.col("doc_id").alias("own_id"), "body", "number"), "row-numbers")
    found = attach(docs.select(F.col("doc_id").alias("own_id"), body_of(), "text"), numbers, ["own_id", "body"], row_bytes=48)
    return found.select(F.col("number").alias("doc_id"), "text"), numbers.select("number", "own_id")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end) and kept (the bytes left) of each row of docs(doc_id, text)."""
    docs, own_ids = one_text_an_id(texts(docs))
    repeats = staged(repeated_spans(docs), "repeats")
    joined = attach(docs, repeats, "doc_id", None)
    runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", runs), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, removed, kept = [], [], []
            for t, starts, spans in zip(text_list(part), part.column("starts").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw = t.encode()
                mask = removal_mask(len(raw), np.array(starts or (), np.int64), np.array(spans or (), np.int64))
                turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
                sizes.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                kept.append(np.frombuffer(raw, np.uint8)[~mask].tobytes() if turns else raw)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, runs), pa.array(kept, pa.binary())], schema=schema)

    out = joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start long, end long>>, kept binary")
    if own_ids is None:
        return out
    return attach(out.withColumnRenamed("doc_id", "number"), own_ids, "number", row_bytes=32).select(F.col("own_id").alias("doc_id"), "n_bytes", "removed", "kept")
