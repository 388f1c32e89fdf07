"""What the text operators share: reading documents, stage tables, checked broadcasts, batches of bounded size."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only where its rows, at their estimated width, stay under this many bytes.
BROADCAST_BYTES = 48 << 20
#: Python works on slices of an Arrow batch with about so many bytes of text (one longer text is a slice alone).
SLICE_BYTES = 1 << 20

_own_folder: list[str] = []
_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text and the columns named; a row without a doc_id is no document and is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).filter("doc_id IS NOT NULL")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests a folder of this process."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-stages-"))
    return f"file://{_own_folder[0]}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")  # what was shuffled for this table is not needed once it is written
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more: what was made of them is staged itself."""
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "1m") -> None:
    """Bound the rows and bytes of an Arrow batch in this session. Plans read this when they run, which is after the operator has returned, so it stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def attach(docs: DataFrame, table: DataFrame, key: str | list[str], row_bytes: int | None, how: str = "left") -> DataFrame:
    """docs joined with a staged table on `key` (at most one row a key), without moving the texts where that is safe.

    The table is counted first. Under BROADCAST_BYTES it is broadcast; beyond that, and with row_bytes None, both
    sides are shuffled and a hash table is made of each partition of the table, not of the texts.
    """
    if row_bytes is not None and table.count() * row_bytes <= BROADCAST_BYTES:
        return docs.join(F.broadcast(table), key, how)
    return docs.join(table.hint("shuffle_hash"), key, how)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut or joined to slices of about `limit` bytes of `column`."""
    held, size = [], 0
    for batch in batches:
        at = 0
        for i, n in enumerate(_lengths(batch.column(column)) if batch.num_rows else ()):
            if size and size + n > limit:
                yield _as_one([*held, batch.slice(at, i - at)])
                held, at, size = [], i, 0
            size += n + 64
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield _as_one(held)
    malloc_trim()  # the worker goes on to other stages


def _as_one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    parts = [p for p in parts if p.num_rows]
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _lengths(column: pa.Array) -> list[int]:
    if pa.types.is_list(column.type):
        return pc.fill_null(pc.multiply(pc.list_value_length(column), 8), 0).to_pylist()
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def text_list(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, strung together, and where each begins and the last ends; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return b[edges[0] : edges[-1]], edges - edges[0]


def binary_column(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of data cut into values of these sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def malloc_trim() -> None:
    """Give freed memory back to the system, for a worker that goes on to other stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def body_of(text: str = "text") -> Column:
    """A hash of a row's text: with doc_id it names the row, or rows that repeat word for word."""
    return F.xxhash64(text).alias("body")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with doc_id as long and the hash of the text under two free names, and these names."""
    key = free_names(docs, "_doc", "_body")
    return docs.select("*", F.col("doc_id").cast("long").alias(key[0]), F.xxhash64("text").alias(key[1])), key


def edit_texts(docs: DataFrame, edits: DataFrame, new_text: Callable[[str, list[tuple[int, int]]], str]) -> DataFrame:
    """docs with text and n_chars changed in the rows that edits(doc_id, body, spans of start and end) names; new_text: (text, spans) -> text.

    All other columns pass through, whatever their names. Of several edits of one row any holds.
    """
    small_batches(docs.sparkSession)
    spans = F.transform("spans", lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    keyed, key = keyed_rows(docs)
    (of_row,) = free_names(docs, "_spans")
    edits = edits.select(F.col("doc_id").alias(key[0]), F.col("body").alias(key[1]), spans.alias(of_row))
    edits = staged(edits.dropDuplicates(key), "edits")
    width = 64 + 32 * int(edits.agg(F.max(F.size(of_row))).first()[0] or 0)
    names, schema = docs.columns, docs.schema
    joined = attach(keyed, edits, key, row_bytes=width)
    joined = joined.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(of_row).alias("spans"))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.column("row").flatten(), b.column("spans")], names=[*names, of_row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(flat(batches)):
            columns = {c: part.column(c) for c in names}
            spans = part.column(of_row)
            if spans.null_count < len(spans):
                texts, lengths = part.column("text").to_pylist(), part.column("n_chars").to_pylist() if "n_chars" in names else []
                for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    texts[i] = new_text(texts[i] or "", [(x["start"], x["end"]) for x in spans[i].as_py()])
                    if lengths:
                        lengths[i] = len(texts[i])
                columns["text"] = pa.array(texts, part.column("text").type)
                if lengths:
                    columns["n_chars"] = pa.array(lengths, part.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return joined.mapInArrow(run, schema)
