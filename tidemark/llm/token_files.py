"""Token-ID files (operator 2): frequency-ranked ids in a byte-aligned variable-length code.

Format. A token file is a Parquet file of documents in ascending doc_id order; file follows file in the
same order, by the number in its name. Each row holds doc_id, n_tokens and two separate byte streams: `control`, with two bits
for each id (its bytes less one, four ids a byte, lowest bits first), and `data`, with the bytes of each
id's frequency rank, lowest first. Rank 0 is the id that occurs most in the corpus, so the ids that
occur most take one byte. The rank table is a second Parquet table, `ranks`. Decoding looks the four lengths
of a control byte up in a table and gathers the data with numpy.

Defined results: a null or empty text is the end id alone; rows that share a doc_id keep an order by
the CRC-32 of their ids; ids that never occur rank last, by id; text that spells an added token of the tokenizer file is that token, as the library
has it by default; extra columns are ignored; a row without a doc_id is left out.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_letters
from tidemark.llm.chunks import PieceIds
from tidemark.llm.common import binary_column, shared_folder, slices, small_batches, staged, texts

#: The id appended to each document.
END_ID = 0
#: Texts in one file, about; the number of files follows the corpus.
FILE_BYTES = 48 << 20
#: Words that go to the library at once.
BATCH = 10_000
#: Text that is cut into pieces at once.
SLICE_BYTES = 3 << 20
#: Lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


class HubEncoder:
    """Ids by the tokenizers library, remembered for pieces of text. A text that holds one of the file's added tokens goes to the library whole."""

    def __init__(self, content: str, pattern: str, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.width = Tokenizer.from_str(content), width
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.words = Tokenizer(self.model)  # without a pre-tokenizer: words come cut
        self.letters = dict(enumerate(byte_letters()))
        self.opens = np.zeros(max(self.words.get_vocab().values()) + 1, bool)
        self.opens[[i for t, i in self.words.get_vocab().items() if t[:1] == self.letters[32]]] = True
        self.pieces = PieceIds(self._encode, self._encode_words, pattern, dtype=width)

    def _spelt(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def _encode(self, pre_token: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(self._spelt(pre_token))], self.width).tobytes()

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """At most BATCH at once, as the library keeps much beside each id."""
        space = self.letters[32]
        spelt = [space + (w if w.isascii() else self._spelt(w)) for w in words]  # ASCII letters stand for themselves
        parts = []
        for i in range(0, len(spelt), BATCH):
            found = self.words.encode_batch_fast([spelt[i : i + BATCH]], is_pretokenized=True, add_special_tokens=False)[0]
            parts.append(np.array(found.ids, self.width))
        ids = np.concatenate(parts)
        first = np.flatnonzero(self.opens[ids])  # a word's space is in its first token and in no other
        return ids, np.diff(np.append(first, len(ids))).astype(np.int32)

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, strung together, and how many each has; null is empty."""
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for token in self.added:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self.pieces.many(texts)
        ids, counts = self.pieces.many(pc.if_else(pa.array(marked), "", texts))
        parts, at = [], np.cumsum(counts) - counts
        for i in np.flatnonzero(marked).tolist():
            own = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, self.width)
            parts.append(own)
            counts[i] = len(own)
        places = np.repeat(at[marked], counts[marked])
        return np.insert(ids, places, np.concatenate(parts)), counts


@lru_cache(maxsize=2)
def hub_encoder(content: str, pattern: str, width: str) -> HubEncoder:
    """One encoder for each Python worker."""
    return HubEncoder(content, pattern, width)


def _joined(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column, strung together."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def vbyte_encode(values: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """control and data of documents of counts[i] unsigned 32-bit values each, strung together."""
    values = values.astype("<u4")
    size = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    width = 1 + int(size.max(initial=0))
    kept = np.arange(width, dtype=np.uint8) <= size[:, None]
    data = values.view(np.uint8).reshape(-1, 4)[:, :width].reshape(-1)[kept.reshape(-1)]
    quads = -(-counts // 4)
    padded = np.zeros(4 * int(quads.sum()), np.uint8)
    padded[_slots(counts, quads)] = size
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    before = np.concatenate([[0], np.cumsum(size.astype(np.int64) + 1)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return binary_column(control, quads), binary_column(data, np.diff(before[edge]))


def _slots(counts: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """The place of each value among the slots of the documents' control bytes."""
    start, slot = np.cumsum(counts) - counts, 4 * (np.cumsum(quads) - quads)
    out = np.repeat((slot - start).astype(np.int32), counts)
    out += np.arange(len(out), dtype=np.int32)
    return out


def vbyte_decode(control: pa.Array, data: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The values of `vbyte_encode`, by table lookup."""
    size = LENGTHS[_joined(control)].reshape(-1)[_slots(counts, -(-counts // 4))]
    at = np.cumsum(size, dtype=np.int32) - size
    raw = np.concatenate([_joined(data), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _edges(docs: DataFrame) -> np.ndarray:
    """doc_ids that part the documents into files of about FILE_BYTES of text: the least of each range but the first, one number a file."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // FILE_BYTES)
    if n < 2:
        return np.zeros(0, np.int64)
    ranges = docs.select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("least"))
    return np.sort(ranges.toPandas()["least"].to_numpy(np.int64))[1:]


def vocabulary_size(content: str) -> int:
    """One more than the largest id of a tokenizer file, added tokens included."""
    import json

    read = json.loads(content)
    return 1 + max([*read["model"]["vocab"].values(), *(x["id"] for x in read["added_tokens"])])


def tokenised(docs: DataFrame, content: str, pattern: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (binary, 16 bits each where the vocabulary allows, else 32) and file, the number of the file it goes to, in any order."""
    spark = docs.sparkSession
    small_batches(spark)
    width = "<u2" if vocabulary_size(content) <= 1 << 16 else "<u4"
    given, edges = spark.sparkContext.broadcast(content), _edges(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("file", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = hub_encoder(given.value, pattern, width)
        for part in slices(batches, limit=SLICE_BYTES):
            ids, counts = enc.many(part.column("text"))
            ends = np.cumsum(counts + 1) - 1
            whole = np.full(len(ids) + len(counts), end_id, width)
            mask = np.ones(len(whole), bool)
            mask[ends] = False
            whole[mask] = ids
            file = np.searchsorted(edges, part.column("doc_id").to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            columns = [part.column("doc_id"), pa.array(counts + 1), binary_column(whole, (counts + 1) * whole.itemsize), pa.array(file)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        enc.pieces.forget()

    out = docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary, file int")
    return staged(out, "token-ids", "snappy").withMetadata("ids", {"width": width, "files": len(edges) + 1})


def frequency_ranks(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """The rank of each id; a table of the size of the vocabulary."""
    width = tokens.schema["ids"].metadata["width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in slices(batches, "ids"):
            counts += np.bincount(_joined(batch.column("ids")).view(width), minlength=vocabulary)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    ranks = np.empty(vocabulary, np.uint32)
    ranks[np.lexsort((np.arange(vocabulary), -counts))] = np.arange(vocabulary, dtype=np.uint32)
    return ranks


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, pattern: str, end_id: int = END_ID) -> None:
    """Token files of docs(doc_id, text) in `folder`/files and the rank table in `folder`/ranks."""
    spark = docs.sparkSession
    docs = texts(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    vocabulary = vocabulary_size(content)
    tokens = tokenised(docs, content, pattern, end_id)
    width, n_files = (tokens.schema["ids"].metadata[k] for k in ("width", "files"))
    ranks = frequency_ranks(tokens, vocabulary)
    table = spark.sparkContext.broadcast(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("control", pa.binary()), ("data", pa.binary()), ("file", pa.int32()), ("crc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids"):
            ranked = table.value[_joined(part.column("ids")).view(width)]
            control, data = vbyte_encode(ranked, part.column("n_tokens").to_numpy())
            crc = [zlib.crc32(np.frombuffer(x, width).astype("<u4").tobytes()) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), control, data, part.column("file"), pa.array(crc, pa.int64())], schema=schema)

    # one task writes one file, whose number is that of its partition; what is shuffled are the codes, the smallest form of the texts
    coded = tokens.mapInArrow(run, "doc_id long, n_tokens long, control binary, data binary, file int, crc long")
    coded = coded.repartitionById(n_files, "file").sortWithinPartitions("doc_id", "crc").drop("crc")
    coded.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(f"{folder}/files")
    spark.createDataFrame([(int(r), i) for i, r in enumerate(ranks)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, unsigned 32 bits little-endian) and file, decoded from the token files."""
    rows = spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").toPandas().sort_values("rank")
    ids_of = spark.sparkContext.broadcast(rows["id"].to_numpy().astype("<u4"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("file", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "data"):
            counts = part.column("n_tokens").to_numpy()
            ids = ids_of.value[vbyte_decode(part.column("control"), part.column("data"), counts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), binary_column(ids, 4 * counts), part.column("file")], schema=schema)

    coded = spark.read.schema("doc_id long, n_tokens long, control binary, data binary, file int").parquet(f"{folder}/files")
    return coded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, file int")


def crc_of_ids(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, file and the unsigned CRC-32 of the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.int32()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = pa.array([zlib.crc32(x) for x in b.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), b.column("file"), crc], schema=schema)

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, file int, ids_crc32 long")


def ids_before(totals: DataFrame, block: int = 4096) -> DataFrame:
    """file and before, the ids in all files before it, of totals(file, n): sums within blocks of files, and over the blocks before."""
    rows = totals.withColumn("block", F.floor(F.col("file") / block))
    of_block = rows.groupBy("block").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # one row for `block` files
    of_block = of_block.select("block", F.coalesce(before, F.lit(0)).alias("of_blocks"))
    in_block = F.sum("n").over(Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("in_block", F.coalesce(in_block, F.lit(0))).join(of_block, "block")
    return rows.select("file", (F.col("of_blocks") + F.col("in_block")).alias("before"))


def token_file_digest(docs: DataFrame, tokenizer_path: str, pattern: str, folder: str | None = None) -> DataFrame:
    """Write the token files, read them back: doc_id, start (ids before the document), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer_path, pattern)
    digest = staged(crc_of_ids(read_token_files(spark, folder)), "token-digest")
    before = ids_before(digest.groupBy("file").agg(F.sum("n_tokens").alias("n")))
    in_file = Window.partitionBy("file").orderBy("doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0))
    return digest.join(before, "file").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
