"""Byte-level BPE encoding and decoding (operator 6) by a sentencepiece model made from the ranks alone.

Method: the model file is serialised directly from the vocabulary: each token's bytes become the
printable characters that stand for them, scored by minus its rank, with identity normalisation. sentencepiece
then merges the pair with the highest score first, which is the pair with the lowest rank. Pre-tokens are
encoded one by one; a pre-token that is itself in the vocabulary is its id at once. Decoding is
the inverse mapping from ids to bytes.

Defined results: null and empty texts have no ids; ids are those of the rank file; text that looks
like a special token is ordinary text; extra columns are ignored; a row without a doc_id is left out.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.chunks import PieceIds
from tidemark.llm.common import binary_column, slices, small_batches, texts

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DDL = "doc_id long, n_tokens long, ids binary"


def read_ranks(ranks: bytes) -> list[bytes]:
    """The token of each id, from a rank file's content."""
    pairs = [line.split() for line in ranks.splitlines() if line]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def byte_letters() -> list[str]:
    """The printable character that stands for each byte; bytes without one get those from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes by length, floats fixed, ints as varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are those of `tokens`; one more id, the last, is the unknown piece."""
    letters = byte_letters()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    no_id = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, no_id) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join([*out, _field(2, trainer), _field(3, normaliser)])


class Encoder:
    """Text to ids and back, by rank file and pre-token pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(ranks)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.pieces = PieceIds(self._encode, self._encode_words, pattern)

    def _encode(self, pre_token: str) -> bytes:
        raw = pre_token.encode()
        whole = self.whole.get(raw)
        ids = [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        space, get = self.letters[32], self.whole.get
        raw = [(" " + w).encode() for w in words]
        whole = [get(r) for r in raw]
        lacking = [i for i, x in enumerate(whole) if x is None]
        spelt = [space + (words[i] if words[i].isascii() else raw[i][1:].decode("latin-1").translate(self.letters)) for i in lacking]
        ids: list = [[x] for x in whole]
        for i, found in zip(lacking, self.model.encode(spelt, num_threads=1) if spelt else [], strict=True):
            ids[i] = found
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(ranks, pattern)


def _default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def vocabulary(docs: DataFrame, ranks_path: str | None):
    """The rank file's content as a broadcast (its size is that of one vocabulary)."""
    with open(ranks_path or _default_ranks(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (binary, unsigned 32 bits little-endian) of each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    ranks, pattern = vocabulary(docs, ranks_path), pattern or _default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for part in slices(batches):
            ids, counts = enc.pieces.many(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), binary_column(ids, 4 * counts)], schema=_SCHEMA)
        enc.pieces.forget()

    return texts(docs).mapInArrow(run, _DDL)


def bpe_decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and bytes of each row of encoded(doc_id, ids)."""
    ranks = vocabulary(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(ranks.value)
        for part in slices(batches, "ids"):
            out = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes: encoding and decoding in one pass over the texts."""
    small_batches(docs.sparkSession)
    ranks, pattern = vocabulary(docs, ranks_path), pattern or _default_pattern()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        spelt = [str(i) for i in range(len(enc.tokens))]
        for part in slices(batches):
            ids, counts = enc.pieces.many(part.column("text"))
            as_list, at, digests, decoded = ids.tolist(), 0, [], []
            for n in counts.tolist():
                own = as_list[at : at + n]
                at += n
                digests.append(hashlib.sha256(" ".join(map(spelt.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(enc.tokens.__getitem__, own))).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], schema=schema)
        enc.pieces.forget()

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
