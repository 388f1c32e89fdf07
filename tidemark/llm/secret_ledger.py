"""Secret scans (operator 1): an incremental ledger of scanned blobs.

Every version of every path is content-addressed by the SHA-256 of its text. Only blobs that the
ledger has not seen under the present rule version are scanned, each once, and the findings are
joined back to all paths that ever held the blob.

Defined results: a null text is the empty blob; copies share one scan; offsets are code points, end
exclusive; a path may occur in any number of versions; extra columns are ignored; a row without a doc_id is left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, body_of, slices, small_batches, staged, text_list, texts

# The base kinds and their patterns, in the order that ranks equal starts.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "pem")
#: Added to the base kinds by this library: the header line of a private key.
PEM = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
#: Least lengths of what the base kinds match: the second group of assign, the whole of the others.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Follows from the patterns: blobs that were scanned under others are scanned again.
RULE_VERSION = zlib.crc32(repr((ASSIGN, ACCESS, HEX, PEM, KINDS, LEAST)).encode()) & 0x7FFFFFFF

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS, _HEX, _PEM = re.compile(ACCESS), re.compile(f"[0-9a-f]{{{LEAST['hex']},}}"), re.compile(PEM)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = pa.schema([("blob", pa.binary()), ("rule_version", pa.int32()), ("findings", _SPANS)])
_DDL = "blob binary, rule_version int, findings array<struct<kind string, start long, end long>>"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of KINDS."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST["assign"]] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(m.start(), 3, m.end()) for m in _PEM.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)] for t in text_list(part)]
        version = pa.array([RULE_VERSION] * part.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays([part.column("blob"), version, pa.array(found, _SPANS)], schema=_SCHEMA)


def _with_blob(versions: DataFrame) -> DataFrame:
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))


def addressed(versions: DataFrame, path: str = "path", *more: str) -> DataFrame:
    """path, blob (SHA-256 of the text, null as empty) and the columns named, of every row of versions(path, text), staged."""
    return staged(_with_blob(versions).select(path, "blob", *more), "blob-addresses")


def scan_new_blobs(versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", addresses: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule_version, findings) for the blobs of versions(path, text) that `ledger` lacks under the present rules.

    The lowest path of a blob stands for it, so only ids and hashes are grouped; texts move only
    where the list of standing paths is too large to broadcast. A path may stand for several blobs of its history.
    """
    small_batches(versions.sparkSession)
    addresses = addressed(versions, path) if addresses is None else addresses
    blobs = addresses.groupBy("blob").agg(F.min(path).alias(path))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    stands = staged(blobs.select(path, "blob"), "blob-stands")
    texts = attach(_with_blob(versions).select(path, "blob", "text"), stands, [path, "blob"], row_bytes=96, how="left_semi")
    return texts.select("blob", "text").mapInArrow(_scan, _DDL).dropDuplicates(["blob"])  # a version that the history repeats is still one blob


def join_paths(addresses: DataFrame, findings: DataFrame) -> DataFrame:
    """Each row of addresses(path, blob) with the findings of its blob, none being an empty array. Blobs without findings need no row, so a blob that many paths hold is
    no hot key unless it has a secret; then the table of findings is broadcast, or, beyond its bound, Spark splits the skewed partition."""
    table = staged(findings.filter(F.size("findings") > 0).select("blob", "findings"), "findings")
    width = 64 + 48 * int(table.agg(F.max(F.size("findings"))).first()[0] or 0)
    none = F.array().cast(_DDL.split("findings ")[1])
    return attach(addresses, table, "blob", row_bytes=width).withColumn("findings", F.coalesce("findings", none))


def span_text(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str, findings: list[tuple[int, int]], mark: str = "<SECRET>") -> str:
    """text with the findings' spans, merged where they overlap, replaced by `mark`."""
    out, at = [], 0
    for start, end in sorted(findings):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body (hash of the text), blob and findings of each row of docs, a snapshot of all paths; the ledger with the blobs that are new, staged)."""
    versions = texts(docs).withColumn("body", body_of())
    addresses = addressed(versions, "doc_id", "body")
    new = scan_new_blobs(versions, ledger, "doc_id", addresses)
    ledger = staged(new if ledger is None else ledger.unionByName(new), "secret-ledger")
    return join_paths(addresses, ledger.filter(F.col("rule_version") == RULE_VERSION)), ledger
