"""A corpus pipeline over `documents`: quality rules, near duplicates, decontamination, secrets, encoding.

Each stage takes the documents that the stage before has kept, as they are after it, and all its decisions take effect:
rejected documents go, lines and texts are cut or redacted.

Defined results: a null text is empty, so the quality rules reject it; rows are told apart by doc_id and text, so rows that share a doc_id
but not the text are judged each on its own; of rows that repeat doc_id and text, and of equal texts, one stays after the
near-duplicate stage (with the smallest doc_id, ties by a hash of the text); a row without a doc_id is left out by the first stage;
empty tables give empty results; all other columns of documents pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, ngram_join, quality_rules, secret_ledger
from tidemark.llm.common import attach, documents, edit_texts, keyed_rows, staged


def _only(docs: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose doc_id and text (by its hash, body) are in rows(doc_id, body), or with left_anti the others."""
    keyed, key = keyed_rows(docs)
    keys = staged(rows.select(F.col("doc_id").alias(key[0]), F.col("body").alias(key[1])).distinct(), "row-keys")
    return attach(keyed, keys, key, row_bytes=40, how=how).select(*_columns(docs))


def _columns(docs: DataFrame) -> list[Column]:
    """All columns, names with dots too."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their host share."""
    spans = staged(quality_rules.removed_spans(quality_rules.lost_lines(docs)), "removed-lines")
    kept = quality_rules.quality_rules(docs, spans=spans).filter("kept")
    return edit_texts(_only(docs, kept), spans, quality_rules.without_lines)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; of rows that repeat it one."""
    stay = staged(ngram_join.ngram_components(docs).filter("representative").groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("n")), "representatives")
    again = stay.filter("n > 1")
    once = _only(docs, stay.filter("n = 1"))
    if not again.take(1):
        return once
    keyed, key = keyed_rows(_only(docs, again))
    return once.unionByName(keyed.dropDuplicates(key).select(*_columns(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their passages of the benchmark; a document that is nothing else goes."""
    found = decontaminate.contamination(docs, documents(spark, sf_dir, "benchmark")).filter(F.size("spans") > 0)
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    found = staged(found.select("doc_id", "body", "spans", (length == F.col("n_words")).alias("all_hit")), "contamination")
    return edit_texts(_only(docs, found.filter("all_hit"), "left_anti"), found.filter("NOT all_hit"), decontaminate.without_spans)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets redacted."""
    found, _ = secret_ledger.secret_scan(docs)
    return edit_texts(docs, found.filter(F.size("findings") > 0).select("doc_id", "body", F.col("findings").alias("spans")), secret_ledger.redacted)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (unsigned 32-bit little-endian) of each document."""
    return bpe.bpe_encode(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("byte-level BPE", encoding)]

#: SQL can express neither the encoding nor, in reasonable time, the join; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
