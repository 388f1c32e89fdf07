"""The registered queries of the operators: thin digests of what the operators return, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, fill_in_middle, license_scan, merkle, ngram_join, oracles, quality_classifier, quality_rules, secret_ledger, source_mix, substring_dedup, token_counts, token_files
from tidemark.llm.common import attach, documents


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    earlier = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0  # an earlier snapshot with half of the paths; the whole one follows and scans only what is new
    _, ledger = secret_ledger.secret_scan(docs.filter(earlier))
    found, _ = secret_ledger.secret_scan(docs, ledger)
    base = F.filter("findings", lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secret_ledger.span_text(base), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, secret_ledger.span_text(F.col("findings")).alias("spans"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_file_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(documents(spark, sf_dir))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(documents(spark, sf_dir))
    families = F.array_join(F.array_sort(F.array_distinct("licences.family")), ",")
    spans = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["place"].cast("string"), x["width"].cast("string"), x["family"])), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licensed"), families.alias("families"), spans.alias("paragraphs"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(documents(spark, sf_dir), token_counts.CLEANING)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix.mix_sources(documents(spark, sf_dir), F.array("source"), (3, 1, 2), percent=150, most=2)
    rows = mix.documents.withColumn("source_key", F.col("sources")[0])
    return attach(rows, mix.source_table(), "source_key", row_bytes=256).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = merkle.leaf_digest([F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in merkle.FIELDS])
    second = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    found = merkle.inclusion_proofs(merkle.merkle_manifest(docs, second=second))
    fold = merkle.folded(F.col("proof"), F.coalesce("second", "digest"))
    out = found.select(F.col("name").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_ALL = (op1_secret_ledger, op2_token_files, op3_suffix_dedup, op4_fm_index, op5_license_scan, op6_bpe, op7_edit_counts, op8_ngram_join, op9_co_training, op10_quality_rules, op11_fill_in_middle, op12_source_mix, op13_merkle_manifest)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {name: oracles.BY_OPERATOR[n] for name in QUERIES if (n := int(name[2:].split("_")[0])) in oracles.BY_OPERATOR}
