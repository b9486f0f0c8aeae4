"""The operators' queries, over whole tables, and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import dart_minhash, exact_dedup, fill_in_middle, merkle_manifest, mixing, packing, pii_feistel, quality_cnn, scaled_sketch, secret_scan, suffix_dedup, toxicity_fm, warc_derivatives
from foldwise.llm.common import table


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymise(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.derivatives(warc_derivatives.responses(table(spark, sf_dir, "pages")))


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.edited_likeness(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents")).drop("rank", "proof")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can tell."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can tell."""
    return op5_pivotal_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def sketch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8 that SQL can tell."""
    return op8_scaled_sketch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def suffix_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 without the places of its spans."""
    return op9_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_pii_feistel": op1_pii_feistel,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_secret_scan": op3_secret_scan,
        "op4_dart_minhash": op4_dart_minhash,
        "op5_pivotal_mix": op5_pivotal_mix,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_scaled_sketch": op8_scaled_sketch,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_quality_cnn": op10_quality_cnn,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_toxicity_fm": op12_toxicity_fm,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline,
        "secret_base_spans": secret_base_spans,
        "mix_targets": mix_targets,
        "sketch_edits": sketch_edits,
        "suffix_removed": suffix_removed,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op11_fill_in_middle": fill_in_middle.ORACLE,
        "op13_merkle_manifest": merkle_manifest.ORACLE,
        "secret_base_spans": secret_scan.BASE_ORACLE,
        "mix_targets": mixing.TARGET_ORACLE,
        "sketch_edits": scaled_sketch.EDIT_ORACLE,
        "suffix_removed": suffix_dedup.ORACLE,
    }
