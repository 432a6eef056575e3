"""The queries of the operators, each over its whole table, and the SQL they are held against."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.registry import Query
from ..runtime import configure, stage
from . import bpe, decontaminate, licenses, line_dedup, merkle, mixing, near_dedup, outliers, passage_dedup, secrets, sql, suffix_dedup, topk, variants
from .text import prepare

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """The vocabulary file, on every machine; ``TOKENIZER_FILE`` names another place."""
    return os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(configure(spark)), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_quality_outliers")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    counted = outliers.quality_counts(docs).select("row.doc_id", "row.lang", "row.source", *outliers.COUNTS)
    table = stage(outliers.vectors(counted, "doc_id", *outliers.COUNTS), "vectors")
    judged = outliers.judge(table, outliers.fit(table), "doc_id", *outliers.COUNTS)
    return judged.select("doc_id", *outliers.BASE, "base_failed", "kept", "distance", "n_lines")


@query("op2_lyndon_suffix_dedup", sql.SUBSTRINGS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_bytes(documents(spark, sf_dir)).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("touched")
    )


@query("op3_source_mixing", sql.MIXING)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = mixing.shuffled(mixing.replicate(docs, mixing.rates(docs)).select("row.doc_id", "row.source", "copy", "order"))
    return rows.select("doc_id", "source", "copy", "order")


@query("op4_odd_sketch_near_dedup", sql.NEAR)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_distinct_word_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer_path(), ["doc_id"], bpe.digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op6_threshold_top_k", sql.TOP_K)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


@query("op7_license_diagonals", sql.LICENSES)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op8_relative_lz_passages", sql.PASSAGES)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.removed_passages(documents(spark, sf_dir)).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@query("op9_line_chunk_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removed_passages(documents(spark, sf_dir))
    return found.select("row.doc_id", "n_chunks", "n_bytes", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op10_linked_secrets", sql.SECRETS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stage(secrets.scanned(documents(spark, sf_dir), "row.doc_id"), "secret-spans")
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return secrets.report(found, "doc_id").withColumn("spans", spans)


@query("op11_slot_pivot_manifest", sql.MANIFEST)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


@query("op12_winnowed_decontamination", sql.LEAKS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(documents(spark, sf_dir), benchmark)
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op13_gram_matrix_variants", sql.VARIANTS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))
