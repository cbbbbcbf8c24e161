"""Registered queries of the training-data operators: one opN_<name> each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from plexmat.llm import ctw, decontaminate, filteraudit, hnsw, htmlextract, jaccardjoin, langid, licenses, minhash, packing, periodic, sharding, suffixdedup
from plexmat.llm.tuning import bounded_batches
from plexmat.session import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(bounded_batches(spark), sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(bounded_batches(spark), sf_dir, "documents"))


def vocabulary() -> str:
    """Where the public vocabulary lies; the file is never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(bounded_batches(spark), sf_dir, "documents"), vocabulary())


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(table(bounded_batches(spark), sf_dir, "documents"))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(bounded_batches(spark), sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(bounded_batches(spark), sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_periods(table(bounded_batches(spark), sf_dir, "documents"))
    return periodic.digest(periodic.periodic_runs(docs))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.similar_sets(table(bounded_batches(spark), sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_language_id, op3_best_fit_packing, op4_suffix_dedup, op5_hnsw, op6_decontaminate, op7_html_extract, op8_license_scan, op9_ctw_scoring, op10_sharding, op11_periodic_runs, op12_filter_audit, op13_jaccard_join, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": minhash.oracle(), "op8_license_scan": licenses.oracle(), "op11_periodic_runs": periodic.oracle(), "op12_filter_audit": filteraudit.oracle(), "op13_jaccard_join": jaccardjoin.oracle()}
