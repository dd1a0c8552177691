"""The subpackage's queries, over whole tables with production parameters, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontaminate, packing, secrets, sharding, simhash, substrings, suffixes, topk, urls
from .shared import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all rows, of every row whose id is divisible by 20."""
    return topk.search(read(spark, sf_dir, "embeddings"), every=topk.EVERY)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats_with_partners(read(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_suffixes(read(spark, sf_dir, "documents"), joined=False)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(read(spark, sf_dir, "pages"), urls.rules(spark, urls.RULES))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their probabilities."""
    return classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_exact_top_k,
        op2_simhash_near_dedup,
        op3_substring_dedup,
        op4_suffix_array_dedup,
        op5_best_fit_packing,
        op6_secret_scans,
        op7_url_filters,
        op8_sharding,
        op9_quality_classifier,
        op10_benchmark_decontamination,
    )
}
ORACLES: dict[str, str] = {
    op1_exact_top_k.__name__: topk.ORACLE,
    op3_substring_dedup.__name__: substrings.ORACLE,
    op4_suffix_array_dedup.__name__: suffixes.ORACLE,
    op7_url_filters.__name__: urls.ORACLE,
}
