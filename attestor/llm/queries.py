"""One registered query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.functions.shipping import spread
from attestor.llm import decontaminate, exact_dedup, hash_tree, language_hd, packing, perspectives, quality_gbt, secret_markov, simhash_pivots, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; documents of fewer parts than there are cores are dealt over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op2_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_hd.identify(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(table(spark, sf_dir, "documents"))


def op6_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_markov.report(secret_markov.scan(table(spark, sf_dir, "documents")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_perspective_rotation, op2_language_hd, op3_token_files, op4_decontaminate, op5_hash_tree,
        op6_cost_packing, op7_quality_gbt, op8_secret_markov, op9_exact_dedup, op10_simhash_pivots,
    )
}
ORACLES: dict[str, str] = {"op1_perspective_rotation": perspectives.ROTATE_SQL, "op5_hash_tree": hash_tree.SHARDS_SQL, "op9_exact_dedup": exact_dedup.COPIES_SQL}
