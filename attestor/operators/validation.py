"""Fail-closed constraints: each gives what breaks it; a valid input gives nothing or zero counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranges_ordered(ranges: Column, length: Column) -> Column:
    """Whether retained ranges (array of struct<start, end>) are non-empty, ordered, apart and within the text."""
    last = F.aggregate(
        ranges, F.lit(0).cast("bigint"),
        lambda at, r: F.when((at >= 0) & (r["start"] >= at) & (r["end"] > r["start"]), r["end"].cast("bigint")).otherwise(F.lit(-1).cast("bigint")),
    )
    return (last >= 0) & (last <= length)


def encoding_faults(diagnostics: DataFrame, passages: DataFrame) -> DataFrame:
    """Diagnostics (passage_id, text_sha256, input_tokens, encoded_tokens, truncated, retained_ranges) that don't fit their passage."""
    joined = diagnostics.join(passages.select("passage_id", F.length("text").alias("_n"), F.sha2("text", 256).alias("_sha")), "passage_id", "left")
    fault = (
        F.when(F.col("_sha").isNull(), "unknown passage").when(F.col("_sha") != F.col("text_sha256"), "other text")
        .when((F.col("encoded_tokens") > F.col("input_tokens")) | (F.col("truncated") != (F.col("encoded_tokens") < F.col("input_tokens"))), "counts")
        .when(~ranges_ordered(F.col("retained_ranges"), F.col("_n")), "ranges")
    )
    return joined.select("passage_id", fault.alias("fault")).filter("fault is not null")


def hit_faults(hits: DataFrame, passages: DataFrame, query: str, limit: int) -> DataFrame:
    """Per query: more hits than the limit, repeated or unknown passages, scores that are not finite."""
    known = hits.join(passages.select("passage_id", F.lit(True).alias("_known")), "passage_id", "left")
    counts = known.groupBy(query).agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("passage_id")).alias("repeated"), F.count_if(F.col("_known").isNull()).alias("unknown"),
        F.count_if(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))).alias("not_finite"),
    )
    return counts.filter((F.col("n") > limit) | (F.col("repeated") > 0) | (F.col("unknown") > 0) | (F.col("not_finite") > 0))


def reference_faults(references: DataFrame, passages: DataFrame) -> DataFrame:
    """References (passage_id, document_id, paragraph) that name no passage, or another document or paragraph than it has."""
    own = passages.select("passage_id", F.col("document_id").alias("_document"), F.col("paragraph").alias("_paragraph"))
    joined = references.join(own, "passage_id", "left")
    wrong = F.col("_document").isNull() | (F.col("_document") != F.col("document_id")) | (F.col("_paragraph") != F.col("paragraph"))
    return joined.filter(wrong).drop("_document", "_paragraph")


def comparable(runs: DataFrame, contract: list[str]) -> DataFrame:
    """Columns of the contract that differ between runs; a controlled comparison needs that there are none."""
    counts = runs.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in contract])
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in contract])).alias("c")).select("c.*")
    return each.filter("n > 1")
