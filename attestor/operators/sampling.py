"""Deterministic samples and splits by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_order(value: Column, seed: str | None = None) -> Column:
    """A pseudo-random order that depends on the value and seed only."""
    return F.sha2(value if seed is None else F.concat(F.lit(f"{seed}:"), value), 256)


def stratified(df: DataFrame, stratum: str, id_: str, n: int, seed: str | None = None) -> DataFrame:
    """The n first rows of each stratum in stable order."""
    by = Window.partitionBy(stratum).orderBy(stable_order(F.col(id_).cast("string"), seed), id_)
    return df.withColumn("pick", F.row_number().over(by)).filter(F.col("pick") <= n)


def numbered(df: DataFrame, order: list, prefix: str = "G") -> DataFrame:
    """Display numbers after ordering; for small selections."""
    return df.withColumn("number", F.format_string(f"{prefix}%03d", F.row_number().over(Window.orderBy(*order))))


def round_robin(df: DataFrame, order: str, jobs: int) -> DataFrame:
    """Deal rows with a gapless ``order`` over workers."""
    return df.withColumn("worker", F.pmod(F.col(order), F.lit(jobs)).cast("int"))


def overlap(a: DataFrame, b: DataFrame, id_: str, normalized: str) -> DataFrame:
    """Rows of ``a`` whose id or normalized text also occurs in ``b``; splits must have none."""
    by_id = a.join(b.select(id_).distinct(), id_, "left_semi")
    by_text = a.join(b.select(normalized).distinct(), normalized, "left_semi")
    return by_id.select(id_, normalized).union(by_text.select(id_, normalized)).distinct()
