"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.shared import discard, own_folder, stored  # noqa: F401
from attestor.functions.shipping import give_back, kept, map_batches  # noqa: F401

#: Most classes that one broadcast of heavy keys may carry.
HEAVY_KEYS = 1000
#: Bits, as a power of two, of the set of keys that ``marked`` broadcasts (in words of 64).
MARK_BITS = 26


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets a name that an operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, classes: DataFrame, keys: Sequence[str], weight: str, spread: str) -> DataFrame:
    """Left join of ``rows`` with ``classes`` (unique on ``keys``) that no frequent key slows.

    The ``HEAVY_KEYS`` classes of greatest ``weight`` are broadcast (that many rows at most, so the
    bound holds at every input size); any other key holds at most 1/HEAVY_KEYS of the rows.  Rows of
    heavy keys skip the shuffle join: they get a salt from column ``spread``, under which nothing
    matches, so they are dealt evenly.
    """
    values = [c for c in classes.columns if c not in keys]
    heavy = classes.orderBy(F.col(weight).desc(), *keys).limit(HEAVY_KEYS)
    heavy = F.broadcast(heavy.select(*keys, *[F.col(c).alias(f"_heavy_{c}") for c in values], F.lit(True).alias("_heavy")))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(65_536)).cast("int") + 1).otherwise(0)
    salted = rows.join(heavy, list(keys), "left").withColumn("_salt", salt)
    joined = salted.join(classes.withColumn("_salt", F.lit(0)), [*keys, "_salt"], "left")
    both = [F.when(F.col("_heavy"), F.col(f"_heavy_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(*rows.columns, *both)


def marked(rows: DataFrame, key: str, names: DataFrame, bits: int = MARK_BITS) -> DataFrame:
    """``rows`` with ``_met``: true wherever ``key`` (a long) is in the one column of ``names``, and for few others.

    What is broadcast is a set of 2**bits bits by the lower bits of the keys, 2**(bits - 6) rows of two
    numbers at most at every size of ``names``; the more of them, the more rows are marked in vain.
    """
    name = names.columns[0]
    word = lambda c: F.shiftright(F.col(c).bitwiseAND(F.lit((1 << bits) - 1)), 6)
    bit = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` & 63L as int))")
    words = names.select(word(name).alias("_word"), bit(name).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    joined = rows.withColumn("_word", word(key)).join(F.broadcast(words), "_word", "left")
    met = F.coalesce(F.col("_bits").bitwiseAND(bit(key)) != 0, F.lit(False))
    return joined.select(*rows.columns, met.alias("_met"))


def one_batch(schema: pa.Schema, columns: dict[str, Sequence]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20, trim: bool = True) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each take about ``most_bytes`` (one row at least); ``trim``: give memory back after each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.column(batch.schema.get_field_index(column)).nbytes <= most_bytes:
            yield batch
            if trim:
                give_back()
            continue
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        first = held = 0
        for i, size in enumerate(sizes):
            held += size or 0
            if held > most_bytes and i > first:
                yield batch.slice(first, i - first)
                if trim:
                    give_back()
                first, held = i, size or 0
        yield batch.slice(first)
        if trim:
            give_back()
