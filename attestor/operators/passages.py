"""Passages: fixed word windows of paragraphs, with stable identities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T

MAX_WORDS = 180


def chunk(docs: DataFrame, max_words: int = MAX_WORDS, separator: str = "\n\n", id_: str = "document_id", text: str = "text") -> DataFrame:
    """One row per window: passage_id ``{document}:p{paragraph}:w{offset}``, document_id, paragraph, word_offset, text.

    Paragraphs without words give no passage but keep their number.  (document order, paragraph,
    word_offset) is the artifact order; no global sort is needed for it.
    """
    if max_words < 1:
        raise ValueError("max_words must be positive")
    paragraphs = docs.select(F.col(id_).alias("document_id"), F.posexplode(F.split(F.col(text), re.escape(separator))).alias("paragraph", "_text"))
    worded = paragraphs.select("document_id", (F.col("paragraph") + 1).alias("paragraph"), T.words(F.col("_text")).alias("_words")).filter("size(_words) > 0")
    windows = worded.withColumn("word_offset", F.explode(F.sequence(F.lit(0), F.size("_words") - 1, F.lit(max_words))))
    return windows.select(
        F.concat_ws(":", "document_id", F.concat(F.lit("p"), "paragraph"), F.concat(F.lit("w"), "word_offset")).alias("passage_id"),
        "document_id", "paragraph", "word_offset", F.array_join(F.slice("_words", F.col("word_offset") + 1, max_words), " ").alias("text"),
    )


def duplicates(df: DataFrame, id_: str) -> DataFrame:
    """Ids that occur more than once; a valid table has none."""
    return df.groupBy(id_).agg(F.count("*").alias("n")).filter("n > 1")


def valid_question(text: Column) -> Column:
    """Stripped text of 3 to 2000 characters."""
    stripped = F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    return F.when(F.length(stripped).between(3, 2000), stripped)
