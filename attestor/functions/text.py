"""Text expressions: white space, tokens, serialized length.  All stay inside generated code."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four separators that Java's class lacks.
SPACE = r"(?U)[\s\x1C-\x1F]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]{2,}+"

#: Default stop words; pass another list where a fitted vocabulary needs it.
STOP_WORDS = tuple(
    "a an and are as at be but by for from had has have he her his i if in into is it its my no not of on or our she so "
    "such that the their them then there these they this to was we were what when which who will with you your".split()
)


def words(text: Column) -> Column:
    """Words between white space, as ``str.split()`` gives them."""
    return F.array_remove(F.split(text, SPACE), "")


def normalize_space(text: Column) -> Column:
    """Words joined by one blank."""
    return F.array_join(words(text), " ")


def strip(text: Column) -> Column:
    """The text without white space at its ends, as ``str.strip()`` gives it."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def receipt(text: Column) -> Column:
    """Text for comparing quotes: a blank for the registered mark, one delta, one blank between words."""
    return normalize_space(F.replace(F.replace(text, F.lit("®"), F.lit(" ")), F.lit("∆t"), F.lit("Δt")))


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased word tokens of two characters or more, without stop words (looked up in a hash set)."""
    return without(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), stop_words)


def without(own: Column, stop_words: Sequence[str]) -> Column:
    """The tokens that are no stop words."""
    return F.filter(own, lambda t: ~t.isin(*stop_words)) if stop_words else own


def read_stop_words(path: str) -> tuple[str, ...]:
    """A stop list from a text file of words between white space, for a vocabulary that was fitted with it."""
    with open(path, encoding="utf-8") as file:
        return tuple(dict.fromkeys(file.read().split()))


def term_pairs(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """array<struct<a, b>>: each token and the one that follows it once stop words are gone (null at the end)."""
    return neighbours(tokens(text, stop_words))


def neighbours(own: Column) -> Column:
    """array<struct<a, b>>: each element and the one that follows it (null at the end)."""
    return F.arrays_zip(own.alias("a"), F.slice(own, 2, F.greatest(F.size(own), F.lit(1))).alias("b"))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def json_string_length(text: Column) -> Column:
    """Length of the text as a JSON string with all but ASCII escaped."""
    escaped = _count(text, r'["\\\n\r\t\x08\f]')
    wide = _count(text, r"[\x{10000}-\x{10FFFF}]")
    other = _count(text, r"[^\x20-\x7E\n\r\t\x08\f]") - wide
    return F.lit(2) + F.length(text) + escaped + 5 * other + 11 * wide


def json_item_length(id_: Column, kind: Column, text: Column) -> Column:
    """Length of ``{"id": ..., "kind": ..., "text": ...}``."""
    return F.lit(28) + json_string_length(id_) + json_string_length(kind) + json_string_length(text)


def json_list_length(items: Column, count: Column) -> Column:
    """Length of a list of items from the sum of their lengths and their number."""
    return F.lit(2) + items + F.greatest(F.lit(0), count - 1) * 2
