"""Three-valued AND and OR as aggregates: unlike bool_and and bool_or they keep an unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def k_and(value: Column) -> Column:
    """False if any is false, else unknown if any is unknown, else true (also of nothing)."""
    return F.when(F.count_if(~value) > 0, False).when(F.count(value) == F.count(F.lit(1)), True)


def k_or(value: Column) -> Column:
    """True if any is true, else unknown if any is unknown, else false."""
    return F.when(F.count_if(value) > 0, True).when(F.count(value) == F.count(F.lit(1)), False)


def all_of(values: Column) -> Column:
    """The same AND over an array."""
    return F.forall(values, lambda v: v)
