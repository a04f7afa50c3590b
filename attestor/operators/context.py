"""Context budgets over ranked passages, in serialized characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T

PROVIDER_CHARS = 3000
PASSAGE_CANDIDATES = 4
#: Worst case of four quoted passages, rounded up to a thousand.
MIN_BUDGET = 7000
#: Characters that the passages mode may take.
MAX_PASSAGES_CHARS = 16_000


def with_cost(hits: DataFrame, id_: str = "passage_id", kind: str = "kind", text: str = "text", most_chars: int | None = PROVIDER_CHARS) -> DataFrame:
    """Serialized length of each hit as the provider sees it (text cut to ``most_chars``)."""
    shown = F.col(text) if most_chars is None else F.substring(text, 1, most_chars)
    return hits.withColumn("visible_chars", F.length(shown)).withColumn("item_chars", T.json_item_length(F.col(id_), F.col(kind), shown))


def checked_budget(budget: int) -> int:
    """A budget for whole contexts must hold the worst case of the passages mode."""
    if budget < MIN_BUDGET:
        raise ValueError(f"a context needs {MIN_BUDGET} characters at least")
    return budget


def character_budget(hits: DataFrame, budget: int, query: str) -> DataFrame:
    """The ranked prefix whose serialized list fits the budget; stops at the first overflow.

    The running length only grows, so keeping the rows within the budget is keeping the prefix.
    """
    by = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = hits.withColumn("total_chars", F.sum("item_chars").over(by) + 2 * F.count("*").over(by))
    return total.filter(F.col("total_chars") <= budget)


def passage_budget(hits: DataFrame, budget: int, query: str, candidates: int = PASSAGE_CANDIDATES) -> DataFrame:
    """Of the first candidates those that fit, skipping any that would overflow and trying the next.

    At most ``candidates`` rows of a query are gathered.
    """
    first = hits.filter(F.col("rank") <= candidates)
    grouped = first.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "passage_id", "item_chars"))).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<rank:int,passage_id:string,total_chars:bigint>>").alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        total = acc["used"] + item["item_chars"] + 2
        one = F.array(F.struct(item["rank"].alias("rank"), item["passage_id"].alias("passage_id"), total.alias("total_chars")))
        fits = total <= budget
        return F.struct(F.when(fits, total).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"))

    kept = grouped.select(query, F.explode(F.aggregate("items", start, step, lambda acc: acc["kept"])).alias("k"))
    return kept.select(query, "k.rank", "k.passage_id", "k.total_chars")


def omitted(hits: DataFrame, supplied: DataFrame, keys: list[str]) -> DataFrame:
    """Retrieved passages that were not supplied."""
    return hits.join(supplied.select(*keys), keys, "left_anti")


def admitted(calls: DataFrame, cap: Column, amount: str, order: str, by: str | None = None) -> DataFrame:
    """Calls admitted before the first refusal: reservations in order while their sum stays within the cap."""
    window = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.withColumn("reserved", F.sum(amount).over(window)).filter(F.col("reserved") <= cap)
