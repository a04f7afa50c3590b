"""Connected components of a table of links, by alternating large-star and small-star steps.

Links never leave the executors.  Each step takes the least neighbour of every node; a node with very
many links is handled by ``common.attach``, so none of its steps gathers a node's links in one task.
Steps are written to the shared folder; the loop ends when a round changes nothing (a number of
rounds that grows with the logarithm of the largest component).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import common


def _least(links: DataFrame) -> DataFrame:
    """(u, least, n): least of u and its neighbours v, and their number."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count("*").alias("n"))


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step's links, and the table that they read."""
    both = links.union(links.select(F.col("v"), F.col("u"))).toDF("u", "v")
    low = common.stored(_least(both), "least")
    return common.attach(both, low, ["u"], "n", "v").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), low


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = common.stored(_least(down), "least")
    moved = common.attach(down, low, ["u"], "n", "v").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(low.select("u", F.col("least").alias("v"))).filter("u <> v").distinct(), low


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two columns of long) that is not its own component's least node.

    Only the last round's table is left in the shared folder.
    """
    links = common.stored(links.toDF("u", "v").filter("u <> v").distinct(), "links")
    mark = None
    while True:
        large, first = _large_star(links)
        small, second = _small_star(large)
        before, links = links, common.stored(small, "links")
        common.discard(before, first, second)
        now = links.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).head()
        if now == mark:
            return links.toDF("node", "component")
        mark = now
