"""Ranking metrics, three-valued evidence coverage, paired comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.kleene import k_and, k_or
from attestor.functions.stats import paired_outcome


def ranking_metrics(cases: DataFrame, references: DataFrame, hits: DataFrame, case: str, source: str, cutoffs: Sequence[int]) -> DataFrame:
    """Per case and cutoff: recall, hit, all sources, first relevant rank, reciprocal rank.

    ``cases`` has ``answerable``; metrics of the others are null and leave every denominator.  A case
    without hits (a failed retrieval) counts zero.  One ranking serves all cutoffs as its prefixes.
    """
    wanted = references.select(case, source).distinct().withColumn("_wanted", F.lit(True))
    found = hits.groupBy(case, source).agg(F.min("rank").alias("rank")).join(wanted, [case, source])
    at = F.explode(F.array(*map(F.lit, cutoffs))).alias("k")
    expected = wanted.groupBy(case).agg(F.count("*").alias("expected"))
    grid = cases.select(case, "answerable", at).join(expected, case, "left")
    within = found.join(cases.select(case, at), case).filter("rank <= k").groupBy(case, "k").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))
    joined = grid.join(within, [case, "k"], "left")
    scored = F.col("answerable") & (F.col("expected") > 0)
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        case, "k", F.when(scored, n / F.col("expected")).alias("recall"), F.when(scored, n > 0).alias("hit"), F.when(scored, n == F.col("expected")).alias("all_sources"),
        F.when(scored, F.col("first_rank")).alias("first_rank"), F.when(scored, F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("reciprocal_rank"),
    )


def cutoff_summary(metrics: DataFrame) -> DataFrame:
    """Means at each cutoff over the cases that count."""
    return metrics.groupBy("k").agg(
        F.count("*").alias("cases"), F.count("recall").alias("scored"), F.avg("recall").alias("mean_recall"), F.avg("reciprocal_rank").alias("mrr"),
        F.count_if("hit").alias("hits"), F.count_if("all_sources").alias("complete"),
    )


def span_visibility(spans: DataFrame, supplied: DataFrame, ranges: DataFrame, query: str) -> DataFrame:
    """``visible`` of each span (passage_id, start, end): false if its passage is not supplied, unknown if
    the passage was not measured, else whether the retained ranges cover the span (adjacent ones jointly).

    ``ranges``: passage_id and an ordered array of struct<start, end>.
    """
    present = supplied.select(query, "passage_id").distinct().withColumn("_supplied", F.lit(True))
    joined = spans.join(present, [query, "passage_id"], "left").join(ranges.select("passage_id", "retained"), "passage_id", "left")
    reach = F.aggregate("retained", F.col("start").cast("bigint"), lambda at, r: F.when((r["start"] <= at) & (r["end"] > at), r["end"].cast("bigint")).otherwise(at))
    return joined.withColumn("visible", F.when(F.col("_supplied").isNull(), False).when(F.col("retained").isNotNull(), reach >= F.col("end"))).drop("_supplied", "retained")


def evidence_coverage(spans: DataFrame, case: str) -> tuple[DataFrame, DataFrame]:
    """Groups (case, group_id, covered) and cases (case, coverage, complete) from spans with ``visible``.

    All spans of an alternative, any alternative of a group, all groups of a case: Kleene logic throughout.
    """
    alternatives = spans.groupBy(case, "group_id", "alternative").agg(k_and(F.col("visible")).alias("covered"))
    groups = alternatives.groupBy(case, "group_id").agg(k_or(F.col("covered")).alias("covered"))
    known = F.count("covered") == F.count("*")
    cases = groups.groupBy(case).agg(F.when(known, F.avg(F.col("covered").cast("int"))).alias("coverage"), k_and(F.col("covered")).alias("complete"))
    return groups, cases


def coverage_loss(before: DataFrame, after: DataFrame, case: str) -> DataFrame:
    """Groups covered before that are ``lost`` (not covered) or ``unknown`` after: (case, group_id, change)."""
    known = before.filter("covered").join(after.select(case, "group_id", F.col("covered").alias("after"), F.lit(True).alias("_there")), [case, "group_id"], "left")
    change = F.when(F.col("_there").isNotNull() & F.col("after").isNull(), "unknown").when(~F.coalesce("after", F.lit(False)), "lost")
    return known.select(case, "group_id", change.alias("change")).filter("change is not null")


def paired_changes(before: DataFrame, after: DataFrame, case: str, deltas: Sequence[str] = ("group_coverage", "reciprocal_rank", "source_recall")) -> DataFrame:
    """One row per case of two runs over the same cases: the differences of ``deltas`` and the outcome of the change.

    Both sides: case, ``error`` (null: none), ``available`` (the cutoff was measured) and the metrics (null: not
    scored).  A case that only one side has, or has twice, fails the query.
    """
    side = lambda df, mark: df.groupBy(case).agg(F.count("*").alias(f"_n{mark}"), *[F.first(c).alias(f"{c}_{mark}") for c in ("error", "available", *deltas)])
    rows = side(before, "a").join(side(after, "b"), case, "full")
    paired = (F.col("_na") == 1) & (F.col("_nb") == 1)
    both = F.col("available_a") & F.col("available_b")
    differences = [F.when(both, F.col(f"{c}_b") - F.col(f"{c}_a")) for c in deltas]
    outcome = paired_outcome(F.col("error_a").isNotNull(), F.col("error_b").isNotNull(), both, F.array(*differences))
    guarded = F.when(F.coalesce(paired, F.lit(False)), outcome).otherwise(F.raise_error(F.lit("a paired comparison needs each case once on both sides")))
    return rows.select(case, *[d.alias(f"{c}_delta") for c, d in zip(deltas, differences, strict=True)], guarded.alias("outcome"))


def holm(tests: DataFrame, p: str, order: Sequence[str]) -> DataFrame:
    """Step-down adjusted p-values of one family of tests (a handful of rows)."""
    ordered = ", ".join([p, *order])
    ranked = tests.selectExpr("*", f"row_number() over (order by {ordered}) as _r", "count(*) over () as _m")
    return ranked.selectExpr("*", f"least(1.0D, max((_m - _r + 1) * {p}) over (order by _r rows unbounded preceding)) as p_holm").drop("_r", "_m")


def asked_only(groups: DataFrame, id_: str) -> DataFrame:
    """The groups that a question asks for: those whose id begins with ``part-``."""
    return groups.filter(F.startswith(F.col(id_), F.lit("part-")))


def set_differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: how many distinct values only one side has, and whether the sets are the same."""
    sides = [df.select(key, value).distinct().withColumn(mark, F.lit(True)) for df, mark in ((a, "_a"), (b, "_b"))]
    joined = sides[0].join(sides[1], [key, value], "full").groupBy(key)
    only = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    return joined.agg(only[0].alias("only_first"), only[1].alias("only_second"), (only[0] + only[1] == 0).alias("same"))


def run_pairs(runs: DataFrame, ids: DataFrame, run: str, id_: str) -> DataFrame:
    """Each unordered pair of ``runs`` (a small table) with how many of ``ids`` (run, id; distinct) both have and whether the first's are all in the second."""
    sides = [runs.join(ids.groupBy(run).agg(F.count("*").alias("n")), run, "left").fillna(0, ["n"]) for _ in "ab"]
    a, b = (df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns]) for df, side in zip(sides, "ab", strict=True))
    met = ids.select(F.col(run).alias(f"{run}_a"), id_).join(ids.select(F.col(run).alias(f"{run}_b"), id_), id_).filter(F.col(f"{run}_a") < F.col(f"{run}_b"))
    shared = met.groupBy(f"{run}_a", f"{run}_b").agg(F.count("*").alias("shared"))
    pairs = a.join(b, F.col(f"{run}_a") < F.col(f"{run}_b")).join(shared, [f"{run}_a", f"{run}_b"], "left").fillna(0, ["shared"])
    return pairs.withColumn("subset", F.col("shared") == F.col("n_a"))
