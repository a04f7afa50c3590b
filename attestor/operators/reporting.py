"""Summaries of evaluated runs: cutoffs, references, contexts, whole runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.stats import hoeffding, mcnemar

#: What a configuration must reach.
TARGETS = {"passage_recall_at_4": 0.8, "context_hit": 0.9, "complete_evidence": 0.8, "both_documents": 0.9, "mrr_at_4": 0.65}
BINARY = ("context_hit", "complete_evidence", "both_documents")


def _mean(value: Column) -> Column:
    return F.avg(value.cast("double"))


def case_metrics(cases: DataFrame, sources: DataFrame, references: DataFrame, hits: DataFrame, relevant: DataFrame, case: str, cutoffs: Sequence[int]) -> DataFrame:
    """Per case and cutoff k: source_recall, passage_recall, first_relevant_rank, reciprocal_rank, all_sources.

    ``cases``: case, expected_abstention; ``sources``: case, document_id (expected); ``references``: case, passage_id;
    ``hits``: case, document_id, passage_id, rank; ``relevant``: case, passage_id (of the evidence labels, or the
    references).  All is null for a case that expects an abstention; a case without hits counts zero.
    """
    at = cases.select(case, "expected_abstention", F.explode(F.array(*map(F.lit, cutoffs))).alias("k"))

    def first_ranks(wanted: DataFrame, id_: str) -> DataFrame:
        wanted = wanted.select(case, id_).distinct()
        return wanted.join(hits.groupBy(case, id_).agg(F.min("rank").alias("rank")), [case, id_], "left")

    def counted(ranks: DataFrame, name: str) -> DataFrame:
        within = ranks.join(at.select(case, "k"), case)
        return within.groupBy(case, "k").agg(F.count("*").alias(f"n_{name}"), F.count_if(F.col("rank") <= F.col("k")).alias(f"{name}"), F.min(F.when(F.col("rank") <= F.col("k"), F.col("rank"))).alias(f"first_{name}"))

    parts = [counted(first_ranks(df, id_), name) for df, id_, name in ((sources, "document_id", "source"), (references, "passage_id", "passage"), (relevant, "passage_id", "relevant"))]
    rows = reduce(lambda a, b: a.join(b, [case, "k"], "left"), parts, at)
    scored = ~F.col("expected_abstention")
    return rows.select(
        case, "k", F.when(scored, F.col("source") / F.col("n_source")).alias("source_recall"), F.when(scored, F.col("passage") / F.col("n_passage")).alias("passage_recall"),
        F.when(scored, F.col("first_relevant")).alias("first_relevant_rank"), F.when(scored, F.coalesce(1 / F.col("first_relevant"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(scored, F.col("source") == F.col("n_source")).alias("all_sources"),
    )


def cutoff_report(metrics: DataFrame, cases: DataFrame, case: str, cutoffs: Sequence[int]) -> DataFrame:
    """At each cutoff, over the answerable cases: means, labelled cases, group coverage and complete evidence.

    ``metrics``: case, k, reciprocal_rank, source_recall, passage_recall, group_coverage, complete_evidence.  A cutoff
    that any answerable case lacks is not available.
    """
    at = cases.filter("not expected_abstention").select(case, F.explode(F.array(*map(F.lit, cutoffs))).alias("k"))
    rows = at.join(metrics.withColumn("_present", F.lit(True)), [case, "k"], "left")
    labeled, complete = F.col("group_coverage").isNotNull(), F.col("group_coverage").isNotNull() & F.col("complete_evidence")
    found = rows.groupBy("k").agg(
        F.count("*").alias("answerable_cases"), (F.count("_present") == F.count("*")).alias("available"), _mean(F.col("reciprocal_rank")).alias("mrr"),
        _mean(F.col("source_recall")).alias("source_recall"), _mean(F.col("passage_recall")).alias("passage_recall"), F.count_if(labeled).alias("evidence_labeled_cases"),
        _mean(F.col("group_coverage")).alias("mean_group_coverage"), F.count_if(complete).alias("complete_evidence_cases"),
    )
    found = found.withColumn("complete_evidence_rate", F.col("complete_evidence_cases") / F.nullif(F.col("evidence_labeled_cases"), F.lit(0)))
    return found.select("k", "answerable_cases", "available", *[F.when(F.col("available"), F.col(c)).alias(c) for c in found.columns[3:]])


def reference_scores(cases: DataFrame, sources: DataFrame, references: DataFrame, hits: DataFrame, context: DataFrame, case: str) -> DataFrame:
    """Scores of each case by its references, in the ranking's first four and in the context that was supplied.

    ``context``: case, document_id, passage_id, place (from 1), of the passages with visible text.  Cases that expect an
    abstention are not scored; ``both_documents`` is for cases of several expected sources.
    """
    wanted = references.select(case, "passage_id").distinct()
    found = wanted.join(hits.groupBy(case, "passage_id").agg(F.min("rank").alias("rank")), [case, "passage_id"], "left")
    found = found.join(context.groupBy(case, "passage_id").agg(F.min("place").alias("place")), [case, "passage_id"], "left")
    first = F.when(F.col("rank") <= 4, F.col("rank"))
    by_case = found.groupBy(case).agg(
        F.count("*").alias("reference_count"), F.count(first).alias("references_found_at_4"), F.min(first).alias("_rank"), F.count("place").alias("_supplied"), F.min("place").alias("_place"),
    )
    expected = sources.select(case, "document_id").distinct()
    met = expected.join(context.select(case, "document_id").distinct().withColumn("_in", F.lit(True)), [case, "document_id"], "left")
    documents = met.groupBy(case).agg(F.count("*").alias("_sources"), F.count("_in").alias("_found"))
    rows = cases.filter("not expected_abstention").select(case).join(by_case, case).join(documents, case, "left")
    n = F.col("reference_count")
    return rows.select(
        case, (F.col("references_found_at_4") / n).alias("passage_recall_at_4"), F.coalesce(1 / F.col("_rank"), F.lit(0.0)).alias("mrr_at_4"), (F.col("_supplied") > 0).alias("context_hit"),
        (F.col("_supplied") == n).alias("complete_evidence"), F.when(F.col("_sources") > 1, F.col("_found") == F.col("_sources")).alias("both_documents"),
        (F.col("_supplied") / n).alias("context_passage_recall"), F.coalesce(1 / F.col("_place"), F.lit(0.0)).alias("context_mrr"), "reference_count", "references_found_at_4",
    )


def reference_summary(scores: DataFrame) -> DataFrame:
    """Each metric's mean over the cases that have it, its target and whether it is reached (on the unrounded mean).

    ``low`` and ``high``: Hoeffding's interval of means; binary metrics have ``successes`` instead, whose exact interval
    ``scoring.with_interval`` gives.  ``micro_recall_at_4`` counts references, which depend on each other within a case.
    """
    names = [*TARGETS, "context_passage_recall", "context_mrr"]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(m in BINARY).alias("binary"), F.lit(TARGETS.get(m)).cast("double").alias("target")) for m in names]))
    rows = scores.select(each.alias("m")).select("m.*").groupBy("metric", "binary", "target").agg(F.avg("value").alias("estimate"), F.count("value").alias("denominator"), F.sum("value").alias("total"))
    low, high = hoeffding(F.col("estimate"), F.col("denominator"))
    rows = rows.select(
        "metric", "estimate", "denominator", F.when(F.col("binary"), F.col("total").cast("long")).alias("successes"), F.when(~F.col("binary"), low).alias("low"),
        F.when(~F.col("binary"), high).alias("high"), "target", (F.col("estimate") >= F.col("target")).alias("passed"),
    )
    n, k = F.sum("reference_count"), F.sum("references_found_at_4")
    none = F.lit(None).cast("double")
    micro = scores.agg(F.lit("micro_recall_at_4").alias("metric"), (k / F.nullif(n, F.lit(0))).alias("estimate"), F.coalesce(n, F.lit(0)).alias("denominator"), F.coalesce(k, F.lit(0)).alias("successes"))
    return rows.unionByName(micro.select("metric", "estimate", "denominator", "successes", none.alias("low"), none.alias("high"), none.alias("target"), F.lit(None).cast("boolean").alias("passed")))


def mcnemar_pairs(before: DataFrame, after: DataFrame, case: str, metrics: Sequence[str] = BINARY) -> DataFrame:
    """Gains, losses and exact p of each binary metric between two tables of the same cases; pairs with an unknown side are counted apart."""
    each = lambda df, name: df.select(case, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])).alias("m")).select(case, "m.*")
    rows = each(before, "a").join(each(after, "b"), [case, "metric"])
    a, b = F.col("a"), F.col("b")
    found = rows.groupBy("metric").agg(
        F.count_if(a.isNotNull() & b.isNotNull()).alias("paired_cases"), F.count_if(a.isNull() | b.isNull()).alias("excluded_unscored_cases"), F.count_if(~a & b).alias("gains"),
        F.count_if(a & ~b).alias("losses"), F.count_if(a & b).alias("both_complete"), F.count_if(~a & ~b).alias("neither_complete"),
    )
    return found.withColumn("p_two_sided", mcnemar("gains", "losses"))


def context_summary(profiles: DataFrame, cases: DataFrame, case: str) -> DataFrame:
    """Per budget, view and cohort (``all`` too): coverage of the answerable cases, and what the contexts took.

    ``profiles``: case, budget, view, complete_evidence, group_coverage, input_tokens, passages, serialized_chars;
    ``cases``: case, expected_abstention, query_style (null: unspecified).  A budget that any answerable case lacks is not available.
    """
    grid = cases.select(case, "expected_abstention", F.coalesce("query_style", F.lit("unspecified")).alias("cohort")).crossJoin(F.broadcast(profiles.select("budget", "view").distinct()))  # a handful of budgets and views
    rows = grid.join(profiles.withColumn("_present", F.lit(True)), [case, "budget", "view"], "left")
    answerable = ~F.col("expected_abstention")
    labeled = answerable & F.col("complete_evidence").isNotNull()
    of = lambda c: F.when(answerable, F.col(c))
    sets = [[F.col("budget"), F.col("view")], [F.col("budget"), F.col("view"), F.col("cohort")]]
    found = rows.groupingSets(sets, F.col("budget"), F.col("view"), F.col("cohort")).agg(
        F.grouping("cohort").alias("_all"), F.count("*").alias("total_cases"), F.count_if(~answerable).alias("unscored_abstention_cases"), (F.count_if(answerable & F.col("_present").isNull()) == 0).alias("available"),
        F.count_if(labeled).alias("labeled_cases"), F.count_if(labeled & F.col("complete_evidence")).alias("complete_evidence_cases"), F.avg(F.when(labeled, F.col("group_coverage"))).alias("mean_group_coverage"),
        F.avg(of("input_tokens")).alias("mean_tokens"), F.median(of("input_tokens")).alias("median_tokens"), F.min(of("input_tokens")).alias("min_tokens"), F.max(of("input_tokens")).alias("max_tokens"),
        F.avg(of("passages")).alias("mean_passages"), F.avg(of("serialized_chars")).alias("mean_serialized_chars"),
    )
    found = found.withColumn("cohort", F.when(F.col("_all") == 1, "all").otherwise(F.col("cohort"))).drop("_all")
    return found.withColumn("complete_evidence_rate", F.col("complete_evidence_cases") / F.nullif(F.col("labeled_cases"), F.lit(0)))


def run_report(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per run: what the rows of a run say in sum.

    ``results``: expected_abstention, category, error (null: none), source_recall, passage_recall, reciprocal_rank, all_sources,
    answer_status, n_hits, retrieval_ms, latency_ms, stable, truncated_passages, omitted_passages, lost_groups, unknown_groups,
    input_tokens, output_tokens, cost_usd.  ``_with_failures`` means count a failed case as zero.
    """
    answerable, failed, comparison = ~F.col("expected_abstention"), F.col("error").isNotNull(), F.col("category") == "comparison"
    generated = F.coalesce(F.col("answer_status").isin("answered", "insufficient_evidence"), F.lit(False))
    abstained = F.coalesce(F.col("answer_status") == "insufficient_evidence", F.lit(False))
    zero = lambda c, rows=answerable: F.avg(F.when(rows, F.coalesce(F.col(c), F.lit(0.0))))
    return results.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count_if(failed).alias("errors"), F.count("source_recall").alias("recall_scored"), F.avg("source_recall").alias("mean_source_recall"),
        F.count_if(answerable).alias("answerable_cases"), zero("source_recall").alias("mean_source_recall_with_failures"), zero("passage_recall").alias("mean_passage_recall_with_failures"),
        zero("reciprocal_rank").alias("mrr_with_failures"), F.count_if(comparison).alias("comparison_cases"), F.count_if(comparison & F.col("all_sources")).alias("comparison_full_coverage"),
        zero("source_recall", comparison).alias("comparison_mean_source_recall"), F.count_if(generated).alias("generated_answers"), F.count_if(generated & ~answerable).alias("generated_unanswerable_cases"),
        F.count_if(generated & answerable).alias("generated_answerable_cases"), F.count_if(abstained).alias("automatic_full_abstentions"), F.count_if(abstained & ~answerable).alias("automatic_abstentions_unanswerable"),
        F.count_if(abstained & answerable).alias("automatic_false_abstentions"), F.count_if(F.col("retrieval_ms").isNotNull() & (F.col("n_hits") == 0)).alias("no_match_cases"),
        F.median("latency_ms").alias("median_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.count("retrieval_ms").alias("query_timing_samples"), F.median("retrieval_ms").alias("query_median_ms"),
        F.expr("percentile_disc(0.95) within group (order by retrieval_ms)").alias("query_p95_ms"), F.max("retrieval_ms").alias("query_max_ms"), F.count_if(~F.col("stable")).alias("unstable_ranking_cases"),
        F.sum("truncated_passages").alias("context_truncated_passages"), F.sum("omitted_passages").alias("context_omitted_passages"), F.count_if(F.col("lost_groups") > 0).alias("evidence_loss_cases"),
        F.count_if(F.col("unknown_groups") > 0).alias("evidence_unknown_cases"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens_known"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens_known"),
        F.count_if(F.col("input_tokens").isNull() | F.col("output_tokens").isNull()).alias("unknown_usage_cases"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd_known"),
        F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost_cases"),
    )
