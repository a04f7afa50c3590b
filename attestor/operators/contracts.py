"""Contracts of datasets, labels, diagnostics, reviews and settings.

Each ``*_faults`` gives rows for what breaks a rule, named; a valid input gives none.  ``require_none``
turns any such row into an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators.validation import ranges_ordered

SHA256 = "^[a-f0-9]{64}$"


def require_none(faults: DataFrame) -> None:
    """Fail with the first fault, if there is one."""
    if (first := faults.head()) is not None:
        raise ValueError(f"contract broken: {first.asDict()}")


def _named(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, fault): a row for each rule that is true."""
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(*keys, F.explode(hits).alias("fault"))


def _blank(c: str) -> Column:
    return F.coalesce(T.strip(F.col(c)), F.lit("")) == ""


def case_faults(cases: DataFrame) -> DataFrame:
    """Faults of cases: id, category, expected_abstention, expected_source_ids, references (array of struct with source_id), required_claims, review_status, reviewer, review_date."""
    sources, cited = F.col("expected_source_ids"), F.transform("references", lambda r: r["source_id"])
    distinct = F.size(F.array_distinct(sources))
    reviewed = F.col("review_status") != "unreviewed"
    return _named(cases, ["id"], {
        "id": ~F.coalesce(F.col("id").rlike("^[a-z0-9-]+$"), F.lit(False)), "category": ~F.col("category").isin("factual", "comparison", "unanswerable"),
        "abstention": F.col("expected_abstention") != (F.col("category") == "unanswerable"), "repeated sources": distinct != F.size(sources),
        "sources without reference": (F.size(F.array_except(sources, cited)) > 0) | (F.size(F.array_except(cited, sources)) > 0),
        "nothing to answer": ~F.col("expected_abstention") & ((F.size(sources) == 0) | (F.size("required_claims") == 0)), "comparison of one source": (F.col("category") == "comparison") & (distinct < 2),
        "review without reviewer": reviewed & (_blank("reviewer") | F.col("review_date").isNull()), "draft with reviewer": ~reviewed & (~_blank("reviewer") | F.col("review_date").isNotNull()),
    })


def dataset_faults(datasets: DataFrame, cases: DataFrame, versions: DataFrame) -> DataFrame:
    """Faults of datasets (id, split, material, status, corpus_sha256) with their ``cases`` (dataset, id, question, review_status) and source ``versions`` (dataset, source_id)."""
    folded = F.lower(T.normalize_space(F.col("question")))
    counts = cases.groupBy("dataset").agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("id")).alias("same_ids"), (F.count("*") - F.count_distinct(folded)).alias("same_questions"), F.count_if(F.col("review_status") != "approved").alias("unapproved")
    )
    pins = versions.groupBy("dataset").agg(F.count("*").alias("pins"), (F.count("*") - F.count_distinct("source_id")).alias("same_pins"))
    rows = datasets.join(counts.withColumnRenamed("dataset", "id"), "id", "left").join(pins.withColumnRenamed("dataset", "id"), "id", "left").fillna(0)
    real, pinned, status, empty = F.col("material") == "real-corpus", F.coalesce(F.col("corpus_sha256").rlike(SHA256), F.lit(False)), F.col("status"), F.col("n") == 0
    pending, review = status == "pending-real-corpus", status == "pending-human-review"
    return _named(rows, ["id"], {
        "repeated cases": F.col("same_ids") > 0, "repeated questions": F.col("same_questions") > 0, "hash": F.col("corpus_sha256").isNotNull() & ~pinned,
        "pending corpus": pending & (~empty | F.col("corpus_sha256").isNotNull() | ~real), "pending review": review & (~empty | ~pinned | ~real), "not runnable": ~pending & ~review & (empty | ~pinned),
        "frozen without approval": (status == "frozen") & (F.col("unapproved") > 0), "synthetic held-out": (F.col("split") == "held-out") & ~real,
        "repeated versions": F.col("same_pins") > 0, "unpinned sources": real & ~empty & (F.col("pins") == 0),
    })


def label_faults(spans: DataFrame, groups: DataFrame, cases: DataFrame, passages: DataFrame) -> DataFrame:
    """Faults of evidence labels, by case.

    ``spans``: case_id, group_id, alternative, passage_id, start, end, quote; ``groups``: case_id, group_id, claim_index;
    ``cases``: id, expected_abstention, expected_source_ids, required_claims; ``passages``: passage_id, document_id, text.
    """
    known = groups.join(cases, groups["case_id"] == cases["id"], "left")
    first = _named(known.select("case_id", "id", "expected_abstention").distinct(), ["case_id"], {"unknown case": F.col("id").isNull(), "case without answer": F.col("expected_abstention")})
    per_case = known.filter("id is not null").groupBy("case_id", "required_claims").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("ids"), F.collect_set("claim_index").alias("claims"))
    wanted = F.when(F.size("required_claims") > 0, F.sequence(F.lit(0), F.size("required_claims") - 1)).otherwise(F.array().cast("array<int>"))
    uncovered = (F.size(F.array_except(wanted, F.col("claims").cast("array<int>"))) > 0) | (F.size(F.array_except(F.col("claims").cast("array<int>"), wanted)) > 0)
    second = _named(per_case, ["case_id"], {"repeated groups": F.col("n") != F.col("ids"), "claims not covered": uncovered})
    text = passages.select("passage_id", "document_id", F.col("text").alias("_text"))
    each = spans.join(text, "passage_id", "left").join(cases.select(F.col("id").alias("case_id"), "expected_source_ids"), "case_id", "left")
    quoted = F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    third = _named(each, ["case_id"], {
        "unknown passage": F.col("_text").isNull(), "unexpected source": ~F.array_contains("expected_source_ids", F.col("document_id")),
        "span": (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("_text")) | (quoted != F.col("quote")),
    })
    return first.unionAll(second).unionAll(third).unionAll(option_faults(spans))


def option_faults(spans: DataFrame) -> DataFrame:
    """Spans that repeat within an alternative, and alternatives of a group with the same spans."""
    key = ["passage_id", "start", "end"]
    options = spans.groupBy("case_id", "group_id", "alternative").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.struct(*key))).alias("spans"))
    twice = options.filter(F.col("n") != F.size("spans")).select("case_id", F.lit("repeated spans").alias("fault"))
    same = options.groupBy("case_id", "group_id", "spans").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("repeated alternatives").alias("fault"))
    return twice.unionAll(same)


def encoding_faults(diagnostics: DataFrame, passages: DataFrame, max_tokens: int, pair: bool = False) -> DataFrame:
    """Faults of an encoder's measurements (passage_id, text_sha256, input_tokens, encoded_tokens, truncated, retained_ranges), or of a reranker's (``pair``).

    A text is truncated exactly when its ranges retain less than all of it, and then tokens are lost (for a pair they
    may be the question's).
    """
    joined = diagnostics.join(passages.select("passage_id", F.length("text").alias("_n"), F.sha2("text", 256).alias("_sha")), "passage_id", "left")
    counts = joined.groupBy("passage_id").agg(F.count("*").alias("n")).filter("n > 1").select("passage_id", F.lit("repeated").alias("fault"))
    retained = F.aggregate("retained_ranges", F.lit(0).cast("bigint"), lambda acc, r: acc + r["end"] - r["start"])
    same = F.col("input_tokens") == F.col("encoded_tokens")
    return counts.unionAll(_named(joined, ["passage_id"], {
        "unknown passage": F.col("_sha").isNull(), "other text": F.col("_sha") != F.col("text_sha256"),
        "counts": (F.col("input_tokens") < 1) | (F.col("encoded_tokens") < 1) | (F.col("encoded_tokens") > F.least("input_tokens", F.lit(max_tokens))),
        "ranges": ~ranges_ordered(F.col("retained_ranges"), F.col("_n")), "flag": F.col("truncated") != (retained < F.col("_n")), "no token lost": F.col("truncated") & same,
    }))


def pair_faults(diagnostics: DataFrame, passages: DataFrame, max_tokens: int) -> DataFrame:
    """Faults of a reranker's measurements of question and passage together."""
    return encoding_faults(diagnostics, passages, max_tokens, pair=True)


def reference_faults(references: DataFrame, passages: DataFrame) -> DataFrame:
    """References (passage_id, document_id, paragraph, section, locator) that their passage contradicts; a null section or locator claims nothing."""
    fields = ("document_id", "paragraph", "section", "locator")
    joined = references.join(passages.select("passage_id", *[F.col(c).alias(f"_{c}") for c in fields]), "passage_id", "left")
    other = {c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fields}
    rules = {"unknown passage": F.col("_document_id").isNull()} | {c: F.col("_document_id").isNotNull() & rule for c, rule in other.items()}
    return _named(joined, ["passage_id"], rules)


def review_faults(review: DataFrame, results: DataFrame, reviewed_sha256: str, run_sha256: str) -> DataFrame:
    """Faults of a review (case_id, status, correctness, citation_support, abstention, sections array<int>) of a run's ``results`` (case_id, answer_status, n_sections)."""
    joined = review.withColumn("_r", F.lit(1)).join(results.withColumn("_x", F.lit(1)), "case_id", "full")
    generated = F.coalesce(F.col("answer_status").isin("answered", "insufficient_evidence"), F.lit(False))
    scored = reduce(Column.__or__, (~F.coalesce(F.col(c) == "not-applicable", F.lit(False)) for c in ("correctness", "citation_support", "abstention")))
    wanted = F.when(F.col("n_sections") > 0, F.sequence(F.lit(0), F.col("n_sections") - 1)).otherwise(F.array().cast("array<int>"))
    repeated = review.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("repeated").alias("fault"))
    rules = {
        "other run": F.lit(reviewed_sha256 != run_sha256), "no review": F.col("_r").isNull(), "unknown case": F.col("_x").isNull(),
        "sections": F.sort_array(F.col("sections").cast("array<int>")) != wanted, "scores without answer": (F.col("status") == "complete") & ~generated & scored,
    }
    return _named(joined, ["case_id"], rules).unionAll(repeated)


def study_faults(cases: DataFrame, rankings: DataFrame, size: int, negatives: int) -> DataFrame:
    """Faults of an answer study's input: other numbers of cases or negatives than planned, cases not approved, rankings that lack a case or have gaps.

    ``cases``: id, expected_abstention, review_status; ``rankings``: case_id, rank, passage_id.
    """
    totals = cases.agg(F.count("*").alias("n"), F.count_if("expected_abstention").alias("negatives"), F.count_if(F.col("review_status") != "approved").alias("unapproved"))
    first = _named(totals, ["n"], {"cases": F.col("n") != size, "negatives": F.col("negatives") != negatives, "not approved": F.col("unapproved") > 0}).select(F.lit(None).cast("string").alias("id"), "fault")
    ranks = rankings.groupBy("case_id").agg(F.max("rank").alias("last"), F.count("*").alias("n"), F.count_distinct("rank").alias("ranks"), F.count_distinct("passage_id").alias("passages"))
    joined = cases.select("id").join(ranks.withColumnRenamed("case_id", "id"), "id", "full")
    gaps = (F.col("last") != F.col("n")) | (F.col("ranks") != F.col("n")) | (F.col("passages") != F.col("n"))
    return first.unionAll(_named(joined, ["id"], {"no ranking": F.col("n").isNull(), "ranking": gaps}))


def configuration_faults(configurations: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Configurations whose ranking hash no run has, or more than one."""
    counts = runs.groupBy(key).agg(F.count("*").alias("n"))
    return _named(configurations.join(counts, key, "left"), [key], {"no run": F.col("n").isNull(), "several runs": F.col("n") > 1})


def merged(parts: list[DataFrame], expected: DataFrame, case: str, order: str) -> DataFrame:
    """Workers' results as one table in the order of ``expected`` (case, order); fails unless every case is there once, without error."""
    rows = reduce(DataFrame.unionByName, parts)
    counts = rows.groupBy(case).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull() | F.col("answer_correct").isNull() & F.col("unscored")).alias("bad"))
    faults = expected.select(case).join(counts, case, "full").join(expected.select(case, F.lit(True).alias("_known")), case, "left")
    require_none(_named(faults, [case], {"missing": F.col("n").isNull(), "repeated": F.col("n") > 1, "unknown": F.col("_known").isNull(), "incomplete": F.col("bad") > 0}))
    return rows.join(expected.select(case, order), case).orderBy(order)
