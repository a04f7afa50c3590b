"""Scoring of cited answers: receipts, metrics, costs, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions.kleene import all_of


def quote_verified(quote: Column, passage: Column, normalized: bool = True) -> Column:
    """Whether the passage contains the quote, exactly or after receipt normalization; a blank quote proves nothing."""
    exact, present = F.contains(passage, quote), T.strip(quote) != ""
    if not normalized:
        return exact & present
    return (exact | F.contains(T.receipt(passage), T.receipt(quote))) & present & (T.receipt(quote) != "")


def citation_value(judged: Column, verbatim: Column, verified: Column) -> Column:
    """A section quoted verbatim is supported; a judged support without a verified quote is unknown."""
    return F.when(verbatim, True).when(judged & ~verified, F.lit(None).cast("boolean")).otherwise(judged)


def ids_known(cited: Column, visible: Column) -> Column:
    return F.size(F.array_except(cited, visible)) == 0


def answer_valid(status: Column, sections: Column, cited: Column, visible: Column) -> Column:
    """Answered needs sections, an abstention has none, and citations must be visible."""
    return (F.when(status == "answered", sections > 0).otherwise(sections == 0)) & ids_known(cited, visible)


def score(answers: DataFrame) -> DataFrame:
    """Metrics of judged answers.

    ``answers``: answerable, status, claims, qualifications, forbidden, citations (arrays of nullable
    boolean).  Abstention metrics hold for every case, claim metrics for answerable ones only.
    """
    answered, abstained = F.col("status") == "answered", F.col("status") == "abstained"
    answerable = F.col("answerable")
    return answers.withColumns({
        "correct_abstention": F.when(~answerable, abstained), "false_abstention": F.when(answerable, abstained), "unsupported_answer": F.when(~answerable, answered),
        "complete_claims": F.when(answerable, F.when(abstained, False).otherwise(all_of(F.col("claims")))),
        "complete_qualifications": F.when(answerable & (F.size("qualifications") > 0), F.when(abstained, False).otherwise(all_of(F.col("qualifications")))),
        "no_forbidden": F.when(answered, all_of(F.transform("forbidden", lambda v: ~v))),
        "citations_supported": F.when(answered & (F.size("citations") > 0), all_of(F.col("citations"))),
        "claim_share": F.when(answerable & (F.size("claims") > 0), F.size(F.filter("claims", lambda v: v)) / F.size("claims")),
    })


def cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Dollars at prices a million tokens."""
    return (input_tokens * input_price + output_tokens * output_price) / 1e6


def token_bound(text: Column, framing: int = 8192) -> Column:
    """No tokenizer makes more tokens than UTF-8 bytes; framing is added."""
    return F.octet_length(text) + framing


def candidates(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Items to grade: one row for each claim, qualification, forbidden claim (inverted) and citation."""
    def part(column: str, kind: str, value) -> DataFrame:
        rows = answers.select(*keys, F.posexplode(column).alias("item", "v"))
        return rows.select(*keys, F.lit(kind).alias("kind"), "item", value(F.col("v")).alias("value"))

    kinds = [("claims", "claim"), ("qualifications", "qualification"), ("forbidden", "forbidden"), ("citations", "citation")]
    out = None
    for column, kind in kinds:
        rows = part(column, kind, (lambda v: ~v) if kind == "forbidden" else (lambda v: v))
        out = rows if out is None else out.unionByName(rows)
    return out


def quality_report(scores: DataFrame, run: str, cohort: str, metric: str, value: str) -> DataFrame:
    """Successes, scored and unscored per run and metric, for all cases and for each cohort."""
    grouped = scores.groupingSets([[F.col(run), F.col(metric)], [F.col(run), F.col(metric), F.col(cohort)]], F.col(run), F.col(metric), F.col(cohort))
    out = grouped.agg(F.grouping(cohort).alias("_all"), F.count_if(F.col(value)).alias("successes"), F.count(value).alias("scored"), (F.count(F.lit(1)) - F.count(value)).alias("unscored"))
    return out.select(run, metric, F.when(F.col("_all") == 1, "all").otherwise(F.col(cohort)).alias("cohort"), "successes", "scored", "unscored")


# What a reader is shown for each status.
HEADINGS = {
    "answered": "Answer with source references",
    "insufficient_evidence": "Insufficient evidence",
    "no_matches": "No matching passages",
    "passages_found": "Retrieved passages",
}


def heading(status: Column) -> Column:
    """What a reader is shown for a status; nothing for an unknown one."""
    return reduce(lambda c, pair: c.when(status == pair[0], pair[1]), HEADINGS.items(), F.when(F.lit(False), ""))


def cited(sections: Column, visible: Column) -> Column:
    """Each section's citations, in order: struct<section, citation_id, number>; the number is the passage's place from 1 (0: not shown)."""
    ids = F.transform(visible, lambda p: p["id"])
    return F.flatten(F.transform(sections, lambda s, i: F.transform(s["citation_ids"], lambda c: F.struct(i.alias("section"), c.alias("citation_id"), F.array_position(ids, c).cast("int").alias("number")))))
