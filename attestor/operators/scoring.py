"""Scores of judged answers, the pool of decisions to grade, and agreement with graders.

An answer is a row: the case (``expected_abstention``, ``n_required``, ``n_qualifications``,
``n_forbidden``), the answer (``status``, null if there is none; ``sections`` array<struct<text,
citation_ids>>), what the model saw (``visible`` array<struct<id, text>>) and the judgment (a struct,
null if none was made): ``required``, ``qualifications``, ``forbidden``, ``supported`` (arrays of nullable
boolean, the last a section each) and ``citations`` (array<struct<section_index, citation_id, value,
quotes>>).  Three-valued logic throughout: a missing judgment is unknown, never false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions.kleene import all_of, k_and
from attestor.functions.stats import clopper_pearson
from attestor.operators.answers import quote_verified
from attestor.operators.sampling import stable_order

GENERATED = ("answered", "insufficient_evidence")
#: Metrics that are true, false or unknown.
METRICS = ("required_claims_met", "qualifications_preserved", "no_forbidden_claims", "citation_ids_valid", "citation_support", "abstention_correct", "negative_abstention_correct", "answer_correct")
#: Of these, those that no judge decides.
DETERMINISTIC = ("citation_ids_valid", "abstention_correct", "negative_abstention_correct")


def citation_values(normalized: bool) -> Column:
    """The judged citations with ``value`` as far as it can be verified.

    A section that stands in the passage is supported.  Support that the judge claims without quotes, or with
    one that the passage lacks, is unknown.  ``normalized``: quotes are compared after receipt normalization too.
    """

    def passage(c: Column) -> Column:
        return F.coalesce(F.get(F.transform(F.filter("visible", lambda p: p["id"] == c["citation_id"]), lambda p: p["text"]), F.lit(0)), F.lit(""))

    def value(c: Column) -> Column:
        shown, section = passage(c), T.strip(F.get(F.col("sections"), c["section_index"])["text"])
        verbatim = (section != "") & F.contains(shown, section)
        bad = F.exists(c["quotes"], lambda q: ~quote_verified(q, shown, normalized))
        unverified = (F.size(c["quotes"]) == 0) | bad
        if not normalized:  # a blank section stands in any passage
            unverified = unverified & ~F.contains(shown, section)
        return F.when(verbatim, True).when(c["value"] & unverified, F.lit(None).cast("boolean")).otherwise(c["value"])

    return F.transform("judgment.citations", lambda c: F.struct(c["section_index"].alias("section_index"), c["citation_id"].alias("citation_id"), c["value"].alias("raw"), value(c).alias("value")))


def _pairs() -> Column:
    """Each section's citations as text, to compare with those that were judged."""
    return F.array_distinct(F.flatten(F.transform("sections", lambda s, i: F.transform(s["citation_ids"], lambda c: F.concat_ws(":", i.cast("string"), c)))))


def judgment_fault() -> Column:
    """What a judgment lacks: decisions for all claims and sections, and exactly the answer's citations."""
    sizes = [("required", F.col("n_required")), ("qualifications", F.col("n_qualifications")), ("forbidden", F.col("n_forbidden")), ("supported", F.size("sections"))]
    short = reduce(Column.__or__, (F.size(f"judgment.{c}") != n for c, n in sizes))
    judged = F.array_distinct(F.transform("judgment.citations", lambda c: F.concat_ws(":", c["section_index"].cast("string"), c["citation_id"])))
    astray = (F.size(F.array_except(_pairs(), judged)) > 0) | (F.size(F.array_except(judged, _pairs())) > 0)
    known = F.col("judgment").isNotNull() & (F.size("sections") > 0)
    return F.when(known & short, "incomplete decisions").when(known & astray, "citations differ")


def score_answers(answers: DataFrame, normalized: bool = False) -> DataFrame:
    """``answers`` with every metric (columns of METRICS, ``required_claim_coverage``, ``qualification_preservation``) and ``fault``.

    Where the judgment has a fault every metric that needs it is unknown.
    """
    rows = answers.withColumn("sections", F.coalesce("sections", F.expr("cast(array() as array<struct<text:string,citation_ids:array<string>>>)"))).withColumn("fault", judgment_fault())
    some, judged = F.size("sections") > 0, F.col("judgment").isNotNull() & F.col("fault").isNull()
    generated = F.coalesce(F.col("status").isin(*GENERATED), F.lit(False))
    abstained = generated & (F.col("status") == "insufficient_evidence") & ~some
    ids = F.transform("visible", lambda p: p["id"])
    valid = generated & F.forall("sections", lambda s: (F.size(s["citation_ids"]) > 0) & (T.strip(s["text"]) != "") & (F.size(F.array_except(s["citation_ids"], ids)) == 0))

    def decisions(field: str, n: str) -> Column:
        unknown, missing = F.array_repeat(F.lit(None).cast("boolean"), F.col(n)), F.array_repeat(F.lit(False), F.col(n))
        return F.when(~some, missing).when(judged, F.col(f"judgment.{field}")).otherwise(unknown)

    rows = rows.withColumns({
        "generated": generated, "abstained": F.coalesce(abstained, F.lit(False)), "valid": F.coalesce(valid, F.lit(False)),
        "required": decisions("required", "n_required"), "preserved": decisions("qualifications", "n_qualifications"), "avoided": F.transform(decisions("forbidden", "n_forbidden"), lambda v: ~v),
    })
    values = F.concat(F.transform(citation_values(normalized), lambda c: c["value"]), F.col("judgment.supported"))
    rows = rows.withColumn("support", F.when(~some, F.col("abstained")).when(judged, all_of(values)))
    negative = F.col("expected_abstention")
    share = lambda v: F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), F.size(F.filter(v, lambda x: x)) / F.size(v))
    correct = F.col("generated") & (F.col("abstained") == negative)
    qualified = F.when(negative & F.col("abstained"), True).otherwise(all_of(F.col("preserved")))
    whole = all_of(F.array(F.col("generated"), correct, F.col("valid"), F.col("support"), all_of(F.col("required")), qualified, all_of(F.col("avoided"))))
    return rows.select(
        *answers.columns, "fault", share("required").alias("required_claim_coverage"), F.when(~negative, share("preserved")).alias("qualification_preservation"),
        F.when(F.size("required") > 0, all_of(F.col("required"))).alias("required_claims_met"), F.when((F.size("preserved") > 0) & ~negative, all_of(F.col("preserved"))).alias("qualifications_preserved"),
        all_of(F.col("avoided")).alias("no_forbidden_claims"), F.when(some, F.col("valid")).alias("citation_ids_valid"), F.when(some, F.col("support")).alias("citation_support"),
        correct.alias("abstention_correct"), F.when(negative, correct).alias("negative_abstention_correct"), whole.alias("answer_correct"),
    )


def by_metric(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value): a row for each of METRICS."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    return scores.select(*keys, each.alias("m")).select(*keys, "m.metric", "m.value")


def with_interval(summary: DataFrame, passes: str = "successes", n: str = "scored") -> DataFrame:
    """A summary with the exact 95% interval of its passes."""
    return summary.withColumn("_i", clopper_pearson(passes, n)).select(*summary.columns, F.col("_i.low").alias("ci_low"), F.col("_i.high").alias("ci_high"))


def grading_pool(answers: DataFrame, keys: list[str], normalized: bool = False) -> DataFrame:
    """Every decision that a grader may check: keys, type, subtype, section_index, citation_id, item_index, requirement, prediction, raw.

    Claims, qualifications and forbidden claims (inverted, unknown stays unknown), citations (decisions of one section
    and passage together: any false wins), each section's set of citations, and each answer's status.  ``answers`` also has
    the texts ``required_claims``, ``required_qualifications``, ``forbidden_claims`` and ``abstention_correct`` of score_answers.
    """
    judged = answers.filter("judgment is not null and size(sections) > 0")
    empty = {"subtype": F.lit(None).cast("string"), "section_index": F.lit(None).cast("int"), "citation_id": F.lit(None).cast("string"), "item_index": F.lit(None).cast("int"), "raw": F.lit(None).cast("boolean")}

    def part(rows: DataFrame, kind: str, **values: Column) -> DataFrame:
        columns = empty | values
        return rows.select(*keys, F.lit(kind).alias("type"), *[columns[c].alias(c) for c in ("subtype", "section_index", "citation_id", "item_index", "requirement", "prediction", "raw")])

    parts = []
    for kind, field, label in (("required_claim", "required", "required_claims"), ("qualification", "qualifications", "required_qualifications"), ("forbidden_claim", "forbidden", "forbidden_claims")):
        rows = judged.select(*keys, label, F.posexplode(f"judgment.{field}").alias("i", "v"))
        parts.append(part(rows, kind, item_index=F.col("i"), requirement=F.get(F.col(label), F.col("i")), prediction=~F.col("v") if kind == "forbidden_claim" else F.col("v"), raw=F.col("v")))
    cited = judged.select(*keys, F.explode(citation_values(normalized)).alias("c")).groupBy(*keys, "c.section_index", "c.citation_id").agg(k_and(F.col("c.value")).alias("v"), k_and(F.col("c.raw")).alias("r"))
    question = F.lit("Does the target citation support a substantive part of this section?")
    parts.append(part(cited, "citation", subtype=F.lit("single"), section_index=F.col("section_index"), citation_id=F.col("citation_id"), requirement=question, prediction=F.col("v"), raw=F.col("r")))
    sets = judged.select(*keys, F.posexplode("judgment.supported").alias("i", "v"))
    question = F.lit("Does this section's citation set support every substantive claim?")
    parts.append(part(sets, "citation", subtype=F.lit("set"), section_index=F.col("i"), requirement=question, prediction=F.col("v"), raw=F.col("v")))
    expected = F.when(F.col("expected_abstention"), F.concat(F.lit("Approved negative: return insufficient_evidence and no sections. Approved content: "), F.array_join("required_qualifications", " ")))
    expected = expected.otherwise(F.concat(F.lit("Approved answerable question: return answered. Approved content: "), F.array_join("required_claims", " ")))
    parts.append(part(answers, "abstention", subtype=F.lit("status"), requirement=expected, prediction=F.col("abstention_correct")))
    return reduce(DataFrame.unionByName, parts)


def calibration_split(cases: DataFrame, id_: str, known: DataFrame, size: int, seed: str | None = None) -> DataFrame:
    """``half`` of each case: calibration for the known ones and the first others in stable order, ``size`` in all; else validation."""
    marked = cases.select(id_).distinct().join(known.select(id_).distinct().withColumn("_known", F.lit(True)), id_, "left")
    order = Window.orderBy(F.col("_known").isNull(), stable_order(F.col(id_).cast("string"), seed), id_)
    first = marked.orderBy(F.col("_known").isNull(), stable_order(F.col(id_).cast("string"), seed), id_).limit(size)  # a top-k of ``size`` rows
    chosen = first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= size).select(id_).withColumn("_chosen", F.lit(True))
    joined = marked.join(chosen, id_, "left")
    return joined.select(id_, F.when(F.col("_known") | F.col("_chosen"), "calibration").otherwise("validation").alias("half"))


def reliability(predictions: DataFrame, grades: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement of judged metrics with human grades, by metric: all of them, and those that a judge decided.

    ``predictions``: keys, metric, value, judged; ``grades``: keys, metric, human (null: not graded).
    """
    rows = predictions.join(grades, [*keys, "metric"]).filter("human is not null")
    semantic = F.col("judged") & ~F.col("metric").isin("citation_ids_valid", "negative_abstention_correct")
    same, both = F.col("value") == F.col("human"), F.col("value").isNotNull()
    return rows.groupBy("metric").agg(
        F.count_if(same).alias("agreement"), F.count_if(both).alias("compared"), F.count_if(same & semantic).alias("judge_only_agreement"),
        F.count_if(both & semantic).alias("judge_only_compared"), F.count_if(~both & semantic).alias("judge_only_unresolved"),
    )


def judge_input(rows: DataFrame) -> Column:
    """What a judge is given, as JSON: question, what is asked for, the answer, the passages that were visible, approved evidence."""
    fields = ["question", "required_claims", F.col("required_qualifications").alias("qualifications"), "forbidden_claims", F.struct("status", "sections").alias("answer"), F.col("visible").alias("visible_passages")]
    more = [F.col("approved_evidence")] if "approved_evidence" in rows.columns else []
    return F.to_json(F.struct(*fields, *more), {"ignoreNullFields": "false"})
