"""Answer studies, full metrics by case, reports and contracts, over stand-ins made from whole tables.

Assistant turns are answers, the turn before is their passage; what a judge would say comes from the numbers of
the turn.  Items that no document contains expect an abstention; the passages with an item's lines are its references.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.shared import stored
from attestor.operators import answers as A
from attestor.operators import contracts as K
from attestor.operators import evaluation as E
from attestor.operators import reporting as R
from attestor.operators import scoring as S
from attestor.operators import validation as V
from attestor.plans import evaluation_queries as Q
from attestor.plans import inputs as I
from attestor.plans.registry import query, table
from attestor.runner import group_summary, unmeasured
from attestor.sources import artifacts

KEYS = ["conv_id", "turn"]


def _study(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("passage"))
    own = rows.filter("role = 'assistant'").select("conv_id", "turn", "text").join(before, KEYS).withColumn("n", F.length("text"))
    own.createOrReplaceTempView("_turns")
    study = spark.sql("""
      select conv_id, turn, n, passage, text, conv_id % 4 = 0 as expected_abstention, 2 as n_required, if(conv_id % 3 = 0, 1, 0) as n_qualifications, 1 as n_forbidden,
        case when n % 7 = 0 then null when n % 5 = 0 then 'insufficient_evidence' else 'answered' end as status,
        case when n % 7 = 0 or n % 5 = 0 and n % 10 <> 0 then cast(array() as array<struct<text:string,citation_ids:array<string>>>)
             when n % 3 = 0 then array(named_struct('text', substring(text, 1, 40), 'citation_ids', array('p1')), named_struct('text', substring(passage, 1, 30), 'citation_ids', if(n % 11 = 0, array('p9'), array('p1', 'p2'))))
             else array(named_struct('text', substring(text, 1, 40), 'citation_ids', array('p1'))) end as sections,
        array(named_struct('id', 'p1', 'text', passage), named_struct('id', 'p2', 'text', text)) as visible,
        array(concat('claim a of ', conv_id), concat('claim b of ', turn)) as required_claims, if(conv_id % 3 = 0, array('with care'), cast(array() as array<string>)) as required_qualifications, array('never') as forbidden_claims
      from _turns""")
    pairs = F.flatten(F.transform("sections", lambda s, i: F.transform(s["citation_ids"], lambda c: F.struct(i.alias("i"), c.alias("c")))))
    quotes = F.when(F.col("n") % 8 == 0, F.array().cast("array<string>")).when(F.col("n") % 9 == 0, F.array(F.lit("invented quote"))).otherwise(F.array(F.substring("passage", 1, 12)))
    cited = F.transform(pairs, lambda p: F.struct(p["i"].alias("section_index"), p["c"].alias("citation_id"), ((F.col("n") + p["i"]) % 5 != 1).alias("value"), quotes.alias("quotes")))
    required = F.array(F.col("n") % 2 == 0, F.when(F.col("n") % 17 != 0, F.col("n") % 3 < 2))
    judgment = F.struct(
        F.when(F.col("n") % 29 == 0, F.slice(required, 1, 1)).otherwise(required).alias("required"), F.when(F.col("n_qualifications") > 0, F.array(F.col("n") % 4 != 0)).otherwise(F.array().cast("array<boolean>")).alias("qualifications"),
        F.array(F.when(F.col("n") % 19 != 0, F.col("n") % 23 == 0)).alias("forbidden"), F.transform("sections", lambda s: F.col("n") % 6 != 0).alias("supported"), cited.alias("citations"),
    )
    return study.withColumn("judgment", F.when((F.col("n") % 13 != 0) & (F.size("sections") > 0), judgment))


def _and(v: str) -> str:
    return f"case when len(list_filter({v}, lambda x: x = false)) > 0 then false when len(list_filter({v}, lambda x: x is null)) = 0 then true end"


def _share(v: str) -> str:
    return f"case when len({v}) > 0 and len(list_filter({v}, lambda x: x is null)) = 0 then len(list_filter({v}, lambda x: x)) / len({v}) end"


_STUDY_SQL = rf"""
turns as (
  select a.conv_id, a.turn, a.text, b.text as passage, length(a.text) as n from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn - 1 where a.role = 'assistant'),
study as (
  select *, conv_id % 4 = 0 as negative, case when n % 7 = 0 then null when n % 5 = 0 then 'insufficient_evidence' else 'answered' end as status,
    case when n % 7 = 0 or n % 5 = 0 and n % 10 <> 0 then []
         when n % 3 = 0 then [{{'text': substr(text, 1, 40), 'ids': ['p1']}}, {{'text': substr(passage, 1, 30), 'ids': case when n % 11 = 0 then ['p9'] else ['p1', 'p2'] end}}]
         else [{{'text': substr(text, 1, 40), 'ids': ['p1']}}] end as sections,
    [n % 2 = 0, case when n % 17 <> 0 then n % 3 < 2 end] as req, case when conv_id % 3 = 0 then [n % 4 <> 0] else [] end as quals, [case when n % 19 <> 0 then n % 23 = 0 end] as forb,
    case when n % 8 = 0 then [] when n % 9 = 0 then ['invented quote'] else [substr(passage, 1, 12)] end as quotes
  from turns),
judged as (
  select *, len(sections) > 0 as has_sections, n % 13 <> 0 and len(sections) > 0 as has, n % 13 <> 0 and len(sections) > 0 and n % 29 = 0 as bad, coalesce(status in ('answered', 'insufficient_evidence'), false) as generated from study),
cites as (
  select conv_id, turn, i, id, raw, case when verbatim then true when raw and (len(quotes) = 0 or len(list_filter(quotes, lambda q: trim(q) = '' or not contains(shown, q))) > 0) and not contains(shown, section) then null else raw end as value
  from (select *, section <> '' and contains(shown, section) as verbatim from (
    select conv_id, turn, n, quotes, i, id, (n + i) % 5 <> 1 as raw, regexp_replace(sections[i + 1].text, '^\s+|\s+$', '', 'g') as section, case id when 'p1' then passage when 'p2' then text else '' end as shown
    from (select *, unnest(sections[i + 1].ids) as id from (select *, unnest(range(0, len(sections))) as i from judged where has)))))"""
_SCORED_SQL = _STUDY_SQL + f""",
supports as (select conv_id, turn, list(value) as vs from cites group by all),
decided as (
  select j.*, generated and status = 'insufficient_evidence' and not has_sections as abstained,
    generated and len(list_filter(sections, lambda s: len(s.ids) = 0 or trim(s.text) = '' or len(list_filter(s.ids, lambda x: x not in ('p1', 'p2'))) > 0)) = 0 as valid,
    case when not has_sections then [false, false] when has and not bad then req else [null, null] end as r, case when not has_sections then list_transform(quals, lambda x: false) when has and not bad then quals else list_transform(quals, lambda x: null::boolean) end as q,
    case when not has_sections then [true] when has and not bad then [not forb[1]] else [null] end as f, list_concat(vs, list_transform(sections, lambda s: n % 6 <> 0)) as sup
  from judged j left join supports using (conv_id, turn)),
almost as (
  select *, coalesce(abstained, false) as ab, case when not has_sections then coalesce(abstained, false) when has and not bad then {_and("sup")} end as support, generated and coalesce(abstained, false) = negative as abstention_correct from decided),
scores as (
  select conv_id, turn, case when bad then 'incomplete decisions' end as fault, {_share("r")} as required_claim_coverage, case when not negative then {_share("q")} end as qualification_preservation,
    {_and("r")} as required_claims_met, case when len(q) > 0 and not negative then {_and("q")} end as qualifications_preserved, {_and("f")} as no_forbidden_claims, case when has_sections then valid end as citation_ids_valid,
    case when has_sections then support end as citation_support, abstention_correct, case when negative then abstention_correct end as negative_abstention_correct,
    {_and("[generated, abstention_correct, valid, support, " + _and("r") + ", case when negative and ab then true else " + _and("q") + " end, " + _and("f") + "]")} as answer_correct, has
  from almost)"""
_METRIC_LIST = ", ".join(S.METRICS)


@query("with " + _SCORED_SQL + f" select conv_id, turn, fault, round(required_claim_coverage, 6) as required_claim_coverage, round(qualification_preservation, 6) as qualification_preservation, {_METRIC_LIST} from scores")
def answer_quality(spark, sf_dir):
    rows = S.score_answers(_study(spark, sf_dir))
    return rows.select(*KEYS, "fault", *[F.round(c, 6).alias(c) for c in ("required_claim_coverage", "qualification_preservation")], *S.METRICS)


_EACH_SQL = f"each as (select conv_id, turn, has, unnest([{', '.join(repr(m) for m in S.METRICS)}]) as metric, unnest([{_METRIC_LIST}]) as value from scores)"


@query("with " + _SCORED_SQL + "," + _EACH_SQL + """
select 'r' || turn % 2 as run, metric, case when grouping(cohort) = 1 then 'all' else cohort end as cohort, cast(count_if(coalesce(value, false)) as bigint) as successes, count(value) as scored, count(*) - count(value) as unscored
from (select *, 'c' || conv_id % 3 as cohort, turn % 2 as half from each) group by grouping sets (('r' || turn % 2, metric), ('r' || turn % 2, metric, cohort))""")
def quality_report(spark, sf_dir):
    each = S.by_metric(S.score_answers(_study(spark, sf_dir)), KEYS)
    rows = each.select(F.concat(F.lit("r"), F.col("turn") % 2).alias("run"), F.concat(F.lit("c"), F.col("conv_id") % 3).alias("cohort"), "metric", "value")
    return A.quality_report(rows, "run", "cohort", "metric", "value")


@query("with " + _SCORED_SQL + "," + _EACH_SQL + """,
graded as (select *, case when turn % 3 <> 0 then (conv_id + length(metric)) % 4 <> 0 end as human from each where conv_id % 2 = 0), c as (select *, has and metric not in ('citation_ids_valid', 'negative_abstention_correct') as semantic from graded where human is not null)
select metric, cast(count_if(value = human) as bigint) as agreement, count(value) as compared, cast(count_if(value = human and semantic) as bigint) as judge_only_agreement,
  cast(count_if(value is not null and semantic) as bigint) as judge_only_compared, cast(count_if(value is null and semantic) as bigint) as judge_only_unresolved from c group by metric""")
def judge_reliability(spark, sf_dir):
    scored = S.score_answers(_study(spark, sf_dir))
    each = S.by_metric(scored, KEYS).join(scored.select(*KEYS, F.col("judgment").isNotNull().alias("judged")), KEYS)
    human = F.when(F.col("turn") % 3 != 0, (F.col("conv_id") + F.length("metric")) % 4 != 0)
    return S.reliability(each, each.filter("conv_id % 2 = 0").select(*KEYS, "metric", human.alias("human")), KEYS)


@query("with " + _SCORED_SQL + """,
items as (
  select conv_id, turn, 'required_claim' as type, null as subtype, null as section_index, null as citation_id, i as item_index, case when i = 0 then 'claim a of ' || conv_id else 'claim b of ' || turn end as requirement, req[i + 1] as prediction, req[i + 1] as raw
    from (select *, unnest(range(0, case when n % 29 = 0 then 1 else 2 end)) as i from judged where has)
  union all select conv_id, turn, 'qualification', null, null, null, 0, 'with care', quals[1], quals[1] from judged where has and len(quals) > 0
  union all select conv_id, turn, 'forbidden_claim', null, null, null, 0, 'never', not forb[1], forb[1] from judged where has
  union all select conv_id, turn, 'citation', 'single', i, id, null, 'Does the target citation support a substantive part of this section?', value, raw from cites
  union all select conv_id, turn, 'citation', 'set', i, null, null, 'Does this section''s citation set support every substantive claim?', n % 6 <> 0, n % 6 <> 0 from (select *, unnest(range(0, len(sections))) as i from judged where has)
  union all select conv_id, turn, 'abstention', 'status', null, null, null, case when negative then 'Approved negative: return insufficient_evidence and no sections. Approved content: ' || case when conv_id % 3 = 0 then 'with care' else '' end
    else 'Approved answerable question: return answered. Approved content: claim a of ' || conv_id || ' claim b of ' || turn end, abstention_correct, null from almost)
select conv_id, turn, type, subtype, cast(section_index as int) as section_index, citation_id, cast(item_index as int) as item_index, requirement, prediction, raw from items""")
def grading_pool(spark, sf_dir):
    study = _study(spark, sf_dir)
    correct = S.score_answers(study).select(*KEYS, "abstention_correct")
    return S.grading_pool(study.join(correct, KEYS), KEYS)


@query("""with known as (select doc_id from documents where doc_id in (select min(doc_id) from documents group by lang))
select doc_id, case when r <= 25 or k then 'calibration' else 'validation' end as half from (
  select d.doc_id, k.doc_id is not null as k, row_number() over (order by k.doc_id is null, sha256('study:' || d.doc_id), d.doc_id) as r from (select distinct doc_id from documents) d left join known k using (doc_id))""")
def calibration_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.calibration_split(docs, "doc_id", docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id")), 25, "study")


@query("""select conv_id, turn, case when status = 'answered' then n_sections > 0 else n_sections = 0 end and cited <= 2 as valid from (
  select conv_id, turn, case when length(text) % 5 = 0 then 'insufficient_evidence' else 'answered' end as status, length(text) % 3 as n_sections, length(text) % 4 as cited from conversations)""")
def answer_status(spark, sf_dir):
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(n % 5 == 0, "insufficient_evidence").otherwise("answered").alias("status"), (n % 3).alias("sections"), F.when(n % 4 > 2, F.array(F.lit("p3"))).otherwise(F.array(F.lit("p1"))).alias("cited"))
    return rows.select("conv_id", "turn", A.answer_valid(F.col("status"), F.col("sections"), F.col("cited"), F.array(F.lit("p1"), F.lit("p2"))).alias("valid"))


@query("with " + _STUDY_SQL + """
select conv_id, turn, cast(i as int) as section, id as citation_id, cast(case id when 'p1' then 1 when 'p2' then 2 else 0 end as int) as number,
  case status when 'answered' then 'Answer with source references' when 'insufficient_evidence' then 'Insufficient evidence' end as heading
from (select *, unnest(sections[i + 1].ids) as id from (select *, unnest(range(0, len(sections))) as i from judged))""")
def citations_shown(spark, sf_dir):
    rows = _study(spark, sf_dir)
    each = rows.select(*KEYS, A.heading(F.col("status")).alias("heading"), F.explode(A.cited(F.col("sections"), F.col("visible"))).alias("c"))
    return each.select(*KEYS, "c.section", "c.citation_id", "c.number", "heading")


# Cases with passage references: the passages that hold a line of the item, in the documents that hold the item.
def _cases(spark, sf_dir, references=None):
    kind = F.when(F.col("item_id") % 3 == 0, "paraphrase").when(F.col("item_id") % 3 == 1, "exact-terminology")
    return Q._cases(spark, sf_dir, references).select("item_id", (~F.col("answerable")).alias("expected_abstention"), kind.alias("query_style"))


def _metrics(spark, sf_dir):
    # References, spans and hits are read at every cutoff, so they are made once; a span's passage is measured whole.
    references = stored(I.references(spark, sf_dir), "references")
    spans = stored(Q._spans(spark, sf_dir, references).withColumn("length", F.length("text")).drop("line", "text"), "spans")
    hits = stored(I.lexical(spark, sf_dir, 10).withColumnRenamed("doc_id", "document_id"), "ranked")
    found, sources = spans.select("item_id", "passage_id").distinct(), references.withColumnRenamed("doc_id", "document_id")
    metrics = R.case_metrics(_cases(spark, sf_dir, references), sources, found, hits, found, "item_id", Q.CUTOFFS)
    whole = spans.select("passage_id", "length").distinct().select("passage_id", F.array(F.struct(F.lit(0).alias("start"), F.col("length").alias("end"))).alias("retained"))
    parts = [E.evidence_coverage(E.span_visibility(spans, hits.filter(F.col("rank") <= k), whole, "item_id"), "item_id")[0].withColumn("k", F.lit(k)) for k in Q.CUTOFFS]
    return metrics.join(group_summary(reduce(DataFrame.unionByName, parts), ["item_id", "k"]), ["item_id", "k"], "left")


def _kleene(v: str, op: str) -> str:
    first, last, no = ("false", "true", f"not {v}") if op == "and" else ("true", "false", v)
    return f"case when cast(count_if({no}) as bigint) > 0 then {first} when count({v}) = count(*) then {last} end"


_CASE_SQL = Q._SPANS_SQL + f""",
cases as (select b.item_id, count(r.doc_id) = 0 as negative, case item_id % 3 when 0 then 'paraphrase' when 1 then 'exact-terminology' end as query_style from benchmark b left join refs r using (item_id) group by b.item_id),
wanted as (select distinct item_id, passage_id from spans),
ks as (select item_id, negative, query_style, unnest([1, 4, 10]) as k from cases),
src as (select item_id, k, count(*) as n, cast(count_if(rank <= k) as bigint) as got from ks join (select r.item_id, r.doc_id, min(h.rank) as rank from refs r left join hits h using (item_id, doc_id) group by all) using (item_id) group by all),
pas as (select item_id, k, count(*) as n, cast(count_if(rank <= k) as bigint) as got, min(case when rank <= k then rank end) as first from ks join (select w.item_id, w.passage_id, min(h.rank) as rank from wanted w left join hits h using (item_id, passage_id) group by all) using (item_id) group by all),
seen as (select s.item_id, group_id, alternative, k, h.rank is not null and h.rank <= k as visible from ks join spans s using (item_id) left join hits h using (item_id, passage_id)),
alt as (select item_id, group_id, alternative, k, {_kleene("visible", "and")} as covered from seen group by all),
grp as (select item_id, group_id, k, {_kleene("covered", "or")} as covered from alt group by all),
cov as (select item_id, k, case when count(covered) = count(*) then avg(cast(covered as int)) end as group_coverage, {_kleene("covered", "and")} as complete_evidence from grp group by all),
metrics as (
  select item_id, k, negative, query_style, case when not negative then src.got / src.n end as source_recall, case when not negative then pas.got / pas.n end as passage_recall, case when not negative then first end as first_relevant_rank,
    case when not negative then coalesce(1 / first, 0) end as reciprocal_rank, case when not negative then src.got = src.n end as all_sources, group_coverage, complete_evidence
  from ks left join src using (item_id, k) left join pas using (item_id, k) left join cov using (item_id, k))"""


@query("with " + _CASE_SQL + """ select item_id, k, round(source_recall, 6) as source_recall, round(passage_recall, 6) as passage_recall, cast(first_relevant_rank as int) as first_relevant_rank, round(reciprocal_rank, 6) as reciprocal_rank,
  all_sources, round(group_coverage, 6) as group_coverage, complete_evidence from metrics""")
def case_metrics(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("source_recall", "passage_recall", "reciprocal_rank", "group_coverage")]
    return _metrics(spark, sf_dir).select("item_id", "k", *rounded, "first_relevant_rank", "all_sources", "complete_evidence")


@query("with " + _CASE_SQL + """ select k, count(*) as answerable_cases, true as available, round(avg(reciprocal_rank), 6) as mrr, round(avg(source_recall), 6) as source_recall, round(avg(passage_recall), 6) as passage_recall,
  count(group_coverage) as evidence_labeled_cases, round(avg(group_coverage), 6) as mean_group_coverage, cast(count_if(complete_evidence) as bigint) as complete_evidence_cases,
  round(cast(count_if(complete_evidence) as bigint) / nullif(count(group_coverage), 0), 6) as complete_evidence_rate from metrics where not negative group by k""")
def cutoff_report(spark, sf_dir):
    rows = R.cutoff_report(_metrics(spark, sf_dir), _cases(spark, sf_dir), "item_id", Q.CUTOFFS)
    means = ("mrr", "source_recall", "passage_recall", "mean_group_coverage", "complete_evidence_rate")
    return rows.select(*[F.round(c, 6).alias(c) if c in means else c for c in rows.columns])


@query("with " + _CASE_SQL + """,
a as (select *, item_id % 10 = 3 as err from metrics where k = 1), b as (select *, item_id % 15 = 3 as err from metrics where k = 10),
d as (
  select item_id, a.err as ea, b.err as eb, a.k is not null and item_id % 11 <> 5 as ok,
    case when item_id % 11 <> 5 then b.group_coverage - a.group_coverage end as g, case when item_id % 11 <> 5 then b.reciprocal_rank - a.reciprocal_rank end as r, case when item_id % 11 <> 5 then b.source_recall - a.source_recall end as s from a join b using (item_id)),
e as (select *, greatest(g, r, s) > 1e-12 as hi, least(g, r, s) < -1e-12 as lo from d)
select item_id, round(g, 6) as group_coverage_delta, round(r, 6) as reciprocal_rank_delta, round(s, 6) as source_recall_delta,
  case when ea and eb then 'both-failed' when eb then 'failed' when ea then 'recovered' when not ok then 'unavailable' when g is null and r is null and s is null then 'not-scored'
       when hi and lo then 'mixed' when hi then 'improved' when lo then 'worsened' else 'unchanged' end as outcome from e""")
def paired_outcomes(spark, sf_dir):
    rows = _metrics(spark, sf_dir)
    failing = lambda n: F.when(F.col("item_id") % n == 3, "retrieval_failed")
    before = rows.filter("k = 1").withColumn("error", failing(10)).withColumn("available", F.lit(True))
    after = rows.filter("k = 10").withColumn("error", failing(15)).withColumn("available", F.col("item_id") % 11 != 5)
    found = E.paired_changes(before, after, "item_id")
    return found.select("item_id", *[F.round(c, 6).alias(c) for c in found.columns[1:4]], "outcome")


# The context is what 9,000 serialized characters hold of the ranking.
def _reference_scores(spark, sf_dir):
    from attestor.operators import context as C
    from attestor.plans import retrieval_queries as P

    supplied = C.character_budget(P._costed(spark, sf_dir), P._BUDGET, "item_id").select("item_id", F.col("doc_id").alias("document_id"), "passage_id", F.col("rank").alias("place"))
    references = Q._spans(spark, sf_dir).select("item_id", "passage_id").distinct()
    sources = I.references(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    return R.reference_scores(_cases(spark, sf_dir), sources, references, I.lexical(spark, sf_dir, 20), supplied, "item_id")


def _reference_sql() -> str:
    from attestor.plans import retrieval_queries as P

    spans = Q._SPANS_SQL.removeprefix(I.lexical_sql(10))
    return P._COSTED_SQL + spans + """,
wanted as (select distinct item_id, passage_id from spans),
per as (
  select item_id, count(*) as reference_count, cast(count_if(h.rank <= 4) as bigint) as references_found_at_4, min(case when h.rank <= 4 then h.rank end) as best, count(s.rank) as supplied_n, min(s.rank) as place
  from wanted w left join hits h using (item_id, passage_id) left join supplied s using (item_id, passage_id) group by item_id),
docs as (select r.item_id, count(*) as sources, cast(count_if(s.doc_id is not null) as bigint) as found from refs r left join (select distinct item_id, h.doc_id from supplied s join hits h using (item_id, passage_id)) s using (item_id, doc_id) group by r.item_id),
refscores as (
  select item_id, references_found_at_4 / reference_count as passage_recall_at_4, coalesce(1 / best, 0) as mrr_at_4, supplied_n > 0 as context_hit, supplied_n = reference_count as complete_evidence,
    case when sources > 1 then found = sources end as both_documents, supplied_n / reference_count as context_passage_recall, coalesce(1 / place, 0) as context_mrr, reference_count, references_found_at_4 from per join docs using (item_id))"""


_ROUNDED = ("passage_recall_at_4", "mrr_at_4", "context_passage_recall", "context_mrr")


@query("with " + _reference_sql() + f" select item_id, {', '.join(f'round({c}, 6) as {c}' for c in _ROUNDED)}, context_hit, complete_evidence, both_documents, reference_count, references_found_at_4 from refscores")
def reference_scores(spark, sf_dir):
    rows = _reference_scores(spark, sf_dir)
    return rows.select("item_id", *[F.round(c, 6).alias(c) for c in _ROUNDED], "context_hit", "complete_evidence", "both_documents", "reference_count", "references_found_at_4")


_NAMES = [*R.TARGETS, "context_passage_recall", "context_mrr"]


@query("with " + _reference_sql() + f""",
each as (select unnest({_NAMES}) as metric, unnest([{', '.join(f'cast({m} as double)' for m in _NAMES)}]) as value, unnest({[m in R.BINARY for m in _NAMES]}) as yes_no,
  unnest([{', '.join(str(R.TARGETS.get(m, 'null')) for m in _NAMES)}]) as target from refscores),
summed as (select metric, yes_no, cast(target as double) as target, avg(value) as estimate, count(value) as denominator, sum(value) as total from each group by all)
select metric, round(estimate, 6) as estimate, denominator, case when yes_no then cast(total as bigint) end as successes, case when not yes_no then round(greatest(0, estimate - sqrt(ln(40) / (2 * denominator))), 6) end as low,
  case when not yes_no then round(least(1, estimate + sqrt(ln(40) / (2 * denominator))), 6) end as high, target, estimate >= target as passed from summed
union all select 'micro_recall_at_4', round(sum(references_found_at_4) / nullif(sum(reference_count), 0), 6), coalesce(cast(sum(reference_count) as bigint), 0), coalesce(cast(sum(references_found_at_4) as bigint), 0), null, null, null, null from refscores""")
def reference_summary(spark, sf_dir):
    rows = R.reference_summary(_reference_scores(spark, sf_dir))
    return rows.select("metric", F.round("estimate", 6).alias("estimate"), "denominator", "successes", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "target", "passed")


@query("with " + _CASE_SQL + """ select case when grouping(cohort) = 1 then 'all' else cohort end as cohort, k as budget, 'all_groups' as view, count(*) as total_cases, cast(count_if(negative) as bigint) as unscored_abstention_cases, true as available,
  cast(count_if(not negative and complete_evidence is not null) as bigint) as labeled_cases, cast(count_if(not negative and complete_evidence) as bigint) as complete_evidence_cases, round(avg(case when not negative and complete_evidence is not null then group_coverage end), 6) as mean_group_coverage,
  round(cast(count_if(not negative and complete_evidence) as bigint) / nullif(cast(count_if(not negative and complete_evidence is not null) as bigint), 0), 6) as complete_evidence_rate,
  round(avg(case when not negative then k * 100 + item_id end), 6) as mean_tokens, round(median(case when not negative then k * 100 + item_id end), 6) as median_tokens, min(case when not negative then k * 100 + item_id end) as min_tokens, max(case when not negative then k * 100 + item_id end) as max_tokens
from (select *, coalesce(query_style, 'unspecified') as cohort from metrics) group by grouping sets ((k), (k, cohort))""")
def context_report(spark, sf_dir):
    tokens = F.col("k") * 100 + F.col("item_id")
    profiles = _metrics(spark, sf_dir).select("item_id", F.col("k").alias("budget"), F.lit("all_groups").alias("view"), "complete_evidence", "group_coverage", tokens.alias("input_tokens"), F.lit(1).alias("passages"), F.lit(1).alias("serialized_chars"))
    rows = R.context_summary(profiles, _cases(spark, sf_dir), "item_id")
    means = ("mean_group_coverage", "complete_evidence_rate", "mean_tokens", "median_tokens")
    return rows.select("cohort", "budget", "view", "total_cases", "unscored_abstention_cases", "available", "labeled_cases", "complete_evidence_cases", "min_tokens", "max_tokens", *[F.round(c, 6).alias(c) for c in means])


# Results of runs: an event is a case's row, its type the run.
_RESULT_SQL = """
results as (select *, event_id % 5 = 0 as negative, case when event_id % 4 = 0 then 'comparison' when event_id % 5 = 0 then 'unanswerable' else 'factual' end as category, event_id % 17 = 0 as failed,
  case when event_id % 5 <> 0 and event_id % 17 <> 0 then (event_id % 3) / 2 end as sr, case when event_id % 6 = 0 then 'answered' when event_id % 6 = 1 then 'insufficient_evidence' end as st,
  case when event_id % 17 <> 0 then value end as ms, case when event_id % 7 <> 0 then event_id % 100 end as tok, case when event_id % 9 <> 0 then event_id % 10 / 1000 end as usd from events)"""


@query("with " + _RESULT_SQL + """ select event_type, count(*) as cases, cast(count_if(failed) as bigint) as errors, count(sr) as recall_scored, round(avg(sr), 6) as mean_source_recall, cast(count_if(not negative) as bigint) as answerable_cases,
  round(avg(case when not negative then coalesce(sr, 0) end), 6) as mean_source_recall_with_failures, cast(count_if(category = 'comparison') as bigint) as comparison_cases, cast(count_if(category = 'comparison' and sr = 1) as bigint) as comparison_full_coverage,
  round(avg(case when category = 'comparison' then coalesce(sr, 0) end), 6) as comparison_mean_source_recall, count(st) as generated_answers, cast(count_if(st is not null and negative) as bigint) as generated_unanswerable_cases,
  cast(count_if(st is not null and not negative) as bigint) as generated_answerable_cases, cast(count_if(st = 'insufficient_evidence') as bigint) as automatic_full_abstentions, cast(count_if(st = 'insufficient_evidence' and negative) as bigint) as automatic_abstentions_unanswerable,
  cast(count_if(st = 'insufficient_evidence' and not negative) as bigint) as automatic_false_abstentions, cast(count_if(ms is not null and event_id % 8 = 0) as bigint) as no_match_cases, median(value) as median_latency_ms, max(value) as max_latency_ms, count(ms) as query_timing_samples,
  median(ms) as query_median_ms, quantile_disc(ms, 0.95) as query_p95_ms, max(ms) as query_max_ms, cast(count_if(event_id % 13 = 0) as bigint) as unstable_ranking_cases, cast(sum(event_id % 2) as bigint) as context_truncated_passages, cast(sum(event_id % 3) as bigint) as context_omitted_passages,
  cast(count_if(event_id % 4 > 0) as bigint) as evidence_loss_cases, cast(count_if(event_id % 10 > 0) as bigint) as evidence_unknown_cases, cast(sum(coalesce(tok, 0)) as bigint) as input_tokens_known, cast(count_if(tok is null) as bigint) as unknown_usage_cases,
  round(sum(coalesce(usd, 0)), 6) as cost_usd_known, cast(count_if(usd is null) as bigint) as unknown_cost_cases from results group by event_type""")
def run_report(spark, sf_dir):
    i = F.col("event_id")
    recall = F.when((i % 5 != 0) & (i % 17 != 0), (i % 3) / 2)
    tokens = F.when(i % 7 != 0, i % 100)
    rows = table(spark, sf_dir, "events").select(
        "event_type", (i % 5 == 0).alias("expected_abstention"), F.when(i % 4 == 0, "comparison").when(i % 5 == 0, "unanswerable").otherwise("factual").alias("category"), F.when(i % 17 == 0, "retrieval_failed").alias("error"),
        recall.alias("source_recall"), recall.alias("passage_recall"), recall.alias("reciprocal_rank"), (recall == 1).alias("all_sources"), F.when(i % 6 == 0, "answered").when(i % 6 == 1, "insufficient_evidence").alias("answer_status"),
        (i % 8).alias("n_hits"), F.when(i % 17 != 0, F.col("value")).alias("retrieval_ms"), F.col("value").alias("latency_ms"), (i % 13 != 0).alias("stable"), (i % 2).alias("truncated_passages"), (i % 3).alias("omitted_passages"),
        (i % 4).alias("lost_groups"), (i % 10).alias("unknown_groups"), tokens.alias("input_tokens"), tokens.alias("output_tokens"), F.when(i % 9 != 0, i % 10 / 1000).alias("cost_usd"),
    )
    found = R.run_report(rows, ["event_type"]).drop("mean_passage_recall_with_failures", "mrr_with_failures", "output_tokens_known")
    rounded = ("mean_source_recall", "mean_source_recall_with_failures", "comparison_mean_source_recall", "cost_usd_known")
    return found.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in found.columns])


@query("with " + Q._SPANS_SQL + " select item_id, group_id, count(*) as spans from spans where ('part-' || group_id) like 'part-%' and group_id % 2 = 0 group by all")
def asked_groups(spark, sf_dir):
    named = Q._spans(spark, sf_dir).withColumn("name", F.concat(F.when(F.col("group_id") % 2 == 0, "part-").otherwise("background-"), F.col("group_id")))
    return E.asked_only(named, "name").groupBy("item_id", "group_id").agg(F.count("*").alias("spans"))


@query("with " + I.lexical_sql(10) + " select item_id, passage_id from hits where doc_id % 3 = 0")
def unmeasured_passages(spark, sf_dir):
    measured = I.passages(spark, sf_dir).filter("doc_id % 3 <> 0").select("passage_id")
    return unmeasured(I.lexical(spark, sf_dir, 10).withColumnRenamed("item_id", "query_id"), measured).withColumnRenamed("query_id", "item_id")


# Contracts: some rows are broken on purpose.
@query("with " + I.REFERENCES_SQL.replace("refs as", "refs as") + """,
c as (select b.item_id, count(r.doc_id) as n from benchmark b left join refs r using (item_id) group by b.item_id),
k as (select item_id, n, case when n = 0 then 'unanswerable' when item_id % 4 = 1 then 'comparison' else 'factual' end as category, item_id % 9 = 2 as abstain, item_id % 6 = 5 as unreviewed from c)
select 'case-' || item_id as id, unnest(list_filter([
  case when (n = 0) <> (category = 'unanswerable') or abstain <> (category = 'unanswerable') then 'abstention' end, case when not abstain and n = 0 then 'nothing to answer' end, case when category = 'comparison' and n < 2 then 'comparison of one source' end,
  case when unreviewed then 'review without reviewer' end], lambda x: x is not null)) as fault from k""")
def case_contract(spark, sf_dir):
    cases = table(spark, sf_dir, "benchmark").select("item_id").join(I.references(spark, sf_dir), "item_id", "left").groupBy("item_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("sources"))
    n, i = F.size("sources"), F.col("item_id")
    rows = cases.select(
        F.concat(F.lit("case-"), i).alias("id"), F.when(n == 0, "unanswerable").when(i % 4 == 1, "comparison").otherwise("factual").alias("category"), (i % 9 == 2).alias("expected_abstention"), F.col("sources").alias("expected_source_ids"),
        F.transform("sources", lambda s: F.struct(s.alias("source_id"))).alias("references"), F.array(F.lit("a claim")).alias("required_claims"), F.lit("approved").alias("review_status"),
        F.when(i % 6 != 5, "someone").alias("reviewer"), F.lit("2026-01-01").cast("date").alias("review_date"),
    )
    return K.case_faults(rows)


@query("with " + Q._SPANS_SQL + """,
s as (select *, case when item_id % 5 = 1 then line || '!' else line end as quote from spans),
c as (select distinct item_id from benchmark where item_id % 7 <> 3)
select 'c' || item_id as case_id, 'span' as fault from s where quote <> line
union all select distinct 'c' || item_id, 'unknown case' from spans where item_id % 7 = 3
union all select 'c' || item_id, 'claims not covered' from (select item_id, count(distinct group_id) as g, max(group_id) as m from spans where item_id % 7 <> 3 group by item_id) where g <> m + 1 + (item_id % 2)""")
def label_contract(spark, sf_dir):
    spans = Q._spans(spark, sf_dir)
    case = F.concat(F.lit("c"), F.col("item_id"))
    quoted = spans.select(case.alias("case_id"), F.col("group_id").cast("string").alias("group_id"), F.col("alternative").cast("string").alias("alternative"), "passage_id", "start", "end", F.when(F.col("item_id") % 5 == 1, F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("quote"))
    groups = spans.select(case.alias("case_id"), F.col("group_id").cast("string").alias("group_id"), F.col("group_id").alias("claim_index")).distinct()
    claims = spans.groupBy("item_id").agg((F.max("group_id") + 1 + F.max(F.col("item_id") % 2)).cast("int").alias("n"))
    sources = I.references(spark, sf_dir).groupBy("item_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("expected_source_ids"))
    cases = claims.join(sources, "item_id").filter("item_id % 7 <> 3").select(case.alias("id"), F.lit(False).alias("expected_abstention"), "expected_source_ids", F.array_repeat(F.lit("claim"), F.col("n")).alias("required_claims"))
    passages = I.passages(spark, sf_dir).select("passage_id", F.col("doc_id").cast("string").alias("document_id"), "text")
    return K.label_faults(quoted, groups, cases, passages)


@query("with " + I.PASSAGES_SQL + """,
m as (select passage_id, length(text) as n, doc_id, case when doc_id % 10 = 1 then 'x' else sha256(text) end as sha, sha256(text) as own, least(length(text), 500) as kept, length(text) as tin, case when doc_id % 10 = 2 then length(text) + 5 else least(length(text), 500) end as tout, (length(text) > 500) <> (doc_id % 10 = 3) as truncated from passages)
select passage_id, unnest(list_filter([case when sha <> own then 'other text' end, case when tout > least(tin, 600) then 'counts' end, case when truncated <> (kept < n) then 'flag' end, case when truncated and tin = tout then 'no token lost' end], lambda x: x is not null)) as fault from m""")
def encoding_contract(spark, sf_dir):
    n = F.length("text")
    rows = I.passages(spark, sf_dir).select(
        "passage_id", F.when(F.col("doc_id") % 10 == 1, "x").otherwise(F.sha2("text", 256)).alias("text_sha256"), n.alias("input_tokens"), F.when(F.col("doc_id") % 10 == 2, n + 5).otherwise(F.least(n, F.lit(500))).alias("encoded_tokens"),
        ((n > 500) != (F.col("doc_id") % 10 == 3)).alias("truncated"), F.array(F.struct(F.lit(0).alias("start"), F.least(n, F.lit(500)).alias("end"))).alias("retained_ranges"),
    )
    return K.encoding_faults(rows, I.passages(spark, sf_dir), 600)


@query("with " + I.PASSAGES_SQL + """
select passage_id, unnest(list_filter([case when doc_id % 8 = 1 then 'paragraph' end, case when doc_id % 9 = 1 then 'section' end], lambda x: x is not null)) as fault from passages
union all select 'no:p1:w' || doc_id, 'unknown passage' from documents where doc_id % 50 = 0""")
def reference_contract(spark, sf_dir):
    located = I.passages(spark, sf_dir).select("doc_id", "passage_id", "document_id", "paragraph", F.lit("body").alias("section"), F.concat(F.lit("./p["), "paragraph", F.lit("]")).alias("locator"))
    made = located.select("passage_id", "document_id", F.when(F.col("doc_id") % 8 == 1, F.col("paragraph") + 1).otherwise(F.col("paragraph")).alias("paragraph"), F.when(F.col("doc_id") % 9 == 1, "other").alias("section"), F.when(F.col("doc_id") % 2 == 0, F.col("locator")).alias("locator"))
    stale = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select(F.concat(F.lit("no:p1:w"), "doc_id").alias("passage_id"), F.lit("no").alias("document_id"), F.lit(1).alias("paragraph"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("locator"))
    return K.reference_faults(made.unionByName(stale), located.drop("doc_id"))


@query("with " + I.lexical_sql(10) + """ select item_id, cast(count(*) + count_if(item_id % 6 = 0) as bigint) as n, cast(count_if(item_id % 6 = 0) as bigint) as repeated, cast(count_if(item_id % 5 = 0) as bigint) as not_finite from hits
  group by item_id having count(*) + count_if(item_id % 6 = 0) > 8 or count_if(item_id % 6 = 0) > 0 or count_if(item_id % 5 = 0) > 0""")
def hit_contract(spark, sf_dir):
    hits = I.lexical(spark, sf_dir, 10).select("item_id", "passage_id", F.when(F.col("item_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))
    twice = hits.unionAll(hits.filter("item_id % 6 = 0").withColumn("score", F.lit(0.5)))
    return V.hit_faults(twice, I.passages(spark, sf_dir), "item_id", 8).select("item_id", "n", "repeated", "not_finite")


@query("""with r as (select source, count(distinct lang) as langs, count(*) as documents, min(doc_id) as first from documents group by source)
select 'langs' as "column", count(distinct langs) as n from r having count(distinct langs) > 1 union all select 'documents', count(distinct documents) from r having count(distinct documents) > 1
union all select 'first', count(distinct first) from r having count(distinct first) > 1""")
def comparable_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("langs"), F.count("*").alias("documents"), F.min("doc_id").alias("first"))
    return V.comparable(runs, ["langs", "documents", "first"])


@query("""with a as (select distinct user_id, event_type from events where event_id % 2 = 0), b as (select distinct user_id, event_type from events where event_id % 2 = 1)
select event_type, cast(sum(only_a) as bigint) as only_first, cast(sum(only_b) as bigint) as only_second, sum(only_a) + sum(only_b) = 0 as same from (
  select coalesce(a.event_type, b.event_type) as event_type, case when b.user_id is null then 1 else 0 end as only_a, case when a.user_id is null then 1 else 0 end as only_b from a full join b on a.user_id = b.user_id and a.event_type = b.event_type) group by event_type""")
def set_equality(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return E.set_differences(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), "event_type", "user_id")


@query("""select vec_id, round(list_aggregate(v, 'sum'), 6) as total, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as norm from (
  select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as v from (select vec_id, list_transform(embedding, lambda x: cast(x as double) * (1 + vec_id % 3)) as e from embeddings))""")
def normalized_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("v"))
    unit = rows.select("vec_id", artifacts.unit(F.col("v")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    return unit.select("vec_id", F.round(total, 6).alias("total"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)), 6).alias("norm"))

