"""Ranking metrics, evidence coverage, statistics, answer scoring, samples and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import stats as S
from attestor.functions import text as T
from attestor.functions.kleene import k_and, k_or
from attestor.operators import answers as A
from attestor.operators import evaluation as E
from attestor.operators import sampling
from attestor.plans import inputs as I
from attestor.plans.registry import query, table

CUTOFFS = (1, 4, 10)


def _cases(spark, sf_dir, references=None):
    items = table(spark, sf_dir, "benchmark").select("item_id")
    known = (references or I.references(spark, sf_dir)).select("item_id").distinct().withColumn("answerable", F.lit(True))
    return items.join(known, "item_id", "left").withColumn("answerable", F.coalesce("answerable", F.lit(False)))


def _metrics(spark, sf_dir):
    return E.ranking_metrics(_cases(spark, sf_dir), I.references(spark, sf_dir), I.lexical(spark, sf_dir, 10), "item_id", "doc_id", CUTOFFS)


_METRICS_SQL = I.lexical_sql(10) + "," + I.REFERENCES_SQL + """,
expected as (select item_id, count(*) as expected from refs group by item_id),
grid as (select item_id, unnest([1, 4, 10]) as k from benchmark),
first_hits as (select item_id, doc_id, min(rank) as rank from hits group by all),
found as (select item_id, doc_id, rank from first_hits join refs using (item_id, doc_id)),
within as (select g.item_id, g.k, count(*) as n, min(rank) as first_rank from grid g join found f on f.item_id = g.item_id and f.rank <= g.k group by all),
metrics as (
  select g.item_id, g.k, coalesce(n, 0) / expected as recall, case when expected > 0 then coalesce(n, 0) > 0 end as hit,
         case when expected > 0 then coalesce(n, 0) = expected end as all_sources, first_rank,
         case when expected > 0 then coalesce(1 / first_rank, 0) end as reciprocal_rank
  from grid g left join expected using (item_id) left join within using (item_id, k))"""


@query("with " + _METRICS_SQL + " select item_id, k, round(recall, 6) as recall, hit, all_sources, cast(first_rank as int) as first_rank, round(reciprocal_rank, 6) as reciprocal_rank from metrics")
def ranking_metrics(spark, sf_dir):
    rows = _metrics(spark, sf_dir)
    return rows.select("item_id", "k", F.round("recall", 6).alias("recall"), "hit", "all_sources", "first_rank", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query("with " + _METRICS_SQL + """ select k, count(*) as cases, count(recall) as scored, round(avg(recall), 6) as mean_recall, round(avg(reciprocal_rank), 6) as mrr,
  cast(count_if(hit) as bigint) as hits, cast(count_if(all_sources) as bigint) as complete from metrics group by k""")
def cutoff_summary(spark, sf_dir):
    rows = E.cutoff_summary(_metrics(spark, sf_dir))
    return rows.select("k", "cases", "scored", F.round("mean_recall", 6).alias("mean_recall"), F.round("mrr", 6).alias("mrr"), "hits", "complete")


@query("with " + _METRICS_SQL + """,
pairs as (select a.item_id, b.recall - a.recall as d, b.reciprocal_rank - a.reciprocal_rank as r from metrics a join metrics b on a.item_id = b.item_id and a.k = 1 and b.k = 10)
select case when d is null and r is null then 'not-scored' when greatest(d, r) > 1e-12 and least(d, r) < -1e-12 then 'mixed' when greatest(d, r) > 1e-12 then 'improved' when least(d, r) < -1e-12 then 'worsened' else 'unchanged' end as outcome,
  count(*) as cases from pairs group by 1""")
def paired_changes(spark, sf_dir):
    rows = _metrics(spark, sf_dir).withColumn("error", F.lit(None).cast("string")).withColumn("available", F.lit(True))
    changes = E.paired_changes(rows.filter("k = 1"), rows.filter("k = 10"), "item_id", ["recall", "reciprocal_rank"])
    return changes.groupBy("outcome").agg(F.count("*").alias("cases"))


# Recall, hit, complete and reciprocal rank at 4 against their targets.
_TARGETS = {"recall": 0.8, "hit": 0.9, "complete": 0.8, "mrr": 0.65}


@query("with " + _METRICS_SQL + f"""
select target, round(estimate, 6) as estimate, estimate >= bar as passed, round(greatest(0, estimate - sqrt(ln(40) / (2 * n))), 6) as low, round(least(1, estimate + sqrt(ln(40) / (2 * n))), 6) as high
from (select unnest(['recall', 'hit', 'complete', 'mrr']) as target, unnest([avg(recall), avg(cast(hit as int)), avg(cast(all_sources as int)), avg(reciprocal_rank)]) as estimate,
             unnest({list(_TARGETS.values())}) as bar, unnest([count(recall), count(recall), count(recall), count(recall)]) as n from metrics where k = 4)""")
def reference_targets(spark, sf_dir):
    rows = _metrics(spark, sf_dir).filter("k = 4")
    means = rows.agg(F.avg("recall").alias("recall"), F.avg(F.col("hit").cast("int")).alias("hit"), F.avg(F.col("all_sources").cast("int")).alias("complete"), F.avg("reciprocal_rank").alias("mrr"), F.count("recall").alias("n"))
    each = means.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("estimate"), F.lit(bar).alias("bar")) for t, bar in _TARGETS.items()])).alias("t")).select("n", "t.*")
    low, high = S.hoeffding(F.col("estimate"), F.col("n"))
    return each.select("target", F.round("estimate", 6).alias("estimate"), (F.col("estimate") >= F.col("bar")).alias("passed"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# Evidence: every line of an item is a group, every document that contains the item an alternative, every
# passage of it with the line a span.  As stand-ins, passages of documents divisible by 7 were not measured by the
# encoder, and what it retained of the others are their two halves.
def _spans(spark, sf_dir, references=None):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("group_id", "line"))
    lines = items.select("item_id", "group_id", T.normalize_space(F.col("line")).alias("line")).filter("line <> ''")
    references = references or I.references(spark, sf_dir)
    own = references.join(lines, "item_id").join(I.passages(spark, sf_dir, references), "doc_id").filter(F.contains("text", "line"))
    start = F.instr("text", F.col("line")) - 1
    return own.select("item_id", "group_id", F.col("doc_id").alias("alternative"), "passage_id", start.alias("start"), (start + F.length("line")).alias("end"), "line", "text")


def _ranges(spark, sf_dir):
    rows = I.passages(spark, sf_dir).filter("doc_id % 7 <> 0").withColumn("n", F.length("text"))
    return rows.select("passage_id", F.expr("array(named_struct('start', 0, 'end', n div 2), named_struct('start', n div 2, 'end', cast(n as bigint)))").alias("retained"))


def _coverage(spark, sf_dir, k):
    hits = I.lexical(spark, sf_dir, 10).filter(F.col("rank") <= k)
    return E.evidence_coverage(E.span_visibility(_spans(spark, sf_dir), hits, _ranges(spark, sf_dir), "item_id"), "item_id")


_K = "case when cast(count_if({no}) as bigint) > 0 then {first} when count({v}) = count(*) then {last} end"
_AND, _OR = (lambda v: _K.format(no=f"not {v}", v=v, first="false", last="true")), (lambda v: _K.format(no=v, v=v, first="true", last="false"))


def _coverage_sql(k: int, name: str) -> str:
    return f""",
{name}_seen as (
  select s.*, case when h.passage_id is null then false when s.alternative % 7 <> 0 then length(s.text) >= "end" end as visible
  from spans s left join (select distinct item_id, passage_id from hits where rank <= {k}) h using (item_id, passage_id)),
{name}_alt as (select item_id, group_id, alternative, {_AND("visible")} as covered from {name}_seen group by all),
{name}_groups as (select item_id, group_id, {_OR("covered")} as covered from {name}_alt group by all),
{name}_cases as (select item_id, case when count(covered) = count(*) then avg(cast(covered as int)) end as coverage, {_AND("covered")} as complete from {name}_groups group by item_id)"""


_SPANS_SQL = I.lexical_sql(10) + "," + I.REFERENCES_SQL + r""",
lines as (select item_id, cast(generate_subscripts(ls, 1) - 1 as int) as group_id, array_to_string(list_filter(regexp_split_to_array(unnest(ls), '\s+'), lambda w: w <> ''), ' ') as line
          from (select item_id, string_split(text, chr(10)) as ls from benchmark)),
spans as (select l.item_id, group_id, p.doc_id as alternative, passage_id, instr(p.text, line) - 1 as "start", instr(p.text, line) - 1 + length(line) as "end", line, p.text
          from refs r join lines l on l.item_id = r.item_id and line <> '' join passages p on p.doc_id = r.doc_id and contains(p.text, line))"""


@query("with " + _SPANS_SQL + _coverage_sql(10, "wide") + " select item_id, round(coverage, 6) as coverage, complete from wide_cases")
def evidence_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir, 10)[1].select("item_id", F.round("coverage", 6).alias("coverage"), "complete")


@query("with " + _SPANS_SQL + _coverage_sql(10, "wide") + _coverage_sql(1, "narrow") + """
select item_id, group_id, case when n.item_id is not null and after is null then 'unknown' else 'lost' end as change from wide_groups w left join (select item_id, group_id, covered as after from narrow_groups) n using (item_id, group_id) where covered and not coalesce(after, false)""")
def coverage_loss(spark, sf_dir):
    return E.coverage_loss(_coverage(spark, sf_dir, 10)[0], _coverage(spark, sf_dir, 1)[0], "item_id")


@query("with " + _SPANS_SQL + """ select count(*) as spans, cast(count_if(substr(text, cast("start" as int) + 1, cast("end" - "start" as int)) <> line) as bigint) as inexact, cast(count_if("end" <= "start") as bigint) as empty,
  count(*) - count(distinct (item_id, group_id, alternative, passage_id)) as repeated from spans""")
def validate_labels(spark, sf_dir):
    rows = _spans(spark, sf_dir)
    quoted = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.agg(F.count("*").alias("spans"), F.count_if(quoted != F.col("line")).alias("inexact"), F.count_if(F.col("end") <= F.col("start")).alias("empty"), (F.count("*") - F.count_distinct("item_id", "group_id", "alternative", "passage_id")).alias("repeated"))


@query("""with p as (select l.doc_id, lang, quality = 1 as v, toxic = 1 as w, doc_id % 5 = 0 as gap from labels l join documents using (doc_id))
select lang, case when cast(count_if(not x) as bigint) > 0 then false when count(x) = count(*) then true end as k_and, case when cast(count_if(x) as bigint) > 0 then true when count(x) = count(*) then false end as k_or
from (select lang, doc_id % 50 as part, case when not gap then v end as x from p) group by lang, part""")
def kleene_aggregates(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.select("lang", (F.col("doc_id") % 50).alias("part"), F.when(F.col("doc_id") % 5 != 0, F.col("quality") == 1).alias("x"))
    return rows.groupBy("lang", "part").agg(k_and(F.col("x")).alias("k_and"), k_or(F.col("x")).alias("k_or")).drop("part")


def _raters(spark, sf_dir):
    """Two raters of each labelled document, by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.groupBy("lang").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"), F.count("*").alias("n"))


_RATERS_SQL = """
raters as (
  select lang, cast(count_if(quality = 1 and toxic = 1) as bigint) as "both", cast(count_if(quality = 1 and toxic <> 1) as bigint) as only_a, cast(count_if(quality <> 1 and toxic = 1) as bigint) as only_b,
         cast(count_if(quality <> 1 and toxic <> 1) as bigint) as neither, count(*) as n
  from labels join documents using (doc_id) group by lang)"""
_P_SQL = """
tested as (select lang, least(1, 2 * list_sum(list_transform(range(0, cast(least(only_a, only_b) + 1 as bigint)),
  lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) as p, only_a, only_b from raters)"""


@query("with " + _RATERS_SQL + "," + _P_SQL + " select lang, only_a, only_b, round(p, 9) as p from tested")
def mcnemar(spark, sf_dir):
    return _raters(spark, sf_dir).select("lang", "only_a", "only_b", F.round(S.mcnemar(F.col("only_a"), F.col("only_b")), 9).alias("p"))


@query("with " + _RATERS_SQL + "," + _P_SQL + """
select lang, round(least(1, max(adjusted) over (order by r rows unbounded preceding)), 9) as p_holm
from (select lang, r, (m - r + 1) * p as adjusted from (select lang, p, row_number() over (order by p, lang) as r, count(*) over () as m from tested))""")
def holm_adjusted(spark, sf_dir):
    tests = _raters(spark, sf_dir).select("lang", S.mcnemar(F.col("only_a"), F.col("only_b")).alias("p"))
    return E.holm(tests, "p", ["lang"]).select("lang", F.round("p_holm", 9).alias("p_holm"))


@query("with " + _RATERS_SQL + """
select lang, round(greatest(0, mean - radius), 9) as low, round(least(1, mean + radius), 9) as high from (select lang, ("both" + only_a) / n as mean, sqrt(ln(40) / (2 * n)) as radius from raters)""")
def hoeffding_interval(spark, sf_dir):
    low, high = S.hoeffding((F.col("both") + F.col("only_a")) / F.col("n"), F.col("n"))
    return _raters(spark, sf_dir).select("lang", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query()
def clopper_pearson(spark, sf_dir):
    rows = _raters(spark, sf_dir).select("lang", "n", (F.col("both") + F.col("only_a")).alias("passes"))
    return rows.select("lang", "n", "passes", S.clopper_pearson("passes", "n").alias("i")).select("lang", "n", "passes", "i.low", "i.high")


@query("with " + _RATERS_SQL + """
select lang, round(accuracy, 9) as accuracy, round((accuracy - chance) / nullif(1 - chance, 0), 9) as kappa, coalesce((accuracy - chance) / nullif(1 - chance, 0) >= 0.6 and accuracy >= 0.8, false) as accepted
from (select lang, ("both" + neither) / n as accuracy, (("both" + only_a) * ("both" + only_b) + (neither + only_a) * (neither + only_b)) / (n * n) as chance from raters)""")
def cohens_kappa(spark, sf_dir):
    value = S.kappa(F.col("both"), F.col("only_a"), F.col("only_b"), F.col("neither"))
    accuracy = (F.col("both") + F.col("neither")) / F.col("n")
    return _raters(spark, sf_dir).select("lang", F.round(accuracy, 9).alias("accuracy"), F.round(value, 9).alias("kappa"), F.coalesce((value >= 0.6) & (accuracy >= 0.8), F.lit(False)).alias("accepted"))


@query("""select event_type, count(*) as n, quantile_disc(value, 0.95) as p95, median(value) as median, min(value) as least, max(value) as most, round(avg(value), 6) as mean from events group by event_type""")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.median("value").alias("median"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"),
    )


@query()
def bootstrap_delta(spark, sf_dir):
    from attestor.operators.bootstrap import paired_bootstrap

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", F.col("doc_id").alias("case_id"), (F.col("quality") - F.col("toxic")).cast("double").alias("delta"))
    return paired_bootstrap(rows, "lang")


# Answers: assistant turns; their passage is the turn before, the quote their first forty characters; judgments
# come from the turn's numbers.
def _answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("passage"))
    own = rows.filter("role = 'assistant'").join(asked, ["conv_id", "turn"])
    n, c = F.length("text"), F.col("conv_id")
    return own.select(
        "conv_id", "turn", "text", "passage", F.substring("text", 1, 40).alias("quote"), (c % 4 != 0).alias("answerable"), F.when(n % 5 == 0, "abstained").otherwise("answered").alias("status"),
        F.array(n % 2 == 0, F.when(n % 7 != 0, n % 3 == 0)).alias("claims"), F.when(n % 3 == 0, F.array(n % 2 == 1)).otherwise(F.array().cast("array<boolean>")).alias("qualifications"),
        F.array(F.when(n % 11 != 0, n % 13 == 0)).alias("forbidden"), F.array(F.when(c % 3 != 0, c % 3 == 1), n % 2 == 0).alias("citations"),
    )


_ANSWERS_SQL = """
answers as (
  select a.conv_id, a.turn, a.text, b.text as passage, substr(a.text, 1, 40) as quote, a.conv_id % 4 <> 0 as answerable, case when length(a.text) % 5 = 0 then 'abstained' else 'answered' end as status,
         [length(a.text) % 2 = 0, case when length(a.text) % 7 <> 0 then length(a.text) % 3 = 0 end] as claims,
         case when length(a.text) % 3 = 0 then [length(a.text) % 2 = 1] else [] end as qualifications,
         [case when length(a.text) % 11 <> 0 then length(a.text) % 13 = 0 end] as forbidden, [case when a.conv_id % 3 <> 0 then a.conv_id % 3 = 1 end, length(a.text) % 2 = 0] as citations
  from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn - 1 where a.role = 'assistant')"""


def _all(v: str, flip: str = "") -> str:
    """DuckDB: Kleene AND over a list."""
    return f"case when len(list_filter({v}, lambda x: x = {'true' if flip else 'false'})) > 0 then false when len(list_filter({v}, lambda x: x is null)) = 0 then true end"


@query("with " + _ANSWERS_SQL + r""",
verified as (select *, trim(quote) <> '' and (contains(passage, quote) or contains(array_to_string(list_filter(regexp_split_to_array(passage, '\s+'), lambda w: w <> ''), ' '),
  array_to_string(list_filter(regexp_split_to_array(quote, '\s+'), lambda w: w <> ''), ' '))) as ok from answers)
select conv_id, turn, ok as verified, case when text = passage then true when citations[1] and not ok then null else citations[1] end as value from verified""")
def citation_scoring(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    verified = A.quote_verified(F.col("quote"), F.col("passage"))
    return rows.select("conv_id", "turn", verified.alias("verified"), A.citation_value(F.col("citations")[0], F.col("text") == F.col("passage"), verified).alias("value"))


_SCORES = ("correct_abstention", "false_abstention", "unsupported_answer", "complete_claims", "complete_qualifications", "no_forbidden", "citations_supported")
_SCORE_SQL = _ANSWERS_SQL + f""",
scores as (
  select conv_id, turn, case when not answerable then status = 'abstained' end as correct_abstention, case when answerable then status = 'abstained' end as false_abstention,
         case when not answerable then status = 'answered' end as unsupported_answer, case when answerable then case when status = 'abstained' then false else {_all("claims")} end end as complete_claims,
         case when answerable and len(qualifications) > 0 then case when status = 'abstained' then false else {_all("qualifications")} end end as complete_qualifications,
         case when status = 'answered' then {_all("forbidden", "x")} end as no_forbidden, case when status = 'answered' and len(citations) > 0 then {_all("citations")} end as citations_supported,
         case when answerable then len(list_filter(claims, lambda x: x)) / len(claims) end as claim_share
  from answers)"""


@query("with " + _SCORE_SQL + f" select conv_id, turn, {', '.join(_SCORES)}, round(claim_share, 6) as claim_share from scores")
def answer_scores(spark, sf_dir):
    return A.score(_answers(spark, sf_dir)).select("conv_id", "turn", *_SCORES, F.round("claim_share", 6).alias("claim_share"))


@query("with " + _SCORE_SQL + """
select run, metric, coalesce(cohort, 'all') as cohort, cast(count_if(value) as bigint) as successes, count(value) as scored, count(*) - count(value) as unscored
from (select 'r' || turn % 2 as run, 'c' || conv_id % 3 as cohort, unnest(['claims', 'false_abstention']) as metric, unnest([complete_claims, false_abstention]) as value from scores)
group by grouping sets ((run, metric), (run, metric, cohort))""")
def quality_grouping_sets(spark, sf_dir):
    scores = A.score(_answers(spark, sf_dir))
    each = scores.select(
        F.concat(F.lit("r"), F.col("turn") % 2).alias("run"), F.concat(F.lit("c"), F.col("conv_id") % 3).alias("cohort"),
        F.explode(F.array(F.struct(F.lit("claims").alias("metric"), F.col("complete_claims").alias("value")), F.struct(F.lit("false_abstention").alias("metric"), F.col("false_abstention").alias("value")))).alias("m"),
    ).select("run", "cohort", "m.*")
    return A.quality_report(each, "run", "cohort", "metric", "value")


@query("with " + _ANSWERS_SQL + """
select conv_id, turn, kind, cast(item as int) as item, case when kind = 'forbidden' then not v else v end as value from (
  select conv_id, turn, 'claim' as kind, generate_subscripts(claims, 1) - 1 as item, unnest(claims) as v from answers
  union all select conv_id, turn, 'qualification', generate_subscripts(qualifications, 1) - 1, unnest(qualifications) from answers
  union all select conv_id, turn, 'forbidden', generate_subscripts(forbidden, 1) - 1, unnest(forbidden) from answers
  union all select conv_id, turn, 'citation', generate_subscripts(citations, 1) - 1, unnest(citations) from answers)""")
def grading_candidates(spark, sf_dir):
    return A.candidates(_answers(spark, sf_dir), ["conv_id", "turn"])


@query("""select role, count(*) as calls, cast(sum(length(text)) as bigint) as input_tokens, cast(count_if(turn % 4 = 3) as bigint) as unknown_usage, round(sum((length(text) * 0.1 + strlen(text) * 0.5) / 1e6), 9) as dollars
  from conversations group by role""")
def cost_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", "turn", F.length("text").alias("n"), F.octet_length("text").alias("b"))
    return rows.groupBy("role").agg(F.count("*").alias("calls"), F.sum("n").alias("input_tokens"), F.count_if(F.col("turn") % 4 == 3).alias("unknown_usage"), F.round(F.sum(A.cost(F.col("n"), F.col("b"), 0.1, 0.5)), 9).alias("dollars"))


@query("select conv_id, turn, reserved from (select conv_id, turn, cast(sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as reserved from conversations) where reserved <= 1500")
def budget_admission(spark, sf_dir):
    from attestor.operators.context import admitted

    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("amount"))
    return admitted(calls, F.lit(1500), "amount", "turn", "conv_id").select("conv_id", "turn", "reserved")


@query("""select doc_id, lang, cast(pick as int) as pick, printf('G%03d', row_number() over (order by lang, pick)) as number, cast(doc_id % 3 as int) as worker
from (select doc_id, lang, row_number() over (partition by lang order by sha256('seed:' || doc_id), doc_id) as pick from documents) where pick <= 2""")
def stratified_sample(spark, sf_dir):
    rows = sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 2, "seed")
    return sampling.round_robin(sampling.numbered(rows, ["lang", "pick"]), "doc_id", 3)


@query("""with n as (select doc_id, source, sha256(text) as h from documents)
select distinct doc_id, h from n where source = 'src0' and h in (select h from n where source <> 'src0')""")
def split_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return sampling.overlap(rows.filter("source = 'src0'"), rows.filter("source <> 'src0'"), "doc_id", "h")


@query("select lang, quality, toxic, count(*) as n from labels join documents using (doc_id) group by cube (lang, quality, toxic)")
def pool_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").cube("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query("""select metric, case when v is null then 'unresolved' when conv_id % 2 = 0 then 'deterministic' else 'semantic' end as mode, count(*) as n
from (select conv_id, unnest(['claim', 'citation']) as metric, unnest([case when length(text) % 7 <> 0 then length(text) % 3 = 0 end, case when conv_id % 3 <> 0 then true end]) as v from conversations) group by all""")
def audit_summary(spark, sf_dir):
    n, c = F.length("text"), F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.array(F.struct(F.lit("claim").alias("metric"), F.when(n % 7 != 0, n % 3 == 0).alias("v")), F.struct(F.lit("citation").alias("metric"), F.when(c % 3 != 0, True).alias("v")))).alias("m"))
    mode = F.when(F.col("m.v").isNull(), "unresolved").when(c % 2 == 0, "deterministic").otherwise("semantic")
    return rows.groupBy(F.col("m.metric").alias("metric"), mode.alias("mode")).agg(F.count("*").alias("n"))


# Runs: the sources of documents, each with its set of distinct texts.
@query("""with r as (select distinct source, sha256(text) as h from documents), n as (select source, count(*) as n from r group by source), l as (select source, list_sort(list(distinct lang)) as langs from documents group by source),
s as (select a.source as run_a, b.source as run_b, count(*) as shared from r a join r b on a.h = b.h and a.source < b.source group by all)
select a.source as run_a, b.source as run_b, coalesce(shared, 0) as shared, coalesce(shared, 0) = n.n as subset, a.langs = b.langs as same_langs
from l a join l b on a.source < b.source join n on n.source = a.source left join s on s.run_a = a.source and s.run_b = b.source""")
def run_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("source").alias("run"), F.sha2("text", 256).alias("h")).distinct()
    runs = docs.groupBy(F.col("source").alias("run")).agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return E.run_pairs(runs, texts, "run", "h").select("run_a", "run_b", "shared", "subset", (F.col("langs_a") == F.col("langs_b")).alias("same_langs"))


@query("""select event_type, count(distinct rankings) = 1 as stable from (
  select event_type, user_id, array_to_string(list(event_id order by value desc, event_id)[1:3], ',') as rankings from events where user_id < 40 group by all) group by event_type""")
def ranking_stability(spark, sf_dir):
    from attestor.operators.retrieval import ranked

    rows = table(spark, sf_dir, "events").withColumn("q", F.concat_ws("/", "event_type", F.col("user_id").cast("string")))
    top = ranked(rows, 3, "q", "value", ["event_id"])
    lists = top.groupBy("event_type", "user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda r: r["event_id"].cast("string")), ",").alias("rankings"))
    return lists.groupBy("event_type").agg((F.count_distinct("rankings") == 1).alias("stable"))


@query("""select conv_id, array_to_string(cited, ',') as cited, cast(len(cited) as int) as n from (
  select conv_id, list(speaker order by first_turn) as cited from (select conv_id, role as speaker, min(turn) as first_turn from conversations group by all) group by conv_id)""")
def citation_numbers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    lists = turns.groupBy("conv_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("first_turn", "role"))), lambda r: r["role"])).alias("cited"))
    return lists.select("conv_id", F.array_join("cited", ",").alias("cited"), F.size("cited").alias("n"))


# Tiers in order of priority, with the memory each needs; fixed values.
_TIERS = (("full", 1, 10.0), ("standard", 2, 5.0), ("light", 3, 2.5), ("minimal", 4, 0.25))


@query(f"""select o_orderkey as request, arg_min(name, priority) as tier from orders join (select unnest({[t[0] for t in _TIERS]}) as name, unnest({[t[1] for t in _TIERS]}) as priority, unnest({[t[2] for t in _TIERS]}) as need) t
  on need <= o_totalprice / 30000 group by o_orderkey""")
def tier_choice(spark, sf_dir):
    memory = F.col("o_totalprice") / 30000
    choice = F.coalesce(*[F.when(memory >= need, name) for name, _, need in _TIERS])  # in order of priority
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), choice.alias("tier")).filter("tier is not null")


@query("""with r as (select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)),
c as (select b.item_id, case when count(r.doc_id) = 0 then 'unanswerable' when count(r.doc_id) > 1 then 'comparison' else 'factual' end as category, count(r.doc_id) as sources from benchmark b left join r using (item_id) group by b.item_id)
select category, count(*) as cases, cast(sum(sources) as bigint) as sources, cast(count_if(category = 'comparison' and sources < 2 or category = 'unanswerable' and sources > 0) as bigint) as invalid from c group by category""")
def case_summary(spark, sf_dir):
    counted = table(spark, sf_dir, "benchmark").select("item_id").join(I.references(spark, sf_dir), "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("sources"))
    kinds = counted.withColumn("category", F.when(F.col("sources") == 0, "unanswerable").when(F.col("sources") > 1, "comparison").otherwise("factual"))
    bad = (F.col("category") == "comparison") & (F.col("sources") < 2) | (F.col("category") == "unanswerable") & (F.col("sources") > 0)
    return kinds.groupBy("category").agg(F.count("*").alias("cases"), F.sum("sources").alias("sources"), F.count_if(bad).alias("invalid"))


@query("with " + I.PASSAGES_SQL + """ select count(*) as passages, cast(count_if(truncated) as bigint) as truncated, round(cast(count_if(truncated) as bigint) / count(*), 9) as truncation_rate, cast(count_if(retained > n) as bigint) as invalid
from (select length(text) as n, length(text) > 500 as truncated, least(length(text), 500) as retained from passages)""")
def encoder_truncation(spark, sf_dir):
    n = F.length("text")
    rows = I.passages(spark, sf_dir).select(n.alias("n"), (n > 500).alias("truncated"), F.least(n, F.lit(500)).alias("retained"))
    return rows.agg(F.count("*").alias("passages"), F.count_if("truncated").alias("truncated"), F.round(F.count_if("truncated") / F.count("*"), 9).alias("truncation_rate"), F.count_if(F.col("retained") > F.col("n")).alias("invalid"))


@query("""select lang, count(*) as cases, count(quality) as judged, cast(count_if(quality = 1) as bigint) as passed, round(cast(count_if(quality = 1) as bigint) / nullif(count(quality), 0), 9) as rate, round(cast(count_if(quality = 1) as bigint) / count(*), 9) as rate_with_failures,
  median(n_chars) as median_chars, quantile_disc(n_chars, 0.95) as p95_chars from documents left join labels using (doc_id) group by grouping sets ((), (lang))""")
def run_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    passed = F.count_if(F.col("quality") == 1)
    return rows.groupingSets([[], [F.col("lang")]], F.col("lang")).agg(
        F.count("*").alias("cases"), F.count("quality").alias("judged"), passed.alias("passed"), F.round(passed / F.nullif(F.count("quality"), F.lit(0)), 9).alias("rate"),
        F.round(passed / F.count("*"), 9).alias("rate_with_failures"), F.median("n_chars").alias("median_chars"), F.expr("percentile_disc(0.95) within group (order by n_chars)").cast("long").alias("p95_chars"),
    )


@query("""select budget, count(*) as calls, cast(sum(tokens) as bigint) as input_tokens, round(sum(tokens) * 0.1 / 1e6 + count(*) * 1000 * 0.5 / 1e6, 9) as estimate
from (select unnest([4000, 12000, 16000]) as budget, length(text) as n from benchmark) b, lateral (select least(n, budget) + strlen('framing') as tokens) group by budget""")
def plan_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.lit(4000), F.lit(12000), F.lit(16000))).alias("budget"), F.length("text").alias("n"))
    tokens = rows.withColumn("tokens", F.least("n", "budget") + 7)
    return tokens.groupBy("budget").agg(F.count("*").alias("calls"), F.sum("tokens").alias("input_tokens"), F.round(A.cost(F.sum("tokens"), F.count("*") * 1000, 0.1, 0.5), 9).alias("estimate"))
