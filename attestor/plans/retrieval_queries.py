"""Passages, retrieval and context budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import context as C
from attestor.operators import passages as P
from attestor.operators import retrieval as R
from attestor.plans import inputs as I
from attestor.plans.registry import query, table
from attestor.sources import articles, artifacts


@query("with " + I.PASSAGES_SQL + "select passage_id, document_id, paragraph, word_offset, sha256(text) as text_sha256, cast(length(text) as bigint) as n_chars from passages")
def chunk_passages(spark, sf_dir):
    rows = I.passages(spark, sf_dir)
    return rows.select("passage_id", "document_id", "paragraph", "word_offset", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


@query("select text, count(*) as n from documents group by text having count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return P.duplicates(table(spark, sf_dir, "documents"), "text")


@query("with " + I.QUESTIONS_SQL + "select item_id, text, 'query: ' || text as prefixed, cast(strlen(text) + 8192 as bigint) as token_bound, substr(text, 1, 60) as shown from questions")
def question_inputs(spark, sf_dir):
    from attestor.operators.answers import token_bound

    rows = I.questions(spark, sf_dir)
    return rows.select("item_id", "text", F.concat(F.lit("query: "), "text").alias("prefixed"), token_bound(F.col("text")).cast("long").alias("token_bound"), F.substring("text", 1, 60).alias("shown"))


@query("with " + I.lexical_sql(4) + " select item_id, passage_id, cast(rank as int) as rank, round(score, 6) as score from hits")
def tfidf_topk(spark, sf_dir):
    return I.lexical(spark, sf_dir, 4).select("item_id", "passage_id", "rank", F.round("score", 6).alias("score"))


@query("with " + I.dense_sql(10) + " select query_id, vec_id, cast(rank as int) as rank, round(score, 6) as score from dense")
def dense_topk(spark, sf_dir):
    return I.dense(spark, sf_dir, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


# Hybrid: the dense list of an item is that of the vector with its number, over the documents' first passages.
_HYBRID_SQL = I.lexical_sql(20) + """,
near as (
  select b.item_id, v.vec_id, list_inner_product(cast(q.embedding as double[]), cast(v.embedding as double[])) as score
  from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings v),
near20 as (select * from (select *, row_number() over (partition by item_id order by round(greatest(-1, least(1, score)), 9) desc, vec_id) as rank from near) where rank <= 20),
parts as (
  select item_id, passage_id, 0.6 / (60 + rank) as part from hits
  union all select item_id, 'd' || vec_id || ':p1:w0', 0.4 / (60 + rank) from near20),
fused as (select item_id, passage_id, sum(part) as score from parts group by all)
select item_id, passage_id, cast(rank as int) as rank, round(score, 6) as score
from (select *, row_number() over (partition by item_id order by round(score, 9) desc, passage_id) as rank from fused) where rank <= 10
"""


@query("with " + _HYBRID_SQL)
def rrf_hybrid(spark, sf_dir):
    own = I.vectors(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(own, "vec_id").select(F.col("vec_id").alias("query_id"), "vector")
    near = R.dense(asked, own, 20).select(F.col("query_id").alias("item_id"), F.concat(F.lit("d"), "vec_id", F.lit(":p1:w0")).alias("passage_id"), "rank")
    fused = R.reciprocal_rank_fusion([(I.lexical(spark, sf_dir, 20), 0.6), (near, 0.4)], ["item_id", "passage_id"])
    return R.ranked(fused, 10, "item_id", "score", ["passage_id"]).select("item_id", "passage_id", "rank", F.round("score", 6).alias("score"))


# The reranker's stand-in scores a pair by its hash.
@query("with " + I.lexical_sql(20) + """
select item_id, passage_id, cast(new_rank as int) as rank, round(utility, 6) as utility from (
  select *, row_number() over (partition by item_id order by given desc, doc_id, paragraph, word_offset) as new_rank from (
    select *, 1 - (rank - 1) / count(*) over (partition by item_id) as utility, cast('0x' || substr(sha256(item_id || ':' || passage_id), 1, 2) as int) as given from hits))
where new_rank <= 5""")
def rerank_topk(spark, sf_dir):
    pool = R.with_utility(I.lexical(spark, sf_dir, 20), "item_id")
    digest = F.sha2(F.concat_ws(":", F.col("item_id").cast("string"), "passage_id"), 256)
    scores = pool.select("item_id", "passage_id", F.conv(F.substring(digest, 1, 2), 16, 10).cast("double").alias("score"))
    return R.rerank(pool, scores, ["item_id", "passage_id"], 5, "item_id", I.ORDER).select("item_id", "passage_id", "rank", F.round("utility", 6).alias("utility"))


@query()
def mmr_select(spark, sf_dir):
    pool = I.dense(spark, sf_dir, 40).withColumnRenamed("vec_id", "candidate_id")
    return R.diverse(pool.join(I.vectors(spark, sf_dir).withColumnRenamed("vec_id", "candidate_id"), "candidate_id"), 10, 0.5)


@query("select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def containment_join(spark, sf_dir):
    return I.references(spark, sf_dir)


def _json_len(column: str) -> str:
    """DuckDB: length of a JSON string with all but ASCII escaped."""
    return rf"""(2 + length({column}) + length(regexp_replace({column}, '[^"\\\n\r\t\x08\f]', '', 'g'))
  + 5 * length(regexp_replace({column}, '[\x20-\x7E\n\r\t\x08\f]', '', 'g')) + 6 * length(regexp_replace({column}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"""


@query(f"select doc_id, cast({_json_len('text')} as bigint) as json_chars from documents")
def json_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.json_string_length(F.col("text")).cast("long").alias("json_chars"))


_BUDGET = 9000


def _costed(spark, sf_dir, limit=20):
    texts = I.passages(spark, sf_dir).select("passage_id", "text")
    return C.with_cost(I.lexical(spark, sf_dir, limit).join(texts, "passage_id").withColumn("kind", F.lit("synthetic")))


_COSTED_SQL = I.lexical_sql(20) + f""",
costed as (
  select item_id, passage_id, rank, least(length(text), 3000) as visible_chars,
         28 + {_json_len("passage_id")} + 11 + {_json_len("shown")} as item_chars
  from (select hits.*, text, substr(text, 1, 3000) as shown from hits join passages using (passage_id))),
supplied as (
  select * from (select *, sum(item_chars + 2) over (partition by item_id order by rank rows unbounded preceding) as total_chars from costed) where total_chars <= {_BUDGET})"""


@query("with " + _COSTED_SQL + " select item_id, passage_id, cast(rank as int) as rank, cast(visible_chars as bigint) as visible_chars, cast(total_chars as bigint) as total_chars from supplied")
def context_characters(spark, sf_dir):
    rows = C.character_budget(_costed(spark, sf_dir), _BUDGET, "item_id")
    return rows.select("item_id", "passage_id", "rank", F.col("visible_chars").cast("long").alias("visible_chars"), F.col("total_chars").cast("long").alias("total_chars"))


@query("with recursive " + _COSTED_SQL + """,
walk as (
  select item_id, cast(0 as bigint) as place, cast(0 as bigint) as used, cast(null as varchar) as passage_id, false as kept from (select distinct item_id from costed)
  union all
  select w.item_id, w.place + 1, case when w.used + c.item_chars + 2 <= 1500 then cast(w.used + c.item_chars + 2 as bigint) else w.used end, c.passage_id, w.used + c.item_chars + 2 <= 1500
  from walk w join costed c on c.item_id = w.item_id and c.rank = w.place + 1 where w.place < 4)
select item_id, passage_id, cast(place as int) as rank, used as total_chars from walk where kept""")
def context_passages(spark, sf_dir):
    return C.passage_budget(_costed(spark, sf_dir), 1500, "item_id").select("item_id", "passage_id", "rank", "total_chars")


@query("with " + _COSTED_SQL + " select item_id, passage_id, cast(rank as int) as rank from hits where (item_id, passage_id) not in (select item_id, passage_id from supplied)")
def omitted_passages(spark, sf_dir):
    hits = _costed(spark, sf_dir)
    return C.omitted(hits, C.character_budget(hits, _BUDGET, "item_id"), ["item_id", "passage_id"]).select("item_id", "passage_id", "rank")


@query("""select count(*) as vectors, count(*) - count(distinct vec_id) as repeated_ids, count(distinct len(embedding)) as widths,
  cast(count_if(len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0) as bigint) as not_finite,
  cast(count_if(abs(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) - 1) > 1.1e-4) as bigint) as not_unit from embeddings""")
def validate_vectors(spark, sf_dir):
    return artifacts.vector_faults(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def page_extract(spark, sf_dir):
    return articles.paragraphs(table(spark, sf_dir, "pages"), "page_id", "html", "html").drop("authors", "published")
