"""Plug-ins and the evaluation of a retriever: from cases to hits, metrics, coverage, contexts and answers.

A batch answers all questions at once.  Plug-ins are plain objects:

* a **retriever** has ``search(questions, limit)``: (query_id, text) to (query_id, passage_id, score, rank);
  optionally ``diagnostics()``: what its encoder retained of each passage;
* an **encoder** is a function of a list of texts that gives a matrix, made once a task by a factory;
* a **scorer** is a function of lists of questions and passages that gives scores, made likewise;
* a **provider** is a function of a question and its passages (dicts of id, kind, text) that gives a dict of
  status and sections, made likewise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions.shared import stored
from attestor.functions.shipping import ship
from attestor.operators import context as C
from attestor.operators import contracts, evaluation, reporting, retrieval, validation

Encode = Callable[[list[str]], np.ndarray]
Score = Callable[[list[str], list[str]], Sequence[float]]
Answer = Callable[[str, list[dict]], dict]
ORDER = "ord"


class Retriever(Protocol):
    def search(self, questions: DataFrame, limit: int) -> DataFrame: ...


def _encoded(factory: Callable[[], Encode], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encode = factory()
    for batch in batches:
        matrix = np.asarray(encode(batch["text"].tolist()), np.float64)
        if matrix.ndim != 2 or len(matrix) != len(batch) or not np.isfinite(matrix).all():
            raise ValueError("an encoder gives one finite vector a text")
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        yield pd.DataFrame({"id": batch["id"], "vector": (matrix / np.where(norms > 0, norms, 1)).tolist()})


def encoded(texts: DataFrame, id_: str, factory: Callable[[], Encode]) -> DataFrame:
    """(id, vector): unit vectors of the column text; blank texts have none."""
    ship(texts.sparkSession)
    rows = texts.filter(T.strip(F.col("text")) != "").select(F.col(id_).alias("id"), "text")
    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(partial(_encoded, factory), f"id {kind}, vector array<double>")


def _counted(factory: Callable[[], Callable[[list[str]], Sequence[int]]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count = factory()
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "tokens": list(count(batch["text"].tolist()))})


def token_counts(texts: DataFrame, id_: str, factory: Callable[[], Callable[[list[str]], Sequence[int]]]) -> DataFrame:
    """(id, tokens): how many tokens a tokenizer, a plug-in like the encoder, makes of each text; an estimate of what a provider bills."""
    ship(texts.sparkSession)
    rows = texts.select(F.col(id_).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(partial(_counted, factory), f"id {dict(rows.dtypes)['id']}, tokens long")


def _named(hits: DataFrame, passages: DataFrame, limit: int) -> DataFrame:
    """Hits over artifact places as hits over passages, ranked by score and place."""
    ranked = retrieval.ranked(hits, limit, "query_id", "score", [ORDER])
    return ranked.join(passages.select(ORDER, "passage_id"), ORDER).select("query_id", "passage_id", ORDER, "score", "rank")


@dataclass
class Lexical:
    """TF-IDF over ``passages`` (ord long, passage_id, text); hits have a positive score."""

    passages: DataFrame
    stop_words: Sequence[str] = T.STOP_WORDS
    index: retrieval.LexicalIndex | None = None

    def search(self, questions: DataFrame, limit: int) -> DataFrame:
        self.index = self.index or retrieval.lexical_index(self.passages, [ORDER], self.stop_words)
        return _named(self.index.search(questions, "query_id"), self.passages, limit)


@dataclass
class Dense:
    """Exact search by inner product over ``vectors`` (ord long, vector), with the same encoder for the questions."""

    passages: DataFrame
    vectors: DataFrame
    encoder: Callable[[], Encode]
    query_prefix: str = ""
    measured: DataFrame | None = None

    def search(self, questions: DataFrame, limit: int) -> DataFrame:
        asked = questions.filter(T.strip(F.col("text")) != "").withColumn("text", F.concat(F.lit(self.query_prefix), "text"))
        numbered = stored(asked.select("query_id", "text").withColumn("number", F.monotonically_increasing_id()), "questions")
        queries = encoded(numbered, "number", self.encoder).select(F.col("id").alias("query_id"), "vector")
        hits = retrieval.dense(queries, self.vectors.select(F.col(ORDER).alias("vec_id"), "vector"), limit).drop("rank")
        named = hits.withColumnsRenamed({"query_id": "number", "vec_id": ORDER}).join(numbered.select("number", "query_id"), "number").drop("number")
        return _named(named, self.passages, limit)

    def diagnostics(self) -> DataFrame | None:
        return self.measured


@dataclass
class Hybrid:
    """Fused ranks of two retrievers; one of weight zero is not asked."""

    lexical: Retriever
    dense: Retriever
    passages: DataFrame
    lexical_weight: float = 1.0
    dense_weight: float = 1.0
    candidates: int = 20
    rrf_k: int = 60

    def search(self, questions: DataFrame, limit: int) -> DataFrame:
        sides = [(r.search(questions, max(limit, self.candidates)), w) for r, w in ((self.lexical, self.lexical_weight), (self.dense, self.dense_weight)) if w]
        fused = retrieval.reciprocal_rank_fusion(sides, ["query_id", ORDER], self.rrf_k)
        return _named(fused, self.passages, limit)

    def diagnostics(self) -> DataFrame | None:
        return getattr(self.dense, "diagnostics", lambda: None)()


def _scored(factory: Callable[[], Score], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    score = factory()
    for batch in batches:
        values = np.asarray(score(batch["question"].tolist(), batch["text"].tolist()), np.float64)
        if values.shape != (len(batch),) or not np.isfinite(values).all():
            raise ValueError("a scorer gives one finite score a pair")
        yield batch[["query_id", ORDER]].assign(score=values)


@dataclass
class Reranked:
    """A fixed pool of candidates in the order of a scorer, or, with diversity, a choice of unlike ones (vectors: ord, vector)."""

    base: Retriever
    scorer: Callable[[], Score]
    passages: DataFrame
    candidates: int = 40
    diversity: float = 0.0
    vectors: DataFrame | None = None

    def search(self, questions: DataFrame, limit: int) -> DataFrame:
        if limit > self.candidates:
            raise ValueError("more hits asked for than there are candidates")
        pool = self.base.search(questions, self.candidates)
        pairs = pool.join(questions.select("query_id", F.col("text").alias("question")), "query_id").join(self.passages.select(ORDER, "text"), ORDER).select("query_id", ORDER, "question", "text")
        ship(pairs.sparkSession)
        kind = dict(pairs.dtypes)["query_id"]
        scores = pairs.mapInPandas(partial(_scored, self.scorer), f"query_id {kind}, {ORDER} long, score double")
        ranked = retrieval.rerank(pool, scores, ["query_id", ORDER], self.candidates, "query_id", [ORDER])
        if self.diversity:
            numbered = ranked.join(self.vectors.select(ORDER, "vector"), ORDER).select("query_id", F.col(ORDER).alias("candidate_id"), "rank", "vector")
            chosen = retrieval.diverse(numbered, limit, self.diversity).withColumnRenamed("candidate_id", ORDER)
            return chosen.join(ranked.drop("rank"), ["query_id", ORDER]).select("query_id", "passage_id", ORDER, "score", "rank")
        return ranked.filter(F.col("rank") <= limit).select("query_id", "passage_id", ORDER, "score", "rank")


def make_retriever(settings, passages: DataFrame, vectors: DataFrame | None = None, encoder: Callable[[], Encode] | None = None, scorer: Callable[[], Score] | None = None, measured: DataFrame | None = None) -> Retriever:
    """The retriever that ``attestor.settings.Settings`` describe; what it needs is asked for before anything is built."""
    if settings.retrieval_reranker != "none" and scorer is None:
        raise ValueError("reranking needs a scorer")
    if settings.retrieval_backend != "tfidf" and (vectors is None or encoder is None):
        raise ValueError("dense retrieval needs vectors and their encoder")
    if settings.retrieval_backend == "tfidf":
        return Lexical(passages)
    found: Retriever = Dense(passages, vectors, encoder, measured=measured)
    if settings.retrieval_backend == "hybrid":
        found = Hybrid(Lexical(passages), found, passages, settings.hybrid_lexical_weight, settings.hybrid_embedding_weight, settings.hybrid_candidates, settings.hybrid_rrf_k)
    if settings.retrieval_reranker != "none":
        found = Reranked(found, scorer, passages, settings.retrieval_rerank_candidates, settings.retrieval_diversity, vectors)
    return found


def first_passage() -> Answer:
    """A provider for tests: the first passage's first sentence, cited; without passages it abstains."""

    def answer(question: str, passages: list[dict]) -> dict:
        if not passages:
            return {"status": "insufficient_evidence", "sections": []}
        return {"status": "answered", "sections": [{"text": passages[0]["text"].split(". ")[0], "citation_ids": [passages[0]["id"]]}]}

    return answer


def _answered(factory: Callable[[], Answer], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    provider = factory()
    for batch in batches:
        rows = []
        for id_, question, items in zip(batch["query_id"], batch["question"], batch["items"], strict=True):
            try:
                given = provider(question, [{k: i[k] for k in ("id", "kind", "text")} for i in items])
                rows.append((id_, given["status"], given["sections"], None))
            except Exception:  # its message may hold what was sent
                rows.append((id_, None, [], "generation_failed"))
        yield pd.DataFrame(rows, columns=["query_id", "status", "sections", "error"])


def answers(contexts: DataFrame, questions: DataFrame, factory: Callable[[], Answer]) -> DataFrame:
    """(query_id, status, sections, error) from contexts (query_id, rank, passage_id, kind, shown); a failing call is an error row."""
    items = contexts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("passage_id").alias("id"), "kind", F.col("shown").alias("text")))), lambda i: F.struct(i["id"].alias("id"), i["kind"].alias("kind"), i["text"].alias("text"))).alias("items"))
    empty = F.expr("cast(array() as array<struct<id:string,kind:string,text:string>>)")
    rows = questions.select("query_id", F.col("text").alias("question")).join(items, "query_id", "left").withColumn("items", F.coalesce("items", empty))
    ship(rows.sparkSession)
    return rows.mapInPandas(partial(_answered, factory), f"query_id {dict(rows.dtypes)['query_id']}, status string, sections array<struct<text:string,citation_ids:array<string>>>, error string")


def context(hits: DataFrame, passages: DataFrame, budget: int) -> DataFrame:
    """What a budget supplies of the hits: 4 means the passages mode, more are serialized characters."""
    rows = C.with_cost(hits.join(passages.select("passage_id", "document_id", "kind", "text"), "passage_id")).withColumn("shown", F.substring("text", 1, C.PROVIDER_CHARS))
    kept = C.passage_budget(rows, C.MAX_PASSAGES_CHARS, "query_id") if budget == C.PASSAGE_CANDIDATES else C.character_budget(rows, budget, "query_id")
    return rows.join(kept.select("query_id", "passage_id", "total_chars"), ["query_id", "passage_id"])


@dataclass
class Run:
    """The tables of a run; ``results`` has a row for each case, whether its retrieval failed or not."""

    hits: DataFrame
    metrics: DataFrame
    coverage: DataFrame | None
    contexts: dict[int, DataFrame]
    answers: DataFrame | None
    results: DataFrame
    configuration: dict = field(default_factory=dict)


def _coverage(spans: DataFrame, hits: DataFrame, ranges: DataFrame, cutoffs: Sequence[int], view: str) -> DataFrame:
    """(query_id, group_id, covered, k, view) of the first k hits."""
    parts = [evaluation.evidence_coverage(evaluation.span_visibility(spans, hits.filter(F.col("rank") <= k), ranges, "query_id"), "query_id")[0].withColumn("k", F.lit(k)) for k in cutoffs]
    return reduce(DataFrame.unionByName, parts).withColumn("view", F.lit(view))


def group_summary(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage and completeness of each of ``keys`` from its groups (Kleene: an unknown group leaves both unknown)."""
    from attestor.functions.kleene import k_and

    share: Column = F.when(F.count("covered") == F.count("*"), F.avg(F.col("covered").cast("int")))
    return groups.groupBy(*keys).agg(share.alias("group_coverage"), k_and(F.col("covered")).alias("complete_evidence"))


def run_evaluation(
    cases: DataFrame, references: DataFrame, passages: DataFrame, retriever: Retriever, limit: int = 10, cutoffs: Sequence[int] = (1, 4, 10), spans: DataFrame | None = None,
    budgets: Sequence[int] = (), provider: Callable[[], Answer] | None = None, failed: DataFrame | None = None, repeats: int = 1, configuration: dict | None = None,
) -> Run:
    """Search all questions once, and score every cutoff as a prefix of that ranking.

    ``cases``: query_id, text, expected_abstention, category; ``references``: query_id, document_id, passage_id;
    ``passages``: ord, passage_id, document_id, kind, text; ``spans``: query_id, group_id, alternative, passage_id, start,
    end; ``failed``: query_id of questions whose retrieval failed (scored zero, their hits don't count).
    """
    if not cutoffs or any(k < 1 or k > limit for k in cutoffs):
        raise ValueError("cutoffs must lie within the limit")
    if any(b < 4 for b in budgets) or any(b != 4 for b in budgets) and limit < 40:
        raise ValueError("character budgets need at least 40 ranked candidates")
    asked = cases.select("query_id", "text")
    found = stored(retriever.search(asked, limit), "hits")
    contracts.require_none(validation.hit_faults(found, passages, "query_id", limit))
    stable = None
    if repeats > 1:
        again = reduce(DataFrame.unionByName, [retriever.search(asked, limit).withColumn("turn", F.lit(i)) for i in range(1, repeats)]).unionByName(found.withColumn("turn", F.lit(0)))
        lists = again.groupBy("query_id", "turn").agg(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))).alias("ids"))
        stable = lists.groupBy("query_id").agg((F.count_distinct("ids") == 1).alias("stable"))
    none = cases.select("query_id").limit(0) if failed is None else failed.select("query_id").distinct()
    hits = found.join(none, "query_id", "left_anti").join(passages.select("passage_id", "document_id"), "passage_id")
    relevant = references.select("query_id", "passage_id")
    if spans is not None:  # labelled cases by their labels, the others by their references
        labelled = spans.select("query_id").distinct()
        relevant = relevant.join(labelled, "query_id", "left_anti").unionByName(spans.select("query_id", "passage_id"))
    sources = references.select("query_id", "document_id").distinct()
    metrics = reporting.case_metrics(cases, sources, references, hits, relevant, "query_id", cutoffs)
    coverage = None
    if spans is not None:
        whole = passages.select("passage_id", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))).alias("retained"))
        coverage = _coverage(spans, hits, whole, cutoffs, "ranking")
        if (measured := getattr(retriever, "diagnostics", lambda: None)()) is not None:
            coverage = coverage.unionByName(_coverage(spans, hits, measured.select("passage_id", F.col("retained_ranges").alias("retained")), cutoffs, "encoder"))
        groups = group_summary(coverage.filter("view = 'ranking'"), ["query_id", "k"])
        metrics = metrics.join(groups, ["query_id", "k"], "left")
    else:
        metrics = metrics.withColumn("group_coverage", F.lit(None).cast("double")).withColumn("complete_evidence", F.lit(None).cast("boolean"))
    metrics = stored(metrics, "metrics")
    contexts = {b: context(hits, passages, b) for b in budgets}
    given = answers(contexts[budgets[0]], asked, provider) if provider and budgets else None
    best = metrics.filter(F.col("k") == max(cutoffs)).drop("k")
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    results = cases.select("query_id", "category", "expected_abstention").join(best, "query_id", "left").join(counts, "query_id", "left").join(none.withColumn("error", F.lit("retrieval_failed")), "query_id", "left").fillna(0, ["n_hits"])
    results = results.join(stable, "query_id", "left") if stable is not None else results.withColumn("stable", F.lit(None).cast("boolean"))
    if given is not None:
        results = results.join(given.select("query_id", F.col("status").alias("answer_status"), F.col("error").alias("_failed")), "query_id", "left").withColumn("error", F.coalesce("error", "_failed")).drop("_failed")
    return Run(found, metrics, coverage, contexts, given, results, configuration or {})


def unmeasured(hits: DataFrame, measured: DataFrame) -> DataFrame:
    """Retrieved passages that the encoder's measurements lack: (query_id, passage_id)."""
    return hits.select("query_id", "passage_id").join(measured.select("passage_id"), "passage_id", "left_anti")


def compare(runs: dict[str, Run], cases: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """The cutoff reports of several runs over the same cases, by run."""
    parts = [reporting.cutoff_report(r.metrics, cases, "query_id", cutoffs).withColumn("run", F.lit(name)) for name, r in runs.items()]
    return reduce(DataFrame.unionByName, parts)


def fits(memory_gib: float, need_gib: float) -> bool:
    """Whether a model may be loaded: unknown memory doesn't admit it."""
    return math.isfinite(memory_gib) and memory_gib >= need_gib


def first_loadable(tiers: Sequence[tuple[str, float]], memory_gib: float, load: Callable[[str], Retriever]) -> tuple[str, Retriever]:
    """The first tier (name, GiB) that fits and loads; one without an artifact is passed over."""
    for name, need in tiers:
        if fits(memory_gib, need):
            try:
                return name, load(name)
            except (FileNotFoundError, ValueError):
                continue
    raise RuntimeError("no retrieval tier fits the memory and has an artifact")
