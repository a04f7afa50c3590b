"""Plug-ins and whole evaluations over a few passages."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attestor import runner
from attestor.settings import Settings

TEXTS = ["moss grows on wet stone", "lichen grows on dry bark", "ferns need deep shade", "a stone wall holds heat", "bark beetles bore holes", "shade keeps soil wet"]


@pytest.fixture(scope="module")
def passages(spark):
    rows = [(i, f"d{i // 2}:p{i % 2 + 1}:w0", f"d{i // 2}", "synthetic", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "ord long, passage_id string, document_id string, kind string, text string").cache()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "Where does moss grow, on wet stone?"), (2, "bark beetles"), (3, " "), (4, "quantum chromodynamics")], "query_id int, text string").cache()


def letters():
    def encode(texts):
        return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], float)

    return encode


def overlap():
    def score(questions, texts):
        return [len(set(q.lower().split()) & set(t.lower().split())) for q, t in zip(questions, texts, strict=True)]

    return score


@pytest.fixture(scope="module")
def vectors(passages):
    return runner.encoded(passages, "ord", letters).withColumnRenamed("id", "ord").cache()


def first(hits):
    return {r.query_id: r.passage_id for r in hits.filter("rank = 1").collect()}


def test_retrievers(passages, vectors, questions):
    lexical = runner.make_retriever(Settings(), passages)
    assert first(lexical.search(questions, 3)) == {1: "d0:p1:w0", 2: "d2:p1:w0"}
    dense = runner.make_retriever(Settings(retrieval_backend="embeddings"), passages, vectors, letters)
    found = dense.search(questions, 2)
    assert {r.query_id for r in found.collect()} == {1, 2, 4} and found.count() == 6 and first(found)[2] == "d2:p1:w0"
    hybrid = runner.make_retriever(Settings(retrieval_backend="hybrid", hybrid_embedding_weight=0.0), passages, vectors, letters)
    assert first(hybrid.search(questions, 3)) == first(lexical.search(questions, 3))
    reranked = runner.make_retriever(Settings(retrieval_backend="embeddings", retrieval_reranker="minilm", retrieval_rerank_candidates=6), passages, vectors, letters, overlap)
    rows = reranked.search(questions, 2).orderBy("query_id", "rank").collect()
    assert [r.passage_id for r in rows if r.query_id == 1] == ["d0:p1:w0", "d0:p2:w0"] and all(r.rank <= 2 for r in rows)
    diverse = runner.Reranked(dense, overlap, passages, 6, 0.9, vectors)
    assert diverse.search(questions.filter("query_id = 2"), 3).count() == 3
    with pytest.raises(ValueError):
        reranked.search(questions, 7)


def test_plug_ins_are_asked_for_first(passages, vectors):
    for settings, given in ((Settings(retrieval_backend="embeddings"), {}), (Settings(retrieval_backend="hybrid", retrieval_reranker="minilm"), {"vectors": vectors, "encoder": letters})):
        with pytest.raises(ValueError):
            runner.make_retriever(settings, passages, **given)
    with pytest.raises(PySparkException):
        runner.encoded(passages, "ord", lambda: lambda texts: np.full((len(texts), 2), np.nan)).collect()


@pytest.fixture(scope="module")
def cases(questions):
    return questions.filter("query_id <> 3").withColumn("expected_abstention", F.col("query_id") == 4).withColumn("category", F.when(F.col("query_id") == 4, "unanswerable").otherwise("factual"))


def test_evaluation(spark, passages, cases):
    references = spark.createDataFrame([(1, "d0", "d0:p1:w0"), (1, "d1", "d1:p2:w0"), (2, "d2", "d2:p1:w0")], "query_id int, document_id string, passage_id string")
    spans = spark.createDataFrame([(1, "part-a", 0, "d0:p1:w0", 0, 4), (1, "part-b", 0, "d1:p1:w0", 0, 5), (2, "part-a", 0, "d2:p1:w0", 0, 4)], "query_id int, group_id string, alternative int, passage_id string, start int, end int")
    run = runner.run_evaluation(cases, references, passages, runner.Lexical(passages), 40, (1, 4), spans, (4, 12_000), runner.first_passage, repeats=2)
    rows = {(r.query_id, r.k): r for r in run.metrics.collect()}
    assert (rows[1, 1].reciprocal_rank, rows[1, 1].source_recall, rows[1, 1].passage_recall, rows[1, 4].source_recall, rows[1, 1].group_coverage, rows[1, 1].complete_evidence) == (1, 0.5, 0.5, 1, 0.5, False)
    assert rows[2, 1].complete_evidence is True and rows[4, 1].reciprocal_rank is None
    results = {r.query_id: r for r in run.results.collect()}
    assert set(results) == {1, 2, 4} and results[1].stable and results[1].error is None and results[4].n_hits == 0
    assert {r.query_id: r.status for r in run.answers.collect()} == {1: "answered", 2: "answered", 4: "insufficient_evidence"}
    report = {r.k: r for r in runner.compare({"lexical": run}, cases, (1, 4)).collect()}
    assert (report[1].answerable_cases, report[1].mrr, report[1].complete_evidence_cases) == (2, 1.0, 1)
    failed = runner.run_evaluation(cases, references, passages, runner.Lexical(passages), 10, (1,), failed=cases.filter("query_id = 1"))
    rows = {r.query_id: r for r in failed.metrics.collect()}
    assert rows[1].reciprocal_rank == 0 and rows[2].reciprocal_rank == 1
    assert {r.query_id: r.error for r in failed.results.collect()} == {1: "retrieval_failed", 2: None, 4: None}


def test_evaluation_refuses_what_does_not_fit(spark, passages, cases):
    references = spark.createDataFrame([(1, "d0", "d0:p1:w0")], "query_id int, document_id string, passage_id string")
    for options in ({"cutoffs": ()}, {"cutoffs": (11,)}, {"budgets": (12_000,)}):
        with pytest.raises(ValueError):
            runner.run_evaluation(cases, references, passages, runner.Lexical(passages), 10, **({"cutoffs": (1,)} | options))

    class Twice(runner.Lexical):
        def search(self, questions, limit):
            hits = super().search(questions, limit)
            return hits.unionAll(hits)

    with pytest.raises(ValueError, match="contract broken"):
        runner.run_evaluation(cases, references, passages, Twice(passages), 10)


def test_failing_providers_are_rows_of_errors(passages, questions):
    def broken():
        def answer(question, items):
            raise RuntimeError("a key that must not be kept")

        return answer

    contexts = passages.select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), "passage_id", "kind", F.col("text").alias("shown")).limit(1)
    assert {(r.status, r.error) for r in runner.answers(contexts, questions, broken).collect()} == {(None, "generation_failed")}


def test_tiers(tmp_path):
    def load(name):
        if name == "standard":
            raise FileNotFoundError(name)
        return name

    tiers = (("full", 10.0), ("standard", 5.0), ("light", 2.5))
    assert runner.first_loadable(tiers, 8.0, load) == ("light", "light") and runner.first_loadable(tiers, 16.0, load)[0] == "full"
    with pytest.raises(RuntimeError):
        runner.first_loadable(tiers, float("nan"), load)


def test_passages_without_measurement(spark, passages):
    hits = spark.createDataFrame([(1, "d0:p1:w0"), (1, "d0:p2:w0")], "query_id int, passage_id string")
    assert [r.passage_id for r in runner.unmeasured(hits, passages.filter("ord = 0")).collect()] == ["d0:p2:w0"]


def test_pooling(spark):
    from attestor.operators.retrieval import pooled

    rows = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "t array<array<float>>, m array<int>")
    found = rows.select(*[pooled(F.col("t"), F.col("m"), how).alias(how) for how in ("mean", "first", "last")]).collect()
    assert found[0].mean == pytest.approx([0.6, 0.8]) and found[0].first == [1, 0] and found[0].last == [0, 1]
    assert found[1].mean == [0, 0] and found[1].last == [0, 0] and found[1].first == pytest.approx([0.5**0.5] * 2)
    with pytest.raises(ValueError):
        pooled(F.col("t"), F.col("m"), "max")


def test_token_counts(questions):
    assert {r.id: r.tokens for r in runner.token_counts(questions, "query_id", lambda: lambda texts: [len(t.split()) for t in texts]).collect()} == {1: 7, 2: 2, 3: 0, 4: 2}
