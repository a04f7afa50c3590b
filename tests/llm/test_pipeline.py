"""The corpus pipeline stage by stage against brute force."""

import corpus_pipeline
from attestor.llm import common
from tests.conftest import SMALL
from tests.llm.test_exact_and_near import brute_copies
from tests.llm.test_jaccard_copies import least_rows
from tests.llm.test_tokens_and_packing import check_packing


def test_stages(spark, documents):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SMALL)
        if name == "packing":
            check_packing(docs, found.collect())
            break
        assert found.schema == docs.schema
        docs = common.stored(found, "test-stage")
        left = {r.doc_id: r.text for r in docs.collect()}
        assert all(rows[d] == t for d, t in left.items())
        if name == "language_id":
            assert set(left) == {d for d, t in rows.items() if any(map(str.isalpha, t))}
        elif name == "exact_dedup":
            assert set(left) == {keep for keep, _ in brute_copies(rows.items()).values()}
        elif name == "near_dedup":
            assert sorted(left.items()) == sorted(least_rows(list(rows.items())))
        else:
            assert set(left) <= {d for d, t in rows.items() if not any(b in t for b in items)} and len(left) > 0.9 * len(rows)
        rows = left


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert "sequence_id" in found.columns and found.count() > 0 and corpus_pipeline.ORACLE_SQL is None
