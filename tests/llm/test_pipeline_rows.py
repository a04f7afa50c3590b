"""Rows that the pipeline's stages must not lose: clean single words, rows without an id of their own."""

import corpus_pipeline
from attestor.llm import decontaminate
from tests.conftest import SMALL


def test_language_stage_keeps_single_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    words = sorted({w for r in docs.collect() for w in (r.text or "").split() if any(map(str.isalpha, w))})
    more = spark.createDataFrame([(1_000_000 + i, w, None) for i, w in enumerate(words)], docs.schema)
    left = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.union(more), SMALL).select("doc_id").collect()}
    assert [w for i, w in enumerate(words) if 1_000_000 + i not in left] == []


def test_leaks_go_by_row(spark):
    item = "the quick brown fox jumps over one lazy dog while nobody at all is looking"
    benchmark = spark.createDataFrame([(1, item), (2, "seven other words that leak into nothing here")], "item_id long, text string")
    clean = [f"clean words number {i} about bread and butter" for i in range(4)]
    rows = [(None, f"before it {item} and after"), (None, clean[0]), (None, clean[1]), (3, item), (3, clean[2]), (4, clean[3]), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for words in (decontaminate.BLOCK_WORDS, 1):  # one block, and a block for each item
        found = decontaminate.drop_leaks(docs, benchmark, most_words=words)
        assert found.schema == docs.schema
        assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted([(None, clean[0]), (None, clean[1]), (3, clean[2]), (4, clean[3]), (5, None)], key=repr)
