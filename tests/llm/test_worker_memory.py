"""What a Python worker holds from task to task, and which workers an executor has."""

import random
from functools import partial

import pyarrow as pa

from attestor.llm import common, decontaminate, jaccard_copies, packing, tokens


def _held(batches):
    list(batches)
    yield pa.RecordBatch.from_pydict({"n": [tokens.encoder.cache_info().currsize + decontaminate._read.cache_info().currsize]})


def test_a_task_of_another_function_finds_nothing_kept(spark, documents):
    docs = common.stored(documents.select("doc_id", "text").repartition(8), "docs")
    assert packing.pack_documents(docs).count() > 0
    assert {r.n for r in common.map_batches(docs, _held, "n long").collect()} == {0}


def _twice(batches):
    first = tokens.encoder(tokens.vocabulary_path("word_bpe_49k.json"), 7)
    yield from (pa.RecordBatch.from_pydict({"n": [id(first) % (1 << 62)]}) for _ in batches)


def test_tasks_of_one_function_share_what_is_kept():
    from attestor.functions import shipping

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    found = [list(shipping._task(f, iter([batch])))[0] for f in (_twice, partial(_twice))]
    assert found[0] == found[1] and tokens.encoder.cache_info().currsize == 1
    assert list(shipping._task(_held, iter([batch])))[0].column(0).to_pylist() == [0]


def test_leaks_need_no_workers_of_another_kind(spark, documents, monkeypatch):
    """Rows made by the driver's Python go through workers of a second daemon."""
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = decontaminate.drop_leaks(documents, benchmark).count()
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_, **__: 1 / 0)
    assert decontaminate.drop_leaks(documents, benchmark).count() == want < documents.count()
    empty = documents.limit(0)
    assert decontaminate.drop_leaks(empty, benchmark).count() == 0


def test_shingles_are_handed_over_in_small_batches():
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(1000)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"name": list(range(len(texts))), "text": texts})
    found = list(jaccard_copies._sets(6, (1, 1), iter([batch])))
    assert sum(len(a) // 8 for b in found for a, s in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True) if not s) == 996 * 1500
    assert max(b.nbytes for b in found) < 10 << 20
