"""Queries that must read all of their table and do the operator's whole job."""

import numpy as np

from attestor.operators import bootstrap
from attestor.plans import evaluation_queries  # noqa: F401
from attestor.plans.registry import QUERIES

from .conftest import SMALL


def test_ranking_stability_sees_every_user(spark, tmp_path):
    rows = [(1, 1, "a", 5.0), (2, 50, "a", 5.0), (3, 60, "b", 1.0), (4, 60, "b", 2.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_type: r.stable for r in QUERIES["ranking_stability"](spark, str(tmp_path)).collect()} == {"a": False, "b": True}


def test_bootstrap_delta_draws_the_operators_samples(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    deltas = {}
    for r in sorted(spark.read.parquet(f"{SMALL}/labels.parquet").collect(), key=lambda r: r.doc_id):
        deltas.setdefault(docs[r.doc_id], []).append(float(r.quality - r.toxic))
    found = {r.lang: (r.low, r.high) for r in QUERIES["bootstrap_delta"](spark, SMALL).collect()}
    assert found == {lang: bootstrap.interval(np.array(values), 10_000, bootstrap.SEED) for lang, values in deltas.items()}
