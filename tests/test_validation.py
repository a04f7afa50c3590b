"""Constraints find what is wrong, and nothing in valid inputs."""

import hashlib

from attestor.operators import validation as V


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages(spark):
    return spark.createDataFrame([("d:p1:w0", "d", 1, "twelve chars"), ("d:p2:w0", "d", 2, "more")], "passage_id string, document_id string, paragraph int, text string")


def test_encoding(spark):
    schema = "passage_id string, text_sha256 string, input_tokens int, encoded_tokens int, truncated boolean, retained_ranges array<struct<start int, end int>>"
    good, text = ("d:p1:w0", sha("twelve chars"), 5, 5, False, [(0, 4), (4, 12)]), sha("more")
    bad = [("x", text, 1, 1, False, []), ("d:p2:w0", sha("other"), 1, 1, False, []), ("d:p2:w0", text, 5, 3, False, []), ("d:p2:w0", text, 5, 5, False, [(0, 3), (2, 4)]), ("d:p2:w0", text, 5, 5, False, [(0, 9)])]
    found = V.encoding_faults(spark.createDataFrame([good, *bad], schema), passages(spark))
    assert sorted(r.fault for r in found.collect()) == ["counts", "other text", "ranges", "ranges", "unknown passage"]


def test_hits_and_references(spark):
    hits = spark.createDataFrame([(1, "d:p1:w0", 0.5), (1, "d:p2:w0", 0.1), (2, "d:p1:w0", 0.5), (2, "d:p1:w0", 0.4), (3, "x", float("nan"))], "q int, passage_id string, score double")
    assert sorted((r.q, r.repeated, r.unknown, r.not_finite) for r in V.hit_faults(hits, passages(spark), "q", 2).collect()) == [(2, 1, 0, 0), (3, 0, 1, 1)]
    assert {r.q for r in V.hit_faults(hits.filter("q = 1"), passages(spark), "q", 1).collect()} == {1}
    references = spark.createDataFrame([("d:p1:w0", "d", 1), ("d:p1:w0", "e", 1), ("d:p2:w0", "d", 1), ("y", "d", 1)], "passage_id string, document_id string, paragraph int")
    assert V.reference_faults(references, passages(spark)).count() == 3


def test_runs(spark):
    runs = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "dataset string, chunking int, label string")
    assert [r.column for r in V.comparable(runs, ["dataset", "chunking", "label"]).collect()] == ["chunking"]
