"""Language profiles and boosted trees: held-out accuracy, defined cases."""

import random
import zlib

import numpy as np
import pytest

from attestor.llm import language_hd, quality_gbt
from tests.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def brute_profile(text):
    points = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or points[-1]:
            points.append(code)
    if points[-1]:
        points.append(0)
    vector = {p: language_hd.letter_vectors(np.array([p]))[0].astype(int) for p in set(points)}
    total, kinds = np.zeros(language_hd.DIMENSIONS, int), set()
    for a, b, c in zip(points, points[1:], points[2:], strict=False):
        kinds.add((a, b, c))
        total += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
    return total, len(kinds)


def test_profiles_bundle_bound_permuted_letters():
    few = ["Some words, und Wörter!", "a", "", "123 ?", "x  y\n\nz", "日本 é"]
    many = [*few, "".join(chr(0x4E00 + i) for i in range(100))]  # too many letters to count codes in an array
    for texts in (few, many):
        found, kinds = language_hd.profiles(texts)
        for text, row, n in zip(texts, found, kinds.tolist(), strict=True):
            total, distinct = brute_profile(text)
            assert row.astype(int).tolist() == total.tolist() and n == distinct
    assert language_hd.bundle(many).astype(int).tolist() == sum(brute_profile(t)[0] for t in many).tolist()


def test_letters_have_vectors_of_their_own():
    vectors = language_hd.letter_vectors(np.arange(0x61, 0x500)).astype(int)
    cosines = vectors @ vectors.T / language_hd.DIMENSIONS
    assert np.abs(cosines - np.eye(len(vectors))).max() < 0.25 and abs(vectors.mean()) < 0.01


def test_stage_drops_what_is_in_no_language_and_keeps_the_rest(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(6)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    latin, others = "abcdefghijklmnopqrstuvwxyz", ("абвгдежзиклмнопрстуфхцчшщ", "あいうえおかきくけこさしすせそ日本語", "אבגדהוזחטיכלמנסעפצקרשת")
    foreign = [word(latin, 3000) for _ in range(10)] + [" ".join(word(latin, rng.randint(2, 9)) for _ in range(400)) for _ in range(10)]
    foreign += [" ".join(word(letters, 6) for _ in range(200)) for letters in others for _ in range(10)]
    more = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(foreign)], docs.schema)
    left = {r.doc_id for r in language_hd.keep_identified(docs.union(more)).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}


def test_only_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_hd, "MOST_LANGUAGES", 3)
    rows = [(f"text of language {i} {chr(97 + i) * 3}", f"l{i}") for i in range(8) for _ in range(10 - i)]
    assert list(language_hd.train(spark.createDataFrame(rows, "text string, lang string"))) == ["l0", "l1", "l2"]


def test_languages_are_told_apart_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_hd.identify(docs).collect()
    assert len(rows) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.98


def test_training_ignores_held_out_rows(spark, documents):
    docs = documents.drop("lang").join(documents.select("doc_id", "lang"), "doc_id")
    other = docs.withColumn("lang", language_hd.F.when(language_hd.fold(5) == 0, "zz").otherwise(language_hd.F.col("lang")))
    assert sorted(map(tuple, language_hd.identify(docs).collect())) == sorted(map(tuple, language_hd.identify(other).collect()))


def test_language_of_odd_rows(odd, nothing):
    rows = language_hd.identify(odd).collect()
    assert len(rows) == odd.count()
    found = {r.doc_id: r for r in rows}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (3, 4, 5, 6)) and found[7].lang_pred == "en"
    assert language_hd.identify(nothing).count() == 0
    kept = language_hd.keep_identified(odd)
    assert kept.schema == odd.schema and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 6})
    unlabelled = language_hd.identify(odd.withColumn("lang", language_hd.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    true = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_gbt.score_documents(docs, labels).collect()
    held = [(r.score, true[r.doc_id]) for r in rows if r.held_out and r.doc_id in true]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_flat_trees_follow_their_splits():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality_gbt.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality_gbt.fit(x, y)

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert trees.score(x[:50]) == pytest.approx([walk(r) for r in x[:50]])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, None, "x"), (None, 0, "x"), (7, 0, "x"), (9, 1, "x"), (99, 1, "x")], "doc_id long, quality int, text string")
    rows = quality_gbt.predict(odd, quality_gbt.train(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_gbt.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_gbt.score_documents(nothing, labels).count() == 0
    bounded = quality_gbt.train(odd, labels, most_rows=1)
    assert len(bounded.roots) == 0


def test_statistics_are_finite():
    rng = random.Random(1)
    for text in ["", " ", "a", "\n\n", "é" * 5, "".join(rng.choice("ab .\n!é") for _ in range(500))]:
        values = quality_gbt.statistics(text)
        assert len(values) == len(quality_gbt.FEATURES) and np.isfinite(values).all()


def test_small_table_is_scored(spark, documents):
    rows = quality_gbt.score_documents(documents, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert rows.count() == documents.count()
