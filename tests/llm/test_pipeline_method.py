"""The pipeline's near_dedup goes through op10's fingerprints and pivot tables; what they link is checked exactly."""

import random

import corpus_pipeline
from attestor.llm import jaccard_copies, simhash_pivots
from tests.llm.test_jaccard_copies import brute_set, edited, least_rows


def _rows():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(4)]
    texts = [t for words in base for t in (" ".join(words), edited(rng, words, 1), edited(rng, words, 1), edited(rng, words, 8), " ".join(words).upper() + "\n")]
    # A line that is repeated very often decides the fingerprint: these two have nearly the same, and different sets.
    line = "one line of nine words that returns very often "
    texts += [line * 400 + " ".join(f"{mark}{i}" for i in range(30)) for mark in "xy"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_stage_asks_fingerprints_first(spark, monkeypatch):
    rows, asked, own = _rows(), [], simhash_pivots.near_copies
    monkeypatch.setattr(simhash_pivots, "near_copies", lambda docs, *more: asked.append(docs) or own(docs, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == least_rows(rows)
    assert len(asked) == 1


def test_fingerprint_links_are_checked(spark):
    rows = _rows()
    found = jaccard_copies.fingerprint_links(spark.createDataFrame(rows + rows[:3], "name long, text string").repartition(3)).collect()
    texts, prints = dict(rows), {n: simhash_pivots.fingerprint(t) for n, t in rows}
    assert len({r.u for r in found}) == len(found)
    reached = {a for a in prints for b in prints if b < a and (prints[a] ^ prints[b]).bit_count() <= simhash_pivots.MOST_BITS}
    assert {r.u for r in found} == reached
    for r in found:
        a, b = brute_set(texts[r.u]), brute_set(texts[r.v])
        assert (r.linked, r.same) == (5 * len(a & b) >= 4 * len(a | b), a == b)
    assert {(r.linked, r.same) for r in found} == {(True, True), (True, False), (False, False)}
