"""Near copies of the pipeline's stage against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from attestor.llm import jaccard_copies, simhash_pivots
from tests.conftest import SMALL


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(rows):
    """The rows' groups by similarity of 0.8 or more, every pair compared."""
    sets, group = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return group


def least_rows(rows):
    found = {}
    for row, g in zip(rows, brute_groups(rows), strict=True):
        found.setdefault(g, []).append(row)
    return sorted((min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in found.values()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.getrandbits(40)}"
    return " ".join(words)


def test_stage_joins_what_brute_force_joins(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = stage(spark, docs, SMALL)
    assert found.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == least_rows(rows)


def test_families_of_edited_copies(spark):
    rng = random.Random(11)
    rows = []
    for family in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((7, 30, 120, 400)))]
        line = ["one", "line", "that", "very", "many", "texts", "share", "with", "others"] * (family % 2)
        for _ in range(12):
            rows.append((len(rows), edited(rng, words + line, rng.randrange(0, 2 + len(words) // 40))))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = least_rows(rows)
    assert 12 < len(expected) < len(rows)
    for unit in (jaccard_copies.UNIT_SHINGLES, 500):  # whole components, and dealt out as pairs of parts
        found = jaccard_copies.drop_near_copies(docs, unit)
        assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == expected


def test_rows_are_told_apart(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, long + " end"), (None, "other"), (5, "mine"), (5, "yours"), (5, long + " close"), (6, "twice"), (6, "twice"), (7, None), (8, " "), (9, "Twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(((r.doc_id, r.text) for r in jaccard_copies.drop_near_copies(docs).collect()), key=repr)
    assert found == sorted([(None, "other"), (5, "mine"), (5, "yours"), (5, long + " close"), (6, "twice"), (7, None)], key=repr)
    assert jaccard_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_units_against_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        base = [rng.sample(range(1000), rng.choice((6, 20, 50))) for _ in range(4)]
        sets = []
        for _ in range(40):
            own = set(rng.choice(base))
            sets.append(np.array(sorted({x if rng.random() > 0.06 else rng.randrange(2000) for x in own}), np.uint64))
        sizes = np.array([len(s) + rng.randrange(2) for s in sets])  # a set may have more shingles than are shared
        forest = simhash_pivots.Forest()
        jaccard_copies.link_unit(list(range(40)), sizes, sets, forest)
        group = list(range(40))
        for a in range(40):
            for b in range(a):
                both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
                if group[a] != group[b] and 5 * both >= 4 * (sizes[a] + sizes[b] - both):
                    group = [group[b] if g == group[a] else g for g in group]
        assert len({forest.root(i) for i in range(40)}) == len(set(group))
        assert all((forest.root(a) == forest.root(b)) == (group[a] == group[b]) for a in range(40) for b in range(40))
