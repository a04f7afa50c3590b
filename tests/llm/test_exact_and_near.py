import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestor.llm import components, exact_dedup, simhash_pivots


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return {t: (max((d for d in g if d is not None), default=None), len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_exact_copies(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    expected = brute_copies(rows)
    digests = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in rows}
    found = exact_dedup.find_copies(docs).collect()
    assert sorted((str(r.doc_id), digests[r.text_sha256]) for r in found) == sorted((str(d), t) for d, t in rows)
    assert all((r.keep_id, r.group_size) == expected[digests[r.text_sha256]] for r in found)
    assert sum(r.kept for r in found) == len(expected)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_one_row_of_each_text_stays_with_its_columns(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    assert sorted(r.text or "" for r in kept.collect()) == sorted({r.text or "" for r in odd.collect()})


def test_equal_keys_are_told_apart_by_bytes(documents):
    texts = {r.text for r in documents.collect()}
    key = F.expr("shiftleft(h, 61)")  # four keys for all texts
    docs = documents.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(4)))
    index = exact_dedup.build_index(docs, key=key, capacity=2, window=2000)
    assert index.entries.count() == len(texts) and index.entries.agg(F.max("chain")).head()[0] > 10
    found = exact_dedup.find_copies(docs, index, key=key)
    assert found.filter("kept").count() == len(texts)


def test_copies_are_found_through_directory_and_buckets(documents):
    expected = len({r.text for r in documents.collect()})
    index = exact_dedup.build_index(documents, capacity=2)
    assert exact_dedup.find_copies(documents, index).filter("kept").count() == expected < documents.count()
    astray = {
        "place": F.when(F.col("place").isNotNull(), F.expr("pmod(place + 1, shiftleft(1L, cast(n as int)))")),
        "bucket": F.when(F.col("place").isNull(), F.col("bucket") + 1).otherwise(F.col("bucket")),
        "key": F.col("key") + 1,
    }
    for column, value in astray.items():
        broken = exact_dedup.Index(index.table.withColumn(column, value), index.owner_bits)
        assert exact_dedup.find_copies(documents, broken).filter("kept").count() > expected


def test_directory_doubles_and_buckets_split(documents):
    index = exact_dedup.build_index(documents, owners=2, capacity=4)
    places = index.directory.collect()
    assert max(p.global_depth for p in places) > 2
    for owner in {p.owner for p in places}:
        own = sorted((p for p in places if p.owner == owner), key=lambda p: p.place)
        assert [p.place for p in own] == list(range(1 << own[0].global_depth))
        assert all(p.place >> p.global_depth - p.depth == p.bucket for p in own)
    assert index.entries.groupBy("owner", "bucket", "depth").agg(F.count_distinct("key").alias("n")).agg(F.max("n")).head()[0] <= 4
    rng, table = random.Random(1), exact_dedup.ExtendibleHash(3)
    keys = [rng.getrandbits(64) for _ in range(500)]
    for k in keys:
        table.insert(k, f"text {k}", k, 1, 1)
        table.insert(k, f"text {k}", k + 1, 1, 1)
        table.insert(k, "another text", 0, 1, 1)
    assert all([(e.text, e.keep, e.n) for e in table.get(k)] == [(f"text {k}", k + 1, 2), ("another text", 0, 1)] for k in keys) and table.get(1) == []
    assert all(k >> 64 - b.depth == b.prefix if b.depth else True for b in table.buckets() for k in b.slots)
    assert all(table.directory[i] is b for b in table.buckets() for i in table.places(b))


def test_buckets_of_the_greatest_depth_grow():
    table = exact_dedup.ExtendibleHash(2, most_depth=3)
    for k in range(50):
        table.insert(k, str(k), k, 1, 1)
    assert table.depth == 3 and all(table.get(k)[0].text == str(k) for k in range(50))


def test_rows_that_repeat_doc_id_and_text(spark):
    rows = [(None, "x")] * 40 + [(1, "x"), (1, "x"), (2, None), (2, ""), (None, "y"), (None, "y"), (3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = exact_dedup.find_copies(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found if r.kept) == [("1", "1", 42), ("2", "2", 2), ("3", "3", 1), ("None", "None", 2)]
    kept = exact_dedup.drop_copies(docs)
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("1", "x"), ("2", ""), ("3", "z"), ("None", "y")]


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in lowered.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=4):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([prints[i] for i in ids], np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values) <= most), strict=True):
        x, y = root(ids[a]), root(ids[b])
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_copies_of_the_small_table(documents):
    prints = {r.doc_id: brute_fingerprint(r.text) for r in documents.collect()}
    expected = brute_components(prints)
    found = simhash_pivots.near_copies(documents).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" for r in found)


def test_near_copies_of_odd_rows(odd, nothing):
    rows = simhash_pivots.near_copies(odd).collect()
    assert len(rows) == odd.count()
    found = {r.doc_id: r for r in rows}
    assert {found[i].component_id for i in (3, 4, 5)} == {3} and found[3].fingerprint == "0" * 16
    assert found[2].component_id == 1 and found[8].component_id == 7 and found[None].component_id is None
    assert simhash_pivots.near_copies(nothing).count() == 0


def test_every_link_survives_the_cells(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(60)}
    values |= {v ^ 1 << rng.randrange(64) for v in values}
    prints = {i: v for i, v in enumerate(sorted(values))}
    expected = brute_components(prints)
    table = {v: simhash_pivots.distance_table(np.array([v], np.uint64), simhash_pivots.pivots())[0].tobytes() for v in prints.values()}
    classes = spark.createDataFrame([(simhash_pivots._signed(v), table[v]) for v in prints.values()], "fp long, pivots binary").repartition(5)
    names = {simhash_pivots._signed(v): i for i, v in prints.items()}
    for count, hot in ((len(prints), simhash_pivots.HOT_CELL), (1 << 22, simhash_pivots.HOT_CELL), (1 << 30, simhash_pivots.HOT_CELL), (len(prints), 10)):  # six, seven and eight blocks; cells dealt out anew
        links = simhash_pivots.links(classes, count, hot=hot)
        pairs = components.components(links.filter("u is not null").select("u", "v"))
        group = {names[r.node]: r.component for r in pairs.collect()}
        found = {i: group.get(i, simhash_pivots._signed(v)) for i, v in prints.items()}
        least = {}
        for i in sorted(prints):
            least.setdefault(found[i], i)
        assert {i: least[found[i]] for i in prints} == expected
        counts = simhash_pivots.pair_counts(links).head()
        assert counts.met >= counts.discarded + counts.verified and counts.discarded > 0 and counts.verified >= len(prints) - len(set(expected.values()))
    assert [len(simhash_pivots.cell_masks(n)) for n in (1000, 1 << 20, 1 << 26, 1 << 30)] == [5, 15, 35, 70]


def test_a_large_cell_is_divided_without_loss():
    rng = random.Random(3)
    start = rng.getrandbits(64)
    values = sorted({start ^ sum(1 << b for b in rng.sample(range(20, 64), rng.randint(0, 5))) for _ in range(900)})
    fps = np.array(values, np.uint64)
    table = simhash_pivots.distance_table(fps, simhash_pivots.pivots())
    links = simhash_pivots.Links()
    simhash_pivots.link_cell(fps, simhash_pivots._free(fps), table, 4, links)
    number = {simhash_pivots._signed(v): i for i, v in enumerate(values)}
    groups = {}
    for v, i in number.items():
        groups.setdefault(links.forest.root(v), []).append(i)
    assert {i: min(own) for own in groups.values() for i in own} == brute_components(dict(enumerate(values)))
    assert links.met < 900 * 899 // 2  # ordered by a coordinate, most pairs never meet


def test_pivots_discard_no_linked_pair():
    rng = random.Random(4)
    fps = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
    fps = np.concatenate([fps, fps ^ np.uint64(0b1111)])
    table = simhash_pivots.distance_table(fps, simhash_pivots.pivots())
    a, b = np.triu_indices(len(fps), 1)
    x, y, left = simhash_pivots.close_pairs(fps, a, b, table, 4)
    found = set(zip(x.tolist(), y.tolist(), strict=True))
    assert len(found) <= left < 0.01 * len(a)  # the table discards nearly all pairs that are not links
    assert found == {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 160)}
