"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 bit SimHashes of word shingles.  Equal fingerprints are one class from the start.
Two classes link when they differ in ``MOST_BITS`` bits at most.

The pivot table holds the Hamming distances of every class to PIVOTS fixed reference fingerprints; it is
computed once, stored with the classes and travels with them.  By the triangle inequality two linked
fingerprints differ by at most MOST_BITS in every coordinate.  Where classes meet they are ordered by the
first coordinate, so that only those meet whose first coordinates are as close as that; a pair whose
greatest coordinate difference is larger is discarded without comparing the fingerprints; survivors are
verified.  ``pair_counts`` tells how many pairs met, were discarded and verified.

Fingerprints of unrelated texts lie about 32 bits from every reference, so with the table alone a fixed
share of all pairs would meet.  Classes therefore meet in cells: the 64 bits are cut into m blocks, of
which at most MOST_BITS can differ, and two classes that agree in some choice of m - MOST_BITS blocks
share the cell of that choice; m is a parameter that the query sets by the number of classes, so that cells
of unrelated fingerprints stay small.  No cell is capped: one of more than HOT_CELL classes is dealt
out anew by blocks of its remaining bits before it reaches a task, and a task divides what it gets in the same
way while that spares comparisons.  It doesn't among very many copies that all lie close together; there
the search goes from class to linked class and meets only those not reached yet, so that most are reached by
few.  A cell gives a spanning forest of its links, never all pairs.

Defined cases: null and empty texts have fingerprint zero and link like any other; a null doc_id is
carried along, and a component of null doc_ids alone is null; rows that repeat get a row each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import common
from attestor.llm.components import components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
PIVOTS, PIVOT_SEED = 16, 1009
#: A cell with more classes is divided before its pairs are looked at; one with more of the second is divided over tasks.
SMALL_CELL, HOT_CELL = 256, 1 << 15
#: How often a hot cell is divided (each time its classes lie in up to MOST_BITS + 1 cells); classes that meet pair by pair.
ROUNDS, FEW = 2, 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SPACES = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 1 << 64, n, np.uint64)


def distance_table(fingerprints: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fingerprints[:, None] ^ references).astype(np.int8)


def _majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        octets = np.array(hashes[first : first + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        if len(octets) < 64:
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            for i in range(8):
                counts[8 * i : 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[shingle - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    return _majority([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)])


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _fingerprints(shingle: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    for batch in common.slices(batches, "text"):
        yield common.one_batch(schema, {"doc_id": batch.column(0), "fp": [_signed(fingerprint(t, shingle, seed)) for t in batch.column(1).to_pylist()]})


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text, as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return common.map_batches(rows, partial(_fingerprints, shingle, seed), "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def cell_masks(classes: int, most: int = MOST_BITS) -> list[int]:
    """Masks of the cells for that many classes: one per choice of blocks that agree.

    The least number of blocks is taken for which fewer classes than possible cells remain.
    """
    for blocks in range(most + 1, most + 5):
        kept = blocks - most
        if classes <= 1 << 64 * kept // blocks:
            break
    return [sum(chosen) for chosen in combinations(block_masks(blocks), kept)]


def close_pairs(fps: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of the pairs (a, b), those that the pivot table doesn't discard and that are verified; and how many it left."""
    for column in range(table.shape[1]):  # a coordinate at a time: most pairs go with the first few
        keep = np.abs(table[a, column] - table[b, column]) <= most
        a, b = a[keep], b[keep]
        if not len(a):
            return a, b, 0
    keep = np.bitwise_count(fps[a] ^ fps[b]) <= most
    return a[keep], b[keep], len(a)


class Links:
    """A forest of links, and what became of the pairs that met."""

    def __init__(self):
        self.forest, self.met, self.left, self.verified = Forest(), 0, 0, 0

    def compare(self, fps: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray, most: int) -> np.ndarray:
        """Join the pairs (a, b) that link; gives their b."""
        self.met += len(a)
        a, b, left = close_pairs(fps, a, b, table, most)
        self.left += left
        self.verified += len(a)
        for x, y in zip(fps[a].view(np.int64).tolist(), fps[b].view(np.int64).tolist(), strict=True):
            self.forest.join(x, y)
        return b


class Forest:
    """Union-find over row numbers; the root is the least."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent, top = self.parent, x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.parent.setdefault(min(x, y), min(x, y))


def free_parts(free: int, most: int) -> list[int]:
    """``most`` + 1 masks that divide the bits of ``free``: of two fingerprints that link, one part at least agrees."""
    places = [b for b in range(64) if free >> b & 1]
    cuts = [len(places) * k // (most + 1) for k in range(most + 2)]
    return [sum(1 << b for b in places[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def link_cell(fps: np.ndarray, free: int, table: np.ndarray, most: int, links: Links) -> None:
    """Join all classes of one cell that link; ``free`` are the bits in which they may differ."""
    n = len(fps)
    if n > SMALL_CELL and free.bit_count() > 2 * (most + 1):
        inside = []
        for part in free_parts(free, most):
            inner = fps & np.uint64(part)
            order = np.argsort(inner, kind="stable")
            inside += [(rows, free & ~part) for rows in np.split(order, np.flatnonzero(np.diff(inner[order])) + 1) if len(rows) > 1]
        if 2 * sum(len(rows) ** 2 for rows, _ in inside) <= n * n:  # not so among copies that all lie close together
            for rows, rest in inside:
                link_cell(fps[rows], rest, table[rows], most, links)
            return
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first = table[:, 0].astype(np.int64)
    if n > FEW:
        _spread_out(fps, table, first, most, links)
        return
    for shift in range(1, n):
        near = np.flatnonzero(first[shift:] - first[:-shift] <= most)
        if not len(near):  # nor is anything further apart in this order near
            return
        links.compare(fps, near, near + shift, table, most)


def _spread_out(fps: np.ndarray, table: np.ndarray, first: np.ndarray, most: int, links: Links) -> None:
    """From class to linked class: each meets only those that nothing has reached yet, so close copies cost little."""
    left = np.arange(len(fps))
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            low, high = np.searchsorted(first[left], (first[x] - most, first[x] + most + 1))
            near = left[low:high]
            found = links.compare(fps, np.full(len(near), x), near, table, most)
            if len(found):
                reached += found.tolist()
                left = left[~np.isin(left, found, assume_unique=True)]


def _links(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp, pivots) ordered by cell and the bits that agree in it: a forest of the links within cells; a row of counts."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("met", pa.int64()), ("discarded", pa.int64()), ("verified", pa.int64())])
    links = Links()
    rest: list[np.ndarray] | None = None

    def run(cell: np.ndarray, fps: np.ndarray, table: np.ndarray) -> None:
        inner = fps & cell
        same = (cell[1:] == cell[:-1]) & (inner[1:] == inner[:-1])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        firsts, lasts = edges[::2], edges[1::2] + 1
        size = lasts - firsts
        twos = firsts[size == 2]
        links.compare(fps, twos, twos + 1, table, most)
        for f, e in zip(firsts[size > 2].tolist(), lasts[size > 2].tolist(), strict=True):
            link_cell(fps[f:e], _free(fps[f:e]), table[f:e], most, links)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(batch.num_rows, -1)
        columns = [batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64), table]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        cell, fps, _ = columns
        last = (cell == cell[-1]) & ((fps & cell) == (fps[-1] & cell[-1]))
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        run(*(c[:cut] for c in columns))
        rest = [c[cut:] for c in columns]  # one cell, of about HOT_CELL rows at most
    if rest is not None:
        run(*rest)
    forest = links.forest
    rows = [(x, r, None, None, None) for x in forest.parent if x != (r := forest.root(x))]
    rows.append((None, None, links.met, links.met - links.left, links.verified))
    for first in range(0, len(rows), 100_000):
        yield common.one_batch(schema, dict(zip(schema.names, zip(*rows[first : first + 100_000], strict=True), strict=True)))


def _free(fps: np.ndarray) -> int:
    """The bits in which these fingerprints are not all equal."""
    return int(np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps))


def _dealt(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """Each row (fp, pivots, and the number i of its masks) in a cell for each mask of masks[i]."""
    known = F.array(*[F.array(*[F.lit(_signed(m)) for m in own]) for own in masks])
    each = rows.select("fp", "pivots", F.explode(F.get(known, F.col("i"))).alias("cell"))
    return each.withColumn("inner", F.col("fp").bitwiseAND(F.col("cell")))


def cells(classes: DataFrame, count: int, most: int = MOST_BITS, hot: int = HOT_CELL) -> DataFrame:
    """Every class (fp, pivots) in its cells; a cell is a mask and the bits under it.

    Cells of more than ``hot`` classes are replaced by finer ones, ROUNDS times.
    """
    masks = [cell_masks(count, most)]
    rows, done = classes.select("fp", "pivots", F.lit(0).alias("i")), None
    for turn in range(ROUNDS + 1):
        dealt = _dealt(rows, masks)
        counts = dealt.groupBy("cell", "inner").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
        found = {m & (1 << 64) - 1 for (m,) in counts.select("cell").distinct().collect()} if turn < ROUNDS else set()  # masks: some tens a round
        finer = {m: [m | part for part in free_parts(~m & (1 << 64) - 1, most)] for m in sorted(found) if 64 - m.bit_count() > 2 * (most + 1)}
        if not finer:
            break
        which = F.create_map(*[F.lit(x) for i, m in enumerate(finer) for x in (_signed(m), i)])
        marked = common.attach(dealt, counts.filter(F.col("cell").isin([_signed(m) for m in finer])), ["cell", "inner"], "n", "fp")
        marked = common.stored(marked, "cells")
        calm = marked.filter("n is null").drop("n")
        done = calm if done is None else done.unionByName(calm)
        rows, masks = marked.filter("n is not null").select("fp", "pivots", which[F.col("cell")].alias("i")), list(finer.values())
    return dealt if done is None else done.unionByName(dealt)


def links(classes: DataFrame, count: int, most: int = MOST_BITS, hot: int = HOT_CELL) -> DataFrame:
    """Links (u, v) between the fingerprints of ``classes`` (fp, pivots) that keep every connection of ``most`` bits or fewer.

    A row without u has a task's counts: pairs met, discarded by the pivot table, verified.
    """
    n = common.partitions(classes.sparkSession)
    dealt = cells(classes, count, most, hot).repartition(n, "cell", "inner").sortWithinPartitions("cell", "inner").select("cell", "fp", "pivots")
    return common.map_batches(dealt, partial(_links, most), "u long, v long, met long, discarded long, verified long")


def pair_counts(links: DataFrame) -> DataFrame:
    """One row: how many pairs of classes met, how many the pivot table discarded, how many are links."""
    return links.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "discarded", "verified")])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    references = pivots()
    for batch in batches:
        table = distance_table(batch.column(0).to_numpy().view(np.uint64), references)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in table], pa.binary())], names=[*batch.schema.names, "pivots"])


def classes_of(marked: DataFrame) -> DataFrame:
    """Classes of equal fingerprints with their row of the pivot table: fp, least, n, pivots."""
    grouped = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    return common.map_batches(grouped, _tables, "fp long, least long, n long, pivots binary")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, most: int = MOST_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id, class_size.

    class_size is the number of documents with the same fingerprint.
    """
    marked = common.stored(fingerprints(docs, shingle, seed), "fingerprints")
    # A class is named by its fingerprint; a component's name becomes its least doc_id at the end.
    classes = common.stored(classes_of(marked), "classes")
    found = components(links(classes, classes.count(), most).filter("u is not null").select("u", "v"))
    named = classes.drop("pivots").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Classes are distinct fingerprints, so even a component of very many documents has few of them.
    linked = named.join(found.select("component").distinct(), "component", "left_semi")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    grouped = common.attach(named, least, ["component"], "m", "fp")
    named = common.stored(grouped.select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "named")
    common.discard(classes, found)
    return common.attach(marked, named, ["fp"], "n", "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("class_size")
    )
