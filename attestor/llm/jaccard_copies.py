"""Near copies by the Jaccard similarity of their word shingles, exactly.

A text's set holds the hashes of its shingles of SHINGLE words (lower-cased in ASCII, between ASCII white
space); a text of fewer words is one shingle.  Two texts link when their sets' similarity is LEAST (as a
fraction) or more; a component of links is a group of near copies.

``drop_near_copies`` begins with op10's method: SimHash fingerprints that differ in few bits, found by their stored
pivot tables.  Each text of a component of fingerprints is held against its first text, shingle by shingle: those of
similarity LEAST or more are links, and those of the same set go, as their links are the first text's.  Fingerprints
can't tell the other links (README gives figures); they come from a join of sets over all texts that are left.

That join misses no link.  A shingle that occurs in one text only is in no intersection, so a text with fewer
than LEAST of its set in other texts links with none and goes first; for nearly all texts that is the end.
That is asked twice: of the shingles whose hash falls into SENT of all values (a text that links misses no
more of these than it may miss at all), then of the whole sets of the texts that are left.
Of two sets that link, the rarest shingles (all but LEAST of the set, and one) have one in common: texts
that share such a shingle meet as candidates, in stars and not in pairs.  Each component of candidates
is compared within, from text to linked text, so that close copies cost little.  In a component of more than
UNIT_SHINGLES all texts are first compared with a leader; those that link with it needn't be compared with each
other, and the rest is compared with all in units of two parts, so the work grows with the rest and not with
the square of a group of near copies.

Defined cases: null and empty texts are near copies of each other; texts are named by a 64 bit hash, so
rows that repeat a doc_id are told apart by their texts; of a group one row stays, that of least doc_id
(null after all others), and of rows that repeat both doc_id and text one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import common, simhash_pivots
from attestor.llm.components import components
from attestor.llm.simhash_pivots import _SPACES, Forest

SHINGLE = 5
#: The least similarity, as numerator and denominator.
LEAST = (4, 5)
#: Texts whose shingles are counted together; shingles that a task gathers, that a row holds, and that are compared in one task.
PART_TEXTS, HELD, ROW, UNIT_SHINGLES = 4096, 1 << 19, 512, 1 << 22
#: The share of shingles that is counted first, as numerator and denominator.
SENT = (3, 10)

_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SCHEMA = pa.schema([("part", pa.int32()), ("sizes", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_COLUMNS = "part int, sizes boolean, a binary, b binary, c binary"


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words))], np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    found = np.zeros(n, np.uint64)
    for i, place in enumerate(_PLACES):
        part = hashes[i : i + n] * place
        found += part ^ part >> np.uint64(29 + i)
    found ^= found >> np.uint64(32)
    found *= _PLACES[0]
    return np.unique(found ^ found >> np.uint64(29))


def least_shared(size: np.ndarray | int) -> np.ndarray | int:
    """How many shingles of a set of this size any set that links with it has too."""
    return -(-LEAST[0] * size // LEAST[1])


def _dealt(keys: np.ndarray, bits: int, columns: list[np.ndarray]) -> Iterator[tuple]:
    """Rows (part, False, columns) of ROW values at most, by the upper bits of the keys."""
    parts = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(parts, kind="stable")
    parts, columns = parts[order], [c[order] for c in columns]
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    for a, b in zip(edges, edges[1:], strict=False):
        for k in range(a, b, ROW):
            yield int(parts[a]), False, *(c[k : min(k + ROW, b)].tobytes() for c in columns)


def _size_rows(names: np.ndarray, sizes: np.ndarray, sent: np.ndarray, bits: int) -> Iterator[tuple]:
    for part, _, *values in _dealt(names, bits, [names, sizes, sent]):
        yield part, True, *values


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return common.one_batch(_SCHEMA, dict(zip(_SCHEMA.names, zip(*rows, strict=True), strict=True)))


def _sets(bits: int, sent: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, text): the share ``sent`` of the shingles with their text's name, dealt by shingle; by name, how many there are and were sent."""
    names: list[int] = []
    found: list[np.ndarray] = []
    sizes: list[int] = []
    held = 0

    def rows() -> list[tuple]:
        named, own, joined = np.array(names, np.int64), [len(f) for f in found], np.concatenate(found)
        return [(*r, b"") for r in _dealt(joined, bits, [joined, np.repeat(named, own)])] + list(_size_rows(named, np.array(sizes, np.int64), np.array(own, np.int64), bits))

    for batch in common.slices(batches, "text"):
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = shingles(text)
            names.append(name)
            sizes.append(len(own))
            found.append(own if sent[0] == sent[1] else own[own % np.uint64(sent[1]) < sent[0]])
            held += len(found[-1]) + 1
            if held >= HELD:
                yield _batch(rows())
                names, found, sizes, held = [], [], [], 0
    if names:
        yield _batch(rows())


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Of rows in order of their part: each part's rows without and with sizes."""
    last, rows = None, ([], [])
    for batch in batches:
        for part, sizes, *values in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if part != last:
                if last is not None:
                    yield rows
                last, rows = part, ([], [])
            rows[sizes].append(values)
    if last is not None:
        yield rows


def _joined(rows: list[list[bytes]], column: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _shared(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of two texts or more, with the number of their texts, dealt by text."""
    for rows, sizes in _by_part(batches):
        out = []
        if sizes:
            out += _size_rows(*(_joined(sizes, i, np.int64) for i in range(3)), bits)
        if rows:
            hashes, names = _joined(rows, 0, np.uint64), _joined(rows, 1, np.int64)
            order = np.argsort(hashes)
            hashes, names = hashes[order], names[order]
            same = hashes[1:] == hashes[:-1]
            again = np.append(same, False) | np.insert(same, 0, False)
            hashes, names = hashes[again], names[again]
            order = np.lexsort((names, hashes))
            hashes, names = hashes[order], names[order]
            if len(hashes):  # rows of equal texts count once
                new = np.append(True, (hashes[1:] != hashes[:-1]) | (names[1:] != names[:-1]))
                hashes, names = hashes[new], names[new]
                first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                n = np.diff(np.append(first, len(hashes)))
                texts = np.repeat(n, n)
                keep = texts > 1
                out += _dealt(names[keep], bits, [hashes[keep], names[keep], texts[keep]])
        for k in range(0, len(out), 2048):
            yield _batch(out[k : k + 2048])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the texts that share as many of the shingles sent as a text with a near copy must."""
    schema = pa.schema([("name", pa.int64())])
    for rows, sizes in _by_part(batches):
        names, first = np.unique(_joined(sizes, 0, np.int64), return_index=True)
        size, sent = _joined(sizes, 1, np.int64)[first], _joined(sizes, 2, np.int64)[first]
        shared = np.bincount(np.searchsorted(names, _joined(rows, 1, np.int64)), minlength=len(names))
        yield common.one_batch(schema, {"name": names[shared >= sent - (size - least_shared(size))]})


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, size, shared, shingles) of the texts that may have a near copy; shared shingles, the rarest first."""
    schema = pa.schema([("name", pa.int64()), ("size", pa.int64()), ("shared", pa.int64()), ("shingles", pa.binary())])
    for rows, sizes in _by_part(batches):
        if not rows:
            continue
        known = dict(zip(_joined(sizes, 0, np.int64).tolist(), _joined(sizes, 1, np.int64).tolist(), strict=True))
        hashes, names, texts = _joined(rows, 0, np.uint64), _joined(rows, 1, np.int64), _joined(rows, 2, np.int64)
        order = np.lexsort((hashes, texts, names))
        hashes, names = hashes[order], names[order]
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        n = np.diff(np.append(first, len(names)))
        own = names[first].tolist()
        size = np.array([known[x] for x in own])
        out = [(own[i], int(size[i]), int(n[i]), hashes[first[i] : first[i] + n[i]].tobytes()) for i in np.flatnonzero(n >= least_shared(size)).tolist()]
        for k in range(0, len(out), 512):
            yield common.one_batch(schema, dict(zip(schema.names, zip(*out[k : k + 512], strict=True), strict=True)))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shingle", pa.int64()), ("name", pa.int64())])
    for batch in batches:
        for name, size, shared, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = np.frombuffer(packed, np.int64)[: shared - least_shared(size) + 1]
            yield common.one_batch(schema, {"shingle": own, "name": np.full(len(own), name)})


class _Postings:
    """Which of some texts have each shingle."""

    def __init__(self, own: list[np.ndarray], kinds: int, left: np.ndarray):
        lengths = np.array([len(own[i]) for i in left.tolist()])
        tokens = np.concatenate([own[i] for i in left.tolist()])
        self.texts = len(left)
        self.n = np.bincount(tokens, minlength=kinds)
        self.start = np.cumsum(self.n) - self.n
        self.owner = np.repeat(left, lengths)[np.argsort(tokens, kind="stable")]

    def common(self, tokens: np.ndarray, texts: int) -> np.ndarray:
        """How many of these shingles each text has."""
        each = self.n[tokens]
        ends = np.cumsum(each)
        rows = np.arange(ends[-1]) + np.repeat(self.start[tokens] - (ends - each), each)
        return np.bincount(self.owner[rows], minlength=texts)


def link_unit(names: list[int], sizes: np.ndarray, sets: list[np.ndarray], forest: Forest) -> None:
    """Join all texts of a unit that link, from text to linked text: each meets only those not reached yet."""
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    own, kinds, count = np.split(place, np.cumsum([len(s) for s in sets])[:-1]), int(place.max()) + 1, len(sets)
    left, unreached = np.arange(count), np.ones(count, bool)
    postings = _Postings(own, kinds, left)
    while len(left):
        reached = [int(left[0])]
        unreached[reached] = False
        left = left[1:]
        while reached and len(left):
            if 2 * len(left) < postings.texts:
                postings = _Postings(own, kinds, left)
            i = reached.pop()
            # similarity >= p / q is common * (p + q) >= p * (sum of sizes)
            found = np.flatnonzero(unreached & (postings.common(own[i], count) * sum(LEAST) >= LEAST[0] * (sizes + sizes[i])))
            for j in found.tolist():
                forest.join(names[i], names[j])
            if len(found):
                reached += found.tolist()
                unreached[found] = False
                left = left[unreached[left]]


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, name, size, shared, shingles, leader): whether each text links with its component's leader (a struct of name, size, shingles)."""
    for batch in batches:
        linked, names = [], []
        for name, size, packed, leader in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5)), strict=True):
            both = len(np.intersect1d(np.frombuffer(packed, np.uint64), np.frombuffer(leader["shingles"], np.uint64), assume_unique=True))
            linked.append(both * sum(LEAST) >= LEAST[0] * (size + leader["size"]))
            names.append(leader["name"])
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(linked, pa.bool_()), pa.array(names, pa.int64())], names=[*batch.schema.names[:5], "linked", "leader"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, text) as (name, size, shingles)."""
    schema = pa.schema([("name", pa.int64()), ("size", pa.int64()), ("shingles", pa.binary())])
    for batch in common.slices(batches, "text"):
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        yield common.one_batch(schema, {"name": batch.column(0), "size": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]})


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, size, shingles, first: a struct of the same) as (u, v, linked, same): whether the two texts link, and whether their sets are equal."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_()), ("same", pa.bool_())])
    for batch in batches:
        found = []
        for name, size, packed, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            both = len(np.intersect1d(np.frombuffer(packed, np.uint64), np.frombuffer(first["shingles"], np.uint64), assume_unique=True))
            found.append((name, first["name"], both * sum(LEAST) >= LEAST[0] * (size + first["size"]), both == size == first["size"]))
        if found:
            yield common.one_batch(schema, dict(zip(schema.names, zip(*found, strict=True), strict=True)))


def fingerprint_links(texts: DataFrame) -> DataFrame:
    """(u, v, linked, same) of ``texts`` (name, text): each text whose SimHash reaches another's, and its component's first text, checked by their sets."""
    near = simhash_pivots.near_copies(texts.select(F.col("name").alias("doc_id"), "text"))
    near = near.filter("doc_id <> component_id").select(F.col("doc_id").alias("name"), F.col("component_id").alias("first")).distinct()
    near = common.stored(near, "fingerprint-copies")
    wanted = near.select("name").union(near.select("first")).distinct()
    rows = common.marked(texts.select("name", "text"), "name", wanted).filter("_met").select("name", "text")
    sets = common.map_batches(rows, _whole, "name long, size long, shingles binary").join(wanted, "name", "left_semi")
    sets = common.stored(sets.dropDuplicates(["name"]), "fingerprint-sets")
    firsts = near.groupBy("first").agg(F.count("*").alias("n")).join(sets.withColumnRenamed("name", "first"), "first")
    firsts = common.stored(firsts.select("first", "n", F.struct(F.col("first").alias("name"), "size", "shingles").alias("leader")), "firsts")
    met = common.attach(near.join(sets, "name"), firsts, ["first"], "n", "name").select("name", "size", "shingles", "leader")
    found = common.stored(common.map_batches(met, _checked, "u long, v long, linked boolean, same boolean"), "checked")
    common.discard(near, sets, firsts)
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, first, second, name, size, shingles) ordered by unit: a forest of the links within units."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    last, rows = None, []

    def linked() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            forest = Forest()
            link_unit([r[0] for r in rows], np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows], forest)
            if pairs := [(x, r) for x in forest.parent if x != (r := forest.root(x))]:
                yield common.one_batch(schema, {"u": [x for x, _ in pairs], "v": [r for _, r in pairs]})

    for batch in batches:
        for *unit, name, size, packed in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if unit != last:
                yield from linked()
                last, rows = unit, []
            rows.append((name, size, packed))
    yield from linked()


def links(texts: DataFrame, count: int, unit: int = UNIT_SHINGLES) -> DataFrame:
    """Links (u, v) between names of ``texts`` (name, text) that keep every connection; ``count`` is about the number of texts."""
    n = common.partitions(texts.sparkSession)
    bits = max(63, count // PART_TEXTS).bit_length()

    def counted(sent: tuple[int, int], rows: DataFrame) -> DataFrame:
        sets = common.map_batches(rows.select("name", "text"), partial(_sets, bits, sent), _COLUMNS)
        shared = common.map_batches(sets.repartition(n, "part").sortWithinPartitions("part"), partial(_shared, bits), _COLUMNS)
        return shared.repartition(n, "part").sortWithinPartitions("part")

    left = common.stored(common.map_batches(counted(SENT, texts), _left, "name long"), "left")
    # A few more texts than are left may pass; they go again with the whole sets.
    again = common.marked(texts.select("name", "text"), "name", left).filter("_met")
    kept = common.map_batches(counted((1, 1), again), _survivors, "name long, size long, shared long, shingles binary")
    kept = common.stored(kept, "shared-shingles")
    met = common.stored(common.map_batches(kept, _prefixes, "shingle long, name long"), "prefixes")
    stars = met.groupBy("shingle").agg(F.min("name").alias("least"), F.count("*").alias("n")).filter("n > 1")
    found = components(common.attach(met, stars, ["shingle"], "n", "name").filter("least is not null").select("name", "least"))
    groups = found.toDF("name", "component").union(found.select("component", "component").distinct())
    sized = kept.join(groups, "name")
    sized = common.stored(sized.select("component", "name", "size", "shared", "shingles"), "candidates")
    common.discard(left, kept, met, found)
    key = ["component", "first", "second"]
    totals = sized.groupBy("component").agg(F.sum("shared").alias("total"), F.count("*").alias("n"), F.expr("percentile_approx(size, 0.5)").alias("middle"))
    large = common.stored(totals.filter(F.col("total") > unit), "large")
    marked = common.attach(sized, large, ["component"], "n", "name")
    units = marked.filter("total is null").select("component", F.lit(0).alias("first"), F.lit(0).alias("second"), "name", "size", "shingles")
    if large.isEmpty():
        return common.map_batches(units.repartition(n, *key).sortWithinPartitions(*key), _links, "u long, v long")
    # In a large component the texts that link with one of middle size, its leader, needn't be compared with each
    # other; what is left is compared with all, in parts.
    rows = marked.filter("total is not null").select("component", "name", "size", "shared", "shingles", "middle", "n")
    leaders = rows.filter("size = middle").groupBy("component").agg(F.min(F.struct("name", "size", "shingles")).alias("leader"), F.max("n").alias("n"))
    met = common.attach(rows.drop("middle", "n"), leaders, ["component"], "n", "name").drop("n")
    schema = T.StructType([*met.schema.fields[:5], T.StructField("linked", T.BooleanType()), T.StructField("leader", T.LongType())])
    led = common.stored(common.map_batches(met, _led, schema), "led")
    share = lambda rows: F.ceil(F.coalesce(F.sum(F.when(rows, F.col("shared"))), F.lit(0)) / unit).cast("int")
    counts = led.groupBy("component").agg(share(F.col("linked")).alias("a"), share(~F.col("linked")).alias("b"), F.count("*").alias("n"))
    dealt = common.attach(led, counts, ["component"], "n", "name").withColumn("own", F.pmod(F.xxhash64("name"), F.when(F.col("linked"), F.col("a")).otherwise(F.col("b"))).cast("int"))
    # Parts of linked texts have numbers below 0.  A unit is two parts, one at least of texts that are not linked.
    others = F.when(F.col("linked"), F.expr("if(b > 0, sequence(0, b - 1), cast(array() as array<int>))")).otherwise(F.expr("concat(sequence(0, b - 1), if(a > 0, sequence(-a, -1), cast(array() as array<int>)))"))
    me = F.when(F.col("linked"), -1 - F.col("own")).otherwise(F.col("own"))
    each = dealt.withColumn("me", me).withColumn("other", F.explode(others))
    parts = each.select("component", F.least("me", "other").alias("first"), F.greatest("me", "other").alias("second"), "name", "size", "shingles")
    found = common.map_batches(units.unionByName(parts).repartition(n, *key).sortWithinPartitions(*key), _links, "u long, v long")
    return found.unionByName(led.filter("linked and name <> leader").select(F.col("name").alias("u"), F.col("leader").alias("v")))


def drop_near_copies(docs: DataFrame, unit: int = UNIT_SHINGLES) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of least doc_id."""
    named = docs.select(F.xxhash64(common.text_of()).alias("name"), F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), common.whole_row(docs).alias("_row"), F.spark_partition_id().alias("part"))
    checked = fingerprint_links(named)
    # Texts of the same set have the same links, so one of them is joined.
    same = checked.filter("same").select(F.col("u").alias("name"))
    met = common.marked(named.select("name", "text"), "name", same)
    left = met.filter("not _met").unionByName(met.filter("_met").join(same, "name", "left_anti")).select("name", "text")
    joined = links(left, docs.count(), unit).union(checked.filter("linked").select("u", "v"))
    linked = components(joined).toDF("name", "component")
    common.discard(checked)
    # Of each text, then of each component: the least doc_id, and how many rows repeat it.
    ids = named.groupBy("name", "doc_id").agg(F.count("*").alias("again"))
    own = ids.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name", "again")).alias("best"), F.sum("again").alias("n"))
    own = common.stored(own.join(linked, "name", "left").select("name", "best", "n", F.coalesce("component", "name").alias("component")), "texts")
    best = own.groupBy("component").agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.count("*").alias("m")).filter("n > 1")
    groups = common.attach(own.select("component", "name"), best, ["component"], "m", "name").filter("n > 1")
    groups = common.stored(groups.select("name", "n", F.col("best.name").alias("keep_name"), F.col("best.doc_id").alias("keep_id"), F.col("best.again").alias("again")), "groups")
    common.discard(own, linked)
    rows = common.marked(named.select("name", "doc_id", "part", "_row"), "name", groups.select("name"))
    alone = rows.filter("not _met").select("_row.*")
    found = common.attach(rows.filter("_met").drop("_met"), groups, ["name"], "n", "doc_id")
    found = found.filter(F.col("n").isNull() | ((F.col("keep_name") == F.col("name")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    if not groups.filter("again > 1").isEmpty():  # rows that repeat doc_id and text: the first of each input partition, then of those
        repeated = F.coalesce("again", F.lit(1)) > 1
        firsts = found.filter(repeated).selectExpr("*", "row_number() over (partition by name, doc_id, part order by part) as _nth").filter("_nth = 1")
        one = firsts.withColumn("_nth", F.expr("row_number() over (partition by name, doc_id order by part)")).filter("_nth = 1").drop("_nth")
        found = found.filter(~repeated).unionByName(one)
    return alone.unionByName(found.select("_row.*"))
