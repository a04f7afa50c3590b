"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased tokens between ASCII white space, without ASCII punctuation.  From every place of a
test item the shortest n-gram is a seed whose words, by their frequencies in all documents, are rare
enough together that chance makes it up at most SPARE times in the whole corpus (it may occur as often
as it likes, as a leaked passage does).  An item without such a place is seeded with all its n-grams of
MOST_WORDS words, or with the whole item if that is shorter.

Documents are scanned for seeds, and a local alignment (match +2, mismatch -1, gap -1 a word) compares
the item with the words around each group of seeds.  ``score`` is the best alignment's score over that
of the item with itself; LEAST_SCORE or more is a leak, so copies with edited, dropped or added
words are found.

An item of more than PIECE_WORDS words is aligned in pieces of that size; its score is the sum of its pieces'
scores over that of the whole item with itself, its place reaches from the first piece found to the last.
Alignments are made together for about TOGETHER cells a step, so that neither long items nor long documents
take more memory.

The benchmark is dealt into blocks of about BLOCK_WORDS words, files in the folder that all hosts share;
tasks read them from there, BLOCKS_HELD at a time.  The documents are gone through twice, once to count the
words of the blocks and once to find leaks, without a shuffle and however many blocks there are.

Defined cases: null and empty texts and items match nothing; rows and items that repeat are reported
each; a null doc_id or item_id is reported as null; empty tables give an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import common

FEWEST_WORDS, MOST_WORDS, SPARE = 2, 8, 0.25
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
BLOCK_WORDS, BLOCKS_HELD = 500_000, 2
PIECE_WORDS, TOGETHER = 1024, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

LEAK_SCHEMA = "doc_id long, item_id long, score double, start long, end long, places long"


_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_TOKEN = re.compile(r"[^ \t\n\r\v\f]+")


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


def numbers_of(text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each word: that of a benchmark word (1 and more), 0 for others."""
    found = words(text)
    return np.fromiter(map(vocabulary.get, found, repeat(0)), np.int64, len(found))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word lies in the text, in code points."""
    return [m.span() for m in _TOKEN.finditer(text) if words(m[0])]


@dataclass
class Block:
    """Items of the benchmark, as numbers of their words, in pieces."""

    item_ids: list[list[int | None]] = field(default_factory=list)  # of each distinct item, all of its rows
    sizes: list[int] = field(default_factory=list)
    pieces: list[np.ndarray] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)  # the item of each piece
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length: hashes, places' first, places

    def add(self, item_ids: list[int | None], found: list[bytes]) -> None:
        numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found])
        cut = [numbers[i : i + PIECE_WORDS] for i in range(0, len(numbers), PIECE_WORDS)]
        self.owners += [len(self.sizes)] * len(cut)
        self.pieces += cut
        self.item_ids.append(item_ids)
        self.sizes.append(len(found))

    def seed(self, counts: dict[int, int], total: int) -> None:
        """Choose the seeds from the corpus counts of the block's words."""
        need = math.log2((total + 1) / SPARE)
        bits = np.array([0.0] + [-math.log2((counts.get(i, 0) + 1) / (total + 1)) for i in range(1, len(self.vocabulary) + 1)])
        found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for at, piece in enumerate(self.pieces):
            ends = np.concatenate(([0.0], np.cumsum(bits[piece])))
            chosen = []
            for p in range(len(piece)):
                n = int(np.searchsorted(ends, ends[p] + need)) - p
                n = max(n, FEWEST_WORDS)
                if n <= MOST_WORDS and p + n <= len(piece):
                    chosen.append((p, n))
            if not chosen:
                n = min(MOST_WORDS, len(piece))
                chosen = [(p, n) for p in range(len(piece) - n + 1)]
            for n in {n for _, n in chosen}:
                own = np.array([p for p, m in chosen if m == n])
                for p, h in zip(own.tolist(), hashed(piece, n, own).tolist(), strict=True):
                    found[n][h].append((at, p))
        for n, places in found.items():
            order = sorted(places)
            first = np.cumsum([0, *(len(places[h]) for h in order)])
            self.seeds[n] = np.array(order, np.uint64), first, np.array([x for h in order for x in places[h]], np.int64).reshape(-1, 2)


def _step(h: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    h = (h ^ numbers.astype(np.uint64)) * _MIX
    return h ^ h >> np.uint64(29)


def hashed(numbers: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """A hash of the n numbers from each place of ``at``."""
    return reduce(lambda h, k: _step(h, numbers[at + k]), range(n), np.zeros(len(at), np.uint64))


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its window, and the window's word where it ends."""
    height, width = max(map(len, items)), max(map(len, windows))
    a, b = np.full((len(items), height), -2, np.int32), np.full((len(items), width), -3, np.int32)
    for i, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    b[b == 0] = -3
    slope = -GAP * np.arange(width, dtype=np.int32)
    row = np.zeros((len(items), width), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(height):
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        diagonal += np.where(a[:, i, None] == b, MATCH, MISMATCH).astype(np.int32)
        row = np.maximum(np.maximum(diagonal, row + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        at = row.argmax(1)
        top = row[np.arange(len(items)), at]
        end, best = np.where(top > best, at, end), np.maximum(best, top)
    return best, end


def _windows(block: Block, numbers: np.ndarray, document: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, piece, first word, end word) of each group of seeds; words counted within the document."""
    pairs = []
    for n, (hashes, starts, places) in block.seeds.items():
        if len(numbers) < n:
            continue
        known = numbers > 0
        inside = np.flatnonzero(reduce(np.logical_and, (known[k : len(numbers) - n + 1 + k] for k in range(n))))
        inside = inside[document[inside] == document[inside + n - 1]]
        if not len(inside):
            continue
        own = hashed(numbers, n, inside)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = hashes[at] == own
        at, inside = at[hit], inside[hit]
        count = starts[at + 1] - starts[at]
        which = np.repeat(starts[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        where = np.repeat(inside, count)
        piece, place = places[which].T
        pairs.append(np.stack((document[where], piece, where - first[document[where]] - place), 1))
    if not sum(map(len, pairs)):
        return []
    found = np.unique(np.concatenate(pairs), axis=0)  # document, piece, diagonal, in that order
    size = np.array([len(x) for x in block.pieces])[found[:, 1]]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1) | (found[1:, 2] - found[:-1, 2] > size[1:] // 2)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(found)) - 1
    length = size[starts]
    pad = length // 2 + 2
    return list(zip(found[starts, 0].tolist(), found[starts, 1].tolist(), np.maximum(0, found[starts, 2] - pad).tolist(), (found[ends, 2] + length + pad).tolist(), strict=True))


def _batches(block: Block, spots: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """Spots of like size, of TOGETHER cells of the alignment's rows at once (one spot at least)."""
    spots = sorted(spots, key=lambda s: (len(block.pieces[s[1]]), s[3] - s[2]))
    some, width = [], 0
    for spot in spots:
        wider = max(width, spot[3] - spot[2])
        if some and (len(some) + 1) * wider > TOGETHER:
            yield some
            some, wider = [], spot[3] - spot[2]
        some.append(spot)
        width = wider
    if some:
        yield some


def leaks_of(block: Block, texts: list[str], least: float) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, start, end, places): the leaks in some texts; start and end in code points."""
    each = [numbers_of(t, block.vocabulary) for t in texts]
    first = np.cumsum([0, *(len(x) for x in each)])
    document = np.repeat(np.arange(len(texts)), np.diff(first))
    spots = _windows(block, np.concatenate([np.zeros(0, np.int64), *each]), document, first)
    best: dict[tuple[int, int], list] = {}  # of a document and a piece: score, first word, last word, places
    for some in _batches(block, spots):
        pieces = [block.pieces[i] for _, i, _, _ in some]
        score, end = align(pieces, [each[d][a:b] for d, _, a, b in some])
        for (d, i, a, _), s, e, piece in zip(some, score.tolist(), end.tolist(), pieces, strict=True):
            entry = best.setdefault((d, i), [s, a, a + e, 0])
            entry[3] += s >= least * MATCH * len(piece)
            if (s, -a) > (entry[0], -entry[1]):
                entry[:3] = s, a, a + e
    whole: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for d, i in sorted(best):
        whole[d, block.owners[i]].append((d, i))
    out = []
    for (d, item), keys in whole.items():
        share = sum(best[k][0] for k in keys) / (MATCH * block.sizes[item])
        if share < least:
            continue
        begins, ends = [], []
        for _, i in keys:
            _, a, e, _ = best[d, i]
            back = each[d][a : e + 1][::-1]
            _, begin = align([block.pieces[i][::-1]], [back])
            begins.append(e - int(begin[0]))
            ends.append(e)
        spans = word_spans(texts[d])
        out.append((d, item, share, spans[min(begins)][0], spans[max(ends)][1], max(1, *(best[k][3] for k in keys))))
    return out


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _written(block: Block, folder: str, number: int) -> str:
    path = f"{folder}/{number:06d}-{uuid.uuid4().hex}.block"
    store, inside = _file_system(path)
    with store.open_output_stream(inside) as out:
        out.write(pickle.dumps(block))
    return path


@partial(common.kept, most=BLOCKS_HELD)
def _read(path: str) -> Block:
    store, inside = _file_system(path)
    with store.open_input_stream(inside) as file:
        return pickle.loads(file.read())


_PATHS = pa.schema([("block", pa.int32()), ("path", pa.string())])


def _build(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, item_id, text) in order of block and text: a file for each block; texts that repeat are one item."""
    at, block, last, ids = None, Block(), None, []

    def settle() -> None:
        if ids and (found := words(last)):
            block.add(ids, found)

    for batch in batches:
        for number, item_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (number, text) != (at, last):
                settle()
                ids = []
            if number != at:
                if at is not None:
                    yield common.one_batch(_PATHS, {"block": [at], "path": [_written(block, folder, at)]})
                at, block = number, Block()
            last = text
            ids.append(item_id)
    settle()
    if at is not None:
        yield common.one_batch(_PATHS, {"block": [at], "path": [_written(block, folder, at)]})


def _count(paths: dict[int, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, n): how often the words of each block occur; word 0 stands for all words."""
    schema = pa.schema([("block", pa.int32()), ("word", pa.int64()), ("n", pa.int64())])
    counts: dict[int, np.ndarray] = {}
    for batch in common.slices(batches, "text"):
        texts = batch.column(0).to_pylist()
        for number, path in paths.items():
            vocabulary = _read(path).vocabulary
            own = counts.setdefault(number, np.zeros(len(vocabulary) + 1, np.int64))
            for text in texts:
                own += np.bincount(numbers_of(text, vocabulary), minlength=len(own))
    for number, own in counts.items():
        own[0] = own.sum()
        kinds = np.flatnonzero(own)
        yield common.one_batch(schema, {"block": [number] * len(kinds), "word": kinds, "n": own[kinds]})


def _seeded(paths: dict[int, str], folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, word, n) in order of block: a file for each block, with its seeds."""
    at, counts = None, {}

    def done() -> pa.RecordBatch:
        block = pickle.loads(pickle.dumps(_read(paths[at])))
        block.seed(counts, counts.pop(0, 0))
        return common.one_batch(_PATHS, {"block": [at], "path": [_written(block, folder, at)]})

    for batch in batches:
        for number, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if number != at:
                if at is not None:
                    yield done()
                at, counts = number, {}
            counts[word] = counts.get(word, 0) + n
    if at is not None:
        yield done()


def blocks(benchmark: DataFrame, texts: DataFrame, most_words: int = BLOCK_WORDS) -> list[str]:
    """Paths of the benchmark's blocks, with seeds by the words' frequencies in ``texts``; one short text a block reaches the driver."""
    spark = benchmark.sparkSession
    folder, n = f"{common.own_folder(spark)}/benchmark-{uuid.uuid4().hex}", common.partitions(spark)
    store, inside = _file_system(folder)
    store.create_dir(inside, recursive=True)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text"))
    (held,) = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).head()
    if not held:
        return []
    count = -(-held // most_words)
    number = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(count)).cast("int").alias("block")
    dealt = rows.select(number, "item_id", "text").repartition(min(count, n), "block").sortWithinPartitions("block", "text", "item_id")
    files = common.stored(common.map_batches(dealt, partial(_build, folder), "block int, path string"), "blocks")
    built = dict(files.collect())
    counted = common.map_batches(texts.select("text"), partial(_count, built), "block int, word long, n long").groupBy("block", "word").agg(F.sum("n").alias("n"))
    none = files.select("block", F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("n"))  # a corpus without texts counts nothing
    ordered = counted.unionByName(none).repartition(min(count, n), "block").sortWithinPartitions("block")
    found = common.stored(common.map_batches(ordered, partial(_seeded, built, folder), "block int, path string"), "blocks").collect()
    return [path for _, path in sorted(found)]


def _scan(paths: list[str], least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("places", pa.int64())])
    for batch in common.slices(batches, "text", 2 << 20):
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for path in paths:
            block = _read(path)
            rows = [(doc_ids[d], item_id, *rest) for d, i, *rest in leaks_of(block, texts, least) for item_id in block.item_ids[i]]
            if rows:
                yield common.one_batch(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, most_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and test item that leaks into it: score, span of the best place, number of places."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    paths = blocks(benchmark, rows, most_words)
    return common.map_batches(rows, partial(_scan, paths, least), LEAK_SCHEMA)


def _clean(paths: list[str], least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "_text", 2 << 20):
        texts = batch.column(0).to_pylist()
        leaking = {d for path in paths for d, *_ in leaks_of(_read(path), texts, least)}
        yield batch.filter(pa.array([i not in leaking for i in range(batch.num_rows)], pa.bool_()))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, most_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents into which no test item leaks, with all their columns; each row is judged by its own text."""
    kept = docs.select(common.text_of().alias("_text"), common.whole_row(docs).alias("_row"))
    paths = blocks(benchmark, kept.select(F.col("_text").alias("text")), most_words)
    return common.map_batches(kept, partial(_clean, paths, least), kept.schema).select("_row.*")
