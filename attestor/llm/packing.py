"""Cost-balanced packing of documents into token sequences.

The cost of a piece of n tokens is estimated as LINEAR * n + QUADRATIC * n**2 (projections and
attention).  Documents are gathered into groups of about GROUP_TOKENS tokens within an input
partition; each group is packed by itself, so nothing is shuffled and no state outgrows a group.  In
a group, whole multiples of the capacity are cut off long documents and fill sequences of their own;
the remainders are taken in descending order of cost, each to the sequence of lowest cost so far that
has room for it.  A piece that fits nowhere is cut: it fills the sequence with most room and the rest
goes on.  A group's sequences are as many full ones as its tokens fill, and powers of two for what is
left over (the binary digits of the rest), so that no sequence needs padding.

Defined cases: null and empty texts are documents of one token (the end id); rows that repeat are
packed as often as they occur; an empty table gives no pieces.  Which sequence a document gets depends on
its partition and place there, so a partition that is computed again must hold the same rows in the same
order: give a stored table or one that is sorted, as the pipeline does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import common, tokens

CAPACITY = 4096
END_ID = 2
GROUP_TOKENS = 1 << 20
#: Bytes of text that are encoded at once; chunks that a worker remembers.
BATCH_BYTES, MEMO_CHUNKS = 4 << 20, 500_000
LINEAR, QUADRATIC = 1.0, 1.0 / 4096

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sizes of the sequences for ``total`` tokens: full ones, then powers of two."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], rooms: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (item, start in item, length, sequence) of items of at most the largest room each.

    The rooms add up to the lengths exactly.
    """
    room = np.array(rooms, np.int64)
    load = np.zeros(len(rooms))
    pieces = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            if fits.any():
                sequence, take = int(np.where(fits, load, np.inf).argmin()), left
            else:
                sequence = int(room.argmax())
                take = int(room[sequence])
            pieces.append((item, start, take, sequence))
            room[sequence] -= take
            load[sequence] += cost(take)
            start, left = start + take, left - take
    return pieces


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, float]]:
    """(document, start, length, sequence, offset, tokens of the sequence, cost of the piece) for documents of that many tokens."""
    whole, rests, owners = [], [], []
    for d, n in enumerate(lengths):
        full = n // capacity
        whole += [(d, k * capacity) for k in range(full)]
        if n % capacity:
            rests.append(n % capacity)
            owners.append((d, full * capacity))
    rooms = capacities(sum(rests), capacity)
    out = [(d, start, capacity, s, 0, capacity, cost(capacity)) for s, (d, start) in enumerate(whole)]
    offsets = [0] * len(rooms)
    for item, start, length, sequence in assign(rests, rooms):
        d, before = owners[item]
        out.append((d, before + start, length, len(whole) + sequence, offsets[sequence], rooms[sequence], cost(length)))
        offsets[sequence] += length
    return out


def _pieces(path: str, end_id: int, capacity: int, group_tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(path, MEMO_CHUNKS)
    schema = pa.schema([(f.split()[0], pa.float64() if f.endswith("double") else pa.int64()) for f in PIECE_SCHEMA.split(", ")])
    names: list = []
    ids: list[np.ndarray] = []
    held = 0
    first: int | None = None

    def close() -> pa.RecordBatch:
        nonlocal first
        rows = pack(list(map(len, ids)), capacity)
        wide = [x.astype("<u4") for x in ids]
        batch = common.one_batch(schema, {
            "doc_id": [names[r[0]] for r in rows], "start": [r[1] for r in rows], "length": [r[2] for r in rows],
            "ids_crc32": [zlib.crc32(wide[r[0]][r[1] : r[1] + r[2]]) for r in rows], "doc_tokens": [len(wide[r[0]]) for r in rows],
            "sequence_id": [first + r[3] for r in rows], "offset": [r[4] for r in rows], "sequence_tokens": [r[5] for r in rows], "cost": [r[6] for r in rows],
        })
        first += 1 + max(r[3] for r in rows)
        return batch

    for batch in common.slices(batches, "text", BATCH_BYTES):
        if first is None:
            first = batch.column(2)[0].as_py() << 33  # sequence ids of other partitions lie apart
        for name, coded in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
            names.append(name)
            ids.append(np.append(coded, np.array(end_id, "<u2")))
            held += len(coded) + 1
            if held >= group_tokens:
                yield close()
                names, ids, held = [], [], 0
    if ids:
        yield close()


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, with its ids' crc32 and cost."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    path = path or tokens.vocabulary_path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), F.spark_partition_id().alias("part"))
    return common.map_batches(rows, partial(_pieces, path, end_id, capacity, group_tokens), PIECE_SCHEMA)
