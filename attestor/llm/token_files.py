"""Token-id files with Elias-Fano document boundaries.

A file ("block") holds the ids of consecutive documents as one array of unsigned 16 bit integers and
two Elias-Fano sequences: where each document starts, and the documents' ids.  ``EliasFano.select``
answers from the sequences as they lie in the file; there is no table of 64 bit offsets.

Layout of a block, all numbers little-endian: magic ``AEF1``, then as unsigned 64 bit: number of
documents, number of ids, number of documents without doc_id, a reserved zero; as
signed 64 bit the smallest doc_id; then two Elias-Fano sequences and the ids.  A sequence of n values
up to u is: n, u, low bits a value (unsigned 64 bit each), the low bits packed, the high bits in unary
(value i sets bit (value >> low) + i), and the position of every 256th set bit as unsigned 32 bit
relative to the sample before, kept as a cumulative array.

Tasks write blocks as files ``PART-BLOCK-ATTEMPT.aef`` to a folder that all hosts share; a table (the
manifest) names the files of the tasks that succeeded, so what a lost or repeated attempt left is never
read.  Readers go from the manifest to the files.  ``Block`` reads the head and the two sequences of a file;
where ids lie is asked of ``select``, and only they are then read.

Defined cases: null text is empty (its document holds the end id only); rows with null doc_id come
first; rows that repeat a doc_id are ordered by XXH64 of the text, then the text; an empty table gives no blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import common, tokens

MAGIC = b"AEF1"
SAMPLE = 256
END_ID = 2
#: Ids after which a block is closed (a document is never divided).
BLOCK_IDS = 2_000_000

#: Chunks that a worker remembers.
MEMO_CHUNKS = 1_200_000
#: Documents whose places are looked up together, and bytes of ids that are read at once (one document at least).
READ_DOCS, READ_BYTES = 1024, 1 << 20

BLOCK_SCHEMA = "part int, block int, n_docs long, n_ids long, path string"


def _pack(values: np.ndarray, width: int) -> bytes:
    if width == 0 or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _sizes(n: int, top: int, low: int) -> tuple[int, int, int]:
    """Bytes of the lower bits, of the upper bits, and of the samples."""
    return (n * low + 7) // 8, (n + (top >> low) + 8) // 8, 4 * -(-n // SAMPLE)


class EliasFano:
    """A sequence of integers that never falls, all 0 or more, in its encoded form."""

    def __init__(self, buffer: memoryview, at: int = 0):
        self.n, self.top, self.low = struct.unpack_from("<QQQ", buffer, at)
        lower, upper, samples = _sizes(self.n, self.top, self.low)
        at += 24
        self.lower = np.frombuffer(buffer, np.uint8, lower, at)
        self.upper = np.frombuffer(buffer, np.uint8, upper, at + lower)
        self.samples = np.frombuffer(buffer, "<u4", samples // 4, at + lower + upper)
        self.end = at + lower + upper + samples

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        upper = np.zeros((n + (top >> low) + 8) // 8 * 8, np.uint8)
        upper[ones] = 1
        lower = _pack(values & np.uint64((1 << low) - 1), low)
        return struct.pack("<QQQ", n, top, low) + lower + np.packbits(upper, bitorder="little").tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """The value at place i, found from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = divmod(position, 8)
        current = int(self.upper[byte]) >> skip << skip
        while (count := current.bit_count()) <= left:
            left -= count
            byte += 1
            current = int(self.upper[byte])
        for _ in range(left):
            current &= current - 1
        high = byte * 8 + (current & -current).bit_length() - 1 - i
        return high << self.low | self._lower(i)

    def _lower(self, i: int) -> int:
        if not self.low:
            return 0
        first, shift = divmod(i * self.low, 8)
        word = int.from_bytes(self.lower[first : first + 9].tobytes(), "little")
        return word >> shift & (1 << self.low) - 1

    def select_range(self, first: int, last: int) -> np.ndarray:
        """The values at places first to last - 1: one scan of the upper bits from the sample before ``first``."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.int64)
        sample = first // SAMPLE
        position = int(self.samples[sample])
        after = -(-last // SAMPLE)
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.upper)
        bits = np.unpackbits(self.upper[position // 8 : stop], bitorder="little")
        bits[: position % 8] = 0  # ones before the sample
        ones = np.flatnonzero(bits)[first - sample * SAMPLE : last - sample * SAMPLE] + position // 8 * 8
        high = (ones - np.arange(first, last)).astype(np.uint64)
        if not self.low:
            return high.astype(np.int64)
        at = np.arange(first, last) * self.low
        words = np.concatenate((self.lower[at[0] // 8 : (int(at[-1]) + self.low + 7) // 8], np.zeros(8, np.uint8)))
        octets = (at // 8 - at[0] // 8)[:, None] + np.arange(8)
        word = np.ascontiguousarray(words[octets]).view("<u8")[:, 0] >> (at % 8).astype(np.uint64)
        return (high << np.uint64(self.low) | word & np.uint64((1 << self.low) - 1)).astype(np.int64)


def encode_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """doc_ids ascending, nulls first; ids of each document as ``<u2``."""
    ends = np.cumsum([0, *map(len, ids)])
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    head = struct.pack("<QQQQq", len(ids), int(ends[-1]), len(doc_ids) - len(known), 0, least)
    return MAGIC + head + EliasFano.encode(ends) + EliasFano.encode((known - least).astype(np.uint64)) + np.concatenate(ids).tobytes()


class Block:
    """A block in an open file: its head and sequences are read at once, ids only as they are asked for."""

    def __init__(self, file):
        self.file = file
        head = file.read(44)
        if head[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.n_docs, self.n_ids, self.n_null, self.base, self.least = struct.unpack_from("<QQQQq", head, 4)
        self.starts = self._sequence()
        self.names = self._sequence()
        self.first = file.tell()

    def _sequence(self) -> EliasFano:
        head = self.file.read(24)
        return EliasFano(memoryview(head + self.file.read(sum(_sizes(*struct.unpack("<QQQ", head))))))

    def ids(self, start: int, stop: int) -> np.ndarray:
        self.file.seek(self.first + 2 * start)
        return np.frombuffer(self.file.read(2 * (stop - start)), "<u2")

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of document i, through select."""
        name = None if i < self.n_null else self.names.select(i - self.n_null) + self.least
        return name, self.ids(self.starts.select(i), self.starts.select(i + 1))

    def documents(self, first: int, last: int) -> tuple[list[int | None], np.ndarray]:
        """doc_ids of documents first to last - 1, and where they start and the last ends."""
        known = self.names.select_range(max(first, self.n_null) - self.n_null, max(last, self.n_null) - self.n_null) + self.least
        return [None] * (last - first - len(known)) + known.tolist(), self.starts.select_range(first, last + 1)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _blocks(path: str, end_id: int, block_ids: int, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(path, MEMO_CHUNKS)
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("path", pa.string())])
    store, inside = _file_system(folder)
    attempt = uuid.uuid4().hex
    names: list = []
    ids: list[np.ndarray] = []
    held = number = 0
    part = 0

    def close() -> pa.RecordBatch:
        name = f"{part:06d}-{number:06d}-{attempt}.aef"
        with store.open_output_stream(f"{inside}/{name}") as out:
            out.write(encode_block(names, ids))
        return common.one_batch(schema, {"part": [part], "block": [number], "n_docs": [len(ids)], "n_ids": [held], "path": [f"{folder}/{name}"]})

    for batch in common.slices(batches, "text", tokens.BATCH_BYTES, trim=False):
        part = batch.column(2)[0].as_py()
        for name, coded in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
            names.append(name)
            ids.append(np.append(coded, np.array(end_id, "<u2")))
            held += len(coded) + 1
            if held >= block_ids:
                yield close()
                names, ids, held, number = [], [], 0, number + 1
    if ids:
        yield close()


def write_blocks(docs: DataFrame, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, folder: str | None = None) -> DataFrame:
    """Encode every document and write the blocks as files of ``folder`` (a URI; else one in the shared folder); gives the manifest.

    The texts are dealt by ranges of (doc_id, text) in one shuffle, so that the order of files by (part,
    block) is the order of doc_id and rows that repeat a doc_id are dealt over parts.
    """
    path = path or tokens.vocabulary_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    folder = folder or f"{common.own_folder(spark)}/token-files-{uuid.uuid4().hex}"
    store, inside = _file_system(folder)
    store.create_dir(inside, recursive=True)
    n = common.partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), F.xxhash64(common.text_of()).alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    return common.stored(common.map_batches(dealt, partial(_blocks, path, end_id, block_ids, folder), BLOCK_SCHEMA), "token-manifest")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, before in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            store, inside = _file_system(path)
            with store.open_input_file(inside) as file:
                block = Block(file)
                for first in range(0, block.n_docs, READ_DOCS):
                    names, starts = block.documents(first, min(first + READ_DOCS, block.n_docs))
                    n, crc, at = len(names), [], 0
                    while at < n:  # some documents at once, READ_BYTES of ids or one document
                        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + READ_BYTES // 2, side="right")) - 1)
                        wide = block.ids(int(starts[at]), int(starts[stop])).astype("<u4")
                        cuts = (starts[at : stop + 1] - starts[at]).tolist()
                        crc += [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                        at = stop
                    yield common.one_batch(schema, {"doc_id": names, "start": starts[:-1] + before, "n_tokens": np.diff(starts), "ids_crc32": crc})


def read_documents(blocks: DataFrame) -> DataFrame:
    """One row per document, read from the files of a manifest: doc_id, start, n_tokens, ids_crc32.

    How many ids lie before each file is told to its reader, so nothing of the documents is joined.
    """
    counts = blocks.select("part", "block", "n_ids")
    # A prefix sum over as many rows as files, in two steps: ranges of doc_id, then the files of each.
    by_part = counts.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = by_part.selectExpr("part", "coalesce(sum(of_part) over (order by part rows between unbounded preceding and 1 preceding), 0) as before_part")
    within = blocks.selectExpr("part", "path", "coalesce(sum(n_ids) over (partition by part order by block rows between unbounded preceding and 1 preceding), 0) as before_block")
    files = within.join(before, "part").selectExpr("path", "before_part + before_block as before")
    dealt = files.repartition(common.partitions(blocks.sparkSession), "path")
    return common.map_batches(dealt, _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, write, read back."""
    return read_documents(write_blocks(docs, path))
