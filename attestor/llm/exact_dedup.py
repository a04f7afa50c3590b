"""Exact deduplication through an extendible-hash index on shared files.

1. Where the documents are read, equal texts of a window are combined to one row (greatest doc_id,
   number of rows), so that a text that a third of all rows hold leaves each task once a window.
2. The 64 bit key of a text (XXH64) lies in one owner's range: its top bits.  Rows are dealt to
   owners and sorted by key.
3. Each owner puts every row into an extendible hash table for its range: the next bits of the key lead
   through the directory to a bucket, the bucket's slot of that key holds a chain, and the text is compared
   with the chain's texts byte by byte; a new text is chained.  A bucket with too many keys splits by its
   next bit, and the directory doubles when the bucket used all of its bits.  As keys arrive in order,
   buckets behind the current one are final: they are written and their texts let go.
4. The index lies in the shared folder: a row for each entry of a bucket (its owner, prefix, depth, key,
   place in the chain) and a row for each place of each owner's directory.
5. A document goes from its owner to a place of the owner's directory, from there to a bucket, and takes the
   entry of the bucket's chain with its key and SHA-256; a bucket without such an entry of two rows or more
   means that the document is alone.

Defined cases: null texts count as empty and are equal to empty ones; of equal texts the greatest
doc_id stays (null only if all are null); of rows that repeat doc_id and text one stays, the others
are reported as not kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm import common

#: Distinct keys of a bucket before it splits; bits that a directory uses at most (buckets of that depth grow).
BUCKET_KEYS, MOST_DEPTH = 256, 20
#: Bytes of distinct texts that the combining step holds; rows of the index that are written together.
WINDOW_BYTES, WRITTEN_ROWS = 32 << 20, 1 << 14
_KEYS = (1 << 64) - 1

COMBINED_SCHEMA = "owner int, key long, text string, keep_id long, n_keep long, n long"
INDEX_SCHEMA = "owner int, place long, bucket long, depth int, chain int, key long, text_sha256 string, keep_id long, n_keep long, n long"


@dataclass(slots=True)
class Entry:
    """A text and what is known of its rows: the greatest doc_id, the rows with it, all rows."""

    text: str
    keep: int | None
    n_keep: int
    n: int

    def add(self, keep: int | None, n_keep: int, n: int) -> None:
        self.n += n
        if keep == self.keep:
            self.n_keep += n_keep
        elif self.keep is None or keep is not None and keep > self.keep:
            self.keep, self.n_keep = keep, n_keep


class Bucket:
    """Slots by key, each a chain of entries; ``prefix`` are the first ``depth`` bits that its keys share."""

    __slots__ = ("depth", "prefix", "slots")

    def __init__(self, depth: int, prefix: int):
        self.depth, self.prefix, self.slots = depth, prefix, {}


class ExtendibleHash:
    """Directory and buckets over 64 bit keys; the first ``skip`` bits, which all keys share, are not used."""

    def __init__(self, capacity: int = BUCKET_KEYS, skip: int = 0, most_depth: int = MOST_DEPTH):
        self.capacity, self.skip, self.most_depth, self.depth = capacity, skip, most_depth, 0
        self.directory = [Bucket(0, 0)]

    def bits(self, key: int, n: int) -> int:
        return (key << self.skip & _KEYS) >> 64 - n

    def bucket(self, key: int) -> Bucket:
        return self.directory[self.bits(key, self.depth)]

    def insert(self, key: int, text: str, keep: int | None, n_keep: int, n: int) -> Bucket:
        """Find the text in its bucket by its bytes and add the rows to it, or chain it; gives the bucket."""
        while True:
            bucket = self.bucket(key)
            chain = bucket.slots.get(key)
            if chain is None:
                if len(bucket.slots) >= self.capacity and bucket.depth < self.most_depth:
                    self.split(bucket)
                    continue
                chain = bucket.slots[key] = []
            for entry in chain:
                if entry.text == text:
                    entry.add(keep, n_keep, n)
                    break
            else:
                chain.append(Entry(text, keep, n_keep, n))
            return bucket

    def split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:  # each place of the directory becomes two
            self.directory = [b for b in self.directory for _ in range(2)]
            self.depth += 1
        halves = Bucket(bucket.depth + 1, 2 * bucket.prefix), Bucket(bucket.depth + 1, 2 * bucket.prefix + 1)
        for key, chain in bucket.slots.items():
            halves[self.bits(key, bucket.depth + 1) & 1].slots[key] = chain
        half = 1 << self.depth - bucket.depth - 1
        first = 2 * half * bucket.prefix
        self.directory[first : first + 2 * half] = [halves[0]] * half + [halves[1]] * half

    def get(self, key: int) -> list[Entry]:
        return self.bucket(key).slots.get(key, [])

    def buckets(self) -> list[Bucket]:
        return list(dict.fromkeys(self.directory))

    def places(self, bucket: Bucket) -> range:
        """The directory's places that lead to the bucket."""
        span = 1 << self.depth - bucket.depth
        return range(bucket.prefix * span, (bucket.prefix + 1) * span)


def _combine(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("text", pa.string()), ("keep_id", pa.int64()), ("n_keep", pa.int64()), ("n", pa.int64())])
    found: dict[str, tuple[int, int, Entry]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        rows = [(owner, key, e.text, e.keep, e.n_keep, e.n) for owner, key, e in found.values()]
        return common.one_batch(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    for batch in common.slices(batches, "text"):
        for doc_id, text, owner, key in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (known := found.get(text)) is None:
                found[text] = owner, key, Entry(text, doc_id, 1, 1)
                held += len(text)
            else:
                known[2].add(doc_id, 1, 1)
        if held > window:
            yield flush()
            found, held = {}, 0
    if found:
        yield flush()


def _index(capacity: int, skip: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of owners in order, each owner's in order of key: the entries of its buckets, then its directory."""
    schema = pa.schema([
        ("owner", pa.int32()), ("place", pa.int64()), ("bucket", pa.int64()), ("depth", pa.int32()), ("chain", pa.int32()), ("key", pa.int64()),
        ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("n_keep", pa.int64()), ("n", pa.int64()),
    ])
    table, owner, last, low = ExtendibleHash(capacity, skip), None, None, 0
    rows: list[tuple] = []

    def final(until: int | None) -> None:
        """Write the buckets from the key ``low`` on up to, and without, the one of the key ``until``."""
        nonlocal low
        end = 1 << table.depth if until is None else table.places(table.bucket(until)).start
        at = table.bits(low, table.depth)
        while at < end:
            bucket = table.directory[at]
            for key, chain in bucket.slots.items():
                for i, e in enumerate(chain):
                    rows.append((owner, None, bucket.prefix, bucket.depth, i, key - (key >> 63 << 64), hashlib.sha256(e.text.encode()).hexdigest(), e.keep, e.n_keep, e.n))
            bucket.slots = {}
            at = table.places(bucket).stop
        low = 0 if until is None else until

    def directory() -> None:
        rows.extend((owner, i, b.prefix, b.depth, None, None, None, None, None, table.depth) for i, b in enumerate(table.directory))

    def written(least: int) -> Iterator[pa.RecordBatch]:
        while len(rows) >= least:
            some = rows[:WRITTEN_ROWS]
            del rows[:WRITTEN_ROWS]
            yield common.one_batch(schema, dict(zip(schema.names, zip(*some, strict=True), strict=True)))

    for batch in common.slices(batches, "text"):
        for own, key, text, keep, n_keep, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if own != owner:
                if owner is not None:
                    final(None)
                    directory()
                table, owner, last = ExtendibleHash(capacity, skip), own, None
                low = own << 64 - skip & _KEYS
            key &= _KEYS
            bucket = table.insert(key, text, keep, n_keep, n)
            if bucket is not last:
                final(key)
                last = bucket
        yield from written(WRITTEN_ROWS)
    if owner is not None:
        final(None)
        directory()
    yield from written(1)


def text_key() -> Column:
    return F.xxhash64(common.text_of())


def owner_bits(docs: DataFrame, owners: int | None = None) -> int:
    return max(1, ((owners or 8 * common.partitions(docs.sparkSession)) - 1).bit_length())


@dataclass
class Index:
    """The index's table in the shared folder, and how many top bits of a key name its owner."""

    table: DataFrame
    owner_bits: int

    @property
    def entries(self) -> DataFrame:
        """One row per distinct text: owner, bucket, depth, chain, key, text_sha256, keep_id, n_keep, n."""
        return self.table.filter("place is null").drop("place")

    @property
    def directory(self) -> DataFrame:
        """One row per place of each owner's directory: owner, place, bucket, depth, global_depth."""
        return self.table.filter("place is not null").select("owner", "place", "bucket", "depth", F.col("n").cast("int").alias("global_depth"))


def build_index(docs: DataFrame, owners: int | None = None, capacity: int = BUCKET_KEYS, window: int = WINDOW_BYTES, key: Column | None = None) -> Index:
    """The index over all documents, written to the shared folder."""
    n, bits = common.partitions(docs.sparkSession), owner_bits(docs, owners)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), (text_key() if key is None else key).alias("key"))
    rows = rows.select("doc_id", "text", F.shiftrightunsigned("key", 64 - bits).cast("int").alias("owner"), "key")
    combined = common.map_batches(rows, partial(_combine, window), COMBINED_SCHEMA)
    dealt = combined.repartition(n, "owner").sortWithinPartitions("owner", "key")
    return Index(common.stored(common.map_batches(dealt, partial(_index, capacity, bits), INDEX_SCHEMA), "hash-index"), bits)


def _looked_up(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (doc_id, _key, _sha256, _part and more) with what the index says: _keep, _n_keep, _n (null for a text of one row).

    Hot places of the directory are joined by ``common.attach``.
    """
    entry = F.struct("key", "text_sha256", "keep_id", "n_keep", "n")
    chains = index.entries.filter("n > 1").groupBy("owner", "bucket", "depth").agg(F.collect_list(entry).alias("_chain"), F.sum("n").alias("_weight"))  # a bucket's entries
    places = index.directory.join(chains, ["owner", "bucket", "depth"]).select(F.col("owner").alias("_owner"), F.col("place").alias("_place"), "_chain", "_weight")
    depths = index.directory.filter("place = 0").select(F.col("owner").alias("_owner"), F.col("global_depth").alias("_depth"))  # a row for each owner
    led = rows.withColumn("_owner", F.shiftrightunsigned("_key", 64 - index.owner_bits).cast("int")).join(F.broadcast(depths), "_owner")
    place = F.expr(f"case when _depth = 0 then 0L else shiftrightunsigned(shiftleft(_key, {index.owner_bits}), 64 - _depth) end")
    found = common.attach(led.withColumn("_place", place).drop("_depth"), places, ["_owner", "_place"], "_weight", "doc_id")
    entry = F.get(F.filter("_chain", lambda e: (e["key"] == F.col("_key")) & (e["text_sha256"] == F.col("_sha256"))), F.lit(0))
    return found.withColumn("_e", entry).select(*rows.columns, F.col("_e.keep_id").alias("_keep"), F.col("_e.n_keep").alias("_n_keep"), F.col("_e.n").alias("_n"))


def _first_of_repeated(rows: DataFrame) -> DataFrame:
    """``_kept`` of one row of those that repeat doc_id and text: the first of each input partition, then of those."""
    same = "_key, _sha256, doc_id"
    nth = rows.selectExpr("*", f"row_number() over (partition by {same}, _part order by _part) as _nth")
    firsts = nth.filter("_nth = 1").selectExpr("*", f"row_number() over (partition by {same} order by _part) = 1 as _first")
    return firsts.unionByName(nth.filter("_nth > 1").withColumn("_first", F.lit(False))).withColumn("_kept", F.col("_first")).drop("_nth", "_first")


def _judged(rows: DataFrame, index: Index) -> DataFrame:
    found = _looked_up(rows, index)
    found = found.withColumn("_kept", F.col("_n").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep")))
    if index.entries.filter("n > 1 and n_keep > 1").isEmpty():
        return found
    again = F.col("_kept") & (F.coalesce("_n_keep", F.lit(1)) > 1)  # rows that repeat doc_id and text: one of them stays
    return found.filter(~again).unionByName(_first_of_repeated(found.filter(again)))


def _rows(docs: DataFrame, key: Column | None, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (text_key() if key is None else key).alias("_key"), F.sha2(common.text_of(), 256).alias("_sha256"), F.spark_partition_id().alias("_part"), *more)


def find_copies(docs: DataFrame, index: Index | None = None, key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, key=key) if index is None else index
    found = _judged(_rows(docs, key), index)
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Only rows whose key the index holds for two rows or more are looked up and shuffled.
    """
    index = build_index(docs)
    rows = common.marked(_rows(docs, None, common.whole_row(docs).alias("_row")), "_key", index.entries.filter("n > 1").select("key"))
    alone = rows.filter("not _met").select("_row.*")
    found = _judged(rows.filter("_met").drop("_met"), index)
    return alone.unionByName(found.filter("_kept").select("_row.*"))


COPIES_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""
