"""Sharding by a weighted hash tree: region, rack, shard.

A row descends the tree from the root.  At each level every child draws -ln(u) / weight, where u in
(0, 1) comes from a hash of the row's key and the child's path, and the least draw wins; so a child
gets rows in proportion to its weight, which is the sum of the weights below it.  When the weights of
some subtree change, rows move only into or out of subtrees whose weights changed.  ``grown`` adds one
shard in a region of its own: no other weight changes, so rows move into the new shard only.

Everything is DataFrame expressions.  A row's slot is its place in its shard by the MD5 of key, size and
checksum, from 0 without gaps: rows are numbered within buckets of that order (not even the rows of one
key meet in a bucket unless they are equal), and counts give the buckets' offsets; no task sees a whole
shard and no text is shuffled.

Defined cases: a null key counts as the word ``null``; rows that repeat a key lie in one shard, in
slots of their own; an empty table gives an empty result.  A column that has the name of the one to be added is
an error in ``with_shard``; ``write_shards`` then names its folders' column ``shard_1``, ``shard_2`` and so on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm import common


@dataclass(frozen=True)
class Topology:
    """Weights of shards: regions of racks of shards.  Shards are numbered in that order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(regions: int = 2, racks: int = 2, shards: int = 4) -> Topology:
        return Topology((((1.0,) * shards,) * racks,) * regions)

    @property
    def count(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, in a new region."""
        return replace(self, regions=(*self.regions, ((weight,),)))

    def paths(self) -> list[tuple[int, int, int, float]]:
        return [(i, j, k, w) for i, region in enumerate(self.regions) for j, rack in enumerate(region) for k, w in enumerate(rack)]


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def draw(key: Column, path: str | Column, weight: float) -> Column:
    """-ln(u) / weight; u from the first 13 hexadecimal digits of MD5(key:path)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), F.lit(path) if isinstance(path, str) else path)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(weight)


def _least(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw (of equal draws the first)."""
    if len(children) == 1:
        return children[0][2]
    options = [F.struct(draw(key, path, weight).alias("d"), F.lit(i).alias("i")) for i, (path, weight, _) in enumerate(children)]
    best = F.least(*options)["i"]
    return F.element_at(F.array(*[value for _, _, value in children]), best + 1)


def shard_of(key: Column, topology: Topology, column: str = "_shard") -> list[tuple[str, Column]]:
    """The columns, in this order, that lead a row from its key to its shard (the last one)."""
    key, number = key_text(key), 0
    weights = [[sum(rack) for rack in region] for region in topology.regions]
    region = _least(key, [(f"{i}", sum(w), F.lit(i)) for i, w in enumerate(weights)])
    steps = [(f"{column}_region", region)]
    rack = shard = None
    for i, racks in enumerate(topology.regions):
        here = F.col(f"`{column}_region`") == i
        inner = _least(key, [(f"{i}.{j}", weights[i][j], F.lit(j)) for j in range(len(racks))])
        rack = F.when(here, inner) if rack is None else rack.when(here, inner)
        for j, shards in enumerate(racks):
            there = here & (F.col(f"`{column}_rack`") == j)
            inner = _least(key, [(f"{i}.{j}.{k}", w, F.lit(number + k)) for k, w in enumerate(shards)])
            shard = F.when(there, inner) if shard is None else shard.when(there, inner)
            number += len(shards)
    return [*steps, (f"{column}_rack", rack), (column, shard)]


def with_shard(df: DataFrame, key: str, topology: Topology, column: str = "shard") -> DataFrame:
    """``df`` with the shard of every row."""
    if column in df.columns:
        raise ValueError(f"the table has a column {column}")
    inner = column
    while {f"{inner}_region", f"{inner}_rack"} & {*df.columns}:
        inner = f"_{inner}"
    steps = shard_of(F.col(key), topology, inner)
    found = df
    for name, value in steps:
        found = found.withColumn(name, value)
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{inner}`").alias(column))


def with_slots(df: DataFrame, key: str, order: list[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, by the MD5 of ``key`` and ``order``, then by these."""
    digest = F.md5(F.concat_ws(":", key_text(F.col(key)), *[F.col(c).cast("string") for c in order]))
    bits = (8 * common.partitions(df.sparkSession) - 1).bit_length()
    own = df.withColumn("_digest", digest).withColumn("_bucket", F.shiftright(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long"), max(0, 32 - bits)).cast("int"))
    counts = own.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.selectExpr(f"`{shard}` as _of", "_bucket as _at", f"coalesce(sum(_n) over (partition by `{shard}` order by _bucket rows between unbounded preceding and 1 preceding), 0) as _before")
    ordered = ", ".join(f"`{c}`" for c in ("_digest", key, *order))
    numbered = own.selectExpr("*", f"row_number() over (partition by `{shard}`, _bucket order by {ordered}) as _nth")
    joined = numbered.join(before, (F.col(shard) == F.col("_of")) & (F.col("_bucket") == F.col("_at")))
    return joined.withColumn(slot, (F.col("_before") + F.col("_nth") - 1).cast("long")).drop("_digest", "_bucket", "_nth", "_of", "_at", "_before")


def shard_documents(docs: DataFrame, topology: Topology | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    topology = topology or Topology.even()
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"),
    )
    placed = with_shard(with_shard(rows, "doc_id", topology), "doc_id", topology.grown(), "grown_shard")
    slotted = with_slots(placed, "doc_id", ["size", "text_crc32"])
    return slotted.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))


def write_shards(docs: DataFrame, path: str, topology: Topology | None = None, key: str = "doc_id") -> None:
    """Write whole rows to one folder for each shard."""
    column = next(c for i in range(len(docs.columns) + 1) if (c := f"shard_{i}" if i else "shard") not in docs.columns)
    with_shard(docs, key, topology or Topology.even(), column).write.partitionBy(column).parquet(path)


def _sql_draw(path: str, weight: float) -> str:
    return f"-ln((cast('0x' || substr(md5(k || ':{path}'), 1, 13) as bigint) + 0.5) / {1 << 52}) / {weight}"


def _sql_least(children: list[tuple[str, float, str]]) -> str:
    """The value of the child with the least draw."""
    if len(children) == 1:
        return children[0][2]
    options = ", ".join(f"{{'d': {_sql_draw(path, weight)}, 'i': {i}}}" for i, (path, weight, _) in enumerate(children))
    return f"[{', '.join(v for _, _, v in children)}][list_min([{options}]).i + 1]"


def _sql_shard(topology: Topology, name: str) -> tuple[str, str, str]:
    """Expressions of region, rack and shard; the later ones read the columns of the former."""
    regions, number, racks, shards = topology.regions, 0, "", ""
    region = _sql_least([(f"{i}", sum(map(sum, r)), f"{i}") for i, r in enumerate(regions)])
    for i, own in enumerate(regions):
        racks += f" when {name}_region = {i} then " + _sql_least([(f"{i}.{j}", sum(x), f"{j}") for j, x in enumerate(own)])
        for j, each in enumerate(own):
            shards += f" when {name}_region = {i} and {name}_rack = {j} then " + _sql_least([(f"{i}.{j}.{k}", w, f"{number + k}") for k, w in enumerate(each)])
            number += len(each)
    return region, f"case{racks} end", f"case{shards} end"


_A, _B = _sql_shard(Topology.even(), "a"), _sql_shard(Topology.even().grown(), "b")
#: DuckDB has no CRC-32: it goes through the bytes of a text with the table of its 256 steps.
SHARDS_SQL = f"""
with steps as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
rows as (select doc_id, coalesce(cast(doc_id as varchar), 'null') as k, cast(coalesce(strlen(text), 0) + 1 as bigint) as size, hex(encode(coalesce(text, ''))) as h from documents),
summed as (
  select doc_id, k, size, xor(4294967295, list_reduce(list_transform(range(0, len(h) // 2), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as bigint), 2) as bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) as text_crc32 from rows, steps),
placed as (
  select *, {_A[2]} as shard, {_B[2]} as grown_shard from (select *, {_A[1]} as a_rack, {_B[1]} as b_rack from (select *, {_A[0]} as a_region, {_B[0]} as b_region from summed)))
select doc_id, size, text_crc32, 'key' as law, cast(shard as int) as shard,
       row_number() over (partition by shard order by md5(concat_ws(':', k, size, text_crc32)), doc_id nulls first, size, text_crc32) - 1 as slot, cast(grown_shard as int) as grown_shard
from placed
"""
