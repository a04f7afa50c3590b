"""Perspective rotation of multi-party dialogues for chat training.

For every participant of a conversation (every speaker but ``system``) the dialogue is rendered with
that speaker as the assistant and all others as named users, with a mask of the spans to train on: the
speaker's own messages and their end marks.

    <|assistant|>\\ntext<|end|>\\n        the speaker; text and end mark are in the mask
    <|user name=NAME|>\\ntext<|end|>\\n   other speakers
    <|system|>\\ntext<|end|>\\n           the system message

No message can forge a marker: ``<|`` in a text is written ``<||`` (a marker never has a second bar, so
reading ``<||`` as ``<|`` gives the text back), and in a name ``% < | >`` and line ends are percent-encoded.

A dialogue is rendered in parts of PART messages at most, so that a conversation of any length, even one
that holds a third of all rows, is many rows of bounded size.  A system message is rendered once, at its
place; later parts don't repeat it.  Messages are numbered by ranges of their order, whose offsets come
from counts, and participants meet the parts in lists of NAMES, through ``common.attach``: no step gathers
a conversation in one task.

Defined cases: a null speaker is named ``unknown``, a null text is empty; messages are ordered by turn
(null first), speaker and MD5 of the text; rows that repeat are messages of their own; rows with a null conv_id are
one conversation; a conversation without participants, and an empty table, give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm import common

PART, NAMES = 64, 64
END = "<|end|>"
#: What stands for the characters that a name must not hold.
ENCODED = {"%": "%25", "<": "%3C", "|": "%7C", ">": "%3E", "\n": "%0A", "\r": "%0D"}


def escaped_text(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def escaped_name(name: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ENCODED.items(), name)


def _speaker(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("unknown"))


def _key() -> Column:
    """The conversation as a text that is never null."""
    return F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("key")


def numbered(messages: DataFrame, speaker: str = "role") -> DataFrame:
    """(key, conv_id, speaker, text, position): messages with their place from 0 in the conversation."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = messages.select(
        _key(), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _speaker(speaker).alias("speaker"), text.alias("text"),
        F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["key", F.col("turn").asc_nulls_first(), "speaker", "digest", "row"]
    dealt = rows.repartitionByRange(common.partitions(messages.sparkSession), *order).withColumn("range", F.spark_partition_id())
    dealt = common.stored(dealt, "messages")  # the ranges must not be drawn twice
    counts = dealt.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = counts.selectExpr("key", "`range`", "coalesce(sum(n) over (partition by key order by `range` rows between unbounded preceding and 1 preceding), 0) as before")
    ordered = dealt.selectExpr("*", "row_number() over (partition by key, `range` order by turn nulls first, speaker, digest) as nth")
    return ordered.join(before, ["key", "range"]).select("key", "conv_id", "speaker", "text", (F.col("before") + F.col("nth") - 1).alias("position"))


def _rendered(perspective: Column, messages: Column) -> Column:
    """struct<text, mask> of one part."""
    kind = "struct<text:string,at:bigint,mask:array<string>>"

    def head(m: Column) -> Column:
        other = F.concat(F.lit("<|user name="), escaped_name(m["speaker"]), F.lit("|>\n"))
        return F.when(m["speaker"] == perspective, "<|assistant|>\n").when(m["speaker"] == "system", "<|system|>\n").otherwise(other)

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(head(m))
        end = start + F.length(m["text"]) + len(END)
        own = F.when(m["speaker"] == perspective, F.array(F.concat_ws(":", start.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(acc["text"], head(m), m["text"], F.lit(END + "\n")).alias("text"), (end + 1).alias("at"), F.concat(acc["mask"], own).alias("mask"))

    first = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("mask")).cast(kind)
    return F.aggregate(messages, first, step)


def rotate(messages: DataFrame, speaker: str = "role", part: int = PART, names: int = NAMES) -> DataFrame:
    """One row per conversation, participant and part: conv_id, perspective, part, n_messages, text, mask (start:end, ...)."""
    rows = numbered(messages, speaker).withColumn("text", escaped_text(F.col("text")))
    parts = rows.groupBy("key", "conv_id", F.floor(F.col("position") / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("position", "speaker", "text"))).alias("messages"))
    people = messages.select(_key(), _speaker(speaker).alias("perspective")).filter("perspective <> 'system'").groupBy("key", "perspective").agg(F.count("*").alias("n"))
    # Participants in lists of about ``names``, by hash: a conversation of very many has many lists.
    counted = people.groupBy("key").agg(F.ceil(F.count("*") / names).cast("int").alias("lists"), F.sum("n").alias("n"))
    dealt = common.attach(people.drop("n"), counted, ["key"], "n", "perspective")
    listed = dealt.groupBy("key", F.pmod(F.xxhash64("perspective"), F.col("lists")).cast("int").alias("list")).agg(F.collect_list("perspective").alias("people"), F.max("n").alias("n"))
    each = common.attach(parts, counted, ["key"], "n", "part").filter("lists is not null").drop("n").withColumn("list", F.explode(F.expr("sequence(0, lists - 1)"))).drop("lists")
    joined = common.attach(each, listed, ["key", "list"], "n", "part").filter("people is not null").withColumn("perspective", F.explode("people"))
    done = joined.select("conv_id", "perspective", "part", F.size("messages").cast("long").alias("n_messages"), _rendered(F.col("perspective"), F.col("messages")).alias("r"))
    return done.select("conv_id", "perspective", "part", "n_messages", F.col("r.text").alias("text"), F.array_join("r.mask", ",").alias("mask"))


def _sql_name(name: str) -> str:
    quoted = {"\n": "chr(10)", "\r": "chr(13)"}
    return reduce(lambda c, pair: f"replace({c}, {quoted.get(pair[0], repr(pair[0]))}, '{pair[1]}')", ENCODED.items(), name)


ROTATE_SQL = f"""
with m as (
  select conv_id, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '<||') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), md5(coalesce(text, ''))) - 1 as position
  from conversations
), p as (select distinct conv_id, coalesce(role, 'unknown') as perspective from conversations where coalesce(role, 'unknown') <> 'system'),
s as (
  select m.conv_id, perspective, position // {PART} as part, position, speaker = perspective as own,
         case when speaker = perspective then '<|assistant|>' when speaker = 'system' then '<|system|>'
              else '<|user name=' || {_sql_name("speaker")} || '|>' end || chr(10) as head, text || '{END}' as body
  from m join p on m.conv_id is not distinct from p.conv_id
), o as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, perspective, part order by position rows between unbounded preceding and 1 preceding), 0) + length(head) as begin
  from s
)
select conv_id, perspective, cast(part as bigint) as part, count(*) as n_messages, string_agg(head || body || chr(10), '' order by position) as text,
       coalesce(string_agg(case when own then cast(begin as bigint) || ':' || cast(begin + length(body) as bigint) end, ',' order by position), '') as mask
from o group by conv_id, perspective, part
"""
