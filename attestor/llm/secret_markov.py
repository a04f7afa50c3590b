"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Base spans are the matches of three patterns (``assign``, ``access``, ``hex``), leftmost and without
overlap within a kind.  The method adds spans of kind ``markov``: runs of MIN_TOKEN or more of ALPHABET
that touch no base span and hold a digit, whose characters a first-order Markov model of random
strings explains better than one of ordinary identifiers, by LEAST_RATIO (natural logarithm) a
character on average.

Both models are counts of pairs of characters in labelled samples: random strings (1) and identifiers
(0).  ``labelled_samples`` makes random ones from SHA-256 digests in several alphabets and takes words
of SAMPLE_DOCS documents (those of least hash of doc_id and text, stored before any pattern touches them) as
ordinary ones, alone and joined to names as programs and paths have them (fooBar, FOO_BAR, foo-bar2, foo/bar).  Only the pair counts, at most
2 * 68 * 68 numbers, reach the driver; the ratios return to the plan as one constant array.

Everything is DataFrame expressions: matches come from ``regexp_extract_all``, what lies between them
from ``split`` by the same pattern, and their lengths give positions in code points.  A text is searched for
a pattern only where it holds what every match holds (a word of ``assign``, ``AKIA``).  Patterns of runs start
at a run's start, so that no run is gone through once for each of its characters.

Defined cases: a null text is empty and has no spans; rows that repeat are scanned each by itself; an
empty table gives an empty result (the models are then trained on random strings alone and nothing is
scanned).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import common

# The patterns as the contract gives them (for access and hex the least length is part
# of the pattern: a run that is too short holds no shorter start that is long enough).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: One of these, in lower case, is in every text with a match of ASSIGN.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]"
MIN_TOKEN = 16
LEAST_RATIO = 2.0
SAMPLE_DOCS, SAMPLE_STRINGS = 2_000, 2_000
SMOOTHING = 0.5
#: Matches of a text that are gathered together.
BLOCK = 128


def matches(text: Column, pattern: str, groups: tuple[int, ...] = (), needed: Column | None = None) -> Column:
    """array<struct<start, end, text, g1, ...>> of all matches, in code points; empty for most texts.

    ``needed`` is true of every text with a match.
    """
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, *groups)]
    names = ["text", *(f"g{g}" for g in groups)]
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), *[c.alias(n) for c, n in zip(found, names, strict=True)])
    kind = "array<struct<start:bigint,end:bigint," + ",".join(f"{n}:string" for n in names) + ">>"

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["gap"])
        end = start + F.coalesce(F.length(row["text"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), *[row[n].alias(n) for n in names]))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(row["text"].isNotNull(), one).otherwise(F.array().cast(kind))).alias("out"))

    none = F.array().cast(kind)

    def block(acc: Column, own: Column) -> Column:
        # A text may hold very many matches: they are gathered BLOCK at a time, not one by one.
        done = F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], d["out"]).alias("out")))[0]

    first = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    blocks = F.transform(F.array(rows), lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int")), lambda b: F.slice(r, b * BLOCK + 1, BLOCK)))[0]
    present = text.rlike(pattern) if needed is None else needed & text.rlike(pattern)
    return F.when(present, F.aggregate(blocks, first, block, lambda acc: acc["out"])).otherwise(none)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> list[tuple[str, Column]]:
    """The spans of each base kind: array<struct<start, kind, end>>."""
    lowered = F.lower(text)
    worded = reduce(Column.__or__, (F.contains(lowered, F.lit(w)) for w in ASSIGN_WORDS))
    assign = F.filter(matches(text, ASSIGN, (2,), worded), lambda m: F.length(m["g2"]) >= ASSIGN_LEAST)
    access = matches(text, ACCESS, needed=F.contains(text, F.lit("AKIA")))
    return [("assign", _spans(assign, 0)), ("access", _spans(access, 1)), ("hex", _spans(matches(text, HEX), 2))]


def rendered(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sampled_texts(docs: DataFrame, most_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``most_docs`` distinct texts at most, written to the shared folder; only hashes are sorted and joined."""
    rows = docs.select(F.xxhash64("doc_id").alias("a"), F.xxhash64(common.text_of()).alias("b"), common.text_of().alias("text"))
    chosen = rows.select("a", "b").orderBy("a", "b").limit(most_docs)
    found = rows.join(F.broadcast(chosen), ["a", "b"], "left_semi")  # most_docs rows of two numbers
    return common.stored(found.groupBy("a", "b").agg(F.first("text").alias("text")).select("text"), "sampled-texts")


def labelled_samples(docs: DataFrame, most_docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(token, label, n): random strings are 1, ordinary identifiers 0; n times each."""
    spark: SparkSession = docs.sparkSession
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    seeds = spark.range(strings).select(F.explode(F.array(
        F.base64(digest), F.lower(F.hex(digest)), F.upper(F.translate(F.base64(digest), "+/=", "")),
        F.lower(F.translate(F.base64(digest), "+/=", "")), F.translate(F.base64(digest), "+/", "-_"),
    )).alias("token"), F.lit(1).alias("label"), F.lit(1).cast("long").alias("n"))
    plain = F.filter(F.regexp_extract_all("text", F.lit(TOKEN + "{2,}"), F.lit(0)), lambda w: ~w.rlike(f"{HEX}|{ACCESS}"))
    words = sampled_texts(docs, most_docs).select(F.array_distinct(plain).alias("w"))
    both = F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    pairs = words.select(F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    a, b, number = F.lower("a"), F.lower("b"), F.pmod(F.xxhash64("a"), F.lit(100)).cast("string")
    names = pairs.select(F.explode(F.array(
        F.col("a"), F.concat(a, F.initcap(b), number), F.concat(F.initcap(a), F.initcap(b)), F.concat(F.upper(a), F.lit("_"), F.upper(b)),
        F.concat(a, F.lit("_"), b, F.lit("_"), number), F.concat(a, F.lit("-"), b, number), F.concat(a, F.lit("/"), b, F.lit("="), number),
    )).alias("token"), F.lit(0).alias("label"), "n")
    return seeds.unionAll(names)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters (a row of ``len(ALPHABET) + 1`` for each first one; 0: other)."""
    width = len(ALPHABET) + 1
    chars = F.split("token", "")
    coded = samples.filter(F.length("token") >= 2).select("label", "n", F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)).alias("c"))
    steps = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * width + b)
    counted = coded.select("label", "n", F.explode(steps).alias("pair")).groupBy("label", "pair").agg(F.sum("n").alias("n"))
    counts = [[SMOOTHING] * (width * width) for _ in range(2)]
    for label, pair, n in counted.collect():  # 2 * width * width rows at most
        counts[label][pair] += n
    ratios = []
    for a in range(width):
        rows = [c[a * width : (a + 1) * width] for c in counts]
        totals = [sum(r) for r in rows]
        ratios += [math.log(p / totals[1]) - math.log(q / totals[0]) for q, p in zip(*rows, strict=True)]
    return ratios


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token, a pair of characters on average."""
    width = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.get(table, a * width + b))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.lit(1), F.length(token) - 1)


def markov_spans(text: Column, base: Column, ratios: list[float], least: float = LEAST_RATIO) -> Column:
    """Runs outside ``base`` that the model of random strings explains better."""
    runs = F.filter(matches(text, f"(?<!{TOKEN}){TOKEN}{{{MIN_TOKEN},}}"), lambda m: m["text"].rlike("[0-9]"))
    apart = F.filter(runs, lambda m: ~F.exists(base, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"])))
    return _spans(F.filter(apart, lambda m: mean_ratio(m["text"], ratios) >= least), 3)


def scan(docs: DataFrame, ratios: list[float] | None = None, least: float = LEAST_RATIO) -> DataFrame:
    """One row per document with its spans: doc_id, assign, access, hex, markov (arrays of start, kind, end)."""
    ratios = train(labelled_samples(docs)) if ratios is None else ratios
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    found = rows.select("*", *[c.alias(n) for n, c in base_spans(F.col("text"))])
    extra = markov_spans(F.col("text"), F.concat("assign", "access", "hex"), ratios, least)
    return found.select("doc_id", "assign", "access", "hex", extra.alias("markov"))


def report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of each document of ``scan``."""
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(rendered(base), 256).alias("base_sha256"),
        rendered(F.concat(base, F.col("markov"))).alias("spans"), F.size("markov").cast("long").alias("n_markov"),
    )
