"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of DIMENSIONS; white space and all else between
letters is one more symbol.  An n-gram's vector binds (multiplies) its letters' vectors, the first
permuted n - 1 times, the second n - 2 times and so on.  A profile bundles (adds) the vectors of all
n-grams of a text, or of all training texts of a language: the language's prototype.  A text gets the
language whose prototype has the greatest cosine with its profile.

Every letter of every script has a vector of its own, made from its code point by a hash, so scripts never
share one.  A profile is the product of the counts of distinct n-grams with their vectors, so the work for a
batch of texts is one matrix product.  Training sums the prototypes of the tasks dimension by dimension; only
the sums (MOST_LANGUAGES x DIMENSIONS at most: of more values of lang the most frequent are learned) reach
the driver.

``keep_identified`` also rejects texts in no known language: those with JUDGED different n-grams or more whose best
cosine is under LEAST_COSINE.  Cosines of shorter texts, and of texts of a few words many times over, scatter too
widely to judge them.  On held-out documents of the test tables the least cosine of a judged text was 0.33;
random letters, also cut into words, and other scripts stay at 0.16 or less.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no language
learned every text is ``und``; of languages with equal cosine the first in order of name is taken;
rows that repeat are scored each by itself; columns of the table named like those that are added
(``lang_pred``, ``score``) are replaced by ``predict`` unless ``keep`` says which columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm import common

DIMENSIONS, GRAM, SEED = 1024, 3, 20_011
UNKNOWN, MOST_LANGUAGES = "und", 1000
#: Different n-grams from which a text is judged, and the cosine that it then needs at least.
JUDGED, LEAST_COSINE = 100, 0.2
#: Characters, texts and kinds of n-grams that are handled at once; codes that are counted in an array.
PIECE_CHARS, BATCH_TEXTS, KINDS, DENSE = 1 << 20, 128, 1 << 13, 1 << 18


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vector of +1 and -1 of each code point (0: between letters)."""
    word = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (points.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(SEED))[:, None] + word
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return (2 * np.unpackbits(h.view(np.uint8), axis=1).astype(np.int8) - 1).reshape(len(points), DIMENSIONS)


@common.kept
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """Code points of a text's letters in lower case, with one 0 between words and at both ends."""
    pieces = []
    for i in range(0, len(text), PIECE_CHARS):
        points = np.frombuffer(text[i : i + PIECE_CHARS].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        pieces.append(np.where(letters()[points], points, 0).astype(np.int32))
    found = np.concatenate((np.zeros(1, np.int32), *pieces, np.zeros(1, np.int32)))
    return found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]


@common.kept
def _numbers() -> np.ndarray:
    return np.zeros(0x110000, np.int64)


class Grams:
    """The n-grams of some texts: codes in base len(alphabet)."""

    def __init__(self, texts: list[str]):
        own = [symbols(t) for t in texts]
        present = np.zeros(0x110000, bool)
        for s in own:
            present[s] = True
        present[0] = True
        self.alphabet = np.flatnonzero(present)
        self.base = len(self.alphabet)
        numbers = _numbers()
        numbers[self.alphabet] = np.arange(self.base)
        each = []
        for s in own:
            local, n = numbers[s], max(0, len(s) - GRAM + 1)
            each.append(sum(local[i : i + n] * self.base ** (GRAM - 1 - i) for i in range(GRAM)))
        self.sizes = np.array([len(g) for g in each], np.int64)  # none if the text has no letter
        joined = np.concatenate([np.zeros(0, np.int64), *each])
        if self.base**GRAM <= DENSE:
            seen = np.bincount(joined, minlength=self.base**GRAM) > 0
            self.kinds, self.place = np.flatnonzero(seen), (np.cumsum(seen) - 1)[joined]
        else:
            self.kinds, self.place = np.unique(joined, return_inverse=True)
        self.letter_vectors = letter_vectors(self.alphabet)

    def vectors(self, first: int, last: int) -> np.ndarray:
        """The bound vectors of the kinds of n-grams from place ``first`` to ``last`` - 1."""
        grams, bound = self.kinds[first:last], None
        for shift in range(GRAM):  # the last letter first, unpermuted
            part = np.roll(self.letter_vectors, shift, axis=1)[grams % self.base]
            bound = part if bound is None else bound * part
            grams = grams // self.base
        return bound.astype(np.float32)


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of the texts, and how many different n-grams each has (none without a letter)."""
    grams = Grams(texts)
    row = np.repeat(np.arange(len(texts)), grams.sizes)
    found, kinds = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), np.int64)
    for first in range(0, len(grams.kinds), KINDS):
        some = min(KINDS, len(grams.kinds) - first)
        own = slice(None) if some == len(grams.kinds) else (grams.place >= first) & (grams.place < first + some)
        counts = np.bincount(row[own] * some + grams.place[own] - first, minlength=len(texts) * some)
        counts = counts.reshape(len(texts), some)
        kinds += np.count_nonzero(counts, axis=1)
        found += counts.astype(np.float32) @ grams.vectors(first, first + some)
    return found, kinds


def bundle(texts: list[str]) -> np.ndarray:
    """The bundled vector of all n-grams of some texts."""
    grams = Grams(texts)
    counts, total = np.bincount(grams.place, minlength=len(grams.kinds)).astype(np.float64), np.zeros(DIMENSIONS)
    for first in range(0, len(grams.kinds), KINDS):
        total += counts[first : first + KINDS] @ grams.vectors(first, min(first + KINDS, len(grams.kinds)))
    return total


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("texts", pa.int64()), ("bundle", pa.list_(pa.int64()))])
    sums: dict[str, list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, n, total.astype(np.int64).tolist()) for lang, (n, total) in sums.items()]
        sums.clear()
        return common.one_batch(schema, dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    for batch in common.slices(batches, "text"):
        texts: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            entry = sums.setdefault(lang, [0, np.zeros(DIMENSIONS)])
            entry[0] += len(own)
            entry[1] += bundle(own)
            if len(sums) > MOST_LANGUAGES:  # a table with very many values of lang: never more than these in a task
                yield flush()
    if sums:
        yield flush()


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes of the languages of ``labelled`` (text, lang): unit vectors by name."""
    rows = labelled.filter("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    bundles = common.map_batches(rows, _bundles, "lang string, texts long, bundle array<long>")
    each = bundles.select("lang", "texts", F.posexplode("bundle").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"), F.sum("texts").alias("texts"))
    each = common.stored(each, "bundles")  # read twice, made once
    most = each.filter("d = 0").orderBy(F.desc("texts"), "lang").limit(MOST_LANGUAGES).select("lang")
    vectors: dict[str, np.ndarray] = {}
    for lang, d, x in each.join(F.broadcast(most), "lang", "left_semi").select("lang", "d", "x").collect():  # MOST_LANGUAGES x DIMENSIONS numbers
        vectors.setdefault(lang, np.zeros(DIMENSIONS))[d] = x
    return {k: vectors[k] / np.linalg.norm(vectors[k]) for k in sorted(vectors) if vectors[k].any()}


def scores(texts: list[str], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best prototype (-1: none) and its cosine, 0 at least, of each text, and how many different n-grams it has."""
    best, score, sizes = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for first in range(0, len(texts), BATCH_TEXTS):
        some = slice(first, first + BATCH_TEXTS)
        found, sizes[some] = profiles(texts[some])
        if len(prototypes):
            norms = np.sqrt((found.astype(np.float64) ** 2).sum(1))
            cosines = found.astype(np.float64) @ prototypes.T / np.where(norms > 0, norms, 1)[:, None]
            best[some] = np.where(sizes[some] > 0, cosines.round(12).argmax(1), -1)
            score[some] = np.where(sizes[some] > 0, cosines.max(1).clip(0, 1), 0)
    return best, score, sizes


def _predict(names: list[str], prototypes: np.ndarray, columns: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "_text"):
        best, score, sizes = scores([t or "" for t in batch.column(0).to_pylist()], prototypes)
        langs = pa.array([names[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string())
        kept = [batch.column(i + 1) for i in range(len(columns))]
        yield pa.RecordBatch.from_arrays([*kept, langs, pa.array(score, pa.float64()), pa.array(sizes)], names=[*columns, "lang_pred", "score", "kinds"])


def _with_prediction(source: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``source`` (its first column is the text, _text) without the text, with lang_pred, score, kinds."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("kinds", T.LongType())]
    vectors = np.array(list(prototypes.values())).reshape(len(prototypes), DIMENSIONS)
    return common.map_batches(source, partial(_predict, list(prototypes), vectors, tuple(source.columns[1:])), T.StructType([*source.schema.fields[1:], *added]))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: DataFrame | None = None) -> DataFrame:
    """``docs`` (columns of ``keep``; a column text) with lang_pred and score."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep.columns
    source = docs.select(F.col("text").cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    return _with_prediction(source, prototypes).select("_row.*", "lang_pred", "score")


def fold(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null doc_id counts as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def identify(docs: DataFrame) -> DataFrame:
    """Held-out prediction: one row per document: doc_id, held_out, lang_pred, score."""
    prototypes = train(docs.filter(fold(5) != 0).select("text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(5) == 0).alias("held_out"), "text")
    return predict(rows, prototypes, rows.select("doc_id", "held_out"))


def known(least: float = LEAST_COSINE, judged: int = JUDGED) -> Column:
    """Whether a text's language is known: it has letters, and if it is long enough to be judged, a cosine of ``least``."""
    return (F.col("lang_pred") != UNKNOWN) & ((F.col("kinds") < judged) | (F.col("score") >= least))


def keep_identified(docs: DataFrame, least: float = LEAST_COSINE, judged: int = JUDGED) -> DataFrame:
    """The documents whose language is known; columns as they were."""
    prototypes = train(docs.select("text", "lang"))
    source = docs.select(F.col("text").cast("string").alias("_text"), common.whole_row(docs).alias("_row"))
    return _with_prediction(source, prototypes).filter(known(least, judged)).select("_row.*")
