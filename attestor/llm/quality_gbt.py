"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (no content words) are computed where the documents are read.  The trees are
fitted on the driver from at most TRAIN_ROWS labelled rows, those of least hash of doc_id; features are
cut into BINS bins at quantiles, and each level of a tree chooses its splits from histograms of
gradients.  Fitted trees are flattened into arrays (feature, threshold, left, right, value), which
numpy follows for all rows and trees at once.

Defined cases: a null text has the statistics of an empty one; labels that are null are left out, of
several labels of a doc_id the mean counts (1 from 0.5 on); with no label the score is 0.5
everywhere, with one kind of label near that kind; rows that repeat are scored each by itself; of rows
that repeat a labelled doc_id the least vector of statistics is trained on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import common
from attestor.llm.language_hd import fold

TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAF_WEIGHT, SHRINK = 64, 80, 4, 0.1, 3.0, 1.0

FEATURES = (
    "chars", "words", "lines", "word_mean", "word_deviation", "line_mean", "letters", "digits", "spaces", "upper",
    "pauses", "symbols", "not_ascii", "distinct_words", "top_word", "repeated_lines", "repeated_triples",
    "short_words", "symbol_ends", "byte_entropy", "shouted_words",
)

_KIND = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (_b >= 128 or _c.isalpha(), 48 <= _b < 58, _c in " \t\n\r\v\f", 65 <= _b < 91, _c in ".,;:?'\"-()", _b < 128 and not _c.isalnum() and not _c.isspace() and _c not in ".,;:?'\"-()", _b >= 128)


def statistics(text: str) -> list[float]:
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(1, int(octets.sum()))
    letters, digits, spaces, upper, pauses, symbols, high = octets @ _KIND
    share = octets[octets > 0] / n
    words = text.split()
    count = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x]
    counted = Counter(words)
    top = max(counted.values(), default=0)
    triples = len(words) - 2
    repeated = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples > 0 else 0.0
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(len(text) / max(1, len(lines))),
        letters / n, digits / n, spaces / n, upper / max(1.0, letters), pauses / n, symbols / n, high / n, len(counted) / count, top / count,
        1 - len(set(lines)) / max(1, len(lines)), repeated, (lengths <= 2).mean(), sum(not w[-1].isalnum() for w in words) / count,
        float(-(share * np.log2(share)).sum()), sum(map(str.isupper, words)) / count,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        found = pa.array([statistics(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "label", "x"])


@dataclass
class Trees:
    """All trees in flat arrays; leaves lead to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost TREES trees on logistic loss."""
    n = len(y)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    arrays: dict[str, list] = {k: [] for k in ("roots", "feature", "threshold", "left", "right", "value")}
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        margin = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            margin += _grow(binned, edges, p - y, p * (1 - p), arrays)
    kinds = {"roots": np.int64, "feature": np.int64, "threshold": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
    return Trees(base, **{k: np.array(v, kinds[k]) for k, v in arrays.items()})


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, out: dict[str, list]) -> np.ndarray:
    """One tree, appended to ``out`` level by level; gives what it adds to each row."""
    n, width = binned.shape
    first = len(out["feature"])
    out["roots"].append(first)

    def leaf() -> int:
        at = len(out["feature"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", 0.0)):
            out[k].append(v)
        return at

    leaf()
    level, place = [first], np.zeros(n, np.int64)  # place: each row's number in the level, -1 when done
    node = np.full(n, first)
    for depth in range(DEPTH + 1):
        live = place >= 0
        slots = len(level)
        cell = (place[live, None] * width + np.arange(width)) * BINS + binned[live]
        shape = (slots, width, BINS)
        hist_g = np.bincount(cell.ravel(), np.repeat(g[live], width), slots * width * BINS).reshape(shape).cumsum(2)
        hist_h = np.bincount(cell.ravel(), np.repeat(h[live], width), slots * width * BINS).reshape(shape).cumsum(2)
        total_g, total_h = hist_g[:, :1, -1:], hist_h[:, :1, -1:]
        for s, at in enumerate(level):
            out["value"][at] = float(-RATE * total_g[s, 0, 0] / (total_h[s, 0, 0] + SHRINK))
        if depth == DEPTH:
            break
        rest_g, rest_h = total_g - hist_g, total_h - hist_h
        gain = hist_g**2 / (hist_h + SHRINK) + rest_g**2 / (rest_h + SHRINK) - total_g**2 / (total_h + SHRINK)
        gain = np.where((hist_h >= LEAF_WEIGHT) & (rest_h >= LEAF_WEIGHT), gain, 0.0).reshape(slots, -1)
        choice = gain.argmax(1)
        following, moved = [], np.full(n, -1)
        for s, at in enumerate(level):
            f, b = divmod(int(choice[s]), BINS)
            if gain[s, choice[s]] <= 1e-9 or b >= len(edges[f]):
                continue
            low, high = leaf(), leaf()
            out["feature"][at], out["threshold"][at], out["left"][at], out["right"][at], out["value"][at] = f, float(edges[f][b]), low, high, 0.0
            own = place == s
            left = own & (binned[:, f] <= b)
            node[left], node[own & ~left] = low, high
            moved[left], moved[own & ~left] = len(following), len(following) + 1
            following += [low, high]
        if not following:
            break
        level, place = following, moved
    return np.array(out["value"])[node]


def _scored(trees: Trees, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        found = trees.score(np.array([statistics(t) for t in batch.column(2).to_pylist()]).reshape(batch.num_rows, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on the labelled documents of least hash, ``most_rows`` at most."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))  # most_rows rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(chosen, "doc_id")
    found = common.map_batches(rows.select("doc_id", "label", "text"), _statistics, "doc_id long, label double, x array<double>")
    samples = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect()  # most_rows at most
    samples.sort(key=lambda r: r.doc_id)
    x = np.array([r.x for r in samples]).reshape(len(samples), len(FEATURES))
    return fit(x, np.array([r.label for r in samples]))


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(3) == 1).alias("held_out"), common.text_of().alias("text"))
    return common.map_batches(rows, partial(_scored, trees), "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents from trees fitted on the labelled rows of the other two folds."""
    return predict(docs, train(docs, labels.filter(fold(3) != 1)))
