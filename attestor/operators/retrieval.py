"""Ranked retrieval for batches of questions: lexical, dense, fused, reranked, diverse."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.functions.shared import discard, stored
from attestor.functions.shipping import map_batches, ship

#: Characters of a short needle by which it meets words.
GRAM = 3
#: Queries that are multiplied at once, with how many vectors.
QUERY_BLOCK, VECTORS = 1024, 1 << 14


def ranked(hits: DataFrame, limit: int, query: str, score: str, order: Sequence[str]) -> DataFrame:
    """The ``limit`` best of each query by score (9 decimals), then artifact order, numbered from 1."""
    by = Window.partitionBy(query).orderBy(F.round(score, 9).desc(), *order)
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def term_counts(rows: DataFrame, keys: Sequence[str], text: str = "text", stop_words: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """How often each row has each token, and each pair of neighbouring tokens."""
    pairs = rows.select(*keys, F.explode(T.term_pairs(F.col(text), stop_words)).alias("p"))
    terms = pairs.select(*keys, F.explode(F.array("p.a", F.concat("p.a", F.lit(" "), "p.b"))).alias("term"))
    return terms.filter("term is not null").groupBy(*keys, "term").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class LexicalIndex:
    """Postings (term, *key, weight), terms (term, df, idf) and norms (*key, norm), as stored tables."""

    postings: DataFrame
    terms: DataFrame
    norms: DataFrame
    key: tuple[str, ...]
    stop_words: tuple[str, ...]

    def search(self, questions: DataFrame, query: str) -> DataFrame:
        """Cosine for every question (``query``, text) and passage that share a term: (query, *key, score).

        Only postings of the questions' terms are read on; terms that no passage has are dropped.  A very
        common term is a skewed key of an equi-join, which adaptive execution splits.
        """
        asked = term_counts(questions, [query], stop_words=self.stop_words)
        wanted = asked.join(self.terms, "term").select(query, "term", (F.col("tf") * F.col("idf")).alias("wq"))
        lengths = wanted.groupBy(query).agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("normq"))
        unit = wanted.join(lengths, query).select(query, "term", (F.col("wq") / F.col("normq")).alias("wq"))
        dots = self.postings.join(unit, "term").groupBy(query, *self.key).agg(F.sum(F.col("weight") * F.col("wq")).alias("dot"))
        return dots.join(self.norms, list(self.key)).select(query, *self.key, (F.col("dot") / F.col("norm")).alias("score")).filter("score > 0")


def lexical_index(passages: DataFrame, key: Sequence[str], stop_words: Sequence[str] = T.STOP_WORDS) -> LexicalIndex:
    """Build an inverted index of TF-IDF weights once, with smooth inverse frequency ln((1 + n) / (1 + df)) + 1.

    Passages are dealt by key before their terms are made, so counting a passage's terms needs no further shuffle;
    the counts are stored once and meet the terms' frequencies by an equi-join.
    """
    n = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = passages.select(*key, "text").repartition(n, *key)
    own = stored(term_counts(dealt, key, stop_words=stop_words), "counts")
    total = passages.agg(F.count("*").alias("_n"))
    idf = (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf")
    terms = stored(own.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("term", "df", idf), "terms")  # total: one row
    postings = stored(own.join(terms, "term").select("term", *key, (F.col("tf") * F.col("idf")).alias("weight")), "postings")
    norms = stored(postings.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")), "norms")
    discard(own)
    return LexicalIndex(postings, terms, norms, tuple(key), tuple(stop_words))


def tfidf(passages: DataFrame, questions: DataFrame, key: Sequence[str], query: str, stop_words: Sequence[str] = T.STOP_WORDS) -> DataFrame:
    """Cosine of TF-IDF vectors for every question and passage that share a term, by an index built for this call."""
    return lexical_index(passages, key, stop_words).search(questions, query)


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(paths: list[str], limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every query of the files the best of some VECTORS at once, ties included: their order is settled later."""
    held: list[pa.RecordBatch] = []

    def scored() -> Iterator[pa.RecordBatch]:
        names, vectors = np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([_rows(b.column(1)) for b in held])
        for path in paths:
            store, inside = fs.FileSystem.from_uri(path)
            with pq.ParquetFile(store.open_input_file(inside)) as file:
                for block in file.iter_batches(QUERY_BLOCK):
                    ids, scores = block.column(0).to_numpy(), np.clip(_rows(block.column(1)) @ vectors.T, -1, 1)
                    if len(names) > limit:
                        bound = -np.partition(-scores, limit - 1, axis=1)[:, limit - 1, None]
                        rows, columns = np.nonzero(scores >= bound - 1e-9)
                    else:
                        rows, columns = np.indices(scores.shape).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(names[columns]), pa.array(scores[rows, columns])], names=["query_id", "vec_id", "score"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= VECTORS:
            yield from scored()
            held = []
    if held:
        yield from scored()


def dense(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Exact top ``limit`` by inner product of (query_id long, vector) and (vec_id long, vector).

    The queries are written once to the shared folder; each task reads them block by block (QUERY_BLOCK) for
    every VECTORS vectors that it holds, and passes on the best.  Vectors are gone through once, and no
    query reaches the driver.  Blank questions have no vector and so no hits.
    """
    asked = stored(queries.select("query_id", "vector").filter("vector is not null"), "queries")
    rows = vectors.select("vec_id", "vector").filter("vector is not null")
    found = map_batches(rows, partial(_best, [str(p) for p in asked.inputFiles()], limit), "query_id long, vec_id long, score double")
    return ranked(found, limit, "query_id", "score", ["vec_id"])


def pooled(tokens: Column, mask: Column, how: str = "mean") -> Column:
    """One unit vector from a model's token vectors (array of arrays) and their mask (array of 0 and 1).

    ``mean`` of the tokens under the mask, the ``first`` token, or the ``last`` one under the mask; a text without a token under
    the mask has a vector of zeros.
    """
    used = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] == 1)
    zeros = F.transform(tokens[0], lambda x: F.lit(0.0))
    if how == "mean":
        total = F.aggregate(used, zeros, lambda acc, t: F.zip_with(acc, t["v"], lambda a, b: a + b.cast("double")))
    elif how in ("first", "last"):
        chosen = tokens[0] if how == "first" else F.try_element_at(used, F.lit(-1))["v"]
        total = F.coalesce(F.transform(chosen, lambda x: x.cast("double")), zeros)
    else:
        raise ValueError("pooling is mean, first or last")
    length = F.aggregate(total, F.lit(0.0), lambda acc, x: acc + x * x, F.sqrt)  # the mean's divisor cancels here
    return F.transform(total, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def reciprocal_rank_fusion(lists: Sequence[tuple[DataFrame, float]], keys: Sequence[str], rrf_k: int = 60) -> DataFrame:
    """Sum of weight / (rrf_k + rank) over ranked lists (each with ``keys`` and rank); lists of weight 0 are left out."""
    parts = [df.select(*keys, (F.lit(weight) / (F.lit(rrf_k) + F.col("rank"))).alias("part")) for df, weight in lists if weight]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(*keys).agg(F.sum("part").alias("score"))


def rerank(pool: DataFrame, scores: DataFrame, keys: Sequence[str], limit: int, query: str, order: Sequence[str]) -> DataFrame:
    """Order a pool by an external score; ties by artifact order."""
    return ranked(pool.drop("score", "rank").join(scores, list(keys)), limit, query, "score", order)


def with_utility(pool: DataFrame, query: str) -> DataFrame:
    """Rank utility 1 - (rank - 1) / n of each candidate."""
    return pool.withColumn("utility", 1 - (F.col("rank") - 1) / F.count("*").over(Window.partitionBy(query)))


def _diverse(limit: int, diversity: float, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rank").reset_index(drop=True)
    utility = 1 - np.arange(len(pdf)) / len(pdf)
    vectors = np.array(pdf["vector"].tolist(), np.float64)
    nearest = np.zeros(len(pdf))
    left, chosen = list(range(len(pdf))), []
    while left and len(chosen) < limit:
        best = max(left, key=lambda i: (round((1 - diversity) * utility[i] - diversity * nearest[i], 12), -i))
        left.remove(best)
        chosen.append(best)
        nearest = np.maximum(nearest, np.clip(vectors @ vectors[best], 0, 1))
    out = pdf.iloc[chosen][["query_id", "candidate_id"]].copy()
    out["rank"] = np.arange(1, len(out) + 1)
    return out


def diverse(pool: DataFrame, limit: int, diversity: float) -> DataFrame:
    """Greedy choice of (1 - d) * rank utility - d * greatest similarity to what is chosen.

    ``pool``: query_id, candidate_id, rank, vector; a bounded pool (some tens of candidates) a query.
    """
    ship(pool.sparkSession)
    return pool.select("query_id", "candidate_id", "rank", "vector").groupBy("query_id").applyInPandas(lambda pdf: _diverse(limit, diversity, pdf), "query_id long, candidate_id long, rank int")


def containing(texts: DataFrame, needles: DataFrame, id_: str, needle_id: str) -> DataFrame:
    """Pairs (id, needle_id) where the text contains the needle's text; ids of both are unique.

    A needle meets texts by a key that any text with it has too: an inner word (the longest; it stands between
    white space), for a needle of one or two words the first GRAM characters of the longer word (part of some word
    of the text), for a blank needle its first character, for an empty one nothing.  Only ids and keys are
    exploded and joined; texts are compared once a pair of ids is known.
    """
    own = needles.select(needle_id, F.col("text").alias("needle"), T.words(F.col("text")).alias("w")).filter("needle is not null")
    longest = lambda words: F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"]
    size = F.size("w")
    inner, short = F.slice("w", 2, F.greatest(size - 2, F.lit(1))), F.substring(longest(F.col("w")), 1, GRAM)
    key = F.when(size > 2, longest(inner)).when(size > 0, short).otherwise(F.substring("needle", 1, 1))
    kind = F.when(size > 2, "word").when(size > 0, "gram").otherwise("blank")
    keyed = own.select(needle_id, kind.alias("kind"), key.alias("key"))
    words = texts.select(id_, F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    grams = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.array(*[F.substring(F.col("word"), i, F.lit(n)) for n in range(1, GRAM + 1)])))))
    sides = {
        "word": words.select(id_, F.col("word").alias("key")),
        "gram": words.select(id_, grams.alias("key")),
        "blank": texts.select(id_, F.explode(F.array_union(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(r"(?U)[\s\x1C-\x1F]"), F.lit(0)))).alias("key")),
    }
    pairs = reduce(DataFrame.unionAll, [side.join(keyed.filter(F.col("kind") == k).drop("kind"), "key").select(id_, needle_id) for k, side in sides.items()]).distinct()
    met = texts.select(id_, "text").join(pairs, id_).join(own.select(needle_id, "needle"), needle_id)
    return met.filter(F.contains("text", "needle")).select(id_, needle_id)
