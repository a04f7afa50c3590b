"""Passage artifacts, document files and small metadata: validated on reading, published as a whole."""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.retrieval import norm

DOCUMENT_SCHEMA = "id string, title string, source_url string, license string, kind string, text string, attribution struct<authors array<string>, publication_date string, doi string, license_url string, copyright string, changes string, source_sha256 string>, paragraph_sources array<struct<section string, locator string>>"
GRADE_SCHEMA = "item_id string, verdict string, notes string"


def canonical_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys and default separators."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def encoded(value: object) -> bytes:
    """JSON with two blanks of indent and a newline, keys as they are; its digest differs from the canonical one."""
    return (json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents, by a fixed schema; malformed files fail."""
    return spark.read.schema(DOCUMENT_SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(path)


def raw_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    """Grades as CSV with a header (a byte-order mark is skipped): item_id, verdict, notes."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns]).select(*[x.split()[0] for x in GRADE_SCHEMA.split(", ")])


def grade_faults(grades: DataFrame, expected: DataFrame) -> DataFrame:
    """What is wrong with grades: unknown verdicts, missing notes, repeated, missing or unknown items."""
    bad = grades.select("item_id", F.when(~F.col("verdict").isin("PASS", "FAIL", "UNCERTAIN") | F.col("verdict").isNull(), "verdict").when(F.coalesce(F.trim("notes"), F.lit("")) == "", "notes").alias("fault"))
    counts = grades.groupBy("item_id").count().filter("count > 1").select("item_id", F.lit("repeated").alias("fault"))
    missing = expected.select("item_id").join(grades, "item_id", "left_anti").select("item_id", F.lit("missing").alias("fault"))
    unknown = grades.join(expected, "item_id", "left_anti").select("item_id", F.lit("unknown").alias("fault"))
    return bad.filter("fault is not null").unionAll(counts).unionAll(missing).unionAll(unknown)


def _umask() -> int:
    mask = os.umask(0)
    os.umask(mask)
    return mask


def write_text(path: str, text: str) -> None:
    """Replace a small file as a whole: a new file beside it, flushed, then renamed over it, mode kept."""
    target = Path(path)
    handle, temporary = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(temporary, target.stat().st_mode & 0o777 if target.exists() else 0o666 & ~_umask())
        os.replace(temporary, target)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise
    folder = os.open(target.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def publish(df: DataFrame, path: str) -> None:
    """Write a table as a new version under ``path`` and point to it by renaming one small file over the old pointer.

    A reader sees the old version or the new one at any moment; a failure leaves the old one.  The version before
    is kept for readers that have begun, older ones are deleted.
    """
    spark = df.sparkSession
    files, folder = _files(spark, path)
    before = _pointer(spark, path)
    name = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged, pointer = jpath(f"{path}/_{name}"), jpath(f"{path}/CURRENT")
    out = files.create(staged, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(staged), files.makeQualified(pointer), overwrite)
    for status in files.listStatus(folder):
        old = status.getPath().getName()
        if old.startswith("version-") and old not in (name, before):
            files.delete(status.getPath(), True)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _pointer(spark: SparkSession, path: str) -> str | None:
    files, target = _files(spark, f"{path}/CURRENT")
    return spark.read.text(f"{path}/CURRENT").head()[0] if files.exists(target) else None


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    if (name := _pointer(spark, path)) is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{name}")


def load_passages(spark: SparkSession, path: str, source: DataFrame | None = None, max_words: int = 180, separator: str = "\n\n") -> DataFrame:
    """A published table of passages, validated; with ``source`` its documents are chunked again and must give the same rows."""
    from attestor.operators import contracts, passages

    rows = published(spark, path)
    contracts.require_none(passages.duplicates(rows, "passage_id"))
    if source is not None:
        again = passages.chunk(source, max_words, separator, "id").select("passage_id", "text")
        if not same_rows(rows.select("passage_id", "text"), again):
            raise ValueError("the passages are not those of the source")
    return rows


def vector_faults(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """One row: what would make a table of vectors invalid, as counts."""
    sizes = vectors.select(id_, F.size(vector).alias("n"), norm(F.col(vector)).alias("norm"), F.exists(vector, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf"))).alias("odd"))
    return sizes.agg(
        F.count("*").alias("vectors"), (F.count("*") - F.count_distinct(id_)).alias("repeated_ids"), F.count_distinct("n").alias("widths"),
        F.count_if("odd").alias("not_finite"), F.count_if(F.abs(F.col("norm") - 1) > 1e-4 + 1e-5).alias("not_unit"),
    )


def unit(vector: Column) -> Column:
    """The vector divided by its length; a vector of zeros stays."""
    length = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"), F.sqrt)
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_bundle(df: DataFrame, path: str) -> None:
    """Evidence as gzip-compressed JSON lines; an existing folder is never overwritten."""
    df.write.mode("errorifexists").option("compression", "gzip").json(path)


def artifact_faults(artifact: dict) -> list[str]:
    """What is wrong with an artifact's metadata: schema version, hashes, and, with vectors, their shape and checksum.

    ``artifact``: schema_version, source_sha256, passage_ids, and for version 2 embeddings (encoding, passage_ids, vectors, vectors_sha256).
    """
    faults, ids = [], artifact.get("passage_ids", [])
    if artifact.get("schema_version") not in (1, 2):
        faults.append("schema_version")
    if not re.fullmatch("[a-f0-9]{64}", artifact.get("source_sha256") or ""):
        faults.append("source_sha256")
    if len(set(ids)) != len(ids):
        faults.append("passage_ids")
    embeddings = artifact.get("embeddings")
    if (embeddings is not None) != (artifact.get("schema_version") == 2):
        faults.append("embeddings")
    elif embeddings is not None:
        vectors = embeddings["vectors"]
        if embeddings["passage_ids"] != ids or len(vectors) != len(ids) or len({len(v) for v in vectors}) > 1:
            faults.append("shape")
        elif any(not math.isfinite(x) for v in vectors for x in v) or any(abs(math.sqrt(math.fsum(x * x for x in v)) - 1) > 1.1e-4 for v in vectors):
            faults.append("norm")
        if embeddings["vectors_sha256"] != canonical_hash(vectors):
            faults.append("vectors_sha256")
    return faults


def passage_identity(source_sha256: str, chunking: dict, passages: DataFrame, order: list[str]) -> str:
    """A hash of corpus, chunking and ordered passages, whatever the vectors; passages pass one by one."""
    digest = hashlib.sha256(canonical_hash({"source": source_sha256, "chunking": chunking}).encode())
    for row in passages.orderBy(*order).select("passage_id", "text").toLocalIterator():
        digest.update(canonical_hash([row.passage_id, row.text]).encode())
    return digest.hexdigest()


def write_new(path: str, text: str) -> None:
    """Write a report; one that exists is never overwritten."""
    with open(path, "x", encoding="utf-8") as out:
        out.write(text)


def write_evidence(path: str, runs: list[dict], reviews: list[dict]) -> dict:
    """Runs and reviews as one gzip file whose bytes depend on them alone; gives the manifest that vouches for it."""
    data = gzip.compress(json.dumps({"runs": runs, "reviews": reviews}, sort_keys=True, ensure_ascii=False, allow_nan=False).encode(), mtime=0)
    with open(path, "xb") as out:
        out.write(data)
    return {"archive_sha256": hashlib.sha256(data).hexdigest(), "runs": [canonical_hash(r) for r in runs], "reviews": [canonical_hash(r) for r in reviews]}


def read_evidence(path: str, manifest: dict, replay: Callable[[dict], list] | None = None) -> dict:
    """Runs and reviews of a file that its manifest vouches for; ``replay`` must give a run's recorded scores again."""
    data = Path(path).read_bytes()
    if hashlib.sha256(data).hexdigest() != manifest["archive_sha256"]:
        raise ValueError("the archive has another checksum")
    bundle = json.loads(gzip.decompress(data))
    for kind in ("runs", "reviews"):
        if [canonical_hash(x) for x in bundle[kind]] != manifest[kind]:
            raise ValueError(f"{kind} have other checksums")
    for run in bundle["runs"] if replay else []:
        if replay(run) != run["scores"]:
            raise ValueError("scores differ when they are made again")
    return bundle


DATASET_SCHEMA = (
    "schema_version int, id string, version string, split string, material string, status string, corpus_sha256 string, notes string, source_versions array<struct<source_id string, source_sha256 string, doi string, "
    "publication_date string>>, cases array<struct<id string, question string, category string, query_style string, expected_source_ids array<string>, references array<struct<source_id string, passage_id string, "
    "paragraph int, page int, source_section string, source_locator string>>, required_claims array<string>, required_qualifications array<string>, forbidden_claims array<string>, expected_abstention boolean, "
    "review_status string, reviewer string, review_date date>>"
)


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dataset, cases, source versions) of a dataset's JSON file, by a fixed schema, checked by its contracts."""
    from attestor.operators import contracts

    whole = spark.read.schema(DATASET_SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(path)
    cases = whole.select(F.col("id").alias("dataset"), F.explode("cases").alias("c")).select("dataset", "c.*")
    versions = whole.select(F.col("id").alias("dataset"), F.explode("source_versions").alias("v")).select("dataset", "v.*")
    datasets = whole.drop("cases", "source_versions")
    contracts.require_none(contracts.case_faults(cases))
    contracts.require_none(contracts.dataset_faults(datasets, cases, versions))
    return datasets, cases, versions
