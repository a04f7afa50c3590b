"""Incremental ingest: new document files become passages, each document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from attestor.operators.passages import MAX_WORDS, chunk


def passages_stream(spark: SparkSession, path: str, schema: str, max_words: int = MAX_WORDS, separator: str = "\n\n", id_: str = "document_id") -> DataFrame:
    """Passages of Parquet files as they arrive."""
    return chunk(spark.readStream.schema(schema).parquet(path), max_words, separator, id_)


def resume(new: DataFrame, done: str, id_: str) -> DataFrame:
    """Rows whose id the table at ``done`` lacks: work that was paid for is not repeated."""
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(done)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return new
    return new.join(spark.read.parquet(done).select(id_).distinct(), id_, "left_anti")


def ingest(stream: DataFrame, target: str, checkpoint: str, id_: str = "passage_id") -> StreamingQuery:
    """Append a stream to ``target`` batch by batch; a batch that runs again adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        resume(batch.dropDuplicates([id_]), target, id_).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
