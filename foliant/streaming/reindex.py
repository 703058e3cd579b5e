"""Incremental indexing as a stream of changed documents.

Each micro-batch writes the documents it saw, and their postings, below its own
batch number; a batch that is tried again overwrites itself. Readers keep, for
every document, the rows of its latest batch, so nothing is rewritten while the
stream runs. Stopping and starting again resumes from the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.search import postings

# A deleted document arrives as a row without text.
SCHEMA = "doc_id bigint, seq bigint, text string"


class Paused(Exception):
    """Raised by a caller's ``on_batch`` to stop the stream; what it had not finished is done again when it goes on."""


def index_changes(
    changes: DataFrame, root: str, checkpoint: str, available_now: bool = True, on_batch: Callable[[int], None] | None = None
):
    """Start a query that indexes ``doc_id, seq, text`` rows below ``root``; of a document's rows in a batch the largest ``seq`` counts.

    ``on_batch`` is called with the number of each batch after it is written
    and before the stream takes it as done. If it raises, the stream stops
    there, and the next start from the same checkpoint writes that batch again.
    """
    if "seq" not in changes.columns:
        raise ValueError("changes need a column seq that orders the rows of a document")

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("doc_id").agg(F.max_by("text", "seq").alias("text")).persist()
        try:
            latest.select("doc_id", F.length("text").alias("text_chars")).write.mode("overwrite").parquet(
                f"{root}/docs/batch={number}")
            postings(latest.filter(F.col("text").isNotNull())).write.mode("overwrite").parquet(
                f"{root}/postings/batch={number}")
        finally:
            latest.unpersist()
        if on_batch is not None:
            on_batch(number)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_until_paused(query) -> bool:
    """Wait for a stream to end; false if ``on_batch`` paused it. Any other failure is raised."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if Paused.__name__ in str(e):
            return False
        raise
    return True


def current_documents(spark: SparkSession, root: str) -> DataFrame:
    """Latest state per document; deleted ones are left out."""
    seen = spark.read.option("basePath", f"{root}/docs").parquet(f"{root}/docs")
    last = seen.groupBy("doc_id").agg(
        F.max("batch").alias("batch"), F.max_by("text_chars", "batch").alias("text_chars"))
    return last.filter(F.col("text_chars").isNotNull())


def current_postings(spark: SparkSession, root: str) -> DataFrame:
    """Postings of each document's latest batch."""
    rows = spark.read.option("basePath", f"{root}/postings").parquet(f"{root}/postings")
    return rows.join(current_documents(spark, root).select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Write the current state as one sorted table, for fast term lookups."""
    rows = current_postings(spark, root)
    rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(target)
