"""Parse results kept apart from the files that could not be read, and another attempt at these.

An attempt is written in one pass: its rows are divided by folder into those
that were read and those with an error. A retry parses only the files that
failed last, so its cost follows the number of failures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _failed(error: Column) -> Column:
    return F.coalesce(error, F.lit("")) != ""


def attempt(parsed: DataFrame, root: str, number: int = 1) -> None:
    """Write the parse results of attempt ``number`` (with a column ``error``) below ``root``; one that is tried again overwrites itself."""
    rows = parsed.withColumn("failed", _failed(F.col("error")))
    rows.write.mode("overwrite").partitionBy("failed").parquet(f"{root}/attempt={number}")


def _rows(spark: SparkSession, root: str) -> DataFrame:
    # Folder names are read back as text.
    return spark.read.option("basePath", root).parquet(root).withColumn("failed", F.col("failed").cast("boolean"))


def read_rows(spark: SparkSession, root: str) -> DataFrame:
    """What was read, at whichever attempt."""
    return _rows(spark, root).filter(~F.col("failed")).drop("failed")


def failures(spark: SparkSession, root: str) -> DataFrame:
    """``(path, error, attempts)`` of the files that no attempt could read; the error is that of the last one."""
    rows = _rows(spark, root)
    bad = rows.filter("failed").groupBy("path").agg(
        F.max_by("error", "attempt").alias("error"), F.max("attempt").cast("bigint").alias("attempts"))
    good = rows.filter("NOT failed").select("path").distinct()
    return bad.join(good, "path", "left_anti")


def error_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many files each error holds back."""
    return failures(spark, root).groupBy("error").agg(F.count("*").alias("files"))


def retry(files: DataFrame, root: str, parse: Callable[[DataFrame], DataFrame], number: int) -> None:
    """Parse again those of ``files`` (with a column ``path``) that failed so far, as attempt ``number``."""
    open_ = failures(files.sparkSession, root).select("path")
    attempt(parse(files.join(open_, "path", "left_semi")), root, number)
