"""Versioned tables of a document set, and the catalogue of sets."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def save_snapshot(
    root: str, collection: str, tables: dict[str, DataFrame], cluster_by: dict[str, list[str]] | None = None
) -> int:
    """Write all tables of a new version, then make it the current one.

    Readers follow a pointer file that is replaced last, so they see the old
    version or the new one, never a mixture. ``cluster_by`` sorts a table by
    columns (postings by term, then document), so that filters skip row groups;
    with the document in the key a very common term is cut like any other.
    """
    spark = next(iter(tables.values())).sparkSession
    version = (current_version(spark, root, collection) or 0) + 1
    base = f"{root}/collection={collection}"
    for name, df in tables.items():
        columns = (cluster_by or {}).get(name)
        out = df.repartitionByRange(*columns).sortWithinPartitions(*columns) if columns else df
        out.write.mode("overwrite").parquet(f"{base}/v={version}/{name}")
    pointer = spark.createDataFrame([(json.dumps({"version": version, "at": int(time.time() * 1000)}),)], "value string")
    pointer.coalesce(1).write.mode("overwrite").text(f"{base}/pointer-{version}")
    return version


def current_version(spark: SparkSession, root: str, collection: str) -> int | None:
    """Highest version whose pointer was completely written."""
    fs, base = _fs(spark, f"{root}/collection={collection}")
    if not fs.exists(base):
        return None
    jvm = spark.sparkContext._jvm
    done = [
        int(s.getPath().getName().split("-")[1]) for s in fs.listStatus(base)
        if s.getPath().getName().startswith("pointer-")
        and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return max(done, default=None)


def load_snapshot(spark: SparkSession, root: str, collection: str, table: str) -> DataFrame:
    version = current_version(spark, root, collection)
    if version is None:
        raise FileNotFoundError(f"no snapshot of {collection} below {root}")
    return spark.read.parquet(f"{root}/collection={collection}/v={version}/{table}")


def collections(catalogue: DataFrame) -> DataFrame:
    """Document sets, newest first; entries without an id are skipped."""
    return catalogue.filter(F.col("id").isNotNull()).orderBy(F.desc("updated_at"), "id")
