"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Skewed join keys are split at run time; small shuffles are coalesced.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "foliant", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings above; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder used to cut lineage and to hold working tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a session on a
    ``local`` master (tests, a laptop) gets a temporary folder without it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = os.path.join(tempfile.mkdtemp(prefix="foliant-"), "checkpoints")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from it.

    This cuts the lineage like a checkpoint and survives lost executors. The
    plan runs once (a checkpoint runs it twice), later reads fetch only the
    columns they use, and the planner sees the true size of the table.
    """
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """Jobs that run inside give Python tasks ``rows`` rows at a time, for columns that hold whole files."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def whole_files(spark: SparkSession):
    """Jobs that run inside read each file in one task, in its order, and write partition folders without sorting."""
    values = {
        "spark.sql.files.maxPartitionBytes": str(1 << 40), "spark.sql.files.openCostInBytes": str(1 << 40),
        "spark.sql.maxConcurrentOutputFileWriters": "1",
    }
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that a finished job no longer needs."""
    for df in tables:
        spark = df.sparkSession
        top = checkpoint_dir(spark).rstrip("/").split(":")[-1].lstrip("/")
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/{top}/" in name and "/table-" in name:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a table a job has to write."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
