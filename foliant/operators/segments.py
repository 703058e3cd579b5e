"""A stored index of sorted segments: a refresh writes what changed and nothing else.

A segment holds the postings of some documents, sorted by term, and the list of
the documents it speaks for; a document that is gone is listed without
postings. Of the segments that list a document the newest counts. A refresh
adds one small segment whatever is already stored. Reading leaves out of each
segment the documents that newer ones list, so its cost grows with the number
of segments; :func:`merge_tiers` keeps that small: runs of segments of like size
become one, and a row is written again only as often as its run grows by the fan.

Segments and the list of them are written under fresh names, and a list counts
once it is complete. A reader or a job that fails sees the old list.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.snapshots import current_version, load_snapshot, save_snapshot

FAN = 4


@dataclass(frozen=True)
class Segment:
    """Folder name, number of postings and of listed documents."""

    name: str
    rows: int
    docs: int


def _list(spark: SparkSession, root: str) -> list[Segment]:
    """Live segments, oldest first: a few dozen names at most, since merging bounds them by the fan and the tiers."""
    if current_version(spark, root, "segments") is None:
        return []
    return [Segment(**s) for s in json.loads(load_snapshot(spark, root, "segments", "list").first()[0])]


def _publish(spark: SparkSession, root: str, segments: list[Segment]) -> None:
    text = json.dumps([asdict(s) for s in segments])
    save_snapshot(root, "segments", {"list": spark.createDataFrame([(text,)], "value string").coalesce(1)})


def _write(postings: DataFrame, docs: DataFrame, root: str) -> Segment:
    spark, name = postings.sparkSession, uuid.uuid4().hex
    # With the document in the key a very common term is cut like any other.
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{root}/{name}/postings")
    docs.select("doc_id").distinct().write.parquet(f"{root}/{name}/docs")
    # Row counts come from the file footers.
    return Segment(name, spark.read.parquet(f"{root}/{name}/postings").count(), spark.read.parquet(f"{root}/{name}/docs").count())


def create(postings: DataFrame, docs: DataFrame, root: str) -> None:
    """Store an index from scratch. ``docs`` lists all its documents, those without any term included."""
    _publish(postings.sparkSession, root, [_write(postings, docs, root)])


def refresh(postings: DataFrame, touched: DataFrame, root: str) -> Segment:
    """Add a segment: the new ``postings`` of the ``touched`` documents, which changed, came or vanished.

    What is written follows the change set. A document that is listed in
    ``touched`` and has no new postings is gone, or has no terms any more.
    """
    spark = postings.sparkSession
    segment = _write(postings, touched, root)
    _publish(spark, root, [*_list(spark, root), segment])
    return segment


def _live(spark: SparkSession, root: str, segments: list[Segment]) -> DataFrame:
    """Postings of some consecutive segments, each without the documents that newer ones of them list."""
    out, newer = None, None
    for s in reversed(segments):
        rows = spark.read.parquet(f"{root}/{s.name}/postings")
        rows = rows if newer is None else rows.join(newer, "doc_id", "left_anti")
        out = rows if out is None else out.unionByName(rows)
        docs = spark.read.parquet(f"{root}/{s.name}/docs")
        newer = docs if newer is None else newer.unionByName(docs)
    return out


def read(spark: SparkSession, root: str) -> DataFrame:
    """The current postings. A filter on terms reaches the sorted files of every segment."""
    segments = _list(spark, root)
    if not segments:
        raise FileNotFoundError(f"no index below {root}")
    return _live(spark, root, segments)


def _run_to_merge(segments: list[Segment], fan: int) -> int:
    """How many of the newest segments form one run: each next older one joins while it is no larger than ``fan`` times the run."""
    size, n = 0, 0
    for s in reversed(segments):
        if n and s.rows + s.docs > fan * size:
            break
        size += s.rows + s.docs
        n += 1
    return n


def merge_tiers(spark: SparkSession, root: str, fan: int = FAN) -> int:
    """Merge the newest run of segments of like size if it has ``fan`` of them or more; the number of segments it replaced.

    Runs beside readers and may be tried again at any time: the new segment
    replaces the run in the list at once. Files of replaced segments stay for
    readers that started earlier; :func:`unlisted` names them.
    """
    segments = _list(spark, root)
    n = _run_to_merge(segments, fan)
    if n < max(2, fan):
        return 0
    older, run = segments[:-n], segments[-n:]
    docs = spark.read.parquet(*(f"{root}/{s.name}/docs" for s in run))
    postings = _live(spark, root, run)
    if not older:
        # Nothing older is left to hide: only documents that still have rows need to be listed.
        docs = postings.select("doc_id")
    _publish(spark, root, [*older, _write(postings, docs, root)])
    return n


def segments(spark: SparkSession, root: str) -> DataFrame:
    """``(nth, name, rows, docs)`` of the live segments, oldest first."""
    rows = [(i, s.name, s.rows, s.docs) for i, s in enumerate(_list(spark, root))]
    return spark.createDataFrame(rows, "nth int, name string, rows long, docs long")


def unlisted(spark: SparkSession, root: str) -> list[str]:
    """Folders of segments that are no longer listed."""
    live = {s.name for s in _list(spark, root)}
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = [f.getPath().getName() for f in found]
    return sorted(n for n in names if n not in live and not n.startswith("collection="))
