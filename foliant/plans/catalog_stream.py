"""Registered queries that run a stream over a given table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.plans import views as v
from foliant.plans.catalog import STOP, c, query
from foliant.plans.catalog_text import PROGRESS
from foliant.session import work_path
from foliant.streaming import progress, reindex


def _stream(spark, sf, name):
    """The table as a stream source, whether it is a file or a folder of files; a few files make a batch."""
    schema = v.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf}/{name}[.]parquet")


def _run(stream, spark, label):
    """Write a stream to its end below the shared folder and read it back."""
    base = work_path(spark, label)
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


SLICES = 4


def _ordered(spark, sf, label):
    """The progress of all runs, from files that arrive in slices of time and in any order inside a slice.

    A slice is as long as an event may be late. A last event far ahead closes the stream: it lets all others go out.
    """
    base = work_path(spark, label)
    events = v.progress(spark, sf).withColumn("ts", c("ts").cast("timestamp"))
    low, high = (x or 0 for x in events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first())
    width = max(1, (high - low) // SLICES + 1)
    late = f"{width // 1_000_000 + 1} seconds"
    for k in range(SLICES):
        part = events.filter(F.floor((F.unix_micros("ts") - low) / width) == k)
        part.repartition(4, "event_id").write.mode("append").parquet(f"{base}/in")
    end = events.limit(1).withColumn("ts", F.timestamp_micros(F.lit(high + 3 * width))).withColumn("collection", F.lit(-1).cast(events.schema["collection"].dataType))
    end.select(events.columns).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    with progress.state_on_disk(spark):
        return _run(progress.ordered_progress(stream, late), spark, f"{label}-out")


@query("progress_stream", f"WITH {PROGRESS} SELECT collection, event_id, pct, max(pct) OVER (PARTITION BY collection ORDER BY ts, event_id)::BIGINT AS shown FROM pc")
def progress_stream(spark, sf):
    return _ordered(spark, sf, "progress").select("collection", "event_id", "pct", "shown")


FRESH = "(e.phase <> r.phase OR e.done < r.a_done)"


@query("eta_stream", f"""WITH RECURSIVE {PROGRESS},
e AS (SELECT collection, event_id, phase, done, total, epoch_us(ts) / 1000.0 AS ms, row_number() OVER (PARTITION BY collection ORDER BY ts, event_id) AS n FROM pr),
r AS (SELECT collection, n, event_id, phase, ms AS a_at, done AS a_done, NULL::DOUBLE AS eta FROM e WHERE n = 1
 UNION ALL SELECT collection, n, event_id, phase, a_at, a_done, CASE WHEN done > a_done AND ms - a_at >= 400 AND done < total
   THEN CASE WHEN eta IS NULL THEN rest ELSE eta * 0.6 + rest * 0.4 END ELSE eta END FROM
  (SELECT *, (total - done) * (ms - a_at) / nullif(done - a_done, 0) AS rest FROM
   (SELECT e.*, CASE WHEN {FRESH} THEN e.ms ELSE r.a_at END AS a_at, CASE WHEN {FRESH} THEN e.done ELSE r.a_done END AS a_done,
      CASE WHEN {FRESH} THEN NULL ELSE r.eta END AS eta FROM e JOIN r ON r.collection = e.collection AND e.n = r.n + 1)))
SELECT collection, event_id, round(eta, 3) AS eta_ms FROM r WHERE eta IS NOT NULL""")
def eta_stream(spark, sf):
    return _ordered(spark, sf, "eta").filter(c("eta_ms").isNotNull()).select(
        "collection", "event_id", F.round("eta_ms", 3).alias("eta_ms"))


@query("stream_reindex", f"""WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
    lambda w: length(w) BETWEEN 2 AND 40 AND NOT list_contains([{STOP}], w)) AS tokens FROM documents)
SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL""")
def stream_reindex(spark, sf):
    base = work_path(spark, "reindex")
    docs = _stream(spark, sf, "documents").select("doc_id", F.lit(0).alias("seq"), "text")
    reindex.index_changes(docs, base, f"{base}/state").awaitTermination()
    return reindex.current_postings(spark, base).select("doc_id", "term", "tf")


@query("activity_stream", """WITH s AS (SELECT event_id // 2 AS id, ts, event_type FROM events WHERE event_id % 2 = 0),
e AS (SELECT event_id // 2 AS id, ts, event_type FROM events WHERE event_id % 2 = 1)
SELECT s.id, s.event_type AS name, e.event_type AS summary, e.ts IS NULL AS open FROM s LEFT JOIN e ON s.id = e.id AND e.ts >= s.ts""")
def activity_stream(spark, sf):
    """Every start with its end, however late, and those that are still open."""
    events = _stream(spark, sf, "events").select(
        F.floor(c("event_id") / 2).cast("bigint").alias("id"), c("ts").cast("timestamp").alias("ts"), c("event_type").alias("name"),
        (c("event_type") != "error").alias("ok"), c("event_type").alias("summary"), (c("event_id") % 2 == 0).alias("is_start"))
    base = work_path(spark, "activity")
    progress.record_activities(events, f"{base}/rows", f"{base}/state").awaitTermination()
    return progress.recorded_pairs(spark, f"{base}/rows").select("id", "name", "summary", c("ended_at").isNull().alias("open"))
