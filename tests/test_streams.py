import random

from pyspark.sql import functions as F

from foliant.operators import search
from foliant.session import work_path
from foliant.streaming import progress, reindex


def run(stream, spark, label):
    base = work_path(spark, label)
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/s").trigger(
        availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def expected(rows):
    """The reference behaviour, event by event."""
    timing, out = {}, {}
    for coll, eid, ms, phase, done, total in rows:
        t = timing.get(coll)
        if t is None or t["phase"] != phase or done < t["done"]:
            t = timing[coll] = {"phase": phase, "at": ms, "done": done, "eta": None}
        elapsed, work = ms - t["at"], done - t["done"]
        if work > 0 and elapsed >= 400 and done < total:
            raw = (total - done) / (work / elapsed)
            t["eta"] = raw if t["eta"] is None else t["eta"] * 0.6 + raw * 0.4
        out[eid] = t["eta"]
    return out


def test_progress_over_several_batches(spark, tmp_path):
    rnd = random.Random(4)
    rows, ms = [], 1_700_000_000_000
    for eid in range(240):
        ms += rnd.choice([50, 300, 900])
        phase = ["Reading documents", "Rendering documents", "odd"][eid // 80]
        rows.append((rnd.choice([1, 1, 1, 2]), eid, ms, phase, eid % 80 // 2 - rnd.choice([0, 0, 0, 30]) % 7, 50))
    src = str(tmp_path / "in")
    cols = "collection bigint, event_id bigint, ms bigint, phase string, done bigint, total bigint"
    for i in range(0, 240, 60):
        spark.createDataFrame(rows[i:i + 60], cols).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream = stream.withColumn("ts", F.timestamp_millis("ms"))
    got = {r.event_id: r for r in run(progress.track_progress(stream), spark, "p").collect()}
    want = expected(rows)
    assert len(got) == 240
    for eid, eta in want.items():
        assert (got[eid].eta_ms is None) == (eta is None) and (eta is None or abs(got[eid].eta_ms - eta) < 1e-6 * eta)
    top = {}
    for coll, eid, *_ in rows:
        top[coll] = max(top.get(coll, 0), got[eid].pct)
        assert got[eid].shown == top[coll]


def test_ordered_progress_of_events_in_any_order(spark, tmp_path, monkeypatch):
    """Events of one large run and two small ones, mixed up inside windows of the allowed lateness, in pieces of three."""
    monkeypatch.setattr(progress, "PIECE", 3)
    rnd = random.Random(5)
    rows, us = [], 1_700_000_000_000_000
    for eid in range(300):
        us += rnd.choice([0, 400, 50_000, 300_000, 900_000])
        phase = ["Reading documents", "Rendering documents", "odd"][eid // 100]
        rows.append((rnd.choice([1, 1, 1, 1, 2, 3]), eid, us, phase, eid % 100 // 2 - rnd.choice([0, 0, 0, 30]) % 7, 50))
    src = str(tmp_path / "in")
    cols = "collection bigint, event_id bigint, us bigint, phase string, done bigint, total bigint"
    for i in range(0, 300, 60):
        part = rows[i:i + 60]
        rnd.shuffle(part)
        for half in (part[:30], part[30:]):
            spark.createDataFrame(half, cols).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(-1, -1, us + 10 ** 9, "end", 0, 1)], cols).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream = stream.withColumn("ts", F.timestamp_micros("us"))
    with progress.state_on_disk(spark):
        got = {r.event_id: r for r in run(progress.ordered_progress(stream, "60 seconds"), spark, "op").collect()}
    want = expected([(c, e, u / 1000, p, d, t) for c, e, u, p, d, t in rows])
    assert set(got) == set(want)
    for eid, eta in want.items():
        assert (got[eid].eta_ms is None) == (eta is None) and (eta is None or abs(got[eid].eta_ms - eta) < 1e-6 * eta)
    top = {}
    for coll, eid, *_ in rows:
        top[coll] = max(top.get(coll, 0), got[eid].pct)
        assert got[eid].shown == top[coll]


def test_a_paused_stream_goes_on(spark, tmp_path):
    src, root, state = (str(tmp_path / x) for x in ("in", "ix", "cp"))
    for k in range(4):
        spark.createDataFrame([(k, f"alpha w{k}", 0), (9, f"beta{k}", k)], "doc_id bigint, text string, seq int").coalesce(1).write.mode("append").parquet(src)
    seen = []

    def pause(number):
        seen.append(number)
        if seen.count(number) == 1 and number in (0, 2):
            raise reindex.Paused("stop")

    ended = []
    while not (ended and ended[-1]):
        changes = spark.readStream.schema("doc_id bigint, text string, seq int").option("maxFilesPerTrigger", 1).parquet(src)
        ended.append(reindex.run_until_paused(reindex.index_changes(changes, root, state, on_batch=pause)))
    assert ended == [False, False, True] and seen == [0, 0, 1, 2, 2, 3]
    got = sorted((r.doc_id, r.term) for r in reindex.current_postings(spark, root).collect())
    assert got == sorted([(k, "alpha") for k in range(4)] + [(k, f"w{k}") for k in range(4)] + [(9, "beta3")])

    def fail(number):
        raise ValueError("disk")

    changes = spark.readStream.schema("doc_id bigint, text string, seq int").parquet(src)
    try:
        reindex.run_until_paused(reindex.index_changes(changes, root + "2", state + "2", on_batch=fail))
    except Exception as e:
        assert "disk" in str(e)
    else:
        raise AssertionError("a failure is not a pause")


def test_reindex_resumes_and_equals_a_rebuild(spark, tmp_path):
    src, root, state = (str(tmp_path / x) for x in ("in", "ix", "cp"))
    steps = [[(1, "alpha beta", 1), (2, "beta", 1)], [(1, "gamma", 2), (3, "alpha alpha", 2), (3, "old", 1)], [(2, None, 3)]]
    for step in steps:
        spark.createDataFrame(step, "doc_id bigint, text string, seq int").coalesce(1).write.mode("append").parquet(src)
        changes = spark.readStream.schema("doc_id bigint, text string, seq int").parquet(src)
        reindex.index_changes(changes, root, state).awaitTermination()
    final = spark.createDataFrame([(1, "gamma"), (3, "alpha alpha")], "doc_id bigint, text string")
    cols = ["doc_id", "term", "tf", "dl"]
    got = sorted(tuple(r) for r in reindex.current_postings(spark, root).select(cols).collect())
    assert got == sorted(tuple(r) for r in search.postings(final).select(cols).collect())
    assert sorted(r.doc_id for r in reindex.current_documents(spark, root).collect()) == [1, 3]
    reindex.compact(spark, root, str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 2
