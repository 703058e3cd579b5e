"""Run progress as a stream: a bar that never goes back, and a smoothed time left."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.messages import overall_percent

OUT = "collection bigint, event_id bigint, pct bigint, shown bigint, eta_ms double"
STATE = "shown bigint, phase string, anchor_ms double, anchor_done bigint, eta_ms double"
MIN_ELAPSED_MS = 400


def next_eta(state: dict, phase: str, at_ms: float, done: int, total: int) -> float | None:
    """Update the timing state of one run and return its time left, if known.

    The rate is measured from an anchor, set anew when the phase changes or the
    count falls below it; a new sample weighs 0.4.
    """
    if state.get("phase") != phase or done < state["anchor_done"]:
        state.update(phase=phase, anchor_ms=at_ms, anchor_done=done, eta_ms=None)
    elapsed, work = at_ms - state["anchor_ms"], done - state["anchor_done"]
    if work > 0 and elapsed >= MIN_ELAPSED_MS and done < total:
        left = (total - done) * elapsed / work
        known = state["eta_ms"]
        state["eta_ms"] = left if known is None else known * 0.6 + left * 0.4
    return state["eta_ms"]


def _advance(key, frames, group: GroupState):
    import pandas as pd

    names = ("shown", "phase", "anchor_ms", "anchor_done", "eta_ms")
    state = dict(zip(names, group.get)) if group.exists else {"shown": 0}
    if state.get("eta_ms") is not None and state["eta_ms"] < 0:
        state["eta_ms"] = None
    # One run's events of one micro-batch are sorted together: a reader without a limit makes that the whole backlog.
    rows = pd.concat(list(frames)).sort_values(["at_ms", "event_id"])
    out = []
    for r in rows.itertuples():
        state["shown"] = max(state["shown"], int(r.pct))
        eta = next_eta(state, r.phase, float(r.at_ms), int(r.done), int(r.total))
        out.append((key[0], int(r.event_id), int(r.pct), state["shown"], eta))
    saved = [state.get(n) for n in names]
    saved[4] = -1.0 if saved[4] is None else saved[4]
    group.update(tuple(saved))
    yield pd.DataFrame(out, columns=["collection", "event_id", "pct", "shown", "eta_ms"]).astype({"eta_ms": "float64"})


def track_progress(events: DataFrame) -> DataFrame:
    """State per collection over ``collection, ts, event_id, phase, done, total`` rows.

    What is kept per collection is five values, however many events arrive.
    """
    pct = overall_percent(F.col("phase"), F.col("done"), F.col("total"))
    rows = events.select(
        "collection", "event_id", "phase", "done", "total", pct.alias("pct"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"),
    )
    return rows.groupBy("collection").applyInPandasWithState(
        _advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


PIECE = 4096
BUCKETS = 256
SLOTS = 16


class _Ordered(StatefulProcessor):
    """Events of one bucket of runs wait by slots of time until the watermark has passed a slot; a timer then takes them in order."""

    def __init__(self, slot_ms: int) -> None:
        self._slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # The timing values of the bucket's runs, the number of the next piece, and the pieces of each slot: JSON texts.
        self._last = handle.getValueState("last", "runs string")
        self._next = handle.getValueState("next", "piece bigint")
        self._waiting = handle.getMapState("waiting", "slot bigint, piece bigint", "rows string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number = self._next.get()[0] if self._next.exists() else 0
        piece: dict[int, list[tuple]] = {}
        slots: set[int] = set()
        n = 0
        for r in rows:
            slot = r.at_us // 1000 // self._slot_ms
            piece.setdefault(slot, []).append((r.at_us, r.event_id, r.collection, r.phase, r.done, r.total, r.pct))
            n += 1
            if n % PIECE == 0:
                number = self._keep(piece, number)
                slots.update(piece)
                piece = {}
        number = self._keep(piece, number)
        slots.update(piece)
        self._next.update((number,))
        if slots:
            self._handle.registerTimer((min(slots) + 1) * self._slot_ms)
        return iter([])

    def _keep(self, piece: dict[int, list[tuple]], number: int) -> int:
        for slot, new in piece.items():
            self._waiting.updateValue((slot, number), (json.dumps(new),))
        return number + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        slots: dict[int, list[int]] = {}
        for slot, number in self._waiting.keys():
            slots.setdefault(slot, []).append(number)
        ready = sorted(s for s in slots if (s + 1) * self._slot_ms <= passed)
        if ready:
            runs = json.loads(self._last.get()[0]) if self._last.exists() else {}
            for slot in ready:
                yield from self._take(slot, slots.pop(slot), runs)
            self._last.update((json.dumps(runs),))
        if slots:
            self._handle.registerTimer((min(slots) + 1) * self._slot_ms)

    def _take(self, slot: int, numbers: list[int], runs: dict[str, dict]) -> Iterator[Row]:
        rows: list[list] = []
        for number in numbers:
            rows += json.loads(self._waiting.getValue((slot, number))[0])
            self._waiting.removeKey((slot, number))
        for at_us, event_id, collection, phase, done, total, pct in sorted(rows, key=lambda x: x[:2]):
            state = runs.setdefault(str(collection), {"shown": 0})
            state["shown"] = max(state["shown"], pct)
            eta = next_eta(state, phase, at_us / 1000, done, total)
            yield Row(collection=collection, event_id=event_id, pct=pct, shown=state["shown"], eta_ms=eta)

    def close(self) -> None:
        pass


def ordered_progress(events: DataFrame, within: str = "10 seconds") -> DataFrame:
    """As :func:`track_progress`, in the order of the events' times whatever order they arrive in.

    An event may come ``within`` later than newer ones; what comes later still
    is dropped, as the watermark says. Runs are dealt to BUCKETS buckets.
    Events wait in the state store under their slot of time, SLOTS of which
    make up ``within``, and a timer takes the slots that have passed one after
    the other, so a task holds the rows of one bucket and one slot at a time,
    and calls the store per slot, not per event. An event is given out once
    events that are ``within`` newer than its slot have come. The stream must
    run inside :func:`state_on_disk`.
    """
    pct = overall_percent(F.col("phase"), F.col("done"), F.col("total"))
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).select(
        "collection", "event_id", "phase", "done", "total", "ts", pct.alias("pct"), F.unix_micros("ts").alias("at_us"),
        F.pmod(F.xxhash64("collection"), F.lit(BUCKETS)).alias("bucket"))
    span = events.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + interval '{within}')").first()[0]
    return rows.groupBy("bucket").transformWithState(_Ordered(max(1, span // SLOTS)), OUT, "Append", "EventTime")


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which timers and map states need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def record_activities(events: DataFrame, root: str, checkpoint: str, available_now: bool = True):
    """Start a query that keeps starts and ends below ``root``, so that an end of any lateness finds its start.

    ``events`` has ``id, ts, name, ok, summary, is_start``. Each batch writes
    below its own number, and one that is tried again overwrites itself;
    nothing is held as state.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select("id", "ts", "name", "ok", "summary", "is_start").write.mode("overwrite").parquet(f"{root}/batch={number}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recorded_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every recorded start with its end, if it has come: ``id, name, started_at, ok, summary, ended_at``."""
    rows = spark.read.option("basePath", root).parquet(root)
    starts = rows.filter("is_start").select("id", "name", F.col("ts").alias("started_at"))
    ends = rows.filter("NOT is_start").select(F.col("id").alias("_id"), "ok", "summary", F.col("ts").alias("ended_at"))
    return starts.join(ends, (F.col("id") == F.col("_id")) & (F.col("ended_at") >= F.col("started_at")), "left").drop("_id")


def pair_activities(starts: DataFrame, ends: DataFrame, within: str = "1 hour") -> DataFrame:
    """Activity pairing inside the stream, for consumers that want a bounded wait.

    Both sides carry ``id`` and ``ts``. A start whose end does not come within
    ``within`` is given out as open once the watermark has passed it; use
    :func:`record_activities` where a later end still has to count.
    """
    a = starts.select("id", "name", F.col("ts").alias("started_at")).withWatermark("started_at", within)
    b = ends.select(F.col("id").alias("_id"), "ok", "summary", F.col("ts").alias("ended_at")).withWatermark("ended_at", within)
    near = (F.col("id") == F.col("_id")) & (F.col("ended_at") >= F.col("started_at")) & (
        F.col("ended_at") <= F.col("started_at") + F.expr(f"interval {within}"))
    return a.join(b, near, "leftOuter").drop("_id")
