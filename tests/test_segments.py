"""The segmented index: latest segment wins, what a refresh writes follows the changes, merging keeps the content."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import segments
from foliant.session import work_path

POSTINGS = "doc_id long, term string, tf long"


def size_of(root: str, name: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/{name}") for f in fs)


def rows(df) -> set:
    return {tuple(r) for r in df.select("doc_id", "term", "tf").collect()}


def frames(spark, state: dict, touched: list):
    new = [(d, t, n) for d in touched for t, n in state.get(d, {}).items()]
    return spark.createDataFrame(new, POSTINGS), spark.createDataFrame([(d,) for d in touched], "doc_id long")


def test_random_refreshes_against_a_dictionary(spark):
    rnd, root = random.Random(4), work_path(spark, "index")
    state = {d: {f"w{rnd.randrange(50)}": d % 5 + 1 for _ in range(6)} for d in range(200)}
    segments.create(*frames(spark, state, sorted(state)), root)
    counts = []
    for _ in range(6):
        touched = rnd.sample(range(230), 9)
        for d in touched:
            if rnd.random() < 0.4:
                state.pop(d, None)
            else:
                state[d] = {f"n{rnd.randrange(30)}": rnd.randrange(1, 9) for _ in range(rnd.randrange(4))}
        segments.refresh(*frames(spark, state, touched), root)
        want = {(d, t, n) for d, ts in state.items() for t, n in ts.items()}
        assert rows(segments.read(spark, root)) == want
        segments.merge_tiers(spark, root, fan=3)
        assert rows(segments.read(spark, root)) == want
        counts.append(segments.segments(spark, root).count())
    # Merged again and again: never as many segments as refreshes.
    assert max(counts) <= 4
    assert len(segments.unlisted(spark, root)) >= 3


def test_a_refresh_writes_what_changed(spark):
    root = work_path(spark, "index")
    base = spark.range(20_000).select(F.col("id").alias("doc_id"), F.explode(F.array(*(F.concat(F.lit(f"t{k}-"), F.col("id") % 997) for k in range(5)))).alias("term"), F.lit(1).cast("long").alias("tf"))
    segments.create(base, base, root)
    # Scattered over all documents, as every hundredth is.
    some = base.filter("doc_id % 400 = 7")
    done = segments.refresh(some, some, root)
    first = segments.segments(spark, root).filter("nth = 0").first()
    assert (first.rows, first.docs, done.rows, done.docs) == (100_000, 20_000, 250, 50)
    assert size_of(root, done.name) < size_of(root, first.name) / 20
    assert segments.merge_tiers(spark, root) == 0
    assert segments.read(spark, root).count() == 100_000


def test_empty_change_sets_and_missing_index(spark):
    root = work_path(spark, "index")
    with pytest.raises(FileNotFoundError):
        segments.read(spark, root)
    segments.create(*frames(spark, {1: {"a": 1}}, [1]), root)
    segments.refresh(*frames(spark, {}, []), root)
    assert rows(segments.read(spark, root)) == {(1, "a", 1)}
    segments.refresh(*frames(spark, {}, [1]), root)
    assert rows(segments.read(spark, root)) == set()


def test_only_runs_of_like_size_are_merged():
    s = [segments.Segment(str(i), n, 0) for i, n in enumerate([10_000, 900, 40, 20, 20])]
    assert segments._run_to_merge(s, 4) == 3
    assert segments._run_to_merge(s, 12) == 5
    assert segments._run_to_merge(s[:1], 4) == 1
