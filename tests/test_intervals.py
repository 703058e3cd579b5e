"""Overlap joins and reading order against plain loops."""

import random

from pyspark.sql import functions as F

from foliant.operators import highlights
from foliant.operators.intervals import interval_join


def spans(rnd: random.Random, n: int) -> list[tuple]:
    out = []
    for i in range(n):
        lo = rnd.choice([rnd.uniform(-50, 900), float(rnd.randrange(0, 320, 32)), -1e6])
        size = rnd.choice([0.0, rnd.uniform(0, 12), 32.0, rnd.uniform(0, 400), 3e6])
        out.append((i, rnd.randrange(3), lo, lo + size))
    # No interval: an end is missing, is no number, or lies before the start.
    return out + [(n, 0, None, 5.0), (n + 1, 0, 5.0, None), (n + 2, 0, 9.0, 2.0), (n + 3, 0, float("nan"), 3.0)]


def test_every_meeting_pair_once(spark):
    rnd = random.Random(8)
    a, b = spans(rnd, 120), spans(rnd, 150)
    left = spark.createDataFrame(a, "i long, page int, a0 double, a1 double")
    right = spark.createDataFrame(b, "j long, page int, b0 double, b1 double")
    got = interval_join(left, right, ["page"], (F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1")), 8.0)
    pairs = [(r.i, r.j) for r in got.collect()]
    want = {
        (i, j) for i, p, a0, a1 in a[:120] for j, q, b0, b1 in b[:150] if p == q and a0 <= b1 and b0 <= a1
    }
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert sorted(got.columns) == ["a0", "a1", "b0", "b1", "i", "j", "page"]
    assert interval_join(left.limit(0), right, ["page"], (F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1")), 8.0).collect() == []


def test_pairs_compared_follow_the_neighbours(spark):
    """A page of 2,000 marks and 2,000 items in 2,000 rows: rows that meet in a cell, not all four million pairs."""
    rows = spark.range(2000).select(F.lit(1).alias("page"), (F.col("id") * 12.0).alias("y0"), (F.col("id") * 12.0 + 10).alias("y1"))
    got = interval_join(
        rows.withColumnsRenamed({"y0": "a0", "y1": "a1"}), rows.withColumnsRenamed({"y0": "b0", "y1": "b1"}), ["page"],
        (F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1")), 32.0)
    assert got.count() == 2000


def plain_lines(items: list[tuple]) -> dict:
    out = {}
    for k in {i[0] for i in items}:
        mine = sorted((-y, x, s) for kk, x, y, s in items if kk == k and s.strip())
        lines, last = [], None
        for d, x, s in mine:
            if last is None or d - last > 4:
                lines.append([])
            lines[-1].append((x, d, s))
            last = d
        for n, line in enumerate(lines):
            out[(k, n)] = " ".join(s for _, _, s in sorted(line))
    return out


def test_reading_lines_of_a_full_page(spark):
    rnd = random.Random(3)
    items = [(rnd.choice([1, 1, 1, 1, 2, 3]), float(rnd.randrange(500)), float(rnd.choice([10, 12, 30, 33, 36, 39, 90])), f"w{i}") for i in range(2000)]
    items += [(1, 5.0, 200.0, "  "), (4, 0.0, 0.0, "only"), (5, 1.0, 3.0, "")]
    df = spark.createDataFrame(items, "page int, x0 double, y0 double, str string").repartition(6)
    got = highlights.reading_lines(df, ["page"]).collect()
    want = plain_lines(items)
    assert {(r.page, r.line) for r in got} == set(want)
    assert all(r.piece == 0 and r.text == want[(r.page, r.line)] for r in got)


def test_long_lines_come_in_pieces(spark):
    df = spark.range(10_000).select(F.lit(1).alias("page"), F.col("id").cast("double").alias("x0"), F.lit(7.0).alias("y0"), F.concat(F.lit("w"), "id").alias("str"))
    got = sorted((r.piece, r.text) for r in highlights.reading_lines(df, ["page"]).collect())
    assert [p for p, _ in got] == [0, 1, 2]
    assert " ".join(t for _, t in got) == " ".join(f"w{i}" for i in range(10_000))


def recorded(monkeypatch) -> list[int]:
    """The numbers of rows of the tables that are written from now on."""
    sizes = []
    real = highlights.settle

    def settle(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(highlights, "settle", settle)
    return sizes


def test_pages_are_put_in_order_without_writing_their_items(spark, monkeypatch):
    rnd = random.Random(5)
    items = [(rnd.choice([1, 1, 1, 1, 2, 3]), float(rnd.randrange(200)), float(rnd.choice([10, 12, 30, 33, 36, 39, 90])), f"w{i}") for i in range(300)]
    df = spark.createDataFrame(items, "page int, x0 double, y0 double, str string").repartition(4)
    sizes, want = recorded(monkeypatch), plain_lines(items)
    got = highlights.reading_lines(df, ["page"]).collect()
    assert {(r.page, r.line): r.text for r in got} == want and len(got) == len(want)
    assert max(sizes, default=0) == 0
    # A page of more items than a task takes is counted over ranges.
    monkeypatch.setattr(highlights, "WHOLE", 100)
    got = highlights.reading_lines(df, ["page"]).collect()
    assert {(r.page, r.line): r.text for r in got} == want and len(got) == len(want)


def test_numbers_of_a_mark_are_worked_out_once(spark):
    points = F.transform(F.array(*[F.lit(float(v)) for v in (1, 9, 5, 9, 1, 2, 5, 2)]), lambda v: F.sqrt(v + F.col("id")))
    df = spark.range(1, 3).select(highlights.quad_boxes(points, F.array(*[F.lit(0.0)] * 4)).alias("boxes"))
    assert df._jdf.queryExecution().analyzed().toString().upper().count("SQRT(") == 1
    near = lambda b, v: all(abs(x - y ** 0.5) < 1e-9 for x, y in zip((b.x0, b.x1, b.y0, b.y1), v))
    first, second = (r.boxes for r in df.collect())
    assert len(first) == 1 and near(first[0], (2, 6, 3, 10)) and near(second[0], (3, 7, 4, 11))


def test_marks_meet_their_words_without_writing_pairs(spark, monkeypatch):
    rnd = random.Random(12)
    items = []
    for i in range(150):
        x, y, page = float(rnd.randrange(60)), float(rnd.choice([0, 3, 10, 33, 36, 60, 99])), rnd.choice([1, 1, 1, 2, None])
        items.append((1, page, f"w{i}" if i % 9 else " ", x, x + 4, y, y + rnd.choice([1.0, 8.0, 70.0])))
    marks = [(1, rnd.choice([1, 1, 2, None]), n, [(x := float(rnd.randrange(50)), x + 20, y := float(rnd.randrange(90)), y + rnd.choice([2.0, 40.0]))]) for n in range(30)]
    df = spark.createDataFrame(items, "doc_id int, page int, str string, x0 double, x1 double, y0 double, y1 double").repartition(3)
    mf = spark.createDataFrame(marks, "doc_id int, page int, mark_no int, boxes array<struct<x0:double,x1:double,y0:double,y1:double>>")
    mf = mf.withColumn("rgb", F.array(F.lit(250), F.lit(240), F.lit(10)))

    def in_order(found):
        lines = plain_lines([(0, x0, y0, s) for _, _, s, x0, _, y0, _ in found])
        return " ".join(lines[0, n] for n in range(len(lines)))

    want = {}
    for d, p, n, ((bx0, bx1, by0, by1),) in marks:
        here = [i for i in items if p is not None and i[1] == p and i[2].strip() and i[6] > by0 - 2 and i[5] < by1 + 2]
        under = [i for i in here if bx0 - 1 <= (i[3] + i[4]) / 2 <= bx1 + 1 and i[6] > by0 and i[5] < by1]
        if under:
            want[d, p, n] = (in_order(under), "yellow", in_order(here))
    assert len(want) > 10
    sizes = recorded(monkeypatch)
    # At first in one task for each mark, then over ranges.
    for limit in (1 << 16, 20):
        monkeypatch.setattr(highlights, "WHOLE", limit)
        got = {tuple(r)[:3]: tuple(r)[3:] for r in highlights.marked_passages(mf, df).collect()}
        assert got == want
        if limit > 20:
            assert max(sizes) <= len(marks)
