"""Overlap joins of intervals on a grid of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAX_LEVEL = 60


def _level(lo: Column, hi: Column, unit: float) -> Column:
    """The number of doublings of ``unit`` after which a cell is no shorter than the interval."""
    ratio = F.greatest((hi - lo) / unit, F.lit(1.0))
    return F.least(F.ceil(F.log2(ratio)), F.lit(_MAX_LEVEL)).cast("int")


def _celled(df: DataFrame, span: tuple[Column, Column], levels: list[int], unit: float, tag: str) -> DataFrame:
    lo, hi = span
    rows = df.withColumn(f"_lo{tag}", lo.cast("double")).withColumn(f"_hi{tag}", hi.cast("double"))
    low, high = F.col(f"_lo{tag}"), F.col(f"_hi{tag}")
    # Without one of its ends, or turned around, an interval meets nothing.
    rows = rows.filter((low <= high) & ~F.isnan(low) & ~F.isnan(high)).withColumn(f"_l{tag}", _level(low, high, unit))
    at = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(f"_l{tag}")))
    rows = rows.withColumn("_level", at)
    size = F.lit(unit) * F.pow(F.lit(2.0), F.col("_level"))
    first, last = F.floor(low / size).cast("bigint"), F.floor(high / size).cast("bigint")
    return rows.withColumn(f"_first{tag}", first).withColumn("_cell", F.explode(F.sequence(first, last)))


def interval_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column],
    unit: float,
) -> DataFrame:
    """Pairs of rows that agree in ``on`` and whose closed intervals ``(low, high)`` meet; every pair once.

    Cells double in length from ``unit`` on. A row lies in two or three cells of
    its own level, where the cells are as long as it is, and of every longer
    level that occurs; two rows meet at the longer level of the two, in the
    first cell that both have. So a key with many rows is dealt over its cells,
    and what is compared follows the number of neighbours. One small job asks
    which levels occur (61 at most).
    """
    sets = [df.agg(level_set(span, unit)).first()[0] for df, span in ((left, left_span), (right, right_span))]
    levels = levels_in(*sets)
    a, b = _celled(left, left_span, levels, unit, "_a"), _celled(right, right_span, levels, unit, "_b")
    met = a.join(b, [*on, "_level", "_cell"]).filter(
        (F.greatest("_l_a", "_l_b") == F.col("_level")) & (F.greatest("_first_a", "_first_b") == F.col("_cell"))
        & (F.col("_lo_a") <= F.col("_hi_b")) & (F.col("_lo_b") <= F.col("_hi_a"))
    )
    return met.drop("_level", "_cell", *(f"{c}{t}" for c in ("_lo", "_hi", "_l", "_first") for t in ("_a", "_b")))


def level_set(span: tuple[Column, Column], unit: float) -> Column:
    """An aggregate: the levels of intervals as the bits of a number."""
    lo, hi = (end.cast("double") for end in span)
    some = (lo <= hi) & ~F.isnan(lo) & ~F.isnan(hi)
    return F.bit_or(F.when(some, F.call_function("shiftleft", F.lit(1).cast("bigint"), _level(lo, hi, unit))))


def levels_in(*sets: int | None) -> list[int]:
    """The levels of any of the sets, at least one."""
    return [n for n in range(_MAX_LEVEL + 1) if any((s or 0) >> n & 1 for s in sets)] or [0]


def interval_lists(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[Column, Column], right_span: tuple[str, str],
    unit: float, levels: list[int], out: str,
) -> DataFrame:
    """As :func:`interval_join`, with what a left row meets as a list ``out`` of structs of the other columns of ``right``.

    A left row comes once for each cell in which it meets something. A cell is
    one list, so this is for keys ``on`` of few right rows each; ``right_span``
    names two of their columns, and ``levels`` are those that occur.
    """
    others = [c for c in right.columns if c not in on]
    a = _celled(left, left_span, levels, unit, "_a")
    b = _celled(right, (F.col(right_span[0]), F.col(right_span[1])), levels, unit, "_b").select(
        *on, "_level", "_cell", *others, (F.col("_l_b") == F.col("_level")).alias("_own"), (F.col("_first_b") == F.col("_cell")).alias("_begins"))
    cells = b.repartition(*on, "_level", "_cell").groupBy(*on, "_level", "_cell").agg(
        F.collect_list(F.struct(*others, "_own", "_begins")).alias(out))
    lo, hi = right_span
    # Neither the level nor the first cell of a row is above those of the cell it lies in; one level is that of all rows.
    a = a.withColumns({"_own": (F.col("_l_a") == F.col("_level")) | F.lit(len(levels) == 1), "_begins": F.col("_first_a") == F.col("_cell")})
    met = F.filter(out, lambda x: (x[hi] >= F.col("_lo_a")) & (x[lo] <= F.col("_hi_a")) & (F.col("_begins") | x["_begins"]) & (F.col("_own") | x["_own"]))
    found = a.join(cells, [*on, "_level", "_cell"]).withColumn(out, met).drop("_own", "_begins")
    return found.drop("_level", "_cell", "_lo_a", "_hi_a", "_l_a", "_first_a")
