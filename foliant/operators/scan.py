"""Running totals over a global order without a single-task window.

A window without partitions sends every row to one task. Here the rows are cut
into ranges of the sort key, each range is scanned on its own, and the totals
of the ranges before it are added. The cut points come from a bounded sample of
the full (unique) sort key, so one huge group is cut like any other.

A scan reads its input four times (count, sample, totals, rows). Settle an expensive
input first; ``tagged`` rows that already went through :func:`split_ranges` can
be scanned again without a new sample.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

SAMPLES_PER_RANGE = 16
MAX_RANGES = 4096


def _range_count(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, min(MAX_RANGES, 2 * parts))


def _near_cuts(leads: list, x: Column) -> Column | None:
    """``(first, many)``: how many cuts surely come before a row, and how many after these may.

    ``leads`` are the leading whole numbers of the cuts, in order, ``x`` that
    of the row. Equal stretches of the numbers tell where to look, so that most
    rows meet a cut or two, not a list of them.
    """
    nulls = sum(v is None for v in leads)
    known = leads[nulls:]
    if not known or known[-1] - known[0] >= 1 << 62:
        return None
    low, high, n = known[0], known[-1], len(leads)
    step = (high - low) // (4 * n) + 1
    firsts, v = [], nulls
    for b in range((high - low) // step + 2):
        while v < n and (leads[v] - low) // step < b:
            v += 1
        firsts.append(v)
    table = F.from_json(F.lit(json.dumps(firsts)), "array<int>")
    at = F.call_function("div", x - F.lit(low).cast("bigint"), F.lit(step).cast("bigint")).cast("int")
    inside = F.struct(F.element_at(table, at + 1).alias("first"), (F.element_at(table, at + 2) - F.element_at(table, at + 1)).alias("many"))
    fixed = lambda first, many: F.struct(F.lit(first).alias("first"), F.lit(many).alias("many"))
    return F.when(x.isNull(), fixed(0, nulls)).when(x < low, fixed(nulls, 0)).when(x > high, fixed(n, 0)).otherwise(inside)


def split_ranges(
    df: DataFrame, order: Sequence[str], ranges: int | None = None, column: str = "_range", whole: bool = False
) -> DataFrame:
    """Tag each row with the number of the range its sort key falls in.

    With ``whole`` the rows of one value of the leading column stay in one range
    unless two cut points or more fall among them. If that happens to any value, a
    column ``_cut`` says of each row whether its value may be dealt over ranges.

    Two small jobs draw the cut points at once: the row count gives a threshold,
    and rows whose key hashes below it are the sample. Its size follows from
    the number of ranges alone, whatever the numbers of rows and tasks, and at
    most MAX_RANGES keys come back. They then stand in the plan as constants,
    so every use of the tag agrees.
    """
    n = ranges or _range_count(df)
    key = F.struct(*order)
    share = n * SAMPLES_PER_RANGE / max(1, df.select(F.lit(1)).count())
    sample = df.select(key.alias("k"))
    if share < 1:
        sample = sample.filter(F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 32)) < int(share * (1 << 32)))
    every = sample.agg(F.sort_array(F.collect_list("k")).alias("ks")).select(
        F.filter("ks", lambda k, i: i % SAMPLES_PER_RANGE == SAMPLES_PER_RANGE - 1).alias("c")
    )
    # Cut points need not be exact: rounding in the text form only moves a cut.
    cuts = json.loads(every.select(F.to_json("c")).first()[0])
    kind = every.schema["c"].dataType.simpleString()
    many: list = []
    if whole:
        leads = [c.get(order[0]) for c in cuts]
        again = [i > 0 and leads[i - 1] == v for i, v in enumerate(leads)]
        many = [v for v in dict.fromkeys(v for v, more in zip(leads, again) if more) if v is not None]
        # The first cut of a value goes back to its start: the other columns are null, which sorts first.
        cuts = [c if more or c.get(order[0]) is None else {order[0]: c[order[0]]} for c, more in zip(cuts, again)]

    def constant(values: list) -> Column:
        return F.from_json(F.lit(json.dumps(values)), kind)

    k = F.col("_k")
    lead = df.select(order[0]).schema[0].dataType
    if many:
        dealt = F.array_contains(F.from_json(F.lit(json.dumps(many)), f"array<{lead.simpleString()}>"), F.col(order[0]))
        df = df.withColumn("_cut", F.coalesce(dealt, F.lit(False)))
    if isinstance(lead, IntegralType) and cuts:
        found = _near_cuts([c.get(order[0]) for c in cuts], k[order[0]].cast("bigint"))
        if found is not None:
            return (
                df.withColumn("_k", key).withColumn("_near", found)
                .withColumn(column, F.when(F.col("_near.many") == 0, F.col("_near.first")).otherwise(
                    F.col("_near.first") + F.size(F.filter(F.slice(constant(cuts), F.col("_near.first") + 1, F.col("_near.many")), lambda c: c <= k))))
                .drop("_k", "_near")
            )
    # Two levels keep the lookup short.
    width = max(2, int(n ** 0.5))
    block = F.size(F.filter(constant(cuts[width - 1::width]), lambda c: c <= k))
    fine = F.slice(constant(cuts), F.col("_block") * width + 1, F.lit(width))
    return (
        df.withColumn("_k", key)
        .withColumn("_block", block)
        .withColumn(column, F.col("_block") * width + F.size(F.filter(fine, lambda c: c <= k)))
        .drop("_k", "_block")
    )


def _spread(df: DataFrame, per_range: DataFrame, column: str) -> DataFrame:
    # One row per range, at most MAX_RANGES and a few: bounded, so broadcast.
    return df.join(F.broadcast(per_range), column, "left")


def running_sum(
    df: DataFrame, order: Sequence[str], value: Column, out: str, ranges: int | None = None,
    tagged: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows *before* this one. ``tagged`` rows keep their range."""
    base = (df if tagged else split_ranges(df, order, ranges)).withColumn("_v", value)
    totals = base.groupBy("_range").agg(F.sum("_v").alias("_t"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    local = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    done = _spread(
        base.withColumn("_local", F.coalesce(F.sum("_v").over(local), F.lit(0))), offsets, "_range"
    ).withColumn(out, F.col("_off") + F.col("_local"))
    return done.drop("_v", "_local", "_off", *([] if tagged else ["_range"]))


def running_max(
    df: DataFrame, order: Sequence[str], value: Column, out: str, ranges: int | None = None,
    tagged: bool = False,
) -> DataFrame:
    """Add ``out``: the largest ``value`` up to and including this row.

    With a struct whose first field is the leading sort column, the maximum
    starts anew in each group, because later groups compare larger.
    """
    base = (df if tagged else split_ranges(df, order, ranges)).withColumn("_v", value)
    tops = base.groupBy("_range").agg(F.max("_v").alias("_t"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select("_range", F.max("_t").over(before).alias("_off"))
    local = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        _spread(base.withColumn("_local", F.max("_v").over(local)), carried, "_range")
        .withColumn(out, F.greatest("_local", "_off"))
        .drop("_v", "_local", "_off", *([] if tagged else ["_range"]))
    )


def previous_row(
    df: DataFrame, order: Sequence[str], fields: Sequence[str], out: str, ranges: int | None = None,
    tagged: bool = False,
) -> DataFrame:
    """Add ``out``: a struct of ``fields`` of the row just before this one."""
    base = (df if tagged else split_ranges(df, order, ranges)).withColumn("_v", F.struct(*fields))
    lasts = base.groupBy("_range").agg(F.max_by("_v", F.struct(*order)).alias("_t"))
    carried = lasts.select("_range", F.lag("_t").over(W.orderBy("_range")).alias("_off"))
    local = F.lag("_v").over(W.partitionBy("_range").orderBy(*order))
    return (
        _spread(base.withColumn("_local", local), carried, "_range")
        .withColumn(out, F.coalesce("_local", "_off"))
        .drop("_v", "_local", "_off", *([] if tagged else ["_range"]))
    )


def row_position(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """Add ``out``: the row's 0-based place in the global order."""
    return running_sum(df, order, F.lit(1).cast("bigint"), out)
