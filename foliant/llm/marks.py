"""Places of pattern matches in texts, with built-in functions only.

Each match is set between two marker characters, the text is split at them, and
every second part is a match. Its place is the length of what comes before it;
lengths are added up in blocks, so many matches in one text stay cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, STAND_IN = "\ue000", "\ue001"
_BLOCK = 256


def unmarked(text: Column) -> Column:
    """The text with marker characters of its own replaced, one for one."""
    return F.replace(text, F.lit(MARK), F.lit(STAND_IN))


def parts_of(text: Column, pattern: str) -> Column:
    """The text cut into what lies between matches (even places) and matches (odd places)."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def matches(rows: DataFrame, parts: str, keep: list[str], near: int = 1) -> DataFrame:
    """``keep`` and ``start, end, value, before, after`` for each match in the array column ``parts``.

    ``before`` and ``after`` are the ``near`` parts next to the match, put
    together: with one they end at the neighbouring matches, with three they go
    beyond them. Code points, end exclusive.
    """
    def beside(i: Column, steps: range) -> Column:
        return F.concat(*(F.when(i + k >= 0, F.coalesce(F.get("_p", i + k), F.lit(""))).otherwise(F.lit("")) for k in steps))

    sized = rows.filter(F.size(parts) > 1).select(*keep, F.col(parts).alias("_p"), F.transform(parts, F.length).alias("_n"))
    block = lambda b: F.slice("_n", b * _BLOCK + 1, F.lit(_BLOCK))
    add = lambda s, x: s + x
    totals = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_n") - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(block(b), F.lit(0), add)
    )
    summed = sized.withColumn("_t", totals).withColumn(
        "_o", F.aggregate("_t", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    )

    def one(i: Column) -> Column:
        b = F.floor(i / _BLOCK).cast("int")
        start = F.get("_o", b) + F.aggregate(F.slice("_n", b * _BLOCK + 1, i - b * _BLOCK), F.lit(0), add)
        return F.struct(
            start.alias("start"), (start + F.get("_n", i)).alias("end"), F.get("_p", i).alias("value"),
            beside(i, range(-near, 0)).alias("before"), beside(i, range(1, near + 1)).alias("after"),
        )

    odd = F.transform(F.sequence(F.lit(1), F.floor(F.size("_p") / 2).cast("int")), lambda k: 2 * k - 1)
    return summed.select(*keep, F.inline(F.transform(odd, one)))
