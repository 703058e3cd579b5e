"""The first table in a Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import S, WS, trim_ws


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(trim_ws(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|", -1), lambda c: trim_ws(c))


def _divider(line: Column) -> Column:
    return line.rlike(rf"^{S}*\|?[{WS}:|\-]+\|?{S}*$") & F.contains(line, F.lit("-"))


def first_table(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of the first table per document: ``row_no`` 0 is the header.

    A table is a line with a pipe followed by a divider line; it ends at the
    next line without a pipe, or the next divider. All within one row.
    """
    lines = F.split(F.col(text), "\n", -1)
    rows = docs.select(*keys, lines.alias("l"))
    last = F.size("l") - 1
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))),
        lambda i: (i < last) & F.contains(F.get("l", i), F.lit("|")) & F.coalesce(_divider(F.get("l", i + 1)), F.lit(False)),
    )
    rows = rows.withColumn("at", F.get(starts, F.lit(0))).filter(F.col("at").isNotNull())
    rest = F.slice("l", F.col("at") + 3, F.size("l"))
    rows = rows.select(*keys, F.get("l", F.col("at")).alias("head"), rest.alias("rest"))
    stop = F.array_position(
        F.transform("rest", lambda s: ~F.contains(s, F.lit("|")) | _divider(s)), True)
    body = F.when(stop > 0, F.slice("rest", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("rest"))
    table = F.concat(F.array("head"), F.filter(body, lambda s: trim_ws(s) != ""))
    return rows.select(*keys, F.posexplode(F.transform(table, _cells)).alias("row_no", "cells"))
