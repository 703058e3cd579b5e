"""Reviewer marks: the table of passages, and marks laid over page text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import WS, blank, squash_ws
from foliant.operators.intervals import interval_join, interval_lists, level_set, levels_in
from foliant.operators.scan import row_position, split_ranges
from foliant.operators.similarity import nearest_color
from foliant.session import settle


def highlight_table(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per mark; documents without marks give none."""
    rows = docs.select(*keep, "name", F.explode("highlights").alias("h"))
    return rows.select(
        *keep, F.col("name").alias("Document"), blank(F.col("h.page")).alias("Page"), blank(F.col("h.color")).alias("Colour"),
        blank(F.col("h.text")).alias("Highlight"), blank(F.col("h.context")).alias("Context"),
    )


def highlight_totals(docs: DataFrame) -> DataFrame:
    """Number of marks, and of documents that have any."""
    marked = docs.filter(F.size(F.coalesce("highlights", F.array())) > 0)
    return marked.agg(
        F.coalesce(F.sum(F.size("highlights")), F.lit(0)).cast("bigint").alias("marks"), F.countDistinct("doc_id").alias("docs"))


def highlight_lines(docs: DataFrame, max_context: int | None = None) -> DataFrame:
    """Text form of each mark for one file's listing; ``max_context`` cuts contexts (the desktop shows 280 characters)."""
    context = blank(F.col("h.context"))
    if max_context is not None:
        context = F.substring(context, 1, max_context)
    rows = docs.select("doc_id", F.posexplode("highlights").alias("i", "h"))
    line = F.concat(
        (F.col("i") + 1).cast("string"), F.lit(". ["), F.col("h.color"), F.lit('] "'), F.col("h.text"),
        F.lit('"\n   in: '), context)
    return rows.select("doc_id", "i", line.alias("line"))


def quad_boxes(points: Column, rect: Column) -> Column:
    """Boxes of a mark: one per eight quad numbers, else its bounding rectangle."""
    def quads(p: Column) -> Column:
        def box(i: Column) -> Column:
            xs, ys = (F.array(*[F.element_at(p, (i * 8 + k).cast("int")) for k in ks]) for ks in ((1, 3, 5, 7), (2, 4, 6, 8)))
            return F.struct(
                F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))

        n = F.floor(F.size(p) / 8).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), box))

    whole = F.struct(
        F.least(rect[0], rect[2]).alias("x0"), F.greatest(rect[0], rect[2]).alias("x1"),
        F.least(rect[1], rect[3]).alias("y0"), F.greatest(rect[1], rect[3]).alias("y1"))
    none = F.array().cast("array<struct<x0:double,x1:double,y0:double,y1:double>>")
    # The numbers may come from a long expression: it is worked out once, not for each use.
    return F.coalesce(_let(points, quads), F.when(F.size(rect) == 4, F.array(whole)), none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


PIECE = 4096
# The items of a key (a page, a mark) are put in order in one task up to this number.
WHOLE = 1 << 16


def reading_lines(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, line, piece, text)``: the text items of each key (a page, a mark) in reading order, line by line.

    Items belong to one line while the gap to the item above is at most 4; lines
    go top down, items of a line from left to right. (The reference compares
    pairs, which is no consistent order for sloping text.) The items of a key
    are dealt to one task and put in order there; of keys with more than WHOLE
    items, gaps, lines and places are counted over ranges of the whole order,
    so that a page with most of the items is dealt like any other. A line of
    more than PIECE items comes in several pieces. ``line`` counts from 0 in
    each key. Blank items, and items without a place, are left out. A small job
    asks at once which keys have more than WHOLE items.
    """
    keys = list(keys)
    rows = _placed(items).select(*keys, "x0", "y0", "str", (-F.col("y0")).alias("_down"))
    crowded = _crowded(rows, keys)
    if crowded is None:
        return _whole_lines(rows, keys)
    few, many = _parted(rows, crowded, keys)
    return _whole_lines(few, keys).unionByName(_ranged_lines(many, keys))


def _placed(items: DataFrame) -> DataFrame:
    return items.filter(F.col("str").rlike(f"[^{WS}]") & F.col("x0").isNotNull() & F.col("y0").isNotNull())


def _crowded(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with more than WHOLE rows, if there are any."""
    found = settle(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > WHOLE).select(*keys))
    return None if found.isEmpty() else found


def _parted(rows: DataFrame, crowded: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of other keys, and those of the crowded ones."""
    a, b, on = rows.alias("a"), crowded.alias("b"), _same_keys("a", "b", keys)
    return a.join(b, on, "left_anti"), a.join(b, on, "left_semi")


def _lines_of(items: Column) -> Column:
    """The words of each line of one key, from a sorted array of ``(_down, x0, str)``."""
    def cut(s: Column) -> Column:
        gap = lambda i: F.get(s, i - 1)["_down"] - F.get(s, i - 2)["_down"]
        return _let(F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (gap(i) > 4)), lambda starts: F.transform(
            starts, lambda at, k: F.slice(s, at, F.coalesce(F.get(starts, k + 1), F.size(s) + 1) - at)))

    def across(line: Column) -> Column:
        # What lies at one height is in order already.
        turned = F.transform(line, lambda x: F.struct(x["x0"].alias("x0"), x["_down"].alias("_down"), x["str"].alias("str")))
        level = F.get(line, F.lit(0))["_down"] == F.get(line, F.size(line) - 1)["_down"]
        return F.when(level, line["str"]).otherwise(F.sort_array(turned)["str"])

    return F.transform(_let(items, cut), across)


def _whole_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    # Dealt before they are collected: collecting first would sort all rows on both sides of the shuffle.
    pages = rows.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("_down", "x0", "str")).alias("_items"))
    found = pages.select(*keys, F.posexplode(_lines_of(F.sort_array("_items"))).alias("_i", "_w"))
    last = F.floor((F.size("_w") - 1) / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("_w", k * PIECE + 1, F.lit(PIECE)))
    cut = found.select(*keys, F.col("_i").cast("bigint").alias("line"), F.posexplode(pieces).alias("_p", "_w"))
    return cut.select(*keys, "line", F.col("_p").cast("bigint").alias("piece"), squash_ws(F.array_join("_w", " ")).alias("text"))


def _ranged_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`reading_lines` for keys of any size."""
    order = [*keys, "_down", "x0", "str"]
    down = split_ranges(settle(rows), order)
    lasts = down.groupBy("_range").agg(F.max_by(F.struct(*keys, "y0"), F.struct(*order)).alias("_t"))
    carried = lasts.select("_range", F.lag("_t").over(W.orderBy("_range")).alias("_off"))
    # One sort of each range serves the item above and the count of openings.
    local = W.partitionBy("_range").orderBy(*order)
    above = down.withColumn("_above", F.lag(F.struct(*keys, "y0")).over(local)).join(F.broadcast(carried), "_range", "left")
    above = above.withColumn("_above", F.coalesce("_above", "_off"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_above.{k}").eqNullSafe(F.col(k))
    opens = F.when(F.col("_above").isNull() | ~same | (F.col("_above.y0") - F.col("y0") > 4), 1).otherwise(0).cast("bigint")
    opened = F.sum(opens).over(local.rowsBetween(W.unboundedPreceding, 0))
    flagged = settle(above.select(*keys, "x0", "_down", "str", "_range", opened.alias("_opened")))
    totals = flagged.groupBy("_range").agg(F.max("_opened").alias("_t"))
    before = totals.select("_range", F.coalesce(F.sum("_t").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    lined = flagged.join(F.broadcast(before), "_range").select(
        *keys, "x0", "_down", "str", (F.col("_off") + F.col("_opened") - 1).alias("_line"))
    sizes = lined.groupBy(*keys, "_line").agg(F.count("*").alias("_n"))
    first = sizes.groupBy(*keys).agg(F.min("_line").alias("_first"))
    long = settle(sizes.filter(F.col("_n") > PIECE).select("_line"))
    some = not long.isEmpty()
    # A line of one piece is put in order by itself; only longer ones need places counted over ranges.
    words = F.array_sort(F.collect_list(F.struct("x0", "_down", "str")))
    short = lined.join(long, "_line", "left_anti") if some else lined
    texts = short.groupBy(*keys, "_line").agg(words.alias("_w")).withColumn("piece", F.lit(0).cast("bigint"))
    if some:
        texts = texts.select(*keys, "_line", "piece", F.col("_w.str").alias("_w")).unionByName(
            _long_lines(lined.join(long, "_line", "left_semi"), keys))
    else:
        texts = texts.select(*keys, "_line", "piece", F.col("_w.str").alias("_w"))
    return texts.alias("t").join(first.alias("f"), _same_keys("t", "f", keys)).select(
        *[F.col(f"t.{k}").alias(k) for k in keys], (F.col("_line") - F.col("_first")).alias("line"), "piece",
        squash_ws(F.array_join("_w", " ")).alias("text"))


def _long_lines(lined: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _line, piece, _w)``: the words of each piece of lines of any length."""
    placed = settle(row_position(settle(lined), ["_line", "x0", "_down", "str"], "_at"))
    heads = placed.groupBy(F.col("_line").alias("_l")).agg(F.min("_at").alias("_head"))
    found = placed.join(heads, F.col("_line") == F.col("_l"))
    piece = F.floor((F.col("_at") - F.col("_head")) / PIECE).cast("bigint")
    words = F.array_sort(F.collect_list(F.struct("_at", "str")))
    return found.groupBy(*keys, "_line", piece.alias("piece")).agg(words.alias("_w")).withColumn("_w", F.col("_w.str"))


def _same_keys(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _one_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of each key as one text: what a mark covers is one value by its nature."""
    parts = F.array_sort(F.collect_list(F.struct("line", "piece", "text")))
    return lines.groupBy(*keys).agg(squash_ws(F.array_join(F.transform(parts, lambda p: p["text"]), " ")).alias("text"))


def marked_passages(marks: DataFrame, items: DataFrame, cell: float = 32.0) -> DataFrame:
    """Text under each mark and around it.

    ``marks``: ``doc_id, page, mark_no, boxes, rgb``; ``items``: ``doc_id, page,
    str, x0, x1, y0, y1``. A text item is under a box when its middle lies
    within the box's width (one unit to spare) and the heights overlap. Marks
    and items meet on a grid of heights (``cell`` units to begin with), so that
    a page of many marks and items does not give every pair of them. What a mark
    meets is put in order in one task; on pages of more than WHOLE items, over
    ranges. A mark without text under it gives no row.
    """
    key, page = ["doc_id", "page", "mark_no"], ["doc_id", "page"]
    c = F.col
    rgb = [c("rgb")[i].cast("double") for i in range(3)]
    # Read three times, and few beside the items: written once, so that no long expression for the boxes is repeated.
    marks = settle(marks.select(*key, "boxes", nearest_color(*rgb).alias("color")))
    band = marks.select(*key, "boxes").withColumns({
        "b0": F.array_min(F.transform("boxes", lambda b: b["y0"])), "b1": F.array_max(F.transform("boxes", lambda b: b["y1"])),
    }).filter(F.size("boxes") > 0)
    written = _placed(items).select("doc_id", "page", "str", "x0", "x1", "y0", "y1")
    # One job tells the crowded pages and the levels of the grid.
    pages = settle(written.groupBy(*page).agg(F.count("*").alias("_n"), level_set((c("y0"), c("y1")), cell).alias("_set")))
    levels = levels_in(pages.agg(F.bit_or("_set")).first()[0], band.agg(level_set(_reach(), cell)).first()[0])
    crowded = pages.filter(c("_n") > WHOLE).select(*page)
    if crowded.isEmpty():
        texts = _whole_passages(band, written, cell, levels)
    else:
        (a, x), (b, y) = (_parted(rows, crowded, page) for rows in (band, written))
        texts = _whole_passages(a, b, cell, levels).unionByName(_ranged_passages(x, y, cell, key))
    return (
        marks.select(*key, "color").join(texts, key)
        .select(*key, "text", "color", blank(c("context")).alias("context"))
    )


def _reach() -> tuple[Column, Column]:
    """The heights of the surroundings of a mark."""
    return F.col("b0") - 2, F.col("b1") + 2


def _under(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    mid = (x0 + x1) / 2
    return F.exists("boxes", lambda b: (mid >= b["x0"] - 1) & (mid <= b["x1"] + 1) & (y1 > b["y0"]) & (y0 < b["y1"]))


def _whole_passages(band: DataFrame, written: DataFrame, cell: float, levels: list[int]) -> DataFrame:
    """``(key, text, context)`` of marks on pages of at most WHOLE items."""
    key = ["doc_id", "page", "mark_no"]
    low, high = _reach()
    found = interval_lists(band, written, ["doc_id", "page"], (low, high), ("y0", "y1"), cell, levels, "_met")
    around = F.transform(F.filter("_met", lambda x: (x["y1"] > low) & (x["y0"] < high)), lambda x: F.struct(
        (-x["y0"]).alias("_down"), x["x0"].alias("x0"), x["str"].alias("str"), _under(x["x0"], x["x1"], x["y0"], x["y1"]).alias("_under")))
    lists = found.select(*key, around.alias("_met")).groupBy(*key).agg(F.flatten(F.collect_list("_met")).alias("_met"))
    lists = lists.filter(F.exists("_met", lambda x: x["_under"]))
    text = lambda items: squash_ws(F.array_join(F.flatten(_lines_of(items)), " "))
    both = _let(F.sort_array("_met"), lambda s: F.struct(
        text(F.filter(s, lambda x: x["_under"])).alias("text"), text(s).alias("context")))
    # Words are not blank, so neither are the texts: a condition on them would have them made twice.
    return lists.select(*key, both.alias("_t")).select(*key, "_t.text", "_t.context")


def _ranged_passages(band: DataFrame, written: DataFrame, cell: float, key: list[str]) -> DataFrame:
    """``(key, text, context)`` of marks on pages of any size."""
    c = F.col
    low, high = _reach()
    pairs = interval_join(band, written, ["doc_id", "page"], (low, high), (c("y0"), c("y1")), cell)
    pairs = pairs.filter((c("y1") > low) & (c("y0") < high))
    pairs = settle(pairs.select(*key, "str", "x0", "y0", _under(c("x0"), c("x1"), c("y0"), c("y1")).alias("_under")))
    text = _one_text(reading_lines(pairs.filter("_under"), key), key)
    around = _one_text(reading_lines(pairs, key), key).withColumnRenamed("text", "context")
    return text.join(around, key, "left")
