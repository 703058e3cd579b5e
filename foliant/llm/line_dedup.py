"""Exact line de-duplication that returns bitmaps of the lines to keep, not texts.

Line keys are hashed to 128 bits, dealt out by ranges of (hash, salt) and sorted
inside each range by document and position, so that one pass over the sorted
rows meets every document of a key once. A salt taken from the document spreads
a key that many documents share over all ranges; its parts are added up
afterwards. What comes back per document is a run-length bitmap of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import lower_ascii, packed, spread, strip_blanks, text_of, unpacked
from foliant.session import settle


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(doc, tag, pos, k1, k2)`` for each line whose key has ``min_chars`` code points.

    ``tag`` is a hash of the whole text, so rows that share an id keep bitmaps of their own.
    """
    text = text_of(text_col)
    lines = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("tag"), F.posexplode(_lines(text)).alias("pos", "line")
    )
    long = lines.filter(F.length(strip_blanks(F.col("line"))) >= min_chars)
    key = lower_ascii(strip_blanks(F.col("line")))
    return long.select(
        "doc", "tag", "pos", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2")
    )


def first_occurrences(keys: DataFrame, min_docs: int, keep: str) -> DataFrame:
    """``(k1, k2, home)`` for each key found in ``min_docs`` documents; ``home`` is the one that keeps its lines.

    A null id counts as one document that sorts before all others.
    """
    n = spread(keys.sparkSession)
    ranged = keys.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(n))).repartitionByRange("k1", "k2", "salt")
    doc = F.col("doc").desc_nulls_last() if keep == "last" else F.col("doc").asc_nulls_first()
    stream = W.partitionBy("k1", "k2", "salt").orderBy(doc, "pos")
    top = F.max if keep == "last" else F.min
    # The sorted rows are streamed: a row opens a document if the row before it is of another one.
    parts = (
        ranged.withColumn("fresh", (F.row_number().over(stream) == 1) | ~F.lag("doc").over(stream).eqNullSafe(F.col("doc")))
        .groupBy("k1", "k2", "salt")
        .agg(F.count_if("fresh").alias("n"), top("doc").alias("home"), F.bool_or(F.col("doc").isNull()).alias("none"))
    )
    return (
        parts.groupBy("k1", "k2")
        .agg(F.sum("n").alias("n"), top("home").alias("home"), F.bool_or("none").alias("none"))
        .filter(F.col("n") >= min_docs)
        .select("k1", "k2", F.when(F.lit(keep == "last") | ~F.col("none"), F.col("home")).alias("home"))
    )


def _runs(positions: Column) -> Column:
    """Sorted positions as ``(start, length)`` runs."""
    last = F.size(positions) - 1
    starts = F.filter(positions, lambda p, i: (i == 0) | (F.get(positions, i - 1) != p - 1))
    ends = F.filter(positions, lambda p, i: (i == last) | (F.get(positions, i + 1) != p + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    keep: str = "last",
) -> DataFrame:
    """``(doc, tag, dropped_runs)`` for each document that loses lines.

    A line's key is the line without blanks at its ends and with A-Z in lower
    case. Keys of at least ``min_chars`` code points found in ``min_docs``
    documents lose their lines in every document but the ``keep`` ("last":
    largest id, "first": smallest id) one. ``dropped_runs`` is the bitmap in
    run-length form: the lines inside the runs go, all others stay.

    Null and empty texts have one empty line. Rows that share an id count as
    one document, and equal rows get equal bitmaps. A very long text is cut
    into lines like any other, an empty table gives no bitmaps, and other
    columns are ignored.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    keys = settle(line_keys(docs, id_col, text_col, min_chars))
    # Written first: a join of two written tables can deal a hot key's rows over several tasks.
    homes = settle(first_occurrences(keys, min_docs, keep))
    dropped = keys.join(homes, ["k1", "k2"]).filter(~F.col("doc").eqNullSafe(F.col("home")))
    return dropped.groupBy("doc", "tag").agg(_runs(F.sort_array(F.collect_set("pos"))).alias("dropped_runs"))


def kept_lines(text: Column, runs: Column) -> Column:
    """The lines of ``text`` that lie outside ``runs``, in order."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"])
    mask = F.flatten(
        F.transform(
            runs,
            lambda r, i: F.concat(
                F.array_repeat(F.lit(True), r["start"] - before(i)), F.array_repeat(F.lit(False), r["length"])
            ),
        )
    )
    return F.filter(_lines(text), lambda _, i: F.coalesce(F.get(mask, i), F.lit(True)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added or replaced, from the bitmaps of :func:`keep_bitmaps`."""
    text, rows = F.col("_text"), packed(docs, id_col, text_col)
    b = bitmaps.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.col("dropped_runs").alias("_runs"))
    found = rows.join(b, F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_tag")), "left")
    gone = F.coalesce(F.aggregate(F.col("_runs"), F.lit(0), lambda s, r: s + r["length"]), F.lit(0)).cast("long")
    kept = F.when(F.col("_runs").isNull(), text).otherwise(F.array_join(kept_lines(text, F.col("_runs")), "\n"))
    return found.select(
        *unpacked(docs.columns, ("n_lines", "n_dropped", "kept_text")), F.size(_lines(text)).cast("long").alias("n_lines"),
        gone.alias("n_dropped"), kept.alias("kept_text"),
    )
