"""Load-file formats: CSV, Concordance DAT and Opticon OPT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import blank

QUALIFIER = "þ"
SEPARATOR = "\u0014"
BOM = "\ufeff"


def csv_cell(value: Column, variant: str = "desktop") -> Column:
    """Quoted only where needed; the browser form does not look at carriage returns."""
    special = '[",\n]' if variant == "web" else '[",\r\n]'
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike(special), quoted).otherwise(value)


def _with_any(value: Column, chars: str, cleaned: Column) -> Column:
    """``cleaned`` where one of ``chars`` occurs; a search for a character costs far less than a pattern."""
    hit = F.contains(value, F.lit(chars[0]))
    for ch in chars[1:]:
        hit = hit | F.contains(value, F.lit(ch))
    return F.when(hit, cleaned).otherwise(value)


def dat_cell(value: Column, variant: str = "desktop") -> Column:
    if variant == "web":
        inner = F.replace(value, F.lit(QUALIFIER), F.lit(""))
    else:
        cleaned = F.regexp_replace(F.regexp_replace(value, f"[{QUALIFIER}{SEPARATOR}]", ""), "[\r\n]+", " ")
        inner = _with_any(value, f"{QUALIFIER}{SEPARATOR}\r\n", cleaned)
    return F.concat(F.lit(QUALIFIER), inner, F.lit(QUALIFIER))


def opt_cell(value: Column) -> Column:
    return _with_any(value, ",\r\n", F.regexp_replace(value, "[,\r\n]+", " "))


_FORMS = {
    "csv": (csv_cell, ",", True), "dat": (dat_cell, SEPARATOR, True),
    "opt": (lambda value, variant: opt_cell(value), ",", False),
}


def lines(table: DataFrame, form: str, columns: Sequence[str], variant: str = "desktop") -> Column:
    """One output line per row of ``table``."""
    cell, sep, _ = _FORMS[form]
    return F.concat_ws(sep, *[cell(blank(F.col(f"`{c}`")), variant) for c in columns])


def header_line(form: str, columns: Sequence[str]) -> str:
    if form == "dat":
        return SEPARATOR.join(f"{QUALIFIER}{c}{QUALIFIER}" for c in columns)
    return ",".join(c if not set(c) & set('",\r\n') else '"' + c.replace('"', '""') + '"' for c in columns)


def write_lines(
    table: DataFrame, path: str, form: str, order: Sequence[str], columns: Sequence[str] | None = None,
    variant: str = "desktop", single_file: bool = False,
) -> None:
    """Write a load file as ordered part files (or as one file, if asked).

    Rows are range-sorted by ``order``, so part files read in name order give
    the file. The header, led by the byte order mark of the format, is a row of
    its own that sorts first; Opticon has neither. ``single_file`` is for sets
    small enough to be written by one task.
    """
    columns = list(columns or [c for c in table.columns if c not in order])
    spark = table.sparkSession
    body = table.select(F.lit(1).alias("_h"), *order, lines(table, form, columns, variant).alias("value"))
    if _FORMS[form][2]:
        mark = "" if variant == "web" and form == "dat" else BOM
        head = spark.createDataFrame([(0, mark + header_line(form, columns))], "_h int, value string")
        body = head.unionByName(body, allowMissingColumns=True)
    rows = body.orderBy("_h", *order).select("value")
    if single_file:
        rows = rows.coalesce(1)
    web_csv = variant == "web" and form == "csv"
    rows.write.mode("overwrite").option("lineSep", "\n" if web_csv else "\r\n").text(path)
