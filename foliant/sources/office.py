"""Office Open XML files as rows: slide, sheet and document text, and marked runs."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import squash_ws
from foliant.operators.scan import previous_row, running_sum, split_ranges
from foliant.session import settle

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xml(box: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(box.read(name))


def _slides(box: zipfile.ZipFile) -> list[str]:
    found = {int(m[1]): n for n in box.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
    out = []
    for number in sorted(found):
        runs = [(t.text or "").strip() for t in _xml(box, found[number]).iter(f"{_A}t")]
        out.append("\n".join(r for r in runs if r))
    return out


def _sheets(box: zipfile.ZipFile) -> list[str]:
    names = set(box.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(box, "xl/sharedStrings.xml")]
    links = {r.get("Id"): r.get("Target") for r in _xml(box, "xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in _xml(box, "xl/workbook.xml").iter(f"{_S}sheet"):
        rows = [f"# Sheet: {sheet.get('name')}"]
        target = links[sheet.get(f"{_R}id")].lstrip("/")
        for row in _xml(box, target if target.startswith("xl/") else f"xl/{target}").iter(f"{_S}row"):
            cells: list[str] = []
            for cell in row.iter(f"{_S}c"):
                letters = re.match("[A-Z]+", cell.get("r") or "")
                at = 0
                for ch in letters[0] if letters else "":
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                value = cell.find(f"{_S}v")
                if cell.get("t") == "s":
                    cells.append(shared[int(value.text)])
                elif cell.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in cell.iter(f"{_S}t")))
                else:
                    cells.append((value.text or "") if value is not None else "")
            if cells:
                rows.append("\t".join(cells))
        out.append("\n".join(rows) + "\n")
    return out


def _paragraphs(box: zipfile.ZipFile) -> list[str]:
    return ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in _xml(box, "word/document.xml").iter(f"{_W}p")]


# How the parts of each format are joined again.
_KINDS = {".pptx": (_slides, "\n\n"), ".ppsx": (_slides, "\n\n"), ".xlsx": (_sheets, "\n"), ".docx": (_paragraphs, "\n\n")}


def office_parts(files: DataFrame) -> DataFrame:
    """``path, part_no, text, error``: one row per slide, sheet or paragraph."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                kind = _KINDS.get("." + path.rsplit(".", 1)[-1].lower())
                if kind is None:
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as box:
                        rows += [(path, i, part, "") for i, part in enumerate(kind[0](box))]
                except Exception as e:  # one bad file does not stop the run
                    rows.append((path, 0, "", str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "part_no", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, part_no int, text string, error string")


def office_text(parts: DataFrame) -> DataFrame:
    """Parts of one file joined in order; the file was read by one task already."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part_no", "text"))), lambda p: p["text"])
    blank_line = F.lower("path").rlike(r"\.(pptx|ppsx|docx)$")
    return parts.groupBy("path").agg(ordered.alias("p")).select(
        "path", F.when(blank_line, F.array_join("p", "\n\n")).otherwise(F.array_join("p", "\n")).alias("text"))


def highlight_runs(files: DataFrame) -> DataFrame:
    """Text runs of Word files: ``path, para, run, text, color, breaks, context, error``.

    A file that cannot be read gives one row without a run, with the error noted.
    """

    def colour(run) -> str:
        props = run.find(f"{_W}rPr")
        if props is None:
            return ""
        pen, shade = props.find(f"{_W}highlight"), props.find(f"{_W}shd")
        value = pen.get(f"{_W}val") if pen is not None else None
        if value and value != "none":
            return value
        fill = shade.get(f"{_W}fill") if shade is not None else None
        return f"#{fill}" if fill and fill.lower() not in ("auto", "ffffff") else ""

    def words(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    def run_rows(frames):
        import pandas as pd

        names = ["path", "para", "run", "text", "color", "breaks", "context", "error"]
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as box:
                        for i, para in enumerate(_xml(box, "word/document.xml").iter(f"{_W}p")):
                            for j, run in enumerate(para.iter(f"{_W}r")):
                                breaks = len(list(run.iter(f"{_W}lastRenderedPageBreak"))) + sum(
                                    b.get(f"{_W}type") == "page" for b in run.iter(f"{_W}br"))
                                rows.append((path, i, j, words(run), colour(run), breaks, words(para), None))
                except Exception as e:  # one bad file does not stop the run
                    rows.append((path, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(
        run_rows, "path string, para int, run int, text string, color string, breaks int, context string, error string")


def highlight_passages(runs: DataFrame) -> DataFrame:
    """Merge neighbouring marked runs of one colour into passages with a page.

    A passage ends where the colour changes, at a plain run, or with the
    paragraph; one without text is left out. The page is that of its first
    text: one more than the page breaks of the file up to it. Breaks and
    passages are counted over ranges of all runs, so that a file of any length
    is dealt like any other. Runs that could not be read are left out.
    """
    c = F.col
    known = runs.filter(c("para").isNotNull()).withColumn("_paint", F.coalesce("color", F.lit("")))
    order = ["path", "para", "run"]
    # Files are read once, not again for the sample of the ranges.
    rows = settle(split_ranges(settle(known), order))
    paged = running_sum(rows, order, c("breaks").cast("bigint"), "_breaks", tagged=True).withColumn("_upto", c("_breaks") + c("breaks"))
    before = previous_row(settle(paged.drop("_breaks")), order, ["path", "para", "_paint"], "_p", tagged=True)
    same = (c("_p.path") == c("path")) & (c("_p.para") == c("para")) & (c("_p._paint") == c("_paint"))
    flagged = settle(before.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1).cast("bigint")).drop("_p"))
    groups = running_sum(flagged, order, c("_new"), "_g", tagged=True).withColumn("_g", c("_g") + c("_new"))
    # Breaks of earlier files do not count: what was there before the file's first run.
    heads = flagged.groupBy("path").agg(F.min(c("_upto") - c("breaks")).alias("_head"))
    merged = groups.filter("_paint <> ''").groupBy("path", "para", "_g", "color").agg(
        F.min("run").alias("run"), F.first("context").alias("context"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda r: r["text"]), "").alias("text"),
        F.min_by("_upto", F.struct(F.when(F.length("text") > 0, 0).otherwise(1), F.col("run"))).alias("_upto"),
    )
    done = merged.withColumn("text", squash_ws(c("text"))).filter(c("text") != "").join(heads, "path")
    return done.select(
        "path", "para", "run", "text", "color", squash_ws(c("context")).alias("context"), (c("_upto") - c("_head") + 1).alias("page"))
