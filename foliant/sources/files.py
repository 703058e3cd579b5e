"""File scans: which files belong to a document set, and their plain text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators.scan import running_sum
from foliant.session import settle

# Extensions read straight as UTF-8 text.
PLAIN_TEXT = (".txt", ".md", ".csv", ".tsv", ".json", ".log", ".xml", ".html", ".htm", ".yml", ".yaml", ".rtf")


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def scan_files(spark: SparkSession, roots: Sequence[str], with_content: bool = False, max_depth: int | None = None) -> DataFrame:
    """Files below the roots: ``root, path, name, size, mtime[, content]``.

    Dot entries and ``node_modules`` below a root are skipped, as is everything
    deeper than ``max_depth`` folders, if given (the desktop goes eight down). A root may be a file; one that does not exist is
    skipped. Without ``with_content`` no file is opened.
    """
    out = None
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for i, root in enumerate(roots):
        where = jvm.org.apache.hadoop.fs.Path(root)
        if not where.getFileSystem(conf).exists(where):
            continue
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        top = root.rstrip("/")
        path = _local(F.col("path"))
        rows = rows.select(
            F.lit(i).alias("root_no"), F.lit(top).alias("root"), path.alias("path"), F.col("length").alias("size"),
            F.unix_millis("modificationTime").alias("mtime"), *(["content"] if with_content else []),
        )
        rel = F.substring("path", len(top) + 2, 1 << 20)
        parts = F.filter(F.split(rel, "/"), lambda p: p != "")
        skipped = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | (p == "node_modules"))
        near = F.lit(True) if max_depth is None else F.size(parts) - 1 <= max_depth
        rows = rows.filter((F.col("path") == top) | (~skipped & near))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        schema = "root_no int, root string, path string, size bigint, mtime bigint, name string"
        return spark.createDataFrame([], schema + (", content binary" if with_content else ""))
    return out.withColumn("name", text.base_name(F.col("path")))


def skeleton(files: DataFrame) -> DataFrame:
    """Document rows before any text is read: id, names, kind and title."""
    name = text.base_name(F.col("path"))
    ext = text.extension(name)
    rows = files.withColumn("name", name).withColumn("ext", ext).withColumn("id", text.path_id(F.col("path")))
    email = F.col("ext") == ".eml"
    return rows.withColumn("kind", F.when(email, "email").otherwise("doc")).withColumn(
        "title", F.when(~email, text.stem(F.col("name")))
    )


# Extensions the browser indexes; it leaves other files out.
WEB_INDEXABLE = (
    ".eml", ".msg", ".pdf", ".docx", ".xlsx", ".xls", ".pptx", ".ppsx", ".ppt",
    ".txt", ".md", ".csv", ".tsv", ".json", ".log", ".xml", ".html", ".htm", ".yml", ".yaml", ".rtf",
)


def indexable(files: DataFrame, variant: str = "desktop") -> DataFrame:
    """The files that are indexed: all of them, or in the browser variant those of a known extension."""
    return files.filter(text.extension(F.col("name")).isin(*WEB_INDEXABLE)) if variant == "web" else files


def plain_text(files: DataFrame, variant: str = "desktop") -> DataFrame:
    """Add ``text``: UTF-8 text for known extensions, else an empty string.

    The browser variant leaves out files it does not index and strips the
    markup of saved web pages.
    """
    ext = text.extension(F.col("name"))
    body = F.decode("content", "UTF-8")
    if variant == "web":
        body = F.when(ext.isin(".html", ".htm"), text.html_to_text(body, "web_file")).otherwise(body)
    return indexable(files, variant).withColumn("text", F.when(ext.isin(*PLAIN_TEXT), body).otherwise(""))


CHUNK = 1 << 20


def source_chunks(docs: DataFrame, by: Sequence[str] = ("matter",), size: int = CHUNK) -> DataFrame:
    """``(by, chunk, text)``: all non-empty texts of a matter, in name order, joined by blank lines, in pieces.

    Chunks in order give the joined text; each has ``size`` characters but the
    last. Where a text begins is a running sum over ranges of the whole order,
    so a matter of any size is dealt over its chunks, and a very long text over
    several of them.
    """
    by = list(by)
    rows = docs.filter(F.length("text") > 0).select(*by, "name", "text")
    rows = settle(rows.withColumn("_i", F.monotonically_increasing_id()))
    sized = rows.select(*by, "name", "_i", (F.length("text") + 2).cast("bigint").alias("_w"))
    starts = settle(running_sum(settle(sized), [*by, "name", "_i"], F.col("_w"), "_before"))
    heads = starts.groupBy(*by).agg(F.min("_before").alias("_head"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"h.{k}"))
    at = starts.alias("s").join(heads.alias("h"), same).select("s._i", (F.col("_before") - F.col("_head")).alias("_at"))
    found = rows.join(at, "_i")
    later = F.col("_at") > 0
    found = found.withColumns({
        "_from": F.when(later, F.col("_at") - 2).otherwise(F.lit(0)), "_body": F.when(later, F.concat(F.lit("\n\n"), "text")).otherwise(F.col("text")),
    })
    last = F.col("_from") + F.length("_body") - 1
    cut = found.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor(last / size))))
    lo = F.greatest(F.col("chunk") * size - F.col("_from"), F.lit(0))
    hi = F.least((F.col("chunk") + 1) * size - F.col("_from"), F.length("_body"))
    piece = F.substring("_body", (lo + 1).cast("int"), (hi - lo).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct((F.col("_from") + lo).alias("at"), piece.alias("piece"))))
    return cut.groupBy(*by, "chunk").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))
