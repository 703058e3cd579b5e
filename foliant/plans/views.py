"""Document-set tables derived from the given parquet tables.

Orders stand for emails, line items for their attachments, parts for file
names, customers for conversations; ``documents`` is the text corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.hashing import hex_to_long
from foliant.functions.text import conversation_key, iso_date

ATT_ORDER = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts. One small file is one task, so it is spread first."""
    rows = table(spark, sf_dir, name)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    if status.isFile() and status.getLen() < 256 << 20:
        return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows


def spread(rows: DataFrame) -> DataFrame:
    """Rows that cost much work each, dealt over four times as many tasks as there are cores: a file may be one row group."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return texts(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.col("source").alias("collection"), name.alias("name"),
        F.concat_ws("/", F.lit("/vault"), F.col("source"), F.col("lang"), name).alias("path"),
    )


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    lead = F.element_at(F.array(F.lit(""), F.lit("RE: "), F.lit("Fwd: re :"), F.lit("AW: Tr:")), (c("o_orderkey") % 4 + 1).cast("int"))
    subject = F.when(c("o_orderkey") % 11 == 0, "").otherwise(
        F.concat(lead, F.lit("Account  "), c("o_custkey").cast("string"))
    )
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("doc_id"), c("o_custkey").alias("conv"), subject.alias("subject"),
        F.concat(F.lit("clerk"), (c("o_orderkey") % 7).cast("string"), F.lit("@a.example")).alias("from"),
        F.concat(F.lit("c"), c("o_custkey").cast("string"), F.lit("@b.example")).alias("to"),
        iso_date(c("o_orderdate")).alias("date"), c("o_orderpriority").alias("priority"),
        (1 + c("o_orderkey") % 3).cast("bigint").alias("pages"), c("o_totalprice").alias("total"),
    )


DIGITS = "0123456789abcdef"


def last_digit(supplier: Column) -> Column:
    return F.substring(F.lit(DIGITS), (supplier % 16 + 1).cast("int"), F.lit(1))


def image_hash(part: Column, supplier: Column) -> Column:
    """A stand-in for the hash of a decoded picture: look-alikes differ in the last digit."""
    return F.concat(F.substring(F.md5((part % 400).cast("string").cast("binary")), 1, 15), last_digit(supplier))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment rows with their conversation; the size filter and columns reach the scans.

    ``ord`` sorts like ``ATT_ORDER``: what comes after the line number only
    tells lines of one number apart, so its rank among these stands for it.
    """
    c = F.col
    rank = F.rank().over(W.partitionBy(*ATT_ORDER[:2]).orderBy(*ATT_ORDER[2:]))
    items = table(spark, sf_dir, "lineitem").select(*ATT_ORDER)
    mails = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("conv"))
    # All digits of the picture's hash but the last come from the part: once for each part, not for each line.
    parts = table(spark, sf_dir, "part").select(
        c("p_partkey").alias("l_partkey"), F.lower("p_name").alias("name"), hex_to_long(image_hash(c("p_partkey"), F.lit(0))).alias("look"))
    img = c("l_partkey") % 2 == 0
    digit = (F.instr(F.lit(DIGITS), last_digit(c("l_suppkey"))) - 1).cast("bigint")
    # Ranked where the first join has put the lines of a mail together; short columns go into the second.
    lines = items.join(mails, "l_orderkey").withColumn("rank", rank).select(
        "l_orderkey", "conv", "l_partkey", "l_suppkey", "l_linenumber", "rank",
        F.floor("l_extendedprice").cast("bigint").alias("size"), c("l_quantity").cast("bigint").alias("pages"))
    return lines.join(parts, "l_partkey").select(
        c("l_orderkey").alias("doc_id"), "conv", "name", "size",
        F.concat_ws("-", c("l_partkey").cast("string"), c("l_suppkey").cast("string")).alias("sha"),
        F.when(img, c("look").bitwiseOR(digit)).alias("dhash"), img.alias("img"), "pages",
        (c("l_linenumber") == 1).alias("inline"), c("l_partkey").alias("part_id"),
        F.struct(*ATT_ORDER[:2], "rank").alias("ord"),
    )


def family_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and attachments as one record table; every 37th attachment failed."""
    c = F.col
    heads = emails(spark, sf_dir)
    conv = conversation_key(c("subject"), c("doc_id"))
    none = F.lit(None)
    head_rows = heads.select(
        c("doc_id").alias("family"), F.lit(0).alias("child"), none.cast("bigint").alias("part_id"),
        none.cast("bigint").alias("supp_id"), none.cast("timestamp").alias("ship"), none.cast("double").alias("qty"),
        none.cast("double").alias("price"), none.cast("double").alias("disc"), none.cast("double").alias("tax"),
        none.cast("string").alias("rf"), none.cast("string").alias("ls"),
        c("pages").alias("span"), "pages", "subject", F.lit("Email").alias("doc_type"), "date", "from", "to", conv.alias("conv"),
        F.concat(F.lit("Documents/"), c("doc_id").cast("string"), F.lit(".pdf")).alias("file_rel"),
    )
    kid = F.when(c("l_partkey") % 37 == 0, F.lit(0)).otherwise(c("l_quantity")).cast("bigint")
    kids = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("family"), c("l_linenumber").alias("child"), c("l_partkey").alias("part_id"),
        c("l_suppkey").alias("supp_id"), c("l_shipdate").alias("ship"), c("l_quantity").alias("qty"),
        c("l_extendedprice").alias("price"), c("l_discount").alias("disc"), c("l_tax").alias("tax"),
        c("l_returnflag").alias("rf"), c("l_linestatus").alias("ls"),
        kid.alias("span"), kid.alias("pages"),
        F.concat(F.lit("part "), c("l_partkey").cast("string")).alias("subject"), F.lit("Attachment").alias("doc_type"),
        iso_date(c("l_shipdate")).alias("date"), F.lit("").alias("from"), F.lit("").alias("to"), F.lit("").alias("conv"),
        F.concat(F.lit("Documents/"), c("l_orderkey").cast("string"), F.lit("/"), c("l_partkey").cast("string"), F.lit(".pdf")).alias("file_rel"),
    )
    return head_rows.unionByName(kids)


RECORD_ORDER = ("family", "child", "part_id", "supp_id", "ship", "qty", "price", "disc", "tax", "rf", "ls")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 sign bits of each embedding, and three variants with a few bits flipped."""
    bits = F.aggregate(
        "embedding", F.lit(0).cast("bigint"),
        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
    )
    flips = F.array(*[F.lit(v).cast("bigint") for v in (0, 0x7, 0x3F00, 0x7FF00000)])
    return (
        table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("base"), F.posexplode(flips).alias("variant", "flip"))
        .select("vec_id", "variant", F.col("base").bitwiseXOR(F.col("flip")).alias("hash"))
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the document set: every 17th gone, 13th edited, 19th also added anew."""
    c = F.col
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    previous = docs.select(
        "doc_id", c("doc_id").cast("string").alias("path"), (c("doc_id") % 1000).alias("mtime"),
        c("n_chars").alias("size"), F.when(c("doc_id") % 29 == 0, 0).otherwise(c("n_chars")).alias("text_chars"), "text",
    )
    edited = c("doc_id") % 13 == 0
    kept = docs.filter(c("doc_id") % 17 != 0).select(
        "doc_id", c("doc_id").cast("string").alias("path"),
        F.when(edited, c("doc_id") % 1000 + 1).otherwise(c("doc_id") % 1000).alias("mtime"), c("n_chars").alias("size"),
        F.when(edited, F.concat("text", F.lit(" amended clause"))).otherwise(c("text")).alias("text"),
    )
    added = docs.filter(c("doc_id") % 19 == 0).select(
        (c("doc_id") + 1_000_000).alias("doc_id"), (c("doc_id") + 1_000_000).cast("string").alias("path"),
        (c("doc_id") % 1000).alias("mtime"), c("n_chars").alias("size"), "text",
    )
    return previous, kept.unionByName(added)


# The phases of a run, and the phase each event type stands for.
PHASE_OF = {
    "view": "Reading documents", "click": "Scanning for repeated logos", "signup": "Checking for changes",
    "purchase": "Rendering documents", "error": "Cleaning up",
}


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_columns(table(spark, sf_dir, "events"))


def progress_columns(events: DataFrame) -> DataFrame:
    c = F.col
    phase = F.create_map(*[F.lit(x) for pair in PHASE_OF.items() for x in pair])
    return events.select(
        c("user_id").alias("collection"), "ts", "event_id", F.element_at(phase, c("event_type")).alias("phase"),
        F.floor("value").cast("bigint").alias("done"), F.lit(400).cast("bigint").alias("total"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract-like texts: document lines as numbered sections, with clauses added by id."""
    c = F.col
    n = c("doc_id")
    lines = F.transform(
        F.split("text", "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(". "), line)
    )
    lang = F.initcap("lang")
    add = F.array(
        F.when(n % 2 == 0, F.concat(F.lit('"'), lang, F.lit(' Fee" means the amount in Section '), (n % 9 + 1).cast("string"), F.lit("."))).otherwise(""),
        F.when(n % 3 == 0, F.concat(F.lit('The charge (the "'), lang, F.lit(' Fee") is due. See Section '), (n % 23 + 1).cast("string"), F.lit(".4 and Exhibit B."))).otherwise(""),
        F.when(n % 4 == 0, F.lit("Exhibit A\nClause 2 and Schedule C apply on [DATE], fee [TBD].")).otherwise(""),
        F.when(n % 5 == 0, F.lit("IN WITNESS WHEREOF the parties sign. ____")).otherwise(""),
    )
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n"), F.array_join(add, "\n"))
    return texts(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
