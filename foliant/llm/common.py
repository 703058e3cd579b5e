"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, other letters as they are; texts of one byte a character take the quick path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_row, _id, _text)``: whole rows beside their id and text, so that columns of any name pass through."""
    return docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text")
    )


def unpacked(columns: list[str], but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a packed row, without those named in ``but``."""
    return [F.col("_row").getField(c).alias(c) for c in columns if c not in but]


def hash_sample(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """At most ``n`` rows of ``df``, those with the smallest hashes of ``key``.

    The row count gives a threshold that about ``n`` and a fifth more rows fall
    below, so what the tasks send on is bounded by ``n`` and not by their number.
    """
    h = F.xxhash64(*key)
    share = 1.2 * n / max(1, df.count())
    if share < 1:
        low = -(1 << 63)
        df = df.filter(h < low + int(share * (1 << 64)))
    return df.orderBy(h, *key).limit(n)


def spread(spark: SparkSession) -> int:
    """How many parts a hot key is dealt over: as many as a shuffle has."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
