"""Shards of bounded size by extendible hashing.

A directory is indexed by the leading bits of a document's hash. Only a bucket
that is larger than the limit takes another bit; all others keep their depth.
Sizes are first added up per cell of a depth that fits the total, the cells are
rolled up to every shallower depth, and a cell takes the first depth whose
bucket fits. The few rows of cells that are still too large go on to deeper
bits, round by round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import text_of
from foliant.operators.scan import running_sum
from foliant.session import settle

HASH_BITS = 60
#: Cells of the first directory are at most 2 ** this; later rounds go deeper where it is needed.
FIRST_DEPTH = 22
ROUND_BITS = 8


def hash_bits(key: Column) -> Column:
    """60 bits of the MD5 digest of the key's text form."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright(F.col("h"), HASH_BITS - depth)


def _leaves(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """``(cell, depth, bytes, rows)``: the shallowest fitting bucket over each depth-``high`` cell, depths from ``low``.

    A bucket of one row cannot be split and counts as fitting. Cells without a fitting bucket have no row.
    """
    cells = rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    up = cells.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "cell", "bytes", "rows").withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)")
    )
    fits = (
        up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        .filter((F.col("bytes") <= limit) | (F.col("rows") == 1))
    )
    mine = up.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"])
    return mine.groupBy("cell").agg(F.min(F.struct("depth", "bytes", "rows")).alias("m")).select("cell", "m.*")


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, shard, local_depth, shard_bytes, shard_rows)`` for every row of ``docs``.

    ``shard`` is ``b`` and the bits of the bucket. No shard is above
    ``limit_bytes`` unless it holds a single row that is larger by itself.
    Rows whose ids are equal have equal hashes and cannot be told apart by more
    bits; where such rows exceed the limit they are packed into overflow pages
    (``b<bits>+<page>``) in order of size. Null texts have size zero, a null id
    is hashed like the text ``null``, an empty table gives no rows, and other
    columns are ignored.
    """
    rows = settle(
        docs.select(
            F.col(id_col).alias("_id"), F.octet_length(text_of(text_col)).cast("long").alias("size"),
            hash_bits(F.col(id_col)).alias("h"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    low, high = 0, min(FIRST_DEPTH, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + 4)
    done, left = None, rows
    while True:
        leaves = settle(_leaves(left, low, high, limit_bytes))
        cell = left.withColumn("cell", _prefix(high))
        out = cell.join(leaves, "cell").select(
            "_id", "size", F.concat(F.lit("b"), F.expr(f"if(depth = 0, '', lpad(bin(shiftright(h, {HASH_BITS} - depth)), depth, '0'))")).alias("shard"),
            F.col("depth").alias("local_depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"),
        )
        done = out if done is None else done.unionByName(out)
        left = settle(cell.join(leaves, "cell", "left_anti").drop("cell"))
        if left.isEmpty():
            break
        if high == HASH_BITS:
            done = done.unionByName(_overflow(left, limit_bytes))
            break
        low, high = high + 1, min(HASH_BITS, high + ROUND_BITS)
    return done.select(
        F.col("_id").alias(id_col), F.col("size").alias("n_bytes"), "shard", "local_depth", "shard_bytes", "shard_rows"
    )


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for rows with equal hashes, cut where the running size passes a multiple of the limit.

    A row that lies across a multiple has a page of its own, so no page of several rows is above the limit.
    """
    own = settle(rows.withColumn("uid", F.monotonically_increasing_id()))
    run = running_sum(own, ["h", "size", "uid"], F.col("size"), "before")
    page = F.floor(F.col("before") / limit)
    across = F.floor((F.col("before") + F.greatest(F.col("size") - 1, F.lit(0))) / limit) > page
    named = settle(
        run.withColumn("shard", F.concat(F.lit("b"), F.lpad(F.bin("h"), HASH_BITS, "0"), F.lit("+"), 2 * page + across.cast("int")))
    )
    sizes = named.groupBy("shard").agg(F.sum("size").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return named.join(sizes, "shard").select(
        "_id", "size", "shard", F.lit(HASH_BITS).alias("local_depth"), "shard_bytes", "shard_rows"
    )


def directory(shards: DataFrame, global_depth: int | None = None) -> DataFrame:
    """``(entry, shard)``: the directory of the result of :func:`assign_shards`, one row per value of the global prefix;
    values under which no document lies have none.

    The global depth is the largest local depth unless it is given; overflow pages hang below their bucket's entry.
    """
    leaves = shards.select(F.regexp_extract("shard", r"^b([01]*)", 1).alias("bits"), "local_depth").distinct()
    depth = global_depth if global_depth is not None else (leaves.agg(F.max("local_depth")).first()[0] or 0)
    first = F.coalesce(F.conv(F.col("bits"), 2, 10).cast("long"), F.lit(0).cast("long"))
    width = F.expr(f"shiftleft(1L, {depth} - local_depth)")
    entry = F.explode(F.sequence(first * width, (first + 1) * width - 1))
    return leaves.filter(F.col("local_depth") <= depth).select(
        entry.alias("entry"), F.concat(F.lit("b"), "bits").alias("shard")
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of ``docs`` as Parquet, one folder a shard. Ids must be unique in ``shards``."""
    tag = shards.select(F.col(id_col).alias("_id"), F.col("shard").alias("shard_id"))
    (
        docs.join(tag, docs[id_col].eqNullSafe(tag["_id"])).drop("_id")
        .repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    )
