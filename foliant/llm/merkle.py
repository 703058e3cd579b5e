"""Merkle manifest of a dataset: one tree for each group of rows, and one over the groups.

Rows become leaves, a number of consecutive nodes of a group (the fanout)
becomes their parent, and what remains of each group is a leaf of the top tree.
Each level is one slot pivot: rows are grouped by their parent and conditional
aggregates spread the children into ``fanout`` columns. All columns together,
concatenated, give the parent's hash; all but a child's own column are its
siblings. The way down joins each level's pivot with the paths of the level
above, so a row meets its whole proof with one join a level, and the levels
shrink by the fanout.

Digests are kept as 32 bytes and hashed as their hex text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.scan import row_position, split_ranges
from foliant.session import settle


def _nothing() -> Column:
    return F.lit(bytearray())


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def encoded(values: Sequence[Column]) -> Column:
    """The fields of a leaf in one string: ``-`` for null, else byte count, ``:`` and value."""
    text = [v.cast("string") for v in values]
    return F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text))


def leaves(
    docs: DataFrame, columns: Sequence[str], id_col: str, group_col: str, altered: dict[str, Column] | None = None
) -> DataFrame:
    """``(grp, id, leaf, claim, nth)``: each row's hash, and its hash after ``altered`` columns took their other values.

    The texts are read once; what is written are two digests a row. ``nth``
    tells repeated rows apart.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    leaf = _hash(encoded(list(values.values())))
    claim = _hash(encoded([(altered or {}).get(c, v) for c, v in values.items()])) if altered else leaf
    rows = docs.select(F.col(f"`{group_col}`").alias("grp"), F.col(f"`{id_col}`").alias("id"), leaf.alias("leaf"), claim.alias("claim"))
    return settle(rows.withColumn("nth", F.monotonically_increasing_id()))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows with g, i, n; groups with g, grp, n)``: group number, place in the group and size of the group.

    Rows are ordered by group (null first), id and hash in ranges of all three,
    so that a group with most of the rows is spread like any other. Places add
    up a table of one row for each range and group.
    """
    ranged = split_ranges(rows, ["grp", "id", "leaf", "nth"])
    counts = ranged.groupBy("_range", "grp").agg(F.count("*").alias("c"))
    earlier = W.partitionBy("grp").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = settle(
        counts.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).withColumn("n", F.sum("c").over(W.partitionBy("grp")))
    )
    groups = settle(row_position(counts.filter("before = 0").select("grp", "n"), ["grp"], "g"))
    offsets = settle(
        counts.alias("c").join(groups.alias("t"), F.col("c.grp").eqNullSafe(F.col("t.grp"))).select(
            F.col("c._range").alias("_r"), F.col("c.grp").alias("_g"), "c.before", "t.g", "t.n")
    )
    local = F.row_number().over(W.partitionBy("_range", "grp").orderBy("id", "leaf", "nth")) - 1
    found = ranged.withColumn("_local", local).join(offsets, (F.col("_range") == F.col("_r")) & F.col("grp").eqNullSafe(F.col("_g")))
    return found.select("g", (F.col("before") + F.col("_local")).alias("i"), "n", "id", "leaf", "claim"), groups


@dataclass(frozen=True)
class Forest:
    """Pivots ``(g, p, n, s0, s1, ...)`` by level, leaves first, and ``(g, depth, top)``: where each tree ends and its last hash."""

    fanout: int
    levels: list[DataFrame]
    tops: DataFrame


def _slots(fanout: int) -> list[str]:
    return [f"s{k}" for k in range(fanout)]


def _pivot(nodes: DataFrame, fanout: int, value: Column) -> DataFrame:
    slot = F.pmod(F.col("i"), F.lit(fanout))
    return nodes.groupBy("g", F.floor(F.col("i") / fanout).alias("p"), "n").agg(
        *(F.max(F.when(slot == k, value)).alias(s) for k, s in enumerate(_slots(fanout)))
    )


def build(nodes: DataFrame, fanout: int = 3) -> Forest:
    """The trees over ``nodes`` ``(g, i, n, h, extra)``: ``n`` nodes of tree ``g``, numbered by ``i`` from 0.

    One small job asks for the largest tree, which sets the number of levels;
    each level is written. A tree of one node has that node as its top.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    first = settle(_pivot(nodes, fanout, F.struct("h", "extra")))
    levels.append(first)
    hashes = [F.col(f"{s}.h") for s in _slots(fanout)]
    level = first
    while True:
        joined = _hash(F.concat(*(F.coalesce(_hex(h), F.lit("")) for h in hashes)))
        # A lone leaf goes up as it is.
        up = joined if len(levels) > 1 else F.when(F.col("n") == 1, hashes[0]).otherwise(joined)
        nodes = level.select("g", F.col("p").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), up.alias("h"))
        tops.append(nodes.filter("n = 1").select("g", F.lit(len(levels)).alias("depth"), F.col("h").alias("top")))
        largest = -(-largest // fanout)
        if largest <= 1:
            break
        level = settle(_pivot(nodes.filter("n > 1"), fanout, F.col("h")))
        levels.append(level)
        hashes = [F.col(s) for s in _slots(fanout)]
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return Forest(fanout, levels, settle(every))


def _children(joined: DataFrame, fanout: int, keep: list[str], first: bool) -> DataFrame:
    """One row for each child of the joined pivots: its siblings are all slots but its own, in front of the path from its parent up."""
    slots = _slots(fanout)
    digest = [F.col(f"{s}.h") if first else F.col(s) for s in slots]
    part = lambda some: F.concat(_nothing(), *(F.coalesce(h, _nothing()) for h in some))
    made = []
    for k, s in enumerate(slots):
        step = F.array(F.struct(part(digest[:k]).alias("left"), part(digest[k + 1:]).alias("right")))
        path = F.concat(step, F.col("path"))
        if first:
            path = F.when(F.col("n") == 1, F.col("path")).otherwise(path)
        own = [F.col(f"{s}.h").alias("h"), F.col(f"{s}.extra").alias("extra")] if first else [F.col(s).alias("h")]
        made.append(F.struct((F.col("p") * fanout + k).alias("i"), *own, path.alias("path")))
    return joined.select("g", *keep, F.inline(F.filter(F.array(*made), lambda c: c["h"].isNotNull())))


def proofs(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """``(g, i, h, extra, path, top)`` for each leaf; ``path`` lists the hashes left and right of it, level by level.

    ``above`` is ``(g, path, tops...)``: paths that go on from the tree's top, with columns to hand down.
    """
    start = forest.tops
    keep = ["top"]
    if above is not None:
        start = start.join(above, "g")
        keep += [c for c in above.columns if c not in ("g", "path")]
    else:
        start = start.withColumn("path", F.array().cast("array<struct<left:binary,right:binary>>"))
    start = settle(start)
    down = None
    for depth in range(len(forest.levels), 0, -1):
        here = start.filter(F.col("depth") == depth).select("g", F.lit(0).cast("long").alias("i"), "path", *keep)
        nodes = here if down is None else down.select("g", "i", "path", *keep).unionByName(here)
        pivot = forest.levels[depth - 1]
        joined = pivot.join(nodes.withColumnRenamed("i", "p"), ["g", "p"])
        down = _children(joined, forest.fanout, keep, depth == 1)
    return down


def path_text(path: Column) -> Column:
    """All siblings of a path as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: _hex(F.concat(s["left"], s["right"]))), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's hash and its path give, as hex text."""
    return F.aggregate(path, _hex(digest), lambda h, s: F.sha2(F.concat(_hex(s["left"]), h, _hex(s["right"])), 256))


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
    group_col: str = "source", fanout: int = 3, altered: dict[str, Column] | None = None,
) -> DataFrame:
    """``(id, leaf, subroot, root, path, claim)`` for each row, digests as bytes.

    Leaves of a group ascend by id, then by hash; groups ascend bytewise, the
    null group first. ``path`` is an array of ``(left, right)`` from the leaf to
    the root. ``claim`` is the hash after ``altered`` columns took their other
    values (the leaf itself without any).

    Null values have a mark of their own in the leaf, an empty text is not a
    null one, texts of any length are hashed where they are read, rows that
    agree in everything are leaves of their own, other columns are ignored, and
    an empty table gives no rows. Runs a few small jobs at once and writes one
    table for each level.
    """
    rows, groups = placed(leaves(docs, columns, id_col, group_col, altered))
    forest = build(rows.select("g", "i", "n", F.col("leaf").alias("h"), F.struct("id", "claim").alias("extra")), fanout)
    # One leaf of the top tree for each group, in the order of the groups.
    total = groups.count()
    roots = forest.tops.select(
        F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(total).cast("long").alias("n"), F.col("top").alias("h"),
        F.lit(None).cast("int").alias("extra"),
    )
    top = proofs(build(roots, fanout)).select(F.col("i").alias("g"), "path", F.col("top").alias("root"))
    found = proofs(forest, top)
    return found.select(F.col("extra.id").alias(id_col), F.col("h").alias("leaf"), F.col("top").alias("subroot"), "root", "path", F.col("extra.claim").alias("claim"))


def verified(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The manifest as hex text, with the digest of each proof and the root that the claims give."""
    out = found.select(
        id_col, *(_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(path_text(F.col("path")), 256).alias("proof_sha256"),
        folded(F.col("claim"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
