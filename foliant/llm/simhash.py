"""Near-duplicate texts by SimHash fingerprints in vantage-point trees.

Two fingerprints that differ in at most ``radius`` bits differ in at most
``radius // 2`` bits of one of their halves. Each half has a tree: a level
parts the fingerprints by their Hamming distance to a vantage point, the first
levels are the same for all branches (a few dozen numbers whatever the size of
the data), and branches that are still crowded are parted again by vantage
points of their own. By the triangle bound a fingerprint can only have partners
across a boundary that is within the half's radius of its distance; it then
visits that branch too. Leaves are shards: each is compared on its own, and
what leaves a shard is a spanning star of its linked fingerprints, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import hash_sample, packed, text_of, unpacked
from foliant.operators.components import components
from foliant.session import settle

SHINGLE = 3
RADIUS = 3
#: Fingerprints owned by a leaf, as planned; rows of a leaf that are compared in one task; rows from which a leaf is parted again.
LEAF, BLOCK, CROWDED = 4096, 1 << 17, 1 << 19
SAMPLE, MAX_LEVELS, MAX_ROUNDS = 2048, 26, 12
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; zero without words."""
    words = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, _SLICE):
        b = min(n, a + _SLICE)
        part = words[a:b + shingle - 1]
        columns = [part[i:i + b - a] for i in range(shingle)]
        texts = map(b" ".join, zip(*columns)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), dtype=np.uint64, count=b - a)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little") if n else np.zeros(8, dtype=np.uint8)
    return int(bits.view(np.int64)[0])


def fingerprint_of(text: Column) -> Column:
    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return F.pandas_udf(batch, "long")(text)


def _half(fp: np.ndarray, tree: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(32 * tree)).astype(np.uint32)


def _half_column(fp: Column, tree: Column) -> Column:
    low = F.lit(0xFFFFFFFF).cast("long")
    return F.when(tree == 0, fp.bitwiseAND(low)).otherwise(F.shiftrightunsigned(fp, 32))


def choose_vantage(sample: np.ndarray, tree: int, levels: int) -> list[tuple[int, int]]:
    """``(vantage, threshold)`` of each level: those that leave the sample in the smallest leaves."""
    x = _half(sample, tree)
    code = np.zeros(len(x), dtype=np.int64)
    out = []
    tried = 0
    for _ in range(levels):
        best = None
        for k in range(24):
            v = x[(tried + k) % len(x)]
            d = np.bitwise_count(x ^ v)
            for m in {int(np.median(d)) - 1, int(np.median(d))}:
                c = 2 * code + (d > m)
                crowd = int((np.unique(c, return_counts=True)[1].astype(np.int64) ** 2).sum())
                if best is None or crowd < best[0]:
                    best = (crowd, int(v), m, c)
        tried += 24
        out.append(best[1:3])
        code = np.unique(best[3], return_inverse=True)[1]
    return out


def _route(nodes: DataFrame, levels: list[list[tuple[int, int]]], reach: int) -> DataFrame:
    """``(tree, depth, leaf, fp, own)``: the leaf that owns a fingerprint and those that it visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(dtype=np.int64)
            for tree, steps in enumerate(levels):
                x = _half(fp, tree)
                row, leaf, own = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64), np.ones(len(fp), dtype=bool)
                for v, m in steps:
                    d = np.bitwise_count(x ^ np.uint32(v)).astype(np.int64)[row]
                    far = d > m
                    both = np.flatnonzero((d > m - reach) & (d <= m + reach))
                    row, own = np.concatenate([row, row[both]]), np.concatenate([own, np.zeros(len(both), dtype=bool)])
                    leaf = np.concatenate([2 * leaf + far, 2 * leaf[both] + ~far[both]])
                yield pd.DataFrame({"tree": tree, "depth": len(steps), "leaf": leaf, "fp": fp[row], "own": own})

    return nodes.select("fp").mapInPandas(run, "tree int, depth int, leaf long, fp long, own boolean")


def _part_again(rows: DataFrame, reach: int) -> DataFrame:
    """Part crowded leaves by a vantage point of their own, at the median distance to it."""
    key = ["tree", "depth", "leaf"]
    v = rows.filter("own").groupBy(*key).agg(F.min_by("fp", F.xxhash64("fp")).alias("v"))
    far = rows.join(v, key).withColumn(
        "d", F.bit_count(_half_column(F.col("fp"), F.col("tree")).bitwiseXOR(_half_column(F.col("v"), F.col("tree"))))
    )
    far = settle(far.drop("v"))
    cut = far.filter("own").groupBy(*key).agg(F.percentile_approx("d", 0.5).alias("m"))
    side = F.col("d") > F.col("m")
    other = (F.col("d") > F.col("m") - reach) & (F.col("d") <= F.col("m") + reach)
    kids = F.when(
        other, F.array(F.struct(side.alias("far"), F.col("own")), F.struct((~side).alias("far"), F.lit(False).alias("own")))
    ).otherwise(F.array(F.struct(side.alias("far"), F.col("own"))))
    return far.join(cut, key).select("tree", "depth", "leaf", "fp", F.explode(kids).alias("k")).select(
        "tree", (F.col("depth") + 1).alias("depth"), (2 * F.col("leaf") + F.col("k.far").cast("int")).alias("leaf"), "fp", "k.own"
    )


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(fp: np.ndarray, own: np.ndarray, radius: int, cross: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(member, root)`` stars of the fingerprints linked within one shard; no list of pairs is kept.

    ``cross``: compare only rows of which one has it set and the other has not.
    """
    x = fp.view(np.uint64)
    parent = np.arange(len(x))
    owners = np.flatnonzero(own)
    step = max(1, (1 << 21) // max(1, len(x)))
    for at in range(0, len(owners), step):
        mine = owners[at:at + step]
        near = np.bitwise_count(x[mine, None] ^ x[None, :]) <= radius
        if cross is not None:
            near &= cross[mine, None] != cross[None, :]
        i, j = np.nonzero(near)
        i = mine[i]
        keep = i != j
        _unite(parent, i[keep], j[keep])
    root = _find(parent, np.arange(len(x)))
    member = np.flatnonzero(root != np.arange(len(x)))
    return fp[member], fp[root[member]]


def links(nodes: DataFrame, radius: int = RADIUS, leaf: int = LEAF, block: int = BLOCK, crowded: int = CROWDED) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints ``fp`` of ``nodes`` (distinct) linked within ``radius`` bits."""
    reach = radius // 2
    n = nodes.count()
    depth = min(MAX_LEVELS, max(0, math.ceil(math.log2(max(1, n / leaf)))))
    # The vantage points are chosen from a sample of fixed size; every fingerprint is routed.
    sample = np.array(
        [r[0] for r in hash_sample(nodes, ["fp"], SAMPLE).select("fp").collect()], dtype=np.int64
    )
    levels = [choose_vantage(sample, t, depth) for t in (0, 1)] if depth else [[], []]
    rows, key = settle(_route(nodes, levels, reach)), ["tree", "depth", "leaf"]
    ready = None
    for k in range(MAX_ROUNDS + 1):
        sizes = rows.groupBy(*key).agg(F.count("*").alias("size"), F.count_if("own").alias("owned")).filter("owned > 0")
        sizes = settle(sizes)
        over = sizes.filter(F.col("size") > crowded)
        if k == MAX_ROUNDS or over.isEmpty():
            part = rows.join(sizes, key)
            ready = part if ready is None else ready.unionByName(part)
            break
        part = rows.join(sizes.filter(F.col("size") <= crowded), key)
        ready = part if ready is None else ready.unionByName(part)
        rows = settle(_part_again(rows.join(over.select(*key), key), reach))
    # A leaf above the block size is compared block by block, each two blocks in a group of their own.
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"))
    )
    dealt = ready.select(*key, "fp", "own", mine.alias("mine"), F.explode(pairs).alias("b")).select(
        *key, "fp", "own", "b.i", "b.j", (F.col("mine") == F.col("b.j")).alias("second")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["i"].iat[0] == pdf["j"].iat[0]
        a, b = shard_links(
            pdf["fp"].to_numpy(dtype=np.int64), pdf["own"].to_numpy(dtype=bool), radius,
            None if one else pdf["second"].to_numpy(dtype=bool),
        )
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy(*key, "i", "j").applyInPandas(compare, "a long, b long")


def near_components(fingerprints: DataFrame, radius: int = RADIUS, **sizes: int) -> DataFrame:
    """``(fp, component_id)`` for each distinct fingerprint of ``fingerprints`` (columns ``doc``, ``fp``).

    Fingerprints link at ``radius`` or fewer differing bits; the component's id
    is the smallest ``doc`` that can be reached. All-equal and zero
    fingerprints are linked like any other; null documents have no say.
    """
    nodes = settle(fingerprints.groupBy("fp").agg(F.min("doc").alias("first")))
    roots = settle(components(settle(links(nodes, radius, **sizes))))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return settle(rooted.join(least, "root").select("fp", "component_id"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, tag, fp)`` per row; null texts count as empty and have fingerprint zero."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("tag"), fingerprint_of(text).alias("fp"))


def document_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``.

    Repeated rows stay, null ids have no say in a component's id, texts without
    words have fingerprint zero, very long texts are read whole in pieces, an
    empty table gives no rows, and other columns are ignored.
    """
    prints = settle(fingerprints(docs, id_col, text_col))
    return prints.join(near_components(prints, radius), "fp").select(F.col("doc").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with the smallest id (then the smallest text hash). Columns stay as they are.

    Rows with a null id stay only if no document of their component has an id.
    """
    prints = settle(fingerprints(docs, id_col, text_col))
    return keep_least(docs, prints.join(near_components(prints, radius), "fp"), id_col, text_col)


def keep_least(docs: DataFrame, of: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``keep_one`` keeps, by their components ``of`` (columns ``doc``, ``tag``, ``fp``, ``component_id``)."""
    # Components without any id are told apart by their fingerprint.
    group = F.coalesce(F.col("component_id"), F.col("fp"))
    best = (
        of.groupBy(group.alias("g"), F.col("component_id").isNull())
        .agg(F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "tag")).alias("m"))
        .select(F.col("m.doc").alias("_doc"), F.col("m.tag").alias("_tag"))
    )
    rows = packed(docs, id_col, text_col)
    kept = rows.join(best, F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("_text") == F.col("_tag")), "left_semi")
    repeated = of.groupBy("doc", "tag").count().filter("count > 1")
    if repeated.isEmpty():
        return kept.select(*unpacked(docs.columns))
    # Of rows that agree in id and text the least one stays; minima are taken before the shuffle, so many copies do not meet in one task.
    one = kept.groupBy("_id", F.xxhash64("_text").alias("_hash")).agg(F.min("_row").alias("_row"))
    return one.select(*unpacked(docs.columns))
