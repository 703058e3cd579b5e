"""Pairs and groups of 64-bit hashes that differ in at most a few bits.

Two hashes at most ``b`` bits apart agree on one of ``b + 1`` disjoint bit
bands, so an equality join on the bands finds every pair. A bucket that is too
full is not joined: its members are split again by bands of their remaining
bits, because a pair in the bucket still agrees on one of those too. What is
still too full after the last split is joined in blocks spread over tasks.
A pair is reported only by the first band it agrees on, so no step has to
remove repeats. All of this is exact.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.hashing import MAX_BITS, hamming
from foliant.operators.components import components
from foliant.operators.scan import row_position
from foliant.session import settle

BUCKET_LIMIT = 256
REF_LIMIT = 512
MAX_DEPTH = 3
# From so many hashes on, up to so many, poor bands give way to blocks of hashes compared with each other.
DENSE_FROM, DENSE_UPTO, DENSE_BLOCK = 20_000, 8_000_000, 16_384
# Where only groups are wanted, a task holds a bucket this many times larger; so many comparisons are made at once.
LINK_FACTOR, LINK_STRIP = 256, 1 << 18


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _constant(values: list, kind: str) -> Column:
    """A constant array; read from text so that it is one literal in the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _bands(mask: int, count: int) -> list[int]:
    """Split the bits outside ``mask`` into ``count`` runs of similar size."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // count for i in range(count + 1)]
    return [sum(free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _next_level(level: list[tuple[int, list[int]]], count: int) -> list[tuple[int, list[int]]]:
    """Children of each band path: its mask, and the sibling bands before it."""
    out = []
    for mask, before in level:
        bands = _bands(mask, count)
        out += [(mask | band, before + bands[:j]) for j, band in enumerate(bands)]
    return out


def similar_edges(
    hashes: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT, linked: bool = False,
    *, queries: DataFrame | None = None,
) -> DataFrame:
    """Pairs ``(a, b, bits)`` with ``a < b`` at most ``max_bits`` apart.

    ``hashes`` has one bigint column ``hash``. With ``linked`` the result only
    has to connect the same groups: a bucket gives a spanning forest of its
    pairs, and of one too full for a task the members that lie close to its
    centre are tied to one of them instead of being paired with each other.
    With ``queries`` (a column ``hash``) only pairs that have one of them are
    looked for. A small job per level runs at once, to see whether a bucket is too full.
    """
    count = max_bits + 1
    known = hashes.select("hash").filter(F.col("hash").isNotNull()).distinct()
    if queries is None:
        asked = known.withColumn("q", F.lit(True))
    else:
        asks = queries.select("hash", F.lit(True).alias("q")).distinct()
        asked = known.join(asks, "hash", "left").withColumn("q", F.coalesce("q", F.lit(False)))
    rows = settle(asked).withColumn("path", F.lit(0))
    most = bucket_limit * LINK_FACTOR if linked else bucket_limit
    level: list[tuple[int, list[int]]] = [(0, [])]
    parts: list[DataFrame] = []
    for depth in range(1, MAX_DEPTH + 1):
        level = _next_level(level, count)
        steps = F.sequence(F.lit(0), F.lit(count - 1))
        cells = rows.select("hash", "q", F.explode(F.transform(steps, lambda j: F.col("path") * count + j)).alias("path"))
        masks = _constant([_signed(mask) for mask, _ in level], "array<bigint>")
        cells = cells.withColumn("key", F.col("hash").bitwiseAND(F.element_at(masks, F.col("path") + 1)))
        if depth == 1 and queries is None and not linked and _bands_are_wide(cells, count):
            return _dense_pairs(rows.select("hash"), max_bits)
        full = settle(
            cells.groupBy("path", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        )
        if full.isEmpty():
            parts.append(_forests(cells, level, max_bits) if linked else _pairs(cells, cells, level, max_bits))
            break
        cold = cells.join(full, ["path", "key"], "left_anti")
        parts.append(_forests(cold, level, max_bits) if linked else _pairs(cold, cold, level, max_bits))
        hot = settle(cells.join(full, ["path", "key"]))
        if linked:
            hot, found = _tie_centres(hot, max_bits, bucket_limit)
            parts += found
        if depth == MAX_DEPTH:
            parts.append(_block_forests(hot, level, max_bits, most) if linked else _block_pairs(hot, level, max_bits, bucket_limit))
        rows = hot.select("hash", "q", "path")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct() if linked else out


def _pairs(left: DataFrame, right: DataFrame, level: list, max_bits: int, on: tuple = ("path", "key")) -> DataFrame:
    a = left.filter("q").select(*on, F.col("hash").alias("a"))
    b = right.select(*on, F.col("hash").alias("b"), F.col("q").alias("bq"))
    bits = hamming(F.col("a"), F.col("b"))
    earlier = _constant([[_signed(m) for m in before] for _, before in level], "array<array<bigint>>")
    first = F.forall(
        F.element_at(earlier, F.col("path") + 1),
        lambda m: F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(m) != 0,
    )
    once = (F.col("a") < F.col("b")) | (~F.col("bq") & (F.col("a") != F.col("b")))
    near = a.join(b, list(on)).filter(once & (bits <= max_bits))
    return near.filter(first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), bits.alias("bits"))


def _block_pairs(hot: DataFrame, level: list, max_bits: int, bucket_limit: int) -> DataFrame:
    """Join what is still crowded block by block, so that no task gets it whole."""
    blocks = F.ceil(F.col("n") / bucket_limit).cast("int")
    right = hot.withColumn("block", F.pmod(F.xxhash64("hash"), blocks).cast("int"))
    left = hot.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return _pairs(left, right, level, max_bits, ("path", "key", "block"))


def _forests(cells: DataFrame, level: list, max_bits: int, on: tuple = ("path", "key")) -> DataFrame:
    """Pairs that connect what is linked inside each bucket, at most one less than it has members.

    A task holds one bucket. Larger ones are sorted by each band of their
    remaining bits, and only equal stretches are compared, strip by strip.
    """

    def whole(key, frame):
        import numpy as np
        import pandas as pd

        mask, before = level[int(key[0])]
        h = np.unique(frame["hash"].to_numpy("int64").view("uint64"))
        stretches = [np.arange(len(h))]
        if len(h) > 1024:
            found = []
            for band in _bands(mask, max_bits + 1):
                part = h & np.uint64(band)
                order = np.argsort(part, kind="stable")
                found += np.split(order, np.nonzero(np.diff(part[order]))[0] + 1)
            # A short stretch costs its call, not its pairs.
            if sum(max(len(x) ** 2, 1 << 15) for x in found) < len(h) ** 2:
                stretches = found
        root, ends = np.arange(len(h)), [(np.empty(0, "int64"), np.empty(0, "int64"))]
        for some in stretches:
            at = 0
            while at < len(some) - 1:
                # Each row meets itself and what follows it.
                left, right = some[at:at + max(1, LINK_STRIP // (len(some) - at))], some[at:]
                at += len(left)
                x, y = np.nonzero(np.bitwise_count(h[left][:, None] ^ h[right][None, :]) <= max_bits)
                x, y = left[x], right[y]
                new = root[x] != root[y]
                x, y = x[new], y[new]
                for m in before:
                    # A pair belongs to the first band it agrees on.
                    other = (h[x] ^ h[y]) & np.uint64(m) != 0
                    x, y = x[other], y[other]
                while len(x):
                    # One pair for each root that joins a smaller one.
                    high, low = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
                    high, one = np.unique(high, return_index=True)
                    root[high] = low[one]
                    ends.append((x[one], y[one]))
                    while (root != (up := root[root])).any():
                        root = up
                    new = root[x] != root[y]
                    x, y = x[new], y[new]
        x, y = (h[np.concatenate(side)].view("int64") for side in zip(*ends))
        bits = np.bitwise_count((x ^ y).view("uint64")).astype("int32")
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "bits": bits})

    # Few bytes and much work: a number of tasks that is not merged.
    spark = cells.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cells.select("hash", *on).repartition(tasks, *on).groupBy(*on).applyInPandas(whole, "a bigint, b bigint, bits int")


def _block_forests(hot: DataFrame, level: list, max_bits: int, most: int) -> DataFrame:
    """Forests of what is still crowded, two blocks of a bucket at a time."""
    blocks = F.ceil(F.col("n") * 2 / most).cast("int")
    rows = hot.withColumn("own", F.pmod(F.xxhash64("hash"), blocks).cast("int"))
    rows = rows.withColumn("peer", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = rows.withColumns({"i": F.least("own", "peer"), "j": F.greatest("own", "peer")})
    return _forests(cells, level, max_bits, ("path", "key", "i", "j"))


def _bands_are_wide(cells: DataFrame, count: int) -> bool:
    """Whether the first bands leave more than a quarter of all pairs to be compared, so that splitting only multiplies rows."""
    sizes = cells.groupBy("path", "key").agg(F.count("*").cast("double").alias("n"))
    total = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s")).first()
    n = (total["n"] or 0) / count
    return DENSE_FROM <= n <= DENSE_UPTO and total["s"] > n * n / 4


def _dense_pairs(hashes: DataFrame, max_bits: int, block: int | None = None) -> DataFrame:
    """All pairs within ``max_bits``, block against block: a task holds two blocks of hashes and one strip of their distances."""
    blocks = max(1, -(-hashes.count() // (block or DENSE_BLOCK)))
    own = F.pmod(F.xxhash64("hash", F.lit(3)), F.lit(blocks)).cast("int")
    rows = hashes.select("hash", own.alias("own")).withColumn("peer", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = rows.select("hash", "own", F.least("own", "peer").alias("i"), F.greatest("own", "peer").alias("j"))

    def whole(key, frame):
        import numpy as np
        import pandas as pd

        left, right = (frame.loc[frame["own"] == k, "hash"].to_numpy("int64") for k in key)
        width, out = 1 << 8, [pd.DataFrame({"a": left[:0], "b": left[:0], "bits": left[:0].astype("int32")})]
        for at in range(0, len(left), width):
            strip = left[at:at + width]
            bits = np.bitwise_count((strip[:, None] ^ right[None, :]).view("uint64"))
            x, y = np.nonzero(bits <= max_bits)
            a, b, n = strip[x], right[y], bits[x, y].astype("int32")
            # Inside one block each pair is met twice, and every hash meets itself.
            keep = a < b if key[0] == key[1] else np.ones(len(a), bool)
            out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "bits": n[keep]}))
        return pd.concat(out)

    return cells.groupBy("i", "j").applyInPandas(whole, "a bigint, b bigint, bits int")


def _tie_centres(hot: DataFrame, max_bits: int, bucket_limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Tie the members near the majority bits of a bucket to one of them.

    Two hashes within half of ``max_bits`` of the same centre are within
    ``max_bits`` of each other. If the bucket has few other members they are
    compared with everyone, and the bucket is done; else it is split further.
    """
    ones = [F.sum(F.shiftright("hash", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(64)]
    major = [F.when(F.col(f"s{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0)) for i in range(64)]
    centre = hot.groupBy("path", "key").agg(F.max("n").alias("n"), *ones).select(
        "path", "key", sum(major[1:], major[0]).alias("centre")
    )
    marked = hot.join(centre, ["path", "key"]).withColumn(
        "near", hamming(F.col("hash"), F.col("centre")) <= max_bits // 2
    )
    shape = settle(
        marked.groupBy("path", "key").agg(
            F.min(F.when(F.col("near"), F.col("hash"))).alias("low"), F.count_if(~F.col("near")).alias("others")
        )
    )
    marked = marked.join(shape, ["path", "key"])
    star = marked.filter(F.col("near") & (F.col("hash") > F.col("low"))).select(
        F.col("low").alias("a"), F.col("hash").alias("b"), hamming(F.col("low"), F.col("hash")).alias("bits")
    )
    done = F.col("others") <= bucket_limit
    x = marked.filter(done & ~F.col("near")).select("path", "key", F.col("hash").alias("x"))
    y = marked.filter(done).select("path", "key", F.col("hash").alias("y"))
    bits = hamming(F.col("x"), F.col("y"))
    cross = x.join(y, ["path", "key"]).filter((F.col("x") != F.col("y")) & (bits <= max_bits)).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), bits.alias("bits")
    )
    return settle(marked.filter(~done).select("path", "key", "hash", "q", "n")), [star, cross]


def near_references(hashes: DataFrame, references: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct ``hash`` values within ``max_bits`` of any reference hash.

    Up to ``REF_LIMIT`` references are compared inside each row; more go
    through the banded pairs. The limit is checked on the data.
    """
    # Settled, so that the comparison below runs once per distinct hash and is
    # not pushed down to every row.
    known = settle(hashes.select("hash").filter(F.col("hash").isNotNull()).distinct())
    refs = settle(references.select("hash").filter(F.col("hash").isNotNull()).distinct())
    few = [r["hash"] for r in refs.limit(REF_LIMIT + 1).collect()]
    if not few:
        return known.filter(F.lit(False))
    if len(few) <= REF_LIMIT:
        listed = _constant(few, "array<bigint>")
        # Settled again: a join would copy the comparison to its other side.
        return settle(known.filter(F.exists(listed, lambda r: hamming(F.col("hash"), r) <= max_bits)))
    pairs = similar_edges(known.unionByName(refs), max_bits)
    both = pairs.select(F.col("a").alias("hash"), F.col("b").alias("ref")).unionByName(
        pairs.select(F.col("b").alias("hash"), F.col("a").alias("ref"))
    )
    hit = both.join(refs.withColumnRenamed("hash", "ref"), "ref", "left_semi").select("hash")
    return known.join(hit.unionByName(refs).distinct(), "hash", "left_semi")


def near_tagged(hashes: DataFrame, references: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(hash, tag)``: distinct ``hash`` values and the tags of the references within ``max_bits`` of them.

    As :func:`near_references` for several sets of references ``(hash, tag)`` in one pass.
    """
    known = settle(hashes.select("hash").filter(F.col("hash").isNotNull()).distinct())
    refs = settle(references.select("hash", "tag").filter(F.col("hash").isNotNull()).distinct())
    few = [tuple(r) for r in refs.limit(REF_LIMIT + 1).collect()]
    if not few:
        return known.select("hash", F.lit(None).cast("string").alias("tag")).filter(F.lit(False))
    if len(few) <= REF_LIMIT:
        tags = sorted({t for _, t in few})
        hit = F.array_compact(F.array(*(
            F.when(F.exists(_constant([h for h, t in few if t == tag], "array<bigint>"), lambda r: hamming(F.col("hash"), r) <= max_bits), F.lit(tag))
            for tag in tags
        )))
        return settle(known.select("hash", F.explode(hit).alias("tag")))
    pairs = similar_edges(known.unionByName(refs.select("hash")), max_bits)
    both = pairs.select(F.col("a").alias("hash"), F.col("b").alias("ref")).unionByName(
        pairs.select(F.col("b").alias("hash"), F.col("a").alias("ref"))
    )
    hit = both.join(refs.withColumnRenamed("hash", "ref"), "ref").select("hash", "tag")
    return hit.unionByName(refs).distinct().join(known, "hash", "left_semi")


def hash_groups(hashes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(hash, root)``: groups linked by chains of similar hashes."""
    known = settle(hashes.select("hash").filter(F.col("hash").isNotNull()).distinct())
    edges = similar_edges(known, max_bits, linked=True).select("a", "b")
    roots = components(edges)
    return known.join(roots, known["hash"] == roots["node"], "left").select(
        "hash", F.coalesce("root", "hash").alias("root")
    )


def excluded_groups(files: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Groups of distinct set-aside files, largest first.

    ``files`` has one row per distinct content: ``content, name, size, dhash``
    (bigint or NULL) and ``ord``, its first-seen position. A file without a
    perceptual hash is a group of its own. Adds ``group_no, members`` and
    ``rep_name`` (the first-seen member's name).
    """
    # Settled: a table of known size is not dealt out with the files, and both results are read several times below.
    roots = settle(hash_groups(files.select(F.col("dhash").alias("hash")), max_bits))
    tagged = settle(files.join(roots.withColumnRenamed("hash", "dhash"), "dhash", "left").withColumn(
        "_g", F.coalesce(F.concat(F.lit("h"), F.col("root").cast("string")), F.concat(F.lit("c"), "content"))
    ))
    groups = settle(tagged.groupBy("_g").agg(
        F.count("*").alias("members"), F.min_by("name", "ord").alias("rep_name"), F.min("ord").alias("_o")
    ))
    ranked = row_position(
        groups.withColumn("_neg", -F.col("members")), ["_neg", "rep_name", "_o"], "_p"
    ).select("_g", "members", "rep_name", (F.col("_p") + 1).alias("group_no"))
    return tagged.join(ranked, "_g").drop("_g", "root")


def group_distances(groups: DataFrame, near_miss: int = MAX_BITS + 4) -> DataFrame:
    """Nearest distance of each pair of groups that come within ``near_miss`` bits.

    ``groups`` has ``group_no, dhash``. Groups that share a hash are 0 bits
    apart. The reference report lists every pair; pairs further apart carry no
    finding, so the banded join (with enough bands for ``near_miss`` bits)
    lists the ones that do.
    """
    edges = similar_edges(groups.select(F.col("dhash").alias("hash")), near_miss)
    left = groups.select(F.col("dhash").alias("a"), F.col("group_no").alias("ga")).distinct()
    right = groups.select(F.col("dhash").alias("b"), F.col("group_no").alias("gb")).distinct()
    pairs = edges.join(left, "a").join(right, "b").select("ga", "gb", "bits").unionByName(_sharing_groups(groups))
    return (
        pairs.filter(F.col("ga") != F.col("gb"))
        .groupBy(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b"))
        .agg(F.min("bits").alias("bits"))
        .orderBy("bits", "group_a", "group_b")
    )


def _sharing_groups(groups: DataFrame) -> DataFrame:
    """``(ga, gb, bits)``: pairs of groups with a hash in common, block by block, so that no task gets a hash of very many groups whole."""
    held = groups.select("dhash", "group_no").distinct()
    sizes = held.groupBy("dhash").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / BUCKET_LIMIT).cast("int")
    shared = held.join(sizes, "dhash")
    left = shared.select("dhash", F.col("group_no").alias("ga"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    right = shared.select("dhash", F.col("group_no").alias("gb"), F.pmod(F.xxhash64("group_no"), blocks).cast("int").alias("block"))
    return left.join(right, ["dhash", "block"]).filter(F.col("ga") < F.col("gb")).select("ga", "gb", F.lit(0).alias("bits"))


def nearest_color(r: Column, g: Column, b: Column) -> Column:
    """Nearest highlighter colour name, or the hex value when none is close."""
    def gap(p: tuple[str, int, int, int]) -> Column:
        return (r - p[1]) * (r - p[1]) + (g - p[2]) * (g - p[2]) + (b - p[3]) * (b - p[3])

    ranked = F.array_min(F.array(*[
        F.struct(gap(p).cast("double").alias("d"), F.lit(i).alias("i"), F.lit(p[0]).alias("name"))
        for i, p in enumerate(PALETTE)
    ]))
    # Half values round up, as in the reference.
    byte = [F.lower(F.lpad(F.hex(F.floor(x + 0.5).cast("bigint")), 2, "0")) for x in (r, g, b)]
    code = F.concat(F.lit("#"), *byte)
    return F.when(r.isNull() | g.isNull() | b.isNull(), "highlight").otherwise(
        F.when(ranked["d"] <= 3600, ranked["name"]).otherwise(code)
    )


# The highlighter palette.
PALETTE = (
    ("yellow", 255, 255, 0), ("green", 0, 255, 0), ("cyan", 0, 255, 255), ("magenta", 255, 0, 255),
    ("blue", 0, 0, 255), ("red", 255, 0, 0), ("darkGreen", 0, 128, 0), ("orange", 255, 165, 0),
    ("gray", 128, 128, 128),
)


def leader_groups(files: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Browser variant: greedy, non-transitive groups around first-seen leaders.

    ``files`` has ``content, dhash, ord``. Walking in ``ord``, a file joins the
    earliest leader it is similar to, else it becomes a leader itself. A file is
    a leader iff no earlier similar file is one, which is settled in rounds on
    open files and the edges between them: files without an open earlier
    neighbour lead, and whoever is near one of these is decided as well.
    """
    first = files.filter(F.col("dhash").isNotNull()).groupBy("dhash").agg(F.min("ord").alias("ord"))
    edges = similar_edges(first.select(F.col("dhash").alias("hash")), max_bits).select("a", "b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = first.select("dhash", "ord")
    earlier = settle(
        both.join(at.toDF("a", "ao"), "a").join(at.toDF("b", "bo"), "b").filter(F.col("bo") < F.col("ao"))
        .select(F.col("a").alias("node"), F.col("b").alias("peer"), F.col("bo").alias("peer_ord"))
    )
    open_nodes, open_edges = settle(first.select(F.col("dhash").alias("node"))), earlier
    leaders = None
    while not open_nodes.isEmpty():
        # Nobody open comes before these; whoever is near one of them follows.
        new = settle(open_nodes.join(open_edges, "node", "left_anti"))
        followers = open_edges.join(new.withColumnRenamed("node", "peer"), "peer", "left_semi").select("node").distinct()
        open_nodes = settle(open_nodes.join(new.unionByName(followers), "node", "left_anti"))
        peers = open_nodes.withColumnRenamed("node", "peer")
        open_edges = settle(open_edges.join(open_nodes, "node", "left_semi").join(peers, "peer", "left_semi"))
        leaders = new if leaders is None else leaders.unionByName(new)
    if leaders is None:
        return first.select("dhash", F.col("dhash").alias("leader"))
    leads = leaders.select(F.col("node").alias("peer"), F.lit(True).alias("leads"))
    followed = earlier.join(leads, "peer").groupBy("node").agg(F.min_by("peer", "peer_ord").alias("leader"))
    return first.join(followed, first["dhash"] == followed["node"], "left").select(
        "dhash", F.coalesce("leader", "dhash").alias("leader")
    )


def leader_listing(files: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Browser grouping of set-aside files: adds ``group_no`` and ``members`` to every row.

    ``files`` has ``content, dhash, ord`` (unique). Files without a hash are
    grouped with equal bytes alone. Larger groups come first, of equal ones
    that which was seen first.
    """
    files = settle(files)
    led = leader_groups(files, max_bits).withColumnRenamed("dhash", "_h")
    keyed = settle(
        files.join(led, F.col("dhash") == F.col("_h"), "left")
        .withColumn("_g", F.coalesce(F.concat(F.lit("h"), F.hex("leader")), F.concat(F.lit("c"), "content"))).drop("_h", "leader")
    )
    sizes = settle(keyed.groupBy("_g").agg(F.count("*").alias("members"), F.min("ord").alias("_o")).withColumn("_size", -F.col("members")))
    ranked = row_position(sizes, ["_size", "_o"], "_n").select("_g", "members", (F.col("_n") + 1).alias("group_no"))
    return keyed.join(ranked, "_g").drop("_g")
