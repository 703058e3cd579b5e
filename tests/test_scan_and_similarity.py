import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.hashing import dhash_from_luma, hex_to_long, long_to_hex
from foliant.operators import scan, similarity
from foliant.operators.components import components


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def dist(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group."""
    rnd = random.Random(5)
    rows = [(rnd.choice([7] * 300 + list(range(600))), i, rnd.randrange(50)) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "g int, i int, v bigint").repartition(5)


def test_running_sum_and_ranges(spark, skewed):
    rows, df = skewed
    got = {(r.g, r.i): r.b for r in scan.running_sum(df, ["g", "i"], F.col("v"), "b").collect()}
    want, total = {}, 0
    for g, i, v in sorted(rows):
        want[(g, i)], total = total, total + v
    assert got == want
    sizes = [r["count"] for r in scan.split_ranges(df, ["g", "i"], 16).groupBy("_range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 4 * len(rows) / 16


def test_running_max_restarts_per_group(skewed):
    rows, df = skewed
    out = scan.running_max(df, ["g", "i"], F.struct("g", "v"), "m").collect()
    top, want = {}, {}
    for g, i, v in sorted(rows):
        top[g] = max(top.get(g, v), v)
        want[(g, i)] = top[g]
    assert {(r.g, r.i): r.m.v for r in out} == want


def test_previous_row(skewed):
    rows, df = skewed
    got = {(r.g, r.i): r.p and (r.p.g, r.p.i) for r in scan.previous_row(df, ["g", "i"], ["g", "i"], "p").collect()}
    keys = sorted((g, i) for g, i, _ in rows)
    assert got == dict(zip(keys, [None] + keys[:-1]))


def clustered(seed, bases, ball=0):
    rnd = random.Random(seed)
    out = set()
    for _ in range(bases):
        b = rnd.getrandbits(64)
        for _ in range(4):
            x = b
            for _ in range(rnd.randint(0, 7)):
                x ^= 1 << rnd.randrange(64)
            out.add(signed(x))
    c = rnd.getrandbits(64)
    for i in range(ball):
        for j in range(i):
            out.add(signed(c ^ (1 << i) ^ (1 << j)))
    return sorted(out)


@pytest.mark.parametrize("limit,ball", [(256, 0), (40, 12)])
def test_pairs_equal_brute_force(spark, limit, ball):
    hs = clustered(1, 60, ball)
    want = {(a, b) for i, b in enumerate(hs) for a in hs[:i] if dist(a, b) <= 8}
    df = spark.createDataFrame([(h,) for h in hs] * 2, "hash bigint")
    got = [(r.a, r.b) for r in similarity.similar_edges(df, bucket_limit=limit).collect()]
    assert len(got) == len(want) and set(got) == want


def roots_of(hs):
    root = {h: h for h in hs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, b in enumerate(hs):
        for a in hs[:i]:
            if dist(a, b) <= 8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {h: find(h) for h in hs}


def test_groups_with_a_crowded_bucket(spark, monkeypatch):
    hs = clustered(2, 40, 14)
    monkeypatch.setattr(similarity.similar_edges, "__defaults__", (8, 40, False))
    got = similarity.hash_groups(spark.createDataFrame([(h,) for h in hs], "hash bigint")).collect()
    assert {r["hash"]: r.root for r in got} == roots_of(hs)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(300)}}


def test_near_references_small_and_large(spark, monkeypatch):
    hs = clustered(3, 50)
    refs = hs[::9]
    want = {h for h in hs if any(dist(h, r) <= 8 for r in refs)}
    df, rf = (spark.createDataFrame([(h,) for h in x], "hash bigint") for x in (hs, refs))
    assert {r[0] for r in similarity.near_references(df, rf).collect()} == want
    monkeypatch.setattr(similarity, "REF_LIMIT", 3)
    assert {r[0] for r in similarity.near_references(df, rf).collect()} == want


def test_tagged_references_in_one_pass(spark, monkeypatch):
    hs = clustered(5, 50)
    refs = [(h, "x") for h in hs[::9]] + [(h, "k") for h in hs[3::11]] + [(hs[0], "k"), (None, "x")]
    want = {(h, t) for h in hs for r, t in refs if r is not None and dist(h, r) <= 8}
    df = spark.createDataFrame([(h,) for h in hs], "hash bigint")
    rf = spark.createDataFrame(refs, "hash bigint, tag string")
    assert {tuple(r) for r in similarity.near_tagged(df, rf).collect()} == want
    monkeypatch.setattr(similarity, "REF_LIMIT", 3)
    assert {tuple(r) for r in similarity.near_tagged(df, rf).collect()} == want
    assert similarity.near_tagged(df, rf.limit(0)).collect() == []


def test_leader_groups_follow_first_seen_order(spark):
    hs = clustered(4, 30)
    random.Random(1).shuffle(hs)
    leaders, want = [], {}
    for h in hs:
        want[h] = next((x for x in leaders if dist(x, h) <= 8), None)
        if want[h] is None:
            leaders.append(h)
            want[h] = h
    df = spark.createDataFrame([(h, i) for i, h in enumerate(hs)], "dhash bigint, ord int")
    assert {r.dhash: r.leader for r in similarity.leader_groups(df).collect()} == want


def test_excluded_groups_fixture(spark):
    files = [("a1", "logo.png", "aaaa5555aaaa5555"), ("a2", "logo2.png", "aaaa5555aaaa5557"), ("a3", "x.png", "aaaa5555aaaa555d"),
             ("b1", "b.png", "00ff00ff00ff00ff"), ("b2", "b2.png", "00ff00ff00ff00fe"), ("c1", "c.png", "3333cccc3333cccc"), ("t", "t.txt", None)]
    df = spark.createDataFrame([(k, n, 10, h, i) for i, (k, n, h) in enumerate(files)], "content string, name string, size int, h string, ord int")
    out = similarity.excluded_groups(df.withColumn("dhash", hex_to_long(F.col("h"))).drop("h")).collect()
    assert {r.content: (r.group_no, r.members) for r in out} == {
        "a1": (1, 3), "a2": (1, 3), "a3": (1, 3), "b1": (2, 2), "b2": (2, 2), "c1": (3, 1), "t": (4, 1)}


def test_hash_of_brightness(spark):
    ramp = [x for _ in range(8) for x in range(9)]
    mixed = [(x * 7 + y * 5) % 9 for y in range(8) for x in range(9)]
    df = spark.createDataFrame([(ramp,), (mixed,)], "m array<int>")
    flat, got = [r[0] for r in df.select(dhash_from_luma(F.col("m"))).collect()]
    bits = "".join("1" if mixed[y * 9 + x] < mixed[y * 9 + x + 1] else "0" for y in range(8) for x in range(8))
    assert flat is None and got == f"{int(bits, 2):016x}"
    back = df.select(long_to_hex(hex_to_long(F.lit("ff00000000000001")))).first()[0]
    assert back == "ff00000000000001"


def test_nearest_color(spark):
    df = spark.createDataFrame([(250.0, 250.0, 10.0), (10.0, 200.0, 90.0), (255.0, 160.0, 5.0), (None, 1.0, 1.0)], "r double, g double, b double")
    got = [r[0] for r in df.select(similarity.nearest_color(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert got == ["yellow", "#0ac85a", "orange", "highlight"]


def test_groups_that_share_a_hash_are_no_bits_apart(spark, monkeypatch):
    gap = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    far = 0x5A5A5A5A5A5A5A5A
    rows = [(g, far) for g in range(12)] + [(20, 0x7), (21, 0x7), (21, 0x7), (21, 0x1F), (22, far ^ 1), (23, None), (24, None), (25, -1)]
    want = {}
    for g, h in rows:
        for k, i in rows:
            if g < k and None not in (h, i) and gap(h, i) <= 12:
                want[g, k] = min(gap(h, i), want.get((g, k), 64))
    assert want[0, 1] == want[20, 21] == 0 and want[0, 22] == 1
    df = spark.createDataFrame(rows, "group_no bigint, dhash bigint")
    # A hash of many groups is paired in blocks.
    monkeypatch.setattr(similarity, "BUCKET_LIMIT", 5)
    got = similarity.group_distances(df).collect()
    assert len(got) == len(want) and {(r.group_a, r.group_b): r.bits for r in got} == want
