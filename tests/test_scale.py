"""What the work of a step grows with, on rows built here."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from foliant.operators import exclusions as ex
from foliant.operators import redline, registers
from foliant.operators.components import components
from foliant.plans import catalog, catalog_files
from foliant.plans import views as v
from foliant.session import whole_files
from foliant.streaming import progress


class _Store:
    """A state variable that counts its calls."""

    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def _count(self):
        self.calls.append(1)

    def exists(self):
        self._count()
        return None in self.rows

    def get(self):
        self._count()
        return self.rows[None]

    def update(self, value):
        self._count()
        self.rows[None] = value

    def keys(self):
        self._count()
        return iter(list(self.rows))

    def getValue(self, key):
        self._count()
        return self.rows[key]

    def updateValue(self, key, value):
        self._count()
        self.rows[key] = value

    def removeKey(self, key):
        self._count()
        del self.rows[key]


def test_store_calls_follow_slots_not_events():
    calls, timers = [], []
    handle = SimpleNamespace(
        getValueState=lambda *a: _Store(calls), getMapState=lambda *a: _Store(calls), registerTimer=timers.append)
    p = progress._Ordered(60_000)
    p.init(handle)
    rows = [SimpleNamespace(at_us=i * 1000 * 100, event_id=i, collection=i % 7, phase="x", done=i, total=5000, pct=i % 100) for i in range(4000)]
    list(p.handleInputRows((0,), iter(reversed(rows)), None))
    assert timers == [60_000]
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 200_000)
    due = SimpleNamespace(getExpiryTimeInMs=lambda: 60_000)
    out = list(p.handleExpiredTimer((0,), clock, due))
    # Three slots have passed; the fourth waits for its end.
    assert [r.event_id for r in out] == list(range(1800)) and timers[-1] == 240_000
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10 ** 9)
    out += list(p.handleExpiredTimer((0,), clock, due))
    assert [r.event_id for r in out] == list(range(4000)) and len(calls) < 60
    top = {}
    for r in out:
        top[r.collection] = max(top.get(r.collection, 0), r.pct)
        assert r.shown == top[r.collection]


def test_mails_are_parsed_by_many_tasks_from_one_row_group(spark, tmp_path):
    from foliant.plans.catalog_text import mail_files
    from foliant.sources import email

    rows = [(k, k * 3, "O") for k in range(400)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    parts = email.parse_attachments(mail_files(spark, str(tmp_path)))
    busy = parts.groupBy(F.spark_partition_id()).count().count()
    assert busy >= spark.sparkContext.defaultParallelism
    got = email.attachment_rows(parts).select("path", "att_idx", "name", "content_id").collect()
    assert sorted(map(tuple, got)) == sorted(
        (f"mail/{k}.eml", i, n, t) for k in range(0, 400, 2) for i, (n, t) in enumerate([("one.png", "one"), ("two.png", "two")]))


def test_equal_headers_are_parsed_once():
    from foliant.sources import email

    policy = email._caching_policy()
    first = policy.header_fetch_parse("Content-Type", 'image/png; name="a.png"')
    assert policy.header_fetch_parse("Content-Type", 'image/png; name="a.png"') is first
    assert first.content_type == "image/png" and first.params["name"] == "a.png"


def test_blocks_of_hashes_give_the_pairs_of_brute_force(spark, monkeypatch):
    import random

    from foliant.operators import similarity

    rnd = random.Random(8)
    hs = [rnd.getrandbits(64) - (1 << 63) for _ in range(150)]
    hs = sorted({h ^ f for h in hs for f in (0, 7, 1 << 40, 0x3F00)})
    rows = spark.createDataFrame([(h,) for h in hs], "hash bigint")
    gap = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    want = sorted((a, b, gap(a, b)) for a in hs for b in hs if a < b and gap(a, b) <= 12)
    assert sorted(map(tuple, similarity._dense_pairs(rows, 12, 100).collect())) == want
    # With thirteen bands of five bits, buckets of many hashes are not split over and over.
    monkeypatch.setattr(similarity, "DENSE_FROM", 10)
    monkeypatch.setattr(similarity, "_block_pairs", None)
    assert sorted(map(tuple, similarity.similar_edges(rows, 12, bucket_limit=4).collect())) == want


def test_near_cuts_agree_with_comparing_all(spark, monkeypatch):
    import random

    from foliant.operators import scan

    rnd = random.Random(3)
    rows = [(rnd.choice([None, -5, 0, 3, 3, 3, 3, rnd.randrange(-10 ** 12, 10 ** 12)]), rnd.choice([None, "a", "b"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, s string, i int")
    near = scan.split_ranges(df, ["k", "s", "i"], 40).collect()
    monkeypatch.setattr(scan, "_near_cuts", lambda *a: None)
    every = scan.split_ranges(df, ["k", "s", "i"], 40).collect()
    assert sorted(near, key=lambda r: r.i) == sorted(every, key=lambda r: r.i)
    assert len({r["_range"] for r in near}) > 20


def test_long_lines_come_in_pieces_as_before(spark, monkeypatch):
    from foliant.operators import highlights

    monkeypatch.setattr(highlights, "PIECE", 5)
    items = [(d, 12.0 * j, 700.0 - 20 * n, f"w{d}{n}{j}") for d in (1, 2, None) for n in range(3) for j in range(12 if n == 1 else 4)]
    df = spark.createDataFrame(items, "doc bigint, x0 double, y0 double, str string")
    got = {(r.doc, r.line, r.piece): r.text for r in highlights.reading_lines(df, ["doc"]).collect()}
    want = {}
    for d in (1, 2, None):
        for n in range(3):
            words = [f"w{d}{n}{j}" for j in range(12 if n == 1 else 4)]
            for p in range(0, len(words), 5):
                want[d, n, p // 5] = " ".join(words[p:p + 5])
    assert got == want


def test_office_files_are_packed_once_and_only_as_asked(spark, tmp_path, monkeypatch):
    from foliant.plans import catalog_files as cf

    rows = [(i, f"a{i}\nb c d", "en", "s") for i in range(9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    import os
    import shutil
    part = next(f for f in os.listdir(tmp_path / "d") if f.endswith(".parquet"))
    shutil.copy(tmp_path / "d" / part, tmp_path / "documents.parquet")
    got = cf._containers(spark, str(tmp_path), 0).select("path").collect()
    assert sorted(r.path for r in got) == ["/vault/0.docx", "/vault/3.docx", "/vault/6.docx"]


def test_labels_and_cells_of_every_kind(spark):
    from foliant.functions.names import bates_label
    from foliant.sources import sinks

    df = spark.createDataFrame([(n,) for n in (0, 7, 999_999, 1_000_000, 10 ** 12, -3)], "n bigint")
    assert [r[0] for r in df.select(bates_label(F.col("n"), "D-")).collect()] == [f"D-{n:06d}" for n in (0, 7, 999_999, 1_000_000, 10 ** 12, -3)]
    df = spark.createDataFrame([("plain",), ("a,\r\n,b",), ("þx\x14\r\ny",), ("",)], "s string")
    assert [r[0] for r in df.select(sinks.opt_cell(F.col("s"))).collect()] == ["plain", "a b", "þx\x14 y", ""]
    assert [r[0] for r in df.select(sinks.dat_cell(F.col("s"))).collect()] == ["þplainþ", "þa, ,bþ", "þx yþ", "þþ"]


def _lines(spark, path):
    """Tables of a few mails, with lines of one number that differ late, or not at all."""
    lines = ", ".join(
        f"({o}L, {n}, {p}L, {s}L, timestamp'2020-01-0{d} 00:00:00', {q}D, {price}D, 0D, 0D, 'N', 'O')"
        for o, n, p, s, d, q, price in [
            (1, 1, 2, 1, 1, 5, 9000), (1, 1, 2, 1, 1, 4, 9000), (1, 1, 2, 1, 1, 4, 9000), (2, 1, 2, 1, 1, 1, 900),
            (3, 2, 2, 1, 3, 1, 9000), (3, 1, 4, 1, 1, 1, 2000), (4, 1, 3, 1, 1, 1, 100), (4, 2, 404, 9, 1, 1, 9000)])
    order = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
    spark.sql(f"SELECT * FROM VALUES {lines} AS t({order})").write.parquet(f"{path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, id * 10 AS o_custkey FROM range(1, 5)").write.parquet(f"{path}/orders.parquet")
    spark.sql("SELECT id AS p_partkey, concat('Part ', id) AS p_name FROM range(1, 500)").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_attachment_order_is_short_and_exact(spark, tmp_path):
    sf = _lines(spark, tmp_path)
    att = v.attachments(spark, sf)
    assert len(att.schema["ord"].dataType.fields) == 3
    rows = att.select("doc_id", "pages", "ord").orderBy("ord").collect()
    assert [(r.doc_id, r.pages) for r in rows] == [(1, 4), (1, 4), (1, 5), (2, 1), (3, 1), (3, 1), (4, 1), (4, 1)]
    assert rows[0].ord == rows[1].ord < rows[2].ord


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_instance_does_not_go_through_the_distinct_count(spark, tmp_path):
    att = catalog.hashed(spark, _lines(spark, tmp_path))
    rules = ex.Rules(exclude_signatures=True)
    report = ex.decision_report(att, ex.decide(att, rules), rules)
    assert any("min_by" in line and "conv#" not in line for line in _plan(report).splitlines() if "Aggregate" in line)
    got = {r.sha_short: (r.conversations, r.decision) for r in report.collect()}
    assert got == {"2-1": (3, "excluded"), "4-1": (1, "excluded"), "3-1": (1, "excluded"), "404-9": (1, "produced")}


def test_unread_contents_are_one_in_the_report(spark):
    att = spark.sql("""SELECT id AS doc_id, id AS conv, concat('n', id) AS name, 5000L AS size, IF(id < 3, NULL, 's') AS sha,
        NULL::bigint AS dhash, false AS img, id AS ord FROM range(5)""")
    rules = ex.Rules(exclude_names=("zzz",))
    got = {(r.name, r.conversations) for r in ex.decision_report(att, ex.decide(att, rules), rules).collect()}
    assert got == {("n0", 3), ("n3", 2)}


def test_automatic_flags_read_their_input_once(spark, tmp_path):
    sf = _lines(spark, tmp_path)
    flags = catalog.auto_flags_web(spark, sf)
    assert "lineitem" not in _plan(flags) and "o_custkey" not in _plan(flags)
    got = sorted((r.doc_id, r.sha, r.auto_reason) for r in flags.collect())
    logo = "logo/signature image"
    # Parts 4 and 404 look nearly alike, but are seen in two conversations only.
    assert got == [(1, "2-1", logo)] * 3 + [(2, "2-1", logo), (3, "2-1", logo), (3, "4-1", "tiny attachment"),
                   (4, "3-1", "tiny attachment"), (4, "404-9", "")]


def test_versions_are_compared_in_many_tasks(spark):
    rows = spark.range(200).selectExpr("id % 20 AS family", "id AS version", "concat('line ', id) AS text")
    out = registers.amendment_history(rows)
    assert out.filter("removed = 1").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert out.count() == 180


def test_a_wave_is_many_files(spark, tmp_path, monkeypatch):
    spark.sql("SELECT id AS doc_id, concat('word', id, ' other') AS text FROM range(400)").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog_files, "work_path", lambda spark, label: f"{tmp_path}/{label}")
    got = catalog_files.resumed_reindex(spark, str(tmp_path)).collect()
    many = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "resumed" / "in").glob("*.parquet"))) > 3 * many
    want = {(i, t) for i in range(400) if i % 9 for t in [f"word{i}", "other"] + ["second", "state"] * (i % 4 == 0)}
    assert {(r.doc_id, r.term) for r in got} == want and len(got) == len(want)


def test_short_texts_are_compared_by_a_table(monkeypatch):
    rng = random.Random(3)
    pairs = [["".join(rng.choice("ab \nc") for _ in range(rng.randrange(60))) for _ in range(2)] for _ in range(300)]
    long_way = redline._Distances
    monkeypatch.setattr(redline, "_Distances", None)
    short = [redline.compare_texts(a, b) for a, b in pairs]
    monkeypatch.setattr(redline, "_Distances", long_way)
    monkeypatch.setattr(redline, "SHORT", -1)
    assert short == [redline.compare_texts(a, b) for a, b in pairs]


def test_folders_are_written_file_by_file(spark, tmp_path):
    spark.range(3000).selectExpr("id", "repeat('x', 200) AS t", "id % 3 AS k").repartition("k").sortWithinPartitions("k", "id").write.partitionBy(
        "k").parquet(f"{tmp_path}/in")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        with whole_files(spark):
            rows = spark.read.schema("id long, t string, k long").parquet(f"{tmp_path}/in")
            assert rows.rdd.getNumPartitions() == 3
            rows.selectExpr("cast(id as string)", "k").write.partitionBy("k").text(f"{tmp_path}/out")
        assert spark.conf.get(key) == "4096"
    finally:
        spark.conf.set(key, before)
    for k in range(3):
        (file,) = (tmp_path / "out" / f"k={k}").glob("*.txt")
        assert [int(x) for x in file.read_text().split()] == list(range(k, 3000, 3))


def test_groups_need_no_rows_for_band_paths(spark, monkeypatch):
    from foliant.operators import similarity

    rnd = random.Random(5)
    spot = [rnd.getrandbits(64) for _ in range(9)]
    hs = [s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))) for s in spot for _ in range(40)]
    hs = sorted({h - (1 << 63) for h in hs} | {rnd.getrandbits(64) - (1 << 63) for _ in range(60)})
    gap = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    root = {h: h for h in hs}

    def top(h):
        while root[h] != h:
            h = root[h]
        return h

    for i, b in enumerate(hs):
        for a in hs[:i]:
            if gap(a, b) <= 8:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    want = {h: top(h) for h in hs}
    df = spark.createDataFrame([(h,) for h in hs], "hash bigint")
    blocks = similarity._block_forests(df.selectExpr("hash", "0 AS path", "0L AS key", f"{len(hs)}L AS n"), [(0, [])], 8, 200)
    got = {r.node: r.root for r in components(blocks).collect()}
    assert {h: got.get(h, h) for h in hs} == want
    split = []
    monkeypatch.setattr(similarity, "_tie_centres", lambda *a, real=similarity._tie_centres: split.append(1) or real(*a))
    monkeypatch.setattr(similarity, "LINK_STRIP", 500)
    monkeypatch.setattr(similarity.similar_edges, "__defaults__", (8, 4, False))
    edges = similarity.similar_edges(df, linked=True).collect()
    # Buckets of more than four hashes are not split again, and give no more pairs than connect them.
    assert not split and len(edges) < 9 * len(hs) and all(gap(r.a, r.b) == r.bits <= 8 and r.a < r.b for r in edges)
    for factor in (256, 6):
        monkeypatch.setattr(similarity, "LINK_FACTOR", factor)
        assert {r["hash"]: r.root for r in similarity.hash_groups(df).collect()} == want
    assert split


def test_plain_queues_of_names_are_counted_at_once(spark, monkeypatch):
    from foliant.operators import production

    rnd = random.Random(4)
    rows = [(i, f"f{i % 2}", f"A{i % 5}.txt") for i in range(40)] + [
        (100 + i, "F0", "_" * rnd.randrange(4) + "b.txt") for i in range(30)] + [(200 + i, None, None) for i in range(3)] + [(300, "z", "___")]
    df = spark.createDataFrame(rows, "k int, folder string, name string")
    want, taken = {}, set()
    for k, folder, name in sorted(rows):
        name = name or ""
        while ((folder or "").lower(), name.lower()) in taken:
            name = "_" + name
        taken.add(((folder or "").lower(), name.lower()))
        want[k] = name
    places = []
    monkeypatch.setattr(production, "row_position", lambda df, *a, real=production.row_position: places.append(df.count()) or real(df, *a))
    for limit, most in ((1 << 16, 30), (3, 70)):
        monkeypatch.setattr(production, "QUEUE_LIMIT", limit)
        places.clear()
        assert {r.k: r.final_name for r in production.claim_names(df, ["k"]).collect()} == want
        # Only names that start at several numbers, or in long queues, go through the rounds.
        assert places and max(places) <= most


def test_often_is_three_conversations(spark, tmp_path):
    rows = [(k, v) for k, vs in {"a": [1, 2, 3], "b": [1, 1, 2, 2], "c": [5], None: [7, 8, 9], "d": [None, 1, 2], "e": [4, None, 2, 9, 9]}.items() for v in vs]
    df = spark.createDataFrame(rows, "sha string, conv int")
    assert {r[0] for r in ex._often(df, "sha").collect()} == {"a", None, "e"}
    att = catalog.hashed(spark, _lines(spark, tmp_path))
    decided = ex.decide(att, ex.Rules(exclude_signatures=True, keep_pointers=spark.createDataFrame([("part 404|9000",)], "fp string")))
    # First instances and flags: conversations and looks of contents are not dealt out again.
    assert _plan(decided).count("Exchange hashpartitioning(sha") == 2
    assert {(r.sha, r.in_logo, r.in_keep) for r in decided.collect()} == {("2-1", True, False), ("404-9", False, True), ("4-1", False, True)}


def test_hash_of_a_picture_comes_from_the_part(spark, tmp_path):
    from foliant.functions.hashing import hex_to_long

    got = v.attachments(spark, _lines(spark, tmp_path)).filter("dhash IS NOT NULL")
    part, supplier = (F.split("sha", "-")[i].cast("bigint") for i in (0, 1))
    assert got.filter(F.col("dhash") != hex_to_long(v.image_hash(part, supplier))).count() == 0 and got.count() == 7
    assert "md5" not in next(line for line in _plan(got).splitlines() if "Project" in line and "l_suppkey" in line and "sha" in line)
