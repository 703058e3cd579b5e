import random

from pyspark.sql import functions as F

from foliant.functions import names, text
from foliant.operators import exclusions as ex
from foliant.operators import highlights, incremental as inc
from foliant.operators import production as prod

RECORDS = [
    ("DOC-000001", "DOC-000004", 4, "2026-03-02", "a@x.com", "b@y.com", "c@z.com", 'Hello, "world"', "Email", "email", "Cat 1/a/a.pdf", 2, "x.pdf; y.png"),
    ("DOC-000005", "DOC-000005", 1, "", "", "", "", "Contract", "NDA", "doc", "contract.pdf", 0, ""),
    ("DOC-000006", "DOC-000006", 0, "", "", "", "", "Sheet", "Document", "doc", "s.xlsx", 0, ""),
]
SCHEMA = (
    "beg_bates string, end_bates string, pages int, date string, `from` string, `to` string, cc string, subject string,"
    " doc_type string, kind string, file_rel string, att_count int, att_names string"
)


def records(spark):
    return spark.createDataFrame(RECORDS, SCHEMA).withColumns(
        {"beg_attach": F.lit(None).cast("string"), "end_attach": F.lit(None).cast("string"), "native_rel": F.lit("")})


def test_scope(spark):
    docs = spark.createDataFrame([("email",), ("doc",), ("email",)], "kind string")
    counts = [prod.production_scope(docs, *flags).count() for flags in
              [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]]
    assert counts == [2, 3, 3, 0]


def test_review_index_and_load_file(spark):
    rows = prod.review_index(records(spark)).collect()
    assert len(rows[0]) == 10 and rows[0][2] == "4" and rows[0][9] == "2"
    assert rows[1][9] == "" and rows[2][2] == ""
    load = prod.load_file(records(spark)).collect()
    assert len(load[0]) == 15 and load[0][2:5] == ("DOC-000001", "DOC-000004", "") and load[0][11:14] == ("Cat 1/a/a.pdf", "", "4")


def test_opticon(spark):
    rows = prod.opticon_rows(records(spark), "DOC-").orderBy("page_id").drop("page").collect()
    assert [tuple(r) for r in rows] == [
        ("DOC-000001", "", "Cat 1\\a\\a.pdf", "Y", "", "", "4"), ("DOC-000002", "", "Cat 1\\a\\a.pdf", "", "", "", ""),
        ("DOC-000003", "", "Cat 1\\a\\a.pdf", "", "", "", ""), ("DOC-000004", "", "Cat 1\\a\\a.pdf", "", "", "", ""),
        ("DOC-000005", "", "contract.pdf", "Y", "", "", "1")]


def test_numbers_tile_and_never_truncate(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1] * 20 + list(range(40))), i, rnd.randrange(0, 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "family int, child int, span bigint")
    out = prod.number_records(df, ["family", "child"], "D", 999_900).orderBy("beg_no", "end_no").collect()
    used = [r for r in out if r.span]
    assert used[0].beg_no == 999_900
    assert all(b.beg_no == a.end_no + 1 for a, b in zip(used, used[1:]))
    assert used[-1].end_bates == f"D{used[-1].end_no}" and len(used[-1].end_bates) == 8
    assert all(r.beg_bates == "" for r in out if not r.span)


def test_sizes(spark):
    def pairs(rows):
        return prod.excluded_summary(spark.createDataFrame(rows, "name string, size int"))

    same = spark.createDataFrame([(1000, 1200), (40100, 512300)], "a int, b int").select(prod.same_size(F.col("a"), F.col("b")))
    assert [r[0] for r in same.collect()] == [True, False]
    assert tuple(pairs([("x", 1000), ("x", 1015)]).first()) == (2, 0)
    assert tuple(pairs([("x", 40000), ("x", 512000)]).first()) == (2, 1)
    assert tuple(pairs([("tpl.pdf", 169773), ("tpl.pdf", 171002)]).first()) == (2, 0)
    assert tuple(pairs([("A.PDF", 1000), ("a.pdf", 9000)]).first()) == (2, 1)
    assert tuple(pairs([("a", 1), ("a", 1), ("b", 2)]).first()) == (3, 0)
    assert tuple(pairs([]).first()) == (0, 0)


def test_small_attachments(spark):
    df = spark.createDataFrame([(1024,), (50_000,), (200_000,), (8192,), (0,)], "size int")
    assert [r[0] for r in df.select(ex.is_small(F.col("size"), True)).collect()] == [True, False, False, False, False]
    assert not any(r[0] for r in df.select(ex.is_small(F.col("size"), False)).collect())


def test_decision_change(spark):
    def shas(*s):
        return spark.createDataFrame([(x,) for x in s], "sha string")

    assert {r.sha for r in inc.changed_decisions(shas("a", "b"), shas("a", "c")).collect()} == {"b", "c"}
    assert inc.changed_decisions(shas("a", "b"), shas("b", "a")).isEmpty()
    att = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "doc_id int, sha string")
    assert [r.doc_id for r in inc.affected_documents(att, shas("b")).collect()] == [1]


ATT = "doc_id string, conv string, name string, size int, sha string, dhash bigint, img boolean, ord int"


def test_same_name_other_image(spark):
    a, a2, b = 0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0E, 0x3333CCCC3333CCCC
    att = spark.createDataFrame([
        ("msg1", "s1", "image001.png", 5000, "A", a, True, 1), ("msg2", "s2", "image001.png", 6000, "B", b, True, 2),
        ("msg3", "s3", "company-logo.png", 5000, "A", a, True, 3), ("msg4", "s4", "image001.png", 5100, "A2", a2, True, 4)], ATT)
    rules = ex.Rules(exclude_pointers=("image001.png|5000",))
    out = ex.dispositions(att.withColumn("inline", F.lit(False)), ex.decide(att, rules), rules)
    assert {r.doc_id: r.disposition for r in out.collect()} == {
        "msg1": "excluded", "msg2": "produced", "msg3": "excluded", "msg4": "excluded"}
    keep = ex.Rules(exclude_pointers=("image001.png|5000",), keep_pointers=("image001.png|5100",))
    assert {r.sha: (r.in_exclude, r.in_keep) for r in ex.decide(att, keep).collect()} == {"A": (False, True), "A2": (False, True)}


def test_reencoded_banner(spark):
    att = spark.createDataFrame([(f"m{i}", f"s{i}", "b.png", 9000 + i, f"sha{i}", 77 << 20 | 0xF0F0F, True, i) for i in range(4)], ATT)
    rules = ex.Rules(exclude_signatures=True)
    assert ex.decide(att, rules).filter("in_logo").count() == 4
    assert ex.decide(att, ex.Rules()).isEmpty()


def test_names(spark):
    cases = [("drawing.pdf", "drawing.pdf"), ("drawing.PDF", "drawing.PDF"), ("report", "report.pdf"), ("data.xls", "data.xls.pdf")]
    df = spark.createDataFrame(cases, "n string, want string")
    assert all(r[0] == r[1] for r in df.select(names.pdf_name(F.col("n")), "want").collect())
    one = spark.range(1).select(
        names.single_pdf_ext(F.lit("Documents/x/drawing.pdf.pdf")), names.restore_dir(F.lit("Mailbox/2026/message.eml")),
        names.restore_dir(F.lit("message.eml")), names.restore_dir(F.lit("Mailbox\\Inbox\\msg.eml")),
        names.undecorate_name(F.lit("DOC-000127 - image018 (69004 bytes, dh=c1d497e9e0f0f0c0).png"), "DOC-"),
        names.undecorate_name(F.lit("a (12 bytes).png")), names.safe_name(F.lit('a<b>:"c.txt')), names.safe_name(F.lit("")),
        names.decorate_name(F.lit("x.png"), F.lit(5), F.lit(None).cast("string")), names.attachment_pdf_name(F.lit("12:30.png"))).first()
    assert tuple(one) == (
        "Documents/x/drawing.pdf", "Documents/Mailbox/2026/message", "Documents/message", "Documents/Mailbox/Inbox/msg",
        "image018.png", "a.png", "a_b___c.txt", "attachment", "x (5 bytes, dh=none).png", "12_30.pdf")


def test_claimed_names_replay_the_loop(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["d", "e"]), "_" * rnd.randrange(3) + rnd.choice(["a.pdf", "A.pdf", "b.pdf"])) for i in range(80)]
    rows += [(100 + i, "f", "same.pdf") for i in range(20)]
    used, want = set(), {}
    for i, folder, n in rows:
        while (folder, n.lower()) in used:
            n = "_" + n
        used.add((folder, n.lower()))
        want[i] = n
    df = spark.createDataFrame(rows, "i int, folder string, name string")
    assert {r.i: r.final_name for r in prod.claim_names(df, ["i"]).collect()} == want


def test_mixed_queue_of_many_files(spark):
    """One name holds most of a folder, and a few files start with one, three or seven underscores."""
    rnd = random.Random(2)
    rows = [(i, "f", "_" * rnd.choice([0] * 40 + [1, 3, 7]) + "image001.png") for i in range(3000)]
    rows += [(5000, "f", None), (5001, None, "x"), (5002, None, "_x"), (5003, None, "x")]
    used, want = set(), {}
    for i, folder, n in rows:
        n = n or ""
        while (folder, n) in used:
            n = "_" + n
        used.add((folder, n))
        want[i] = len(n)
    df = spark.createDataFrame(rows, "i int, folder string, name string").repartition(7)
    got = prod.claim_names(df, ["i"]).select("i", "folder", F.length("final_name").alias("n"), "final_name").collect()
    assert {r.i: r.n for r in got} == want
    assert len({(r.folder, r.final_name) for r in got}) == len(rows)
    assert prod.claim_names(df.limit(0), ["i"]).collect() == []


def test_stale_outputs(spark):
    listing = spark.createDataFrame(
        [("kept", n) for n in ("kept.pdf", "report.pdf", "TPL4AL.pdf", "_report.pdf")] + [("gone", "gone.pdf"), ("old", "x.pdf")],
        "folder string, name string")
    items = spark.createDataFrame(
        [("Kept", ["kept.pdf"]), ("kept", ["Report.pdf"]), ("old", None)], "folder string, files array<string>")
    got = {(r.folder, r.name) for r in prod.stale_outputs(listing, items).collect()}
    assert got == {("kept", "TPL4AL.pdf"), ("kept", "_report.pdf"), ("gone", "gone.pdf")}


def test_index_table_schema_depends_on_emails(spark):
    cols = "kind string, date string, `from` string, `to` string, subject string, title string, name string, doc_type string, summary string, path string, ext string"
    doc = ("doc", None, None, None, None, "t", "t.txt", None, None, "/t.txt", ".txt")
    mail = ("email", "d", "f", "t", "s", None, "m.eml", "Email", None, "/m.eml", ".eml")
    assert len(prod.index_table(spark.createDataFrame([doc], cols)).columns) == 5
    both = prod.index_table(spark.createDataFrame([doc, mail], cols))
    assert len(both.columns) == 7 and [r.Subject for r in both.collect()] == ["t", "s"]


def test_highlight_rows(spark):
    kind = "name string, highlights array<struct<text:string,color:string,page:int,context:string>>"
    df = spark.createDataFrame([
        ("a.docx", [("indemnify", "yellow", 3, "the clause"), ("liability", "#00ff00", None, "")]), ("b.pdf", []), ("c.pdf", None)], kind)
    rows = [tuple(r) for r in highlights.highlight_table(df).collect()]
    assert rows == [("a.docx", "3", "yellow", "indemnify", "the clause"), ("a.docx", "", "#00ff00", "liability", "")]


def test_marked_passages(spark):
    marks = spark.createDataFrame(
        [(1, 1, 0, [10.0, 90.0, 60.0, 90.0, 10.0, 80.0, 60.0, 80.0], [0.0] * 4, [255, 255, 0])],
        "doc_id int, page int, mark_no int, q array<double>, rect array<double>, rgb array<int>")
    marks = marks.withColumn("boxes", highlights.quad_boxes(F.col("q"), F.col("rect")))
    items = spark.createDataFrame([
        (1, 1, "world", 35.0, 55.0, 82.0, 90.0), (1, 1, "hello", 12.0, 30.0, 82.5, 90.0), (1, 1, "right", 70.0, 90.0, 82.0, 90.0),
        (1, 1, "below", 12.0, 30.0, 60.0, 70.0), (1, 2, "other", 12.0, 30.0, 82.0, 90.0)],
        "doc_id int, page int, str string, x0 double, x1 double, y0 double, y1 double")
    r = highlights.marked_passages(marks, items).first()
    assert (r.text, r.color, r.context) == ("hello world", "yellow", "hello world right")


def test_config_key_and_drift(spark):
    df = spark.createDataFrame([(1, 0, True, 2, "DOC-000001", 2), (2, 1, False, 2, "DOC-000003", 5), (3, 2, True, 1, "DOC-000005", 1)],
                               "doc_id int, position int, reuse boolean, prev_span int, prev_beg string, new_span int")
    out = inc.drifted_families(df).orderBy("doc_id").collect()
    assert [(r.planned_beg, r.drifted) for r in out] == [("DOC-000001", False), ("DOC-000003", False), ("DOC-000008", True)]
    keys = df.select(inc.config_key(F.struct("prev_span", "new_span")).alias("k")).collect()
    assert keys[0].k != keys[1].k and len(keys[0].k) == 64


def test_conversation_and_ids(spark):
    df = spark.createDataFrame([("RE: Fwd:  Big   Deal", "x"), ("aw: Tr: a", "y"), ("re:", "z"), (None, "w")], "s string, i string")
    got = [tuple(r) for r in df.select(
        text.conversation_key(F.col("s"), F.col("i")), text.conversation_key(F.col("s"), F.col("i"), "web")).collect()]
    assert got == [("big deal", "big   deal"), ("a", "aw: tr: a"), ("id:z", "z"), ("id:w", "w")]
    path = "/été/😀.pdf"
    h = 5381
    for unit in [int.from_bytes(path.encode("utf-16-le")[i:i + 2], "little") for i in range(0, len(path.encode("utf-16-le")), 2)]:
        h = (h * 33 + unit) & 0xFFFFFFFF
    digits = ""
    while h:
        digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
    assert spark.range(1).select(text.path_id(F.lit(path))).first()[0] == "d" + digits


def test_enrichment_ignores_failing_batches(spark):
    df = spark.createDataFrame(
        [(i, f"n{i}", "doc", "", "", "", "text", None, None) for i in range(12)],
        "doc_id bigint, name string, kind string, subject string, `from` string, `to` string, head string, summary string, doc_type string").coalesce(1)

    def label(items):
        if any(i["id"] == 7 for i in items):
            raise ValueError("no reply")
        return [{"id": i["id"], "summary": "s"} for i in items] + [{"id": 999, "summary": "stranger"}]

    assert sorted(r.doc_id for r in inc.enrich(df, label).filter("error IS NULL").collect()) == [0, 1, 2, 3, 4, 10, 11]
    raw = spark.createDataFrame([('Sure: [{"id":"a","docType":"NDA","parties":["x"]}] done',), ("none",)], "r string")
    rows = raw.select(inc.parse_reply(F.col("r")).alias("p")).collect()
    assert rows[0].p[0].docType == "NDA" and not rows[1].p


def test_families_are_found_where_they_were_numbered(spark):
    import random

    rnd = random.Random(9)
    # One family holds most records and is dealt over ranges; others have no head, and some records no family.
    rows = [(f, k, rnd.choice([0, 1, 3]), i) for f in [*range(-20, 20), None] for i, k in enumerate(rnd.sample(range(6), 3))]
    rows += [(7, 10 + i, rnd.choice([0, 2]), i) for i in range(600)] + [(19, None, 1, 1)]
    df = spark.createDataFrame(rows, "family bigint, child int, span bigint, ord int").repartition(5)
    order = ["family", "child", "ord"]
    # In number order, which is that of the rows.
    plain = sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in (r[0], r[1], r[3])))
    at, of = 1, {}
    for f, k, n, _ in plain:
        of.setdefault(f, []).append((k, at, n, f"DOC-{at:06d}" if n else "", f"DOC-{at + n - 1:06d}" if n else ""))
        at += n
    kept = prod.number_records(df, order, families=True)
    assert {"_range", "_cut"} <= set(kept.columns)
    for numbers in (kept, prod.number_records(df, order)):
        got = {}
        for r in prod.family_ranges(numbers).collect():
            got.setdefault(r.family, []).append((r.child, r.beg_no, r.span, r.beg_bates, r.end_bates))
            some = [x for x in of[r.family] if x[2]]
            assert r.end_attach == (some[-1][4] if some else "")
            assert r.beg_attach == of[r.family][0][3]
        assert {f: sorted(x, key=str) for f, x in got.items()} == {f: sorted(x, key=str) for f, x in of.items() if f is not None}
        for r in prod.family_ranges_web(numbers.filter("span > 0")).collect():
            kids = [x for x in of[r.family] if x[0] and x[0] > 0 and x[2]]
            own = r.child == 0 and r.family is not None and kids
            assert (r.beg_attach, r.end_attach) == ((kids[0][3], kids[-1][4]) if own else ("", ""))


def test_review_tables_deal_their_records_out_once(spark):
    from foliant.plans import catalog as plans
    from foliant.plans import catalog_text as catalog

    plan = catalog.dat_lines_web(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan and "hashpartitioning(family" not in plan

    plan = plans.load_file_web(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan and "hashpartitioning(family" not in plan
