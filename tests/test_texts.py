import random

from pyspark.sql import functions as F

from foliant.functions import markdown, text, tokens
from foliant.operators import checks, messages, redline, registers, search

LINT_TEXT = """1. Terms
"Fee" means x. ("Fee") Section 9 applies, see Exhibit B here, date [TBD].
2. Scope
3. Law
Exhibit A"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_lint(spark):
    rows = checks.lint(docs(spark, LINT_TEXT)).orderBy("ord").collect()
    assert [(r.severity, r.category, r.detail) for r in rows] == [
        ("high", "Defined terms", '"Fee" is defined 2 times — consolidate to one definition to avoid conflicts.'),
        ("high", "Cross-references", "Reference to §9 does not resolve to any section in this document."),
        ("high", "Execution readiness", "Unfilled placeholder(s) found: [TBD], TBD."),
        ("medium", "Cross-references", "Exhibit B is referenced but no matching Exhibit heading was found."),
        ("medium", "Execution readiness", 'No signature block detected (no "By:/Name:/Title:" or "IN WITNESS WHEREOF").'),
        ("low", "Defined terms", '"Fee" is defined but never used — consider removing the definition.'),
    ]


def test_lint_report_text(spark):
    d = docs(spark, LINT_TEXT, "IN WITNESS WHEREOF")
    out = {r.doc_id: r for r in checks.lint_reports(d, checks.lint(d)).collect()}
    assert out[0].report.startswith('6 issue(s) found:\n- [HIGH] Defined terms: "Fee" is defined 2 times')
    assert "- **LOW** · Defined terms" in out[0].footer
    assert out[1].report.startswith("No defined-term") and out[1].footer == ""


def test_placeholders_beyond_eight(spark):
    body = " ".join("_" * n for n in range(4, 14))
    r = checks.lint(docs(spark, body)).filter("severity = 'high'").first()
    assert r.detail.count(",") == 7 and r.detail.endswith(" ….")


def test_citations(spark):
    cite = "Section 4.2, section 2 and Article 33(1) GDPR; § 7 of the Companies Act"
    df = spark.createDataFrame([(1, cite, "1. A\n2. B\n3. C"), (2, cite, "1. A\n3. C"), (3, "none", "1. A\n2. B"), (4, "section 2", "1. A\n2. B")],
                               "id int, deliverable string, source string")
    out = {r.id: r for r in checks.verify_citations(df).withColumn(
        "foot", checks.citation_footer(F.col("cited"), F.col("unverified"))).collect()}
    assert out[1].cited == ["§4.2", "§2"] and out[1].unverified == ["§4.2"]
    assert "§4.2 could not be found" in out[1].foot and "relying on it. The other 1 cited" in out[1].foot
    assert out[2].unverified == [] and out[3].foot == "" and "all 1 cited" in out[4].foot


def test_citations_against_many_sources(spark):
    d = spark.createDataFrame([(1, "section 2, section 9 and clause 4"), (2, "section 1")], "matter int, deliverable string")
    s = spark.createDataFrame([(1, "1. A\n2. B"), (1, "3. C\nunder clause 4"), (1, "none")], "matter int, text string")
    got = {r.matter: r.unverified for r in checks.verify_against_sources(d, s).collect()}
    assert got == {1: ["§9"], 2: []}


def test_citation_numbers_are_not_cut(spark):
    t = "Section 4.2, section 12, Article 33(1) GDPR, § 7 of the Companies Act, clause 9.1"
    assert docs(spark, t).select(checks.cited_sections(F.col("text"))).first()[0] == ["§4.2", "§12", "§9.1"]


def test_word_edges_next_to_accents(spark):
    assert docs(spark, "état: écTBD é TBD é").select(checks.placeholders(F.col("text"))).first()[0] == ["TBD"]


def test_redline_examples():
    assert redline.compare_texts("a b c", "a x c") == ("a <del>b</del><ins>x</ins> c", 1, 1)
    assert redline.compare_texts("same\ntext", "same\ntext") == ("same\ntext", 0, 0)
    assert redline.compare_texts("a\nb", "a\nnew\nb") == ("a\n<ins>new</ins>\nb", 1, 0)


def table_script(a, b):
    n, m = len(a), len(b)
    dp = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            dp[i][j] = dp[i + 1][j + 1] + 1 if a[i] == b[j] else max(dp[i + 1][j], dp[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(("eq", a[i]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and dp[i + 1][j] >= dp[i][j + 1]):
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("ins", b[j]))
            j += 1
    return out


def test_script_equals_full_table():
    rnd = random.Random(2)
    for _ in range(300):
        a = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 25))]
        b = [rnd.choice("abcd") for _ in range(rnd.randrange(0, 25))]
        assert redline._script(a, b) == table_script(a, b)


def test_script_of_unlike_and_long_sequences():
    rnd = random.Random(6)
    for _ in range(12):
        a = [rnd.randrange(40) for _ in range(rnd.randrange(150, 260))]
        b = [rnd.randrange(60) for _ in range(rnd.randrange(150, 260))]
        assert redline._script(a, b) == table_script(a, b)
    old = [f"line {i}" if i % 3 else "the same" for i in range(200_000)]
    new = list(old)
    for k in range(9):
        new[k * 20_011 + 5] = f"changed {k}"
    new.insert(150_000, "the same")
    got = redline._script(old, new)
    assert [v for kind, v in got if kind != "ins"] == old and [v for kind, v in got if kind != "del"] == new
    assert sum(kind != "eq" for kind, _ in got) == 19


def test_redline_operator_keeps_both_texts(spark):
    rows = [("k1", "a\nb c d\ne", "a\nb x d\ne\nf"), ("k2", "", "new"), ("k3", "x", "x")]
    df = spark.createDataFrame(rows, "k string, old_text string, new_text string")
    out = redline.redline(df, ["k"]).withColumns(
        {"o": redline.reject_changes(F.col("markup")), "n": redline.accept_changes(F.col("markup"))}).collect()
    got = {r.k: r for r in out}
    assert (got["k1"].added, got["k1"].removed, got["k3"].added) == (2, 1, 0)
    assert got["k1"].o.rstrip("\n") == rows[0][1] and got["k1"].n == rows[0][2] and got["k2"].n == "new"


def test_apply_and_parse_redline(spark):
    df = spark.createDataFrame([("one two two", "two", "2"), ("x", " ", "y"), ("x", "z", "y"), ("", "a", "b")], "t string, f string, r string")
    got = [tuple(r[0]) for r in df.select(redline.apply_redline(F.col("t"), F.col("f"), F.col("r"))).collect()]
    assert got == [("one <del>two</del><ins>2</ins> two", "applied"), ("x", "empty find"), ("x", "not found"), ("", "no document")]
    runs = df.limit(1).select(redline.redline_runs(F.lit("a **b** <ins>c\nd</ins><del>e</del>"))).first()[0]
    assert [tuple(r) for r in runs] == [("plain", "a "), ("bold", "b"), ("plain", " "), ("ins", "c\nd"), ("del", "e")]


def test_markdown_table(spark):
    md = "intro | x\ntext\n| a | b |\n| --- | :-: |\n| 1 | 2 |\n\n| 3 |"
    got = [tuple(r) for r in markdown.first_table(docs(spark, md, "no table | here\nat all")).collect()]
    assert got == [(0, 0, ["a", "b"]), (0, 1, ["1", "2"])]
    two = "h | k\n---|---\n1 | 2\n|---|\n3 | 4"
    assert [r.cells for r in markdown.first_table(docs(spark, two)).collect()] == [["h", "k"], ["1", "2"]]


def test_text_edges(spark):
    nbsp = " a   b﻿"
    one = spark.range(1).select(
        text.squash_ws(F.lit(nbsp)), text.trim_ws(F.lit(nbsp)), text.utf16_length(F.lit("a😀")),
        tokens.estimate_tokens(F.lit("abcde")), tokens.estimate_tokens(F.lit("")),
        text.html_to_text(F.lit("<p>a&nbsp;b</p><script>x</script>\n\n\n<b>&lt;c&gt;</b>")),
        text.stem(F.lit("a.b.txt")), text.stem(F.lit(".env")), text.extension(F.lit(".env")), text.extension(F.lit("X.PDF")),
        text.address_list(F.array(F.lit("a"), F.lit("b"))), text.address_list(F.array(F.lit("a"), F.lit("b")), "web"),
    ).first()
    assert tuple(one) == ("a b", "a   b", 3, 2, 0, "a b\n\n<c>", "a.b", ".env", "", ".pdf", "a; b", "a, b")


def test_snippets(spark):
    long = "word " * 40 + "needle " + "tail " * 80
    df = docs(spark, long, "short text", "")
    got = [r[0] for r in df.select(text.snippet(F.col("text"), ["needle", "zzz"])).collect()]
    at = long.index("needle")
    assert got == ["…" + long[at - 60:at + 160].strip() + "…", "short text", ""]


def test_search_without_terms_or_hits(spark):
    d = docs(spark, "alpha beta", "")
    p, n = search.postings(d), search.doc_lengths(d)
    assert {(r.doc_id, r.dl) for r in n.collect()} == {(0, 2), (1, 0)}
    assert search.bm25(p, n, "the of", 5).isEmpty() and search.search_texts(d, "the of").isEmpty()
    assert [r.doc_id for r in search.bm25(p, n, "Alpha", 5).collect()] == [0]
    c = d.withColumn("collection", F.lit("Main"))
    keys = ("collection", "doc_id")
    lib = [search.search_library(search.postings(c, keys), search.doc_lengths(c, keys), "beta", scope=s, shared_statistics=g).count()
           for s, g in (("main", False), ("other", False), (None, True))]
    assert lib == [1, 0, 1]


def test_progress_and_messages(spark):
    df = spark.createDataFrame([("Reading documents", 1, 2), ("Numbering documents", 5, 5), ("odd", 1, 3), ("odd", 1, 0)], "p string, d int, t int")
    assert [r[0] for r in df.select(messages.overall_percent(F.col("p"), F.col("d"), F.col("t"))).collect()] == [10, 100, 33, 0]
    chat = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (1, 2, "assistant"), (2, 0, "user")], "conv_id int, turn int, role string")
    part = {(r.conv_id, r.turn): r.part for r in messages.deliverable_and_chat(chat).collect()}
    assert part == {(1, 0): "chat", (1, 1): "deliverable", (1, 2): "chat", (2, 0): "chat"}
    assert messages.deliverable_and_chat(chat, "given").filter("part = 'chat'").count() == 4
    assert messages.price_table(spark).count() == 3


def test_registers(spark):
    notes = spark.createDataFrame([
        ("a.txt", "Signed on 3 March 2021.\nPaid circa June 2020 and on 2021-02-30."), ("b.txt", "Sent January 5, 2019"), ("c.txt", "none")],
        "name string, text string")
    rows = [(r.shown, r.source) for r in registers.chronology(notes).collect()]
    assert rows == [("2019-01-05", "b.txt"), ("~2020-06-01", "a.txt"), ("2021-03-03", "a.txt")]
    assert [r[0] for r in registers.undated(notes).collect()] == ["c.txt"]
    d = docs(spark, "1. Intro\n7.2 Change of control needs consent", "nothing")
    got = registers.clause_matrix(d, {"coc": ["change of control"]}).collect()
    assert [r.coc for r in got] == ["§7.2: 7.2 Change of control needs consent", "Not addressed"]
    when = spark.createDataFrame([("2020-01-31", 12, "2023-05-01")], "s string, m int, t string").select(
        registers.next_renewal(F.to_date("s"), F.col("m"), F.to_date("t"))).first()[0]
    assert str(when) == "2024-01-31"


def test_sql_functions(spark):
    from foliant.functions.sql import register_functions

    register_functions(spark)
    row = spark.sql(
        "SELECT hamming64(-1, 0), tokenize('The Quick, a fox-x'), fingerprint(' A.PDF ', 7), bates_label('D', 1234567)").first()
    assert tuple(row) == (64, ["quick", "fox"], "a.pdf|7", "D1234567")
    made = spark.createDataFrame([("The Quick, a fox-x",)], "t string")
    assert made.select(text.tokenize(F.col("t"))).first()[0] == row[1]
