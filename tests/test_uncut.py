"""What used to be cut or fell through: late hits, late ends, folders as tables, equal names, odd white space."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import names, text
from foliant.operators import checks, exclusions, production, scan, search, similarity
from foliant.plans.catalog_stream import _stream
from foliant.streaming import progress, reindex


def test_snippet_from_far_inside(spark):
    docs = spark.createDataFrame([(1, "filler " * 5000 + "needle here " + "tail " * 100), (2, "other words")], "doc_id long, text string")
    index, lengths = search.query_index(docs, "needle")
    got = search.search_collection(index, lengths, search.snippet_sources(docs), docs.drop("text"), "needle").collect()
    assert len(got) == 1 and "needle here" in got[0].snippet and got[0].snippet.startswith("…")
    full = search.bm25(search.postings(docs), search.doc_lengths(docs), "needle words").collect()
    small = search.bm25(*search.query_index(docs, "needle words"), "needle words").collect()
    assert full == small


def test_all_files_are_found(spark):
    files = spark.range(700).select(
        F.concat(F.lit("/a/"), F.col("id"), F.lit("-x.txt")).alias("path"), F.concat(F.col("id"), F.lit("-x.txt")).alias("name"),
        F.lit(False).alias("is_dir"), F.lit(9).alias("depth"), F.lit("").alias("text"))
    assert search.find_files(files, "-X").count() == 700 and search.find_files(files, "-x", limit=500).count() == 500
    assert search.find_in_files(files, "-x").count() == 700 and search.find_in_files(files, "-x", max_depth=4).count() == 0


def test_late_end_closes_its_start(spark, tmp_path):
    src, root, state = (str(tmp_path / x) for x in ("in", "rows", "cp"))
    cols = "id long, ms long, name string, ok boolean, summary string, is_start boolean"
    hour = 3_600_000
    for step in ([(1, 0, "a", None, None, True), (2, 5, "b", None, None, True)], [(1, 2 * hour, None, True, "done", False)]):
        spark.createDataFrame(step, cols).coalesce(1).write.mode("append").parquet(src)
        rows = spark.readStream.schema(cols).parquet(src).withColumn("ts", F.timestamp_millis("ms"))
        progress.record_activities(rows, root, state).awaitTermination()
    got = {r.id: (r.name, r.summary, r.ended_at is None) for r in progress.recorded_pairs(spark, root).collect()}
    assert got == {1: ("a", "done", False), 2: ("b", None, True)}


def test_stream_reads_a_folder_of_files(spark, tmp_path):
    sf = str(tmp_path)
    spark.range(100).repartition(5).write.parquet(f"{sf}/events.parquet")
    stream = _stream(spark, sf, "events")
    q = stream.writeStream.format("memory").queryName("folder").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("folder").count() == 100


def test_changes_need_an_order(spark, tmp_path):
    changes = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path))
    with pytest.raises(ValueError):
        reindex.index_changes(changes, str(tmp_path / "r"), str(tmp_path / "c"))


def test_equal_names_in_a_group(spark):
    rows = [("a", "x.png", 10, 1), ("b", "x.png", 10, 1), ("c", "y.png", 10, 1)]
    groups = spark.createDataFrame(rows, "content string, name string, size long, group_no long").withColumns(
        {"dhash": F.lit(None).cast("long"), "members": F.lit(3)})
    files = {r.content: r.file for r in exclusions.group_layout(groups).collect()}
    assert len(set(files.values())) == 3 and files["b"] == "_" + files["a"]


def test_long_name_queue_is_dealt_out(spark):
    files = spark.range(3000).select(F.lit("f").alias("folder"), F.lit("image001.png").alias("name"), F.col("id").alias("ord"))
    got = production.claim_names(files, ["ord"]).select("ord", F.length("final_name").alias("n")).collect()
    assert {r.ord: r.n for r in got} == {i: 12 + i for i in range(3000)}


def test_no_rules_no_report(spark):
    att = spark.createDataFrame([(1, 1, "a", 10, "s", None, False, 1)], "doc_id long, conv long, name string, size long, sha string, dhash long, img boolean, ord long")
    none = exclusions.Rules(keep_names=("x",))
    assert exclusions.decision_report(att, exclusions.decide(att, none), none).isEmpty()
    table = exclusions.Rules(exclude_pointers=spark.createDataFrame([("a|10",)], "fp string"))
    assert [r.decision for r in exclusions.decision_report(att, exclusions.decide(att, table), table).collect()] == ["excluded"]


def test_white_space_and_extensions(spark):
    row = spark.range(1).select(
        names.fingerprint(F.lit("\tA.png\u00a0"), F.lit(3)), text.extension(F.lit("a..pdf")), text.extension(F.lit(".pdf")), text.extension(F.lit("..")),
        text.stem(F.lit("a..pdf")), text.extension(F.lit("b.TXT")), names.safe_name(F.lit("n" * 300)),
    ).first()
    assert tuple(row) == ("a.png|3", ".pdf", "", "", "a.", ".txt", "n" * 300)
    lines = spark.createDataFrame([("3 \u00a0\u00a0",), ("4. Real",)], "t string")
    assert [r[0] for r in lines.select(F.regexp_extract("t", checks.HEADING, 1)).collect()] == ["", "4"]


def test_range_sample_needs_no_merge(spark, capsys):
    df = spark.range(100_000).select(F.col("id").alias("k"))
    tagged = scan.split_ranges(df, ["k"], ranges=8)
    sizes = [r["count"] for r in tagged.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 25_000
    out = scan.running_sum(df, ["k"], F.lit(1), "n", ranges=8).filter("n <> k")
    assert out.isEmpty()


def test_email_batch_numbers_emails_alone(spark):
    mails = spark.createDataFrame([("b.eml", 2), ("a.eml", 3), ("c.eml", 1)], "path string, pages long").withColumns(
        {x: F.lit("") for x in ("date", "from", "to", "cc", "subject", "file_rel")})
    atts = spark.createDataFrame([("a.eml", "two.pdf", 2), ("a.eml", "one.pdf", 1)], "path string, name string, ord long")
    rows = production.batch_index(production.number_emails(mails, atts), keep=["path"]).orderBy("path").collect()
    assert [(r["Beginning Bates"], r["Ending Bates"], r["# Attachments"], r["Attachments"]) for r in rows] == [
        ("DOC-000001", "DOC-000003", "2", "one.pdf; two.pdf"), ("DOC-000004", "DOC-000005", "0", ""), ("DOC-000006", "DOC-000006", "0", "")]


def test_groups_of_files_without_a_hash(spark):
    rows = [("x", None, 1), ("x", None, 2), ("y", None, 3), ("z", 7, 4), ("w", 7, 5), ("v", 6, 6)]
    df = spark.createDataFrame(rows, "content string, dhash long, ord long")
    got = {r.ord: (r.group_no, r.members) for r in similarity.leader_listing(df).collect()}
    assert got == {4: (1, 3), 5: (1, 3), 6: (1, 3), 1: (2, 2), 2: (2, 2), 3: (3, 1)}


def test_dense_cluster_needs_no_pairs(spark):
    # 20,000 look-alikes of one picture in many conversations, and a few strays around them.
    n = 20_000
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"), (F.col("id") % 50).alias("conv"), F.lit("x.png").alias("name"), F.lit(9000).cast("long").alias("size"),
        F.concat(F.lit("s"), F.col("id")).alias("sha"),
        F.expr("shiftleft(1L, cast(id % 60 as int)) ^ shiftleft(1L, cast(floor(id / 60) % 60 as int))").alias("dhash"),
        F.lit(True).alias("img"), F.col("id").alias("ord"))
    stray = spark.createDataFrame([(n + 1, 1, "y.png", 9000, "t1", 0x3FF, True, n + 1), (n + 2, 1, "y.png", 9000, "t2", 0x0FFFFF00000, True, n + 2)],
                                  "doc_id long, conv long, name string, size long, sha string, dhash long, img boolean, ord long")
    got = {r.sha: r.auto_reason for r in exclusions.auto_flags(rows.unionByName(stray)).collect()}
    assert sum(v == "logo/signature image" for v in got.values()) >= n and got["t2"] == ""
    # 0x3ff is ten bits from nothing, eight from the pairs inside it: a neighbour, not a member of the centre.
    assert got["t1"] == "logo/signature image"
