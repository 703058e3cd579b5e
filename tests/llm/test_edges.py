"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import chat, decontaminate, licences, line_dedup, mixing, pii, quality, secret_scan, sharding, shingle_sets, simhash

LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
LINE = "This line is long enough to count as a key of its own, yes."
ROWS = [
    (1, None), (2, ""), (3, LONG), (4, f"{LINE}\nmail me at ann@example.org or +1 (234) 567-8901"), (4, f"{LINE}\nmail me at ann@example.org or +1 (234) 567-8901"),
    (5, LINE), (6, LINE), (7, f"  {LINE.upper()}\t"), (8, LINE), (None, LINE), (None, None), (9, "   \n\t\n"), (10, "ünï" * 50),
]
CLASH = ["_row", "_id", "_text", "pos", "tag", "doc", "words", "fp", "_stats", "_kept", "_rate", "_copies", "kept_text", "n_lines", "shard", "h", "size", "kind", "_doc", "_tag", "_nth"]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string")
    return base.select("*", *(F.lit(f"x{c}").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 0, 1), (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, LINE), (1, LINE), (2, None), (3, ""), (4, "too short")], "item_id long, text string")


def run_all(spark, docs, labels, bench):
    path = F.concat(F.lit("a/b/"), F.col("doc_id").cast("string"))
    domain = F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'clean' END")
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text", *CLASH)
    spans = pii.personal_spans(docs)
    return {
        "leaks": decontaminate.leaks(docs, bench), "no_leaks": decontaminate.drop_leaks(docs, bench),
        "secrets": secret_scan.scan(docs, labels, F.col("value").rlike("[0-9]"), path=path),
        "quality": quality.judge(docs.select("doc_id", "text"), quality.train(docs, labels)), "good": quality.keep_good(docs, labels),
        "pii": pii.report(docs), "redacted": pii.redacted(docs, spans),
        "mixed": mixing.mix(docs, labels, domain, {"clean": 0.9, "toxic": 0.1}),
        "chat": chat.digests(chat.format_windows(turns)), "shards": sharding.assign_shards(docs, 1 << 20),
        "licences": licences.licences(docs, path), "components": simhash.document_components(docs), "one": simhash.keep_one(docs),
        "similar": shingle_sets.keep_one(docs),
        "lines": line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)),
    }


def test_odd_rows(spark, docs, labels, bench):
    got = {k: v.collect() for k, v in run_all(spark, docs, labels, bench).items()}
    n = len(ROWS)
    for k in ("quality", "pii", "shards", "components", "lines", "redacted"):
        assert len(got[k]) == n, k
    for k in ("good", "mixed", "one", "similar", "no_leaks"):
        assert all(r[c] == f"x{c}" for r in got[k] for c in CLASH), k
    # Licences: rows that agree in id and path share one.
    assert len(got["licences"]) == n
    assert {r.doc_id for r in got["leaks"]} == {4, 5, 6, 7, 8, None}
    assert {r.doc_id for r in got["no_leaks"]} == {1, 2, 3, 9, 10}
    assert [r._base_failed for r in got["quality"] if r.doc_id in (1, 2, 9)] == [True] * 3
    by = {r.doc_id: r for r in got["pii"]}
    assert (by[4].n_email, by[4].n_phone, by[1].n_email, by[1].spans) == (1, 1, 0, "")
    assert "[EMAIL]" in {r.doc_id: r.redacted_text for r in got["redacted"]}[4]
    lines = {}
    for r in got["lines"]:
        lines.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped))
    # Documents 4 to 8 and the one without an id hold the line; 8 is the largest.
    assert lines[8] == [(1, 0)] and lines[5] == [(1, 1)] and lines[7] == [(1, 1)] and lines[4] == [(2, 1), (2, 1)]
    assert sorted(lines[None]) == [(1, 0), (1, 1)] and lines[1] == lines[2] == [(1, 0)]
    comp = {r.doc_id: r.component_id for r in got["components"] if r.doc_id is not None}
    # No words: fingerprint zero, one component.
    assert comp[1] == comp[2] == comp[9] == 1 and comp[6] == comp[7] == comp[8] == 5
    assert sorted(r.doc_id for r in got["one"]) == sorted(r.doc_id for r in got["similar"]) == [1, 3, 4, 5, 10]
    assert sum(r.n_turns for r in got["chat"]) == n


def test_empty_tables(spark, docs, labels, bench):
    none = docs.limit(0)
    for k, df in run_all(spark, none, labels.limit(0), bench.limit(0)).items():
        assert df.collect() == [], k
    for k, df in run_all(spark, docs, labels.limit(0), bench.limit(0)).items():
        df.collect()


def test_stages_keep_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
