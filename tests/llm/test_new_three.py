"""Merkle manifest, rule ensemble and fill-in-middle frames: brute force, held-out rows, round trips and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import frames, merkle, rule_ensemble
from foliant.llm.common import table

LONG = "\n".join(f"line {i} " + "word " * (i % 40) for i in range(40_000))
ODD = [
    (1, "a", "en", 3, "x\ny"), (2, "a", None, None, None), (3, None, "en", 0, ""), (4, "b", "de", 9, "ü\n\n" * 5), (4, "b", "de", 9, "ü\n\n" * 5),
    (None, "a", "en", 1, "no id"), (None, None, None, None, None), (5, "", "en", 4, "<P>"), (6, "long", "en", len(LONG), LONG), (7, "a", "en", 1, "\n"), (8, "a", "en", 1, "z"),
]
CLASH = ["grp", "id", "leaf", "claim", "nth", "_store", "_key", "n", "form", "_stats", "score", "predicted", "frames", "g", "i", "path", "root"]


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf the (left, right) of each level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fanout * fanout:i // fanout * fanout + fanout]
            paths[k].append(("".join(run[:i % fanout]), "".join(run[i % fanout + 1:])))
            at[k] = i // fanout
        level = [sha(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows: list[tuple], fanout: int = 3) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        leaf = sha(*map(field, r))
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        claim = sha(*map(field, (*r[:4], r[4].replace("\n", "")))) if bad else leaf
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf, claim, r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda x: x[:2])
        trees.append(tree([x[1] for x in groups[name]], fanout))
    root, above = tree([t[0] for t in trees], fanout)
    out = []
    for name, (subroot, paths), up in zip(names, trees, above):
        for (_, leaf, claim, i), path in zip(groups[name], paths):
            whole = path + up
            h = claim
            for left, right in whole:
                h = sha(left, h, right)
            out.append((i, leaf, subroot, root, sha(*(a + b for a, b in whole)), h, h == root))
    return out


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def manifest_rows(docs, **options) -> list[tuple]:
    gone = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.verified(merkle.manifest(docs, altered={"text": gone}, **options))
    return sorted((tuple(r) for r in out.collect()), key=key)


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.createDataFrame(ODD, "doc_id long, source string, lang string, n_chars long, text string")
    return base.select("*", *(F.lit(f"x{c}").alias(c) for c in CLASH))


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_against_brute_force(spark, fanout):
    rnd = random.Random(fanout)
    rows = [(i, rnd.choice(["hot"] * 6 + ["é", "Z", "a", None, f"only{i}"]), "en", i % 7, f"t{i}\n{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest_rows(docs, fanout=fanout) == sorted(brute(rows, fanout), key=key)


def test_manifest_of_odd_rows(spark, odd):
    got = manifest_rows(odd)
    assert got == sorted(brute(ODD), key=key)
    changed = {r[0] for r in got if not r[-1]}
    assert changed == {i for i, _, _, _, t in ODD if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and t and "\n" in t}
    assert manifest_rows(odd.limit(0)) == []
    one = odd.filter("doc_id = 1")
    (row,) = manifest_rows(one)
    assert row[1] == row[2] == row[3] and row[4] == sha("")


def test_rules_are_the_paths_of_the_trees():
    a, b = rule_ensemble.Bound("n_words", True, 2.0), rule_ensemble.Bound("n_words", True, 5.0)
    c = rule_ensemble.Bound("sign_share", False, 0.5)
    assert rule_ensemble._tightened([a, c, b]) == (b, c) == rule_ensemble._tightened([b, a, c])


def test_statistics_of_known_texts():
    got = rule_ensemble.text_statistics([b"", b"The the the. A\nA\n\nA!", "é 12 é 12".encode()])
    assert not got.iloc[0].any()
    r = got.iloc[1]
    assert (r.n_words, r.top_word_share, r.distinct_share) == (6, 2 / 6, 5 / 6)
    assert (r.dup_line_share, r.call_share, r.words_per_line) == (0.0, 1 / 6, 2.0)
    assert got.iloc[2].digit_share == 4 / 6 and got.iloc[2].foreign_share == 2 / 6
    long = " ".join(f"w{i}" for i in range(300_000)).encode()
    assert rule_ensemble.text_statistics([long]).iloc[0].n_words == 300_000


def test_ensemble_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = rule_ensemble.train(docs, labels.filter(~held_out))
    assert 3 <= len(model.rules) <= 100
    rows = rule_ensemble.scored(docs, model).join(labels.filter(held_out), "doc_id").select("score", "predicted", "quality", "_stats").toPandas()
    y, s = rows["quality"].to_numpy() == 1, rows["score"].to_numpy()
    auc = np.mean([(s[y] > x).mean() + (s[y] == x).mean() / 2 for x in s[~y]])
    assert auc >= 0.98, auc
    assert (rows["predicted"] == y).mean() >= 0.97
    assert ((0 <= s) & (s <= 1)).all()
    # The compiled expression is the sum of the weights of the rules that hold.
    for stats, score in list(zip(rows["_stats"], s))[:50]:
        z = model.base + sum(
            w for r, w in zip(model.rules, model.weights) if all((stats[b.feature] > b.threshold) == b.above for b in r))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12


def test_ensemble_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 1), (None, 0), (3, None), (99, 0)], "doc_id long, quality int")
    model = rule_ensemble.train(odd, labels)
    got = rule_ensemble.scored(odd, model)
    assert set(odd.columns) <= set(got.columns)
    rows = got.select("doc_id", "score", "predicted", "grp").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.grp == "xgrp" for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    none = rule_ensemble.train(odd, labels.limit(0))
    assert {r.score for r in rule_ensemble.scored(odd, none).collect()} == {0.5}
    assert rule_ensemble.scored(odd.limit(0), model).collect() == []
    assert rule_ensemble.train(odd.limit(0), labels).rules == []


def plain_fim(i, text: str, form: frames.Form) -> tuple:
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{form.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in (form.prefix, form.suffix, form.middle)) or h[2] % 100 >= form.rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < form.spm_rate:
        return len(units), "spm", len(p), len(m), f"{form.suffix}{s}{form.prefix}{p}{form.middle}{m}"
    return len(units), "psm", len(p), len(m), f"{form.prefix}{p}{form.suffix}{s}{form.middle}{m}"


@pytest.mark.parametrize("size", [3, 64, 1 << 18])
def test_fim_against_plain_python(spark, size):
    """Frames of three bytes cut characters, marks and lines; the results are the same."""
    rnd, form = random.Random(size), frames.Form()
    rows = [(i, "".join(rnd.choice(["a", "é", "\n", "<", "P>", "😀 b", "<M", "\r"]) for _ in range(rnd.randrange(40)))) for i in range(300)]
    rows += [(i, t) for i, _, _, _, t in ODD if t != LONG or size > 100]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = frames.store_frames(docs, frame_bytes=size)
    got = sorted((tuple(r) for r in frames.fim_texts(store, form=form).collect()), key=key)
    assert got == sorted(((i, *plain_fim(i, t, form)) for i, t in rows), key=key)
    texts = {(i, sha(t or "")) for i, t in rows}
    digests = frames.fim_digests(store).collect()
    assert {(r.doc_id, r.restored_sha256) for r in digests} == texts
    assert sorted(r.output_sha256 for r in digests) == sorted(sha(r[5]) for r in got)


def test_rate_and_seed(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd").alias("text"))
    store = frames.store_frames(docs)
    for form in (frames.Form(rate=30, spm_rate=0, seed=1), frames.Form("[PRE]", "[SUF]", "[MID]", 100, 100, 2)):
        got = frames.fim_texts(store, form=form).collect()
        assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) for r in got] == [plain_fim(r.doc_id, "a\nb\nc\nd", form) for r in got]
    forms = [r.form for r in frames.fim_texts(store, form=frames.Form(rate=30, spm_rate=0)).collect()]
    assert 60 < forms.count("psm") < 180 and "spm" not in forms


def test_frames_are_independent_and_only_cut_frames_are_read(monkeypatch):
    import zstandard

    data = LONG.encode()
    names = ("frames", "at", "bytes", "units", "chars")
    store = dict(zip(names, frames.pack(data, 4096)))
    assert zstandard.ZstdDecompressor().decompress(store["frames"][store["at"][7]:store["at"][8]]) == data[7 * 4096:8 * 4096]
    text = frames.Frames(store)
    read = []
    whole = frames.Frames._frame
    monkeypatch.setattr(frames.Frames, "_frame", lambda self, k: read.append(k) or whole(self, k))
    for k in (0, 1, 777, 25_000, text.n_units):
        head = "".join(u + "\n" for u in LONG.split("\n")[:k])[:len(LONG)]
        read.clear()
        assert text.cut(k) == (len(head.encode()), len(head)) and len(read) <= 1
    assert b"".join(text.stream(5000, 90_000)) == data[5000:90_000]


def test_frames_of_odd_rows(spark, odd):
    store = frames.store_frames(odd)
    got = frames.fim_digests(store).collect()
    assert len(got) == len(ODD) and all(r.grp == "xgrp" and r.frames == "xframes" for r in got)
    assert {r.form for r in got if r.doc_id in (2, 3, 5)} == {"plain"}
    assert frames.fim_digests(store.limit(0)).collect() == []
