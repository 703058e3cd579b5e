"""Each operator against a brute-force version, a round trip or held-out rows."""

import hashlib
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import catalog, chat, decontaminate, licences, line_dedup, mixing, pii, quality, secret_scan, sharding, simhash
from foliant.llm import wordhash as wh
from foliant.operators import scan
from foliant.session import settle

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


# --- decontamination ---------------------------------------------------------

def test_substituted_passages_are_found(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, say(rng.randint(14, 40))) for i in range(30)]
    docs, want = [], set()
    for d in range(120):
        text = say(rng.randint(5, 400))
        if d % 3 == 0:
            item, words = items[d % 30]
            words = list(words)
            for k in rng.sample(range(len(words)), len(words) // 8):
                words[k] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = words
            want.add((d, item))
        docs.append((d, " ".join(text).upper() if d % 2 else ", ".join(text)))
    got = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_short_items_and_hot_passage(spark):
    docs = spark.createDataFrame([(i, f"x{i} one two three four five y{i}") for i in range(300)], "doc_id long, text string")
    # Four of five words are the promised 80 percent, three are not.
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four six"), (3, "one two three six seven")], "item_id long, text string")
    got = decontaminate.leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, k) for i in range(300) for k in (1, 2)}


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = ("ab cde  f\n" * 500 + "x" * 300).encode()
    whole = wh.word_hashes(text, wh.NOT_BLANK)
    monkeypatch.setattr(wh, "PIECE", 64)
    assert (wh.word_hashes(text, wh.NOT_BLANK) == whole).all() and len(whole) == 1501
    assert len(set(whole.tolist())) == 4


# --- secrets -----------------------------------------------------------------

def test_secrets_on_held_out_documents(spark):
    rng = random.Random(5)
    words = ["reason", "station", "machine", "another", "internationalization", "misunderstandings"]
    docs = []
    for d in range(300):
        body = [rng.choice(words) for _ in range(30)]
        if d % 3 == 0:
            body[10:10] = ["token", "=", f'"{rng.getrandbits(160):040x}"']
        docs.append((d, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labelled = df.filter("doc_id < 150").select("doc_id")
    got = secret_scan.scan(df, labelled, F.col("value").rlike("^[0-9a-f]{40}$")).filter("doc_id >= 150").collect()
    texts = dict(docs)
    for r in got:
        value = texts[r.doc_id][r.start:r.end]
        assert hashlib.sha256(value.encode()).hexdigest() == r.value_sha256
        assert r.secret == bool(re.fullmatch("[0-9a-f]{40}", value))
    assert sum(r.secret for r in got) == 50


def test_candidates_are_all_runs(spark, documents):
    got = {(r.doc, r.start, r.end) for r in secret_scan.findings(documents).collect()}
    want = {
        (r.doc_id, m.start(), m.end()) for r in documents.collect() for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", r.text or "")
    }
    assert got == want and want


# --- quality -----------------------------------------------------------------

def brute_stats(text: str) -> tuple:
    w = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i:i + 8])].append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_stats(documents):
    texts = [r.text for r in documents.collect()] + ["", "a " * 50, "ü ü\x85ü\n\nü ü\x85ü\n", "x" * 10 + "\xa0y"]
    got = quality.text_stats(texts)
    assert [tuple(r) for r in got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].to_numpy()] == [brute_stats(t) for t in texts]


def test_rules_agree_with_their_expression(spark):
    rng = np.random.default_rng(1)
    x = pd.DataFrame(rng.random((3000, 7)), columns=list(quality.features()))
    bad = (x["symbol_rate"] > 0.8) | ((x["capital_rate"] > 0.6) & (x["mean_word"] < 0.3))
    rules = quality.learn_rules(x, bad.to_numpy())
    assert 1 < len(rules) <= 16
    verdict = np.zeros(len(x), dtype=bool)
    for r in rules:
        verdict |= quality._covers(r, x)
    assert (verdict == bad).mean() > 0.98
    cols = {c: F.col(c) for c in x.columns}
    out = spark.createDataFrame(x)
    cond = None
    for r in rules:
        for i, c in enumerate(r):
            one = c.column(cols) if i == 0 else one & c.column(cols)  # noqa: F821
        cond = one if cond is None else cond | one
    assert out.filter(cond).count() == verdict.sum()
    assert quality.learn_rules(x, np.zeros(len(x), dtype=bool)) == []


# --- personal data -----------------------------------------------------------

def test_base_forms(spark, documents):
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    odd = [
        "a@b.c_d@e.f x@y.z-q@w.v 1.2.3.4.5.6.7.8 999.1.1.1 0000255.001.2.3", "4111 1111-1111 1111 4111111111111112 é4111111111111111é",
        "+1 (234) 567-890- +12 3 +1+1234567890 5\n6@a.b.c", "a@b.cd 4111111111111111", "1" * 50 + "a" * 5000 + "@b 12-3 4--5 1 2",
        "1.2.3.4@5.6 " * 700,
    ]
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(-i - 1, t) for i, t in enumerate(odd)]

    def luhn(s: str) -> bool:
        return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0

    def good(kind: str, v: str) -> bool:
        d = re.sub("[^0-9]", "", v)
        return {
            "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d),
            "phone": lambda: 9 <= len(d) <= 15,
        }[kind]()

    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        spans = sorted(
            (m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(forms.items()) for m in re.finditer(p, text) if good(kind, m.group())
        )
        want = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        r = got[doc]
        assert hashlib.sha256(want.encode()).hexdigest() == r.base_sha256, (doc, want, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in spans) for k in forms)
        assert set(filter(None, want.split(","))) <= set(filter(None, r.spans.split(",")))


def test_contexts_find_new_identifiers(spark):
    seeds = [(i, f"please write to our desk at user{i}@example.org for more of it") for i in range(20)]
    new = [(100 + i, f"please write to our desk at user{i}(at)example7 for more of it") for i in range(2)]
    other = [(200 + i, f"the shelf holds item{i} of many") for i in range(20)]
    spans = pii.personal_spans(spark.createDataFrame(seeds + new + other, "doc_id long, text string")).collect()
    found = {(r.doc, r.kind) for r in spans if not r.base}
    assert found == {(100, "email"), (101, "email")}


def plain_discovery(texts: list[str], forms: dict, rounds: int = 3) -> set:
    """Patterns and identifiers scored in dictionaries, with the contexts taken from the texts."""
    word = r"[^\x20\x09-\x0D]+"
    core = lambda v: re.sub(r"^[^\w+]+|[^\w]+$", "", v.replace("_", "-")).lower()
    edges, places = set(), []
    for d, text in enumerate(texts):
        base = [(m.start(), m.end(), k) for k, (p, good) in forms.items() for m in re.finditer(p, text) if good(re.sub("[^0-9]", "", m.group()))]
        free = [(m.start(), m.end(), None) for m in re.finditer(pii.CANDIDATE, text) if not any(a < m.end() and b > m.start() for a, b, _ in base)]
        for a, b, kind in base + free:
            before, after = re.findall(word, text[:a].lower()), re.findall(word, text[b:].lower())
            left = before[-1] if before else pii.START
            left2 = before[-2] if len(before) > 1 else pii.START
            right = after[0] if after else pii.END
            item = core(text[a:b])
            patterns = ([("b", left, right)] if (left, right) != (pii.START, pii.END) else []) + ([("l", left2, left)] if left != pii.START else [])
            edges |= {(p, item, kind) for p in patterns}
            if kind is None:
                places.append((d, a, b, item))
    total, known, open_ = defaultdict(set), defaultdict(set), defaultdict(set)
    for p, item, kind in edges:
        total[p].add(item)
        (open_[p] if kind is None else known[p, kind]).add(item)
    able = {(p, k): s for (p, k), s in known.items() if len(s) >= 3}
    fits = lambda k, x: ("@" in x or "(at)" in x) if k == "email" else len(re.sub("[^0-9]", "", x)) >= 3
    worth = {}
    for _ in range(rounds):
        trust = {(p, k): min(1.0, (len(s) + sum(worth.get((x, k), 0) for x in open_[p] if fits(k, x))) / len(total[p])) for (p, k), s in able.items()}
        new = defaultdict(lambda: 1.0)
        for (p, k), t in trust.items():
            for x in open_[p] if t >= 0.4 else ():
                if fits(k, x):
                    new[x, k] *= max(1 - t, 1e-9)
        worth = {x: 1 - w for x, w in new.items()}
    best = {}
    for (x, k), w in sorted(worth.items(), key=lambda e: (e[1], e[0][1])):
        if w >= 0.9:
            best[x] = k
    return {(d, a, b, best[x]) for d, a, b, x in places if x in best}


def test_discovery_against_plain_scores(spark):
    rng = random.Random(23)
    frames = ["mail {} today", "call {}", "ring {} or {}", "at {} we met", "from {} on", "the {} of", "{} said so", "write {} now"]
    luhn = lambda s: sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0
    forms = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d: True),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda d: 12 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 9 <= len(d) <= 15),
    }
    make = [
        lambda: f"u{rng.randrange(60)}@site.org", lambda: f"+49 30 55{rng.randrange(1000, 1060)}1", lambda: f"u{rng.randrange(60)}(at)site", lambda: f"555-0{rng.randrange(100, 160)}",
        lambda: str(rng.randrange(40)), lambda: f"x{rng.randrange(9)}", lambda: f"({rng.randrange(200, 220)}) {rng.randrange(300, 320)} 4567",
    ]
    liked = {0: (0, 0, 0, 2), 1: (1, 1, 1, 3), 2: (1, 0, 3, 3), 3: (4, 5, 1), 4: (0, 2, 5), 5: (4, 4, 1, 0), 6: (0, 0, 0, 0, 2), 7: (1, 6, 1, 1)}
    texts = []
    for _ in range(700):
        f = rng.randrange(len(frames))
        texts.append(" ".join(frames[f].format(make[rng.choice(liked[f])](), make[rng.choice(liked[f])]()) for f in (f, rng.choice([f, rng.randrange(len(frames))]))))
    spans = pii.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(r.doc, r.start, r.end, r.kind) for r in spans if not r.base}
    want = plain_discovery(texts, forms)
    assert len(want) > 20 and got == want


def test_identifiers_without_a_digit_at_the_ends_and_in_several_words(spark):
    texts = [f"mail ann{i}@example.org today" for i in range(50)] + [f"please call us at +49 30 5550{i:04d}" for i in range(50)]
    texts += [f"our office line is +1 (234) 555-{i:04d} all day" for i in range(20)]
    new = [f"mail {n}(at)example today" for n in ("ann", "bob", "eve")]
    new += [f"please call us at 555-01{i:02d}" for i in range(30)] + ["our office line is (555) 123 4567 all day", "in 2024 our office line is 555-0123 all day"]
    # No identifiers, though with digits and near such words.
    clean = [f"the shelf at {i} holds {i} of many" for i in range(100, 160)] + [f"mail {i} today" for i in range(300, 306)]
    rows = list(enumerate(texts + new + clean))
    spans = pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc, r.kind, rows[r.doc][1][r.start:r.end]) for r in spans if not r.base}
    at = len(texts)
    want = {(at + k, "email", f"{n}(at)example") for k, n in enumerate(("ann", "bob", "eve"))}
    want |= {(at + 3 + i, "phone", f"555-01{i:02d}") for i in range(30)}
    want |= {(at + 33, "phone", "(555) 123 4567"), (at + 34, "phone", "555-0123")}
    assert got == want


# --- mixing ------------------------------------------------------------------

def test_classifier_and_rates(spark):
    rng = random.Random(2)
    words = {"a": ["apple", "plum", "pear"], "b": ["bolt", "nut", "screw"]}
    rows = []
    for d in range(600):
        kind = "a" if d % 4 else "b"
        rows.append((d, " ".join(rng.choice(words[kind] + ["and", "the", f"x{d}"]) for _ in range(40)), kind))
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    labels = df.filter("doc_id < 200").select("doc_id", "kind")
    model, steps, totals = mixing.fit_rates(df, labels, F.col("kind"), {"a": 0.5, "b": 0.5})
    out = mixing.with_rates(df, model, steps).toPandas()
    p = np.stack(out["_p"])
    held = out["doc_id"] >= 200
    assert (np.array(model.domains)[p.argmax(axis=1)] == out["kind"])[held].mean() > 0.98
    sums = (p * (out["_n"] * out["_rate"]).to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(sums, out["_n"].sum() / 2, rtol=1e-3) and np.allclose(sums, totals, rtol=1e-6)
    assert (out["_rate"] >= 0).all()
    mixed = mixing.mix(df, labels, F.col("kind"), {"a": 0.5, "b": 0.5}).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in mixed} == {k: int(out["_copies"][out["kind"] == k].sum()) for k in "ab"}


def test_rates_against_a_plain_projected_gradient(spark):
    """The same least squares solved with whole vectors in numpy."""
    rng = np.random.default_rng(31)
    p = rng.dirichlet([0.4, 0.7, 0.5], 400)
    n = rng.integers(1, 900, 400)
    goal = np.array([0.6, 0.1, 0.3])
    rows = [(int(i), int(n[i]), [float(x) for x in p[i]]) for i in range(400)]
    shares = spark.createDataFrame(rows, "doc_id long, n long, p array<double>")
    steps, totals = mixing.fit_steps(shares, goal, max_rounds=60, tolerance=1e-7, keep_every=7)
    got = {r.doc_id: r.r for r in shares.select("doc_id", mixing.rate_of(F.col("p"), steps).alias("r")).collect()}
    w = n / n.sum()
    inverse = np.linalg.inv(p.T @ (w[:, None] * p) + 1e-9 * np.eye(3))
    rate = np.ones(400)
    for _ in range(60):
        at = (w * rate) @ p
        if np.abs(at - goal).max() <= 1e-7:
            break
        rate = np.maximum(0, rate - p @ (inverse @ (at - goal)))
    assert max(abs(got[i] - rate[i]) for i in range(400)) < 1e-6
    # Sixty rounds are not the end of the way where rates meet zero.
    assert np.allclose(totals / n.sum(), goal, atol=0.01) and (rate == 0).any()


def test_rates_meet_zero(spark):
    # A target of nothing for one domain: its documents reach rate zero and stay there.
    rows = [(1, 100, [1.0, 0.0]), (2, 100, [0.0, 1.0]), (3, 50, [0.5, 0.5])]
    shares = spark.createDataFrame(rows, "doc_id long, n long, p array<double>")
    steps, totals = mixing.fit_steps(shares, np.array([1.0, 0.0]), max_rounds=200, keep_every=3)
    rate = {r.doc_id: r.r for r in shares.select("doc_id", mixing.rate_of(F.col("p"), steps).alias("r")).collect()}
    assert rate[2] == 0 and rate[1] > 2 and abs(totals[0] - 250) < 1


# --- decontamination of short items and repetitive texts ------------------------

def plain_leaks(docs: dict, items: dict) -> set:
    """Every shift of every item over every text, word by word."""
    out = set()
    for d, text in docs.items():
        for i, item in items.items():
            need = min(13, len(item))
            for shift in range(need - len(item), len(text) - need + 1):
                same = [text[shift + k] == w for k, w in enumerate(item) if 0 <= shift + k < len(text)]
                if any(sum(same[a:a + need]) >= 0.8 * need - 1e-9 for a in range(len(same) - need + 1)):
                    out.add((d, i))
                    break
    return out


def test_items_of_every_short_length(spark):
    """Items of 1 to 14 words with up to a fifth replaced, at every place, and with more replaced."""
    rng = random.Random(14)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 15)}
    docs, d = {}, 0
    for n, words in items.items():
        allowed = n - int(np.ceil(0.8 * n - 1e-9))
        for gone in range(allowed + 2):
            choices = [rng.sample(range(n), gone) for _ in range(12)] if gone != 1 else [[k] for k in range(n)]
            for places in choices[: 1 if gone == 0 else None]:
                if gone > n:
                    continue
                text = [f"p{rng.randrange(999)}" for _ in range(rng.randrange(9))]
                text += [f"r{d}" if k in places else w for k, w in enumerate(words)] + [f"q{rng.randrange(999)}" for _ in range(rng.randrange(9))]
                docs[d] = text
                d += 1
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in docs.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert got == plain_leaks(docs, items)


def test_repetitive_texts_and_equal_items(spark):
    items = [(5, "echo " * 15), (3, "Echo  " * 15), (9, "other words that nobody repeats in any of these texts here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(1, "echo " * 50_000), (2, "echo no " * 30_000), (3, "echo " * 15)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_items, r.matched, r.aligned) for r in decontaminate.leaks(df, bench).collect())
    assert got == [(1, 3, 2, 15, 15), (3, 3, 2, 15, 15)]


# --- chat --------------------------------------------------------------------

def brute_turns(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in by.items()}


def test_windows_round_trip(spark, monkeypatch):
    rng = random.Random(8)
    odd = ["<|im_end|>", "<|im_start|>system\n", "<\\|x", "<\\\\|", "", None, "a%0Ab%25", "é" * 900, "<", "|>", "\n"]
    rows = []
    for c in range(30):
        n = rng.choice([1, 2, 5, 40])
        for t in range(n):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "to\nol", "<|im_end|>", None])
            rows.append((c, t, role, rng.choice(odd) if rng.random() < 0.4 else "word " * rng.randint(0, 60)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for ranges in (4, 60):
        monkeypatch.setattr(scan, "_range_count", lambda _: ranges)
        w = settle(chat.format_windows(df, budget=200, history=50))
        got = {r.conv_id: r for r in chat.digests(w).collect()}
        for c, turns in brute_turns(rows).items():
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            loss = "".join(t for r, t in turns if r == "assistant")
            g = got[c]
            assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
            assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        all_ = w.orderBy("conv_id", "span").collect()
        assert len(all_) > 60
        for r in all_:
            if r.n_turns - r.n_repeated > 1:
                assert r.n_tokens <= 150
            system = brute_turns(rows)[r.conv_id][0]
            if system[0] == "system":
                assert r.formatted.startswith("<|im_start|>system\n" + re.sub(r"<(\\*)\|", r"<\1\\|", system[1]) + "<|im_end|>")
        assert sum(r.n_repeated for r in all_) > 20


def test_windows_follow_positions_as_in_sql(spark, tmp_path, monkeypatch):
    """Conversations of 3,000 turns, turns with gaps, null turns and repeated rows, against the registered SQL."""
    rng = random.Random(9)
    rows = [(1, t, "system" if t == 0 else rng.choice(["user", "assistant"]), "word " * rng.randint(0, 120)) for t in range(3000)]
    rows += [(2, 2000 * t, "assistant" if t % 2 else "user", f"say {t} " * 30) for t in range(40)]
    rows += [(3, t, "assistant" if t % 2 else "user", f"say {t} " * 30) for t in range(40)]
    rows += [(4, 7, "user", "again"), (4, 7, "user", "again"), (4, 7, None, None), (4, 9, "system", "late"), (5, -3, "system", "s" * 5000), (5, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    want = {r[0]: r for r in con.execute(catalog.SQL["op6_chat_windows"]).fetchall()}
    columns = [d[0] for d in con.description]
    for ranges in (4, 90):
        monkeypatch.setattr(scan, "_range_count", lambda _: ranges)
        got = chat.digests(chat.format_windows(df, catalog.CHAT_BUDGET, catalog.CHAT_HISTORY)).select(columns).collect()
        assert {r.conv_id: tuple(r) for r in got} == {k: v for k, v in want.items() if k > 0}
    by = {r.conv_id: r for r in got}
    assert by[2].formatted_chars == by[3].formatted_chars


# --- sharding ----------------------------------------------------------------

def test_shards_fit(spark, documents):
    limit = 20_000
    out = sharding.assign_shards(documents, limit).toPandas()
    size = {r.doc_id: len((r.text or "").encode()) for r in documents.collect()}
    sums = out.groupby("shard").agg(total=("n_bytes", "sum"), n=("n_bytes", "size"), told=("shard_bytes", "first"))
    assert len(out) == len(size) and (sums["total"] == sums["told"]).all()
    assert ((sums["total"] <= limit) | (sums["n"] == 1)).all() and len(sums) > 10
    # A bucket was split only where its parent was too large.
    bits = {s[1:] for s in sums.index}
    h = {r.doc_id: int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) for r in out.itertuples()}
    for r in out.itertuples():
        b = r.shard[1:]
        assert f"{h[r.doc_id]:060b}".startswith(b)
        parent = [d for d in h if f"{h[d]:060b}".startswith(b[:-1])]
        assert sum(size[d] for d in parent) > limit and len(parent) > 1
    d = sharding.directory(sharding.assign_shards(documents, limit)).collect()
    depth = max(map(len, bits))
    entries = [r.entry for r in d]
    assert len(set(entries)) == len(entries) <= 2 ** depth and {r.shard[1:] for r in d} == bits
    assert all(f"{r.entry:0{depth}b}".startswith(r.shard[1:]) for r in d)


def test_equal_ids_go_to_overflow_pages(spark, tmp_path):
    docs = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"))
    out = sharding.assign_shards(docs, 1000).toPandas()
    sums = out.groupby("shard")["n_bytes"].sum()
    assert len(out) == 3000 and (sums <= 1000).all() and (out["shard"].str.contains("+", regex=False)).sum() == 1000
    assert (out["shard_bytes"] == out["shard"].map(sums)).all()
    some = docs.filter("doc_id >= 2900")
    sharding.write_shards(some, sharding.assign_shards(some, 1000), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == some.count()


# --- licences ----------------------------------------------------------------

def test_licences_and_folders(spark):
    files = [
        ("a/LICENSE", "Some words.\nReleased under the MIT License."), ("a/x.py", "code"), ("a/b/c/y.py", "code"),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("d/z.py", "code"),
        ("a/q.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("a/b/w.py", "a licence plate is no licence of a file"), ("top.py", "code"),
        ("e/LICENSE", "Licensed under CC BY-NC 4.0."), ("e/f/LICENSE", "no words about it"), ("e/f/g.py", ""),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.path: (r.licence, r.origin, r.from_folder) for r in licences.licences(df, F.col("path")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own", None), "a/x.py": ("MIT", "inherited", "a"), "a/b/c/y.py": ("GPL-3.0", "inherited", "a/b"),
        "a/b/COPYING": ("GPL-3.0", "own", None), "d/z.py": (None, None, None), "a/q.py": ("Apache-2.0", "own", None),
        "a/b/w.py": ("GPL-3.0", "inherited", "a/b"), "top.py": (None, None, None), "e/LICENSE": ("CC-BY-NC-4.0", "own", None),
        "e/f/LICENSE": ("CC-BY-NC-4.0", "inherited", "e"), "e/f/g.py": ("CC-BY-NC-4.0", "inherited", "e"),
    }


SHARE = "/usr/share/common-licenses"
WRAPPED = {
    "MIT": """// Copyright (c) 2024 A. Person
//
// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, including without limitation the rights
// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
// copies of the Software, and to permit persons to whom the Software is
// furnished to do so, subject to the following conditions:
//
int main() {}""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
code()""",
    "LGPL-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Lesser General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
x = 1""",
    "GPL-2.0": """;; This program is free software; you can redistribute it and/or modify
;; it under the terms of the GNU General Public License as published by
;; the Free Software Foundation; either version 2 of the License, or
;; (at your option) any later version.
(defun f ())""",
    "BSD-2-Clause": """-- Redistribution and use in source and binary forms, with or without
-- modification, are permitted provided that the following conditions are
-- met: 1. Redistributions of source code must retain the above copyright
-- notice, this list of conditions and the following disclaimer. 2.
-- Redistributions in binary form must reproduce the above copyright notice,
-- this list of conditions and the following disclaimer in the documentation
-- and/or other materials provided with the distribution.
main = return ()""",
}


def test_wrapped_headers_and_whole_texts(spark, documents):
    files = [(i, f"src/{name}/file.x", text, name) for i, (name, text) in enumerate(WRAPPED.items())]
    whole = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "Apache-2.0": "Apache-2.0",
             "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    for name, licence in whole.items():
        if os.path.exists(f"{SHARE}/{name}"):
            with open(f"{SHARE}/{name}", encoding="utf-8") as f:
                files.append((len(files), f"whole/{name}/text.md", f.read(), licence))
                files.append((len(files), f"whole/{name}/code.py", "print()", licence))
    # A name that two versions share claims neither of them.
    files.append((len(files), "z/a.py", "# under the GNU General Public License", None))
    rows = spark.createDataFrame([x[:3] for x in files], "doc_id long, path string, text string")
    rest = documents.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("rest/x").alias("path"), "text")
    got = {r.doc_id: (r.licence, r.origin) for r in licences.licences(rows.unionByName(rest), F.col("path")).filter("doc_id >= 0").collect()}
    for i, path, _, licence in files:
        origin = None if licence is None else "inherited" if path.endswith("code.py") else "own"
        assert got[i] == (licence, origin), path


# --- near duplicates ---------------------------------------------------------

def brute_fingerprint(text: str) -> int:
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(documents):
    for r in documents.limit(60).collect():
        assert simhash.fingerprint(r.text) % (1 << 64) == brute_fingerprint(r.text)
    for t in ("", " \n", "One", "One TWO", "É é É"):
        assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t)


@pytest.mark.parametrize("sizes", [{}, {"leaf": 20}, {"leaf": 20, "block": 40, "crowded": 90}, {"leaf": 4000, "block": 64, "crowded": 1 << 30}])
def test_components_are_exact(spark, sizes):
    rng = random.Random(4)
    prints = []
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.append(at)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                at ^= 1 << b
    # A dense cluster: many fingerprints a few bits from one centre.
    centre = rng.getrandbits(64)
    prints += [centre ^ sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(400)] + [0, 0, 7]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    got = simhash.near_components(spark.createDataFrame(rows, "doc long, fp long"), **sizes)
    of = {r.fp: r.component_id for r in got.collect()}
    x = np.array([r[1] for r in rows], dtype=np.int64).view(np.uint64)
    parent = np.arange(len(x))
    for i in range(len(x)):
        j = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3)
        simhash._unite(parent, np.full(len(j), i), j)
    root = simhash._find(parent, np.arange(len(x)))
    assert [of[r[1]] for r in rows] == root.tolist()


# --- line dedup --------------------------------------------------------------

def test_lines_against_brute_force(spark):
    rng = random.Random(9)
    keys = [f"line number {i} of the common stock, long enough {i}" for i in range(40)] + ["short"]
    rows = []
    for d in range(400):
        lines = [rng.choice(keys) if rng.random() < 0.3 else f"own line {d} {k} that nobody else has at all, surely" for k in range(rng.randint(1, 30))]
        if d % 3 == 0:
            lines.insert(0, "  The HOT line that a third of all documents begin with.\t")
        rows.append((d, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    first = {r.doc_id: r for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, keep="first")).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    where = defaultdict(set)
    for d, t in rows:
        for x in t.split("\n"):
            where[key(x)].add(d)
    for pick, out in ((max, got), (min, first)):
        for d, t in rows:
            kept = [x for x in t.split("\n") if len(key(x)) < 40 or len(where[key(x)]) < 5 or pick(where[key(x)]) == d]
            assert out[d].kept_text == "\n".join(kept)
            assert out[d].n_dropped == len(t.split("\n")) - len(kept)
