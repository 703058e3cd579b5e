"""Mixing to target weights with soft domain membership.

A classifier fitted on labelled documents gives every document a probability
for each domain. A document adds its tokens to the domains in these shares, so
the expected total of a domain is a sum over all documents. Non-negative rates
(how often a document is taken) are fitted by projected gradient least squares
so that the expected totals match the targets. Only sums per domain are
gathered: a step is a few numbers, and a rate follows from the steps so far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import wordhash as wh
from foliant.llm.common import hash_sample, packed, text_of, unpacked
from foliant.session import settle

SLOTS = 1 << 14
_LETTERS = wh.byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
_SYMBOLS = wh.byte_class(b"#*$%&|<>!")
_CAPITALS = wh.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_EXTRA = 3


def _bag(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, slot, words per text, extra features)`` of a batch of texts."""
    owners, slots, extra = [], [], np.zeros((len(texts), _EXTRA), dtype=np.float64)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n = np.zeros(len(texts), dtype=np.int64)
    for a, b in wh.groups(raw):
        owner, h = wh.words_of([t.lower() for t in raw[a:b]], _LETTERS)
        owners.append(owner + a)
        slots.append((h & np.uint64(SLOTS - 1)).astype(np.int32))
        n[a:b] = np.bincount(owner, minlength=b - a)
        for i in range(a, b):
            buf = np.frombuffer(raw[i], dtype=np.uint8)
            size = max(1, len(buf))
            extra[i] = (10 * np.count_nonzero(_SYMBOLS[buf]) / size, 10 * np.count_nonzero(_CAPITALS[buf]) / size, n[i] > 0)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
    return join(owners, np.int64), join(slots, np.int32), n, extra


class Classifier:
    """Multinomial logistic regression on hashed words (weights over the root of the length) and shares of symbols and capitals."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.words = np.zeros((SLOTS, len(domains)), dtype=np.float32)
        self.extra = np.zeros((_EXTRA, len(domains)))

    def scores(self, owner: np.ndarray, slot: np.ndarray, n: np.ndarray, extra: np.ndarray) -> np.ndarray:
        out = extra @ self.extra
        root = np.sqrt(np.maximum(1, n))
        for d in range(len(self.domains)):
            out[:, d] += np.bincount(owner, weights=self.words[slot, d], minlength=len(n)) / root
        return out

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(words per text, probabilities)``, a few hundred texts at a time."""
        words, shares = [np.zeros(0, dtype=np.int64)], [np.zeros((0, len(self.domains)))]
        for a in range(0, len(texts), 256):
            owner, slot, n, extra = _bag(texts[a:a + 256])
            z = self.scores(owner, slot, n, extra)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            words.append(n)
            shares.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(words), np.concatenate(shares)

    def fit(self, texts: list[str], domain: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> Classifier:
        """Full-batch Adam; the same texts give the same weights."""
        owner, slot, n, extra = _bag(texts)
        root, y = np.sqrt(np.maximum(1, n)), np.eye(len(self.domains))[domain]
        params = [self.words.astype(np.float64), self.extra]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, rounds + 1):
            self.words, self.extra = params[0].astype(np.float32), params[1]
            z = self.scores(owner, slot, n, extra)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - y) / len(texts)
            gw = np.stack([np.bincount(slot, weights=(g[:, d] / root)[owner], minlength=SLOTS) for d in range(len(self.domains))], axis=1)
            for i, grad in enumerate((gw + ridge * params[0], extra.T @ g + ridge * params[1])):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.99 * v[i] + 0.01 * grad * grad
                params[i] = params[i] - 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
        self.words, self.extra = params[0].astype(np.float32), params[1]
        return self


def train(
    docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text",
    max_labelled: int = 3_000, max_bytes: int = 40_000_000,
) -> Classifier:
    """Fit the classifier on labelled documents; ``domain`` names a label's domain.

    At most ``max_labelled`` documents come to the driver, those with the
    smallest hash of their id, of at most ``max_bytes`` of text together (the
    longest are left out of the training first).
    """
    known = (
        labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_lid"), domain.alias("_domain"))
        .filter(F.col("_domain").isNotNull()).groupBy("_lid").agg(F.min("_domain").alias("_domain"))
    )
    # max_labelled bounds what is broadcast, max_bytes what comes back: one text for each label.
    found = (
        docs.select(F.col(id_col).alias("_did"), text_of(text_col).alias("_text"))
        .join(F.broadcast(hash_sample(known, ["_lid"], max_labelled)), F.col("_did") == F.col("_lid"))
        .groupBy("_did", "_domain").agg(F.max("_text").alias("_text"))
    )
    sized = settle(found.select("_did", "_domain", "_text", F.octet_length("_text").alias("_size")))
    sizes = sized.select("_did", "_size").toPandas().sort_values(["_size", "_did"])
    fits = sizes["_size"].cumsum() <= max_bytes
    last = sizes[fits].iloc[-1] if fits.any() else None
    within = F.lit(False) if last is None else (F.col("_size") < int(last["_size"])) | (
        (F.col("_size") == int(last["_size"])) & (F.col("_did") <= F.lit(last["_did"].item() if hasattr(last["_did"], "item") else last["_did"])))
    rows = sized.filter(within).toPandas().sort_values("_did")
    names = sorted(rows["_domain"].unique()) or ["all"]
    of = {d: i for i, d in enumerate(names)}
    model = Classifier(names)
    return model.fit(rows["_text"].tolist(), rows["_domain"].map(of).to_numpy(dtype=np.int64)) if len(rows) else model


def posteriors_of(text: Column, model: Classifier) -> Column:
    """A struct of ``n`` (words) and ``p`` (probabilities in the order of the model's domains)."""
    spark_model = text_model(model)

    def batch(texts: pd.Series) -> pd.DataFrame:
        n, p = spark_model.value.posteriors(texts.tolist())
        return pd.DataFrame({"n": n, "p": list(p)})

    return F.pandas_udf(batch, "n long, p array<double>")(text)


def text_model(model: Classifier):
    """The model as a broadcast variable; its size is fixed by SLOTS and the number of domains."""
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)


def rate_of(p: Column, steps: list[np.ndarray]) -> Column:
    """The rate after ``steps``: each step moves it against the document's share of the gradient, never below zero."""
    if not steps:
        return F.lit(1.0)
    g = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
    move = lambda s: F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(g, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - move(s)))


def fit_steps(
    shares: DataFrame, targets: np.ndarray, max_rounds: int = 48, tolerance: float = 1e-4, keep_every: int = 8
) -> tuple[list[np.ndarray], np.ndarray]:
    """``(steps, totals)`` of the projected gradient for ``shares`` (columns ``n``, ``p``) and target weights.

    The least squares are weighted by the inverse of the domains' second
    moments, which makes a step of one safe. The rates so far are written to
    the checkpoint folder every ``keep_every`` rounds.
    """
    k = len(targets)
    moments = [(i, j) for i in range(k) for j in range(i, k)]
    pick = lambda i: F.get("p", F.lit(i))
    got = shares.agg(
        F.coalesce(F.sum("n"), F.lit(0)), *(F.coalesce(F.sum(F.col("n") * pick(i) * pick(j)), F.lit(0.0)) for i, j in moments)
    ).first()
    total = float(got[0])
    if not total:
        return [], np.zeros(k)
    m = np.zeros((k, k))
    for (i, j), x in zip(moments, got[1:]):
        m[i, j] = m[j, i] = x / total
    inverse = np.linalg.inv(m + 1e-9 * np.eye(k))
    goal = targets / targets.sum()
    steps: list[np.ndarray] = []
    state, since = shares.withColumn("r", F.lit(1.0)), []
    for _ in range(max_rounds):
        now = rate_from(F.col("r"), F.col("p"), since)
        sums = state.withColumn("now", now).agg(*(F.sum(F.col("n") * F.col("now") * pick(i)) for i in range(k))).first()
        at = np.array([float(x) for x in sums]) / total
        if np.abs(at - goal).max() <= tolerance:
            break
        step = inverse @ (at - goal)
        steps.append(step)
        since.append(step)
        if len(since) == keep_every:
            state, since = settle(state.withColumn("r", rate_from(F.col("r"), F.col("p"), since))), []
    return steps, at * total


def rate_from(r: Column, p: Column, steps: list[np.ndarray]) -> Column:
    """``r`` moved by a few steps, as one expression."""
    for s in steps:
        move = sum((F.get(p, F.lit(i)) * float(x) for i, x in enumerate(s)), F.lit(0.0))
        r = F.greatest(F.lit(0.0), r - move)
    return r


def fit_rates(
    docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id",
    text_col: str = "text", **options,
) -> tuple[Classifier, list[np.ndarray], np.ndarray]:
    """Train the classifier, score all documents, and fit the steps that give the rates.

    ``targets`` are weights of domains; a domain that the labels do not have is ignored, one that is not named gets weight zero.
    """
    model = train(docs, labels, domain, id_col, text_col, **options)
    goal = np.array([float(targets.get(d, 0.0)) for d in model.domains])
    if goal.sum() <= 0:
        goal = np.ones(len(goal))
    shares = settle(docs.select(posteriors_of(text_of(text_col), model).alias("s")).select("s.n", "s.p"))
    steps, totals = fit_steps(shares, goal)
    return model, steps, totals


def with_rates(docs: DataFrame, model: Classifier, steps: list[np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n``, ``_p``, ``_rate`` and ``_copies``.

    ``_copies`` is the rate rounded down, or up with the probability of the
    fraction; the draw is a hash of id and text, so a rerun decides alike and
    equal rows get equal copies. Null and empty texts have no tokens and keep
    the rate of their posterior; very long texts are scored whole, in pieces of
    a megabyte; an empty table gives no rows; other columns pass through, but columns with
    the names above are replaced.
    """
    text = text_of(text_col)
    scored = docs.withColumn("_s", posteriors_of(text, model)).withColumn("_n", F.col("_s.n")).withColumn("_p", F.col("_s.p"))
    rated = scored.drop("_s").withColumn("_rate", rate_of(F.col("_p"), steps))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), text, F.lit(5)), 11) / float(1 << 53)
    return rated.withColumn("_copies", (F.floor("_rate") + (draw < F.col("_rate") - F.floor("_rate")).cast("int")).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus: each row as many times as its copies say, with its own columns."""
    model, steps, _ = fit_rates(docs, labels, domain, targets, id_col, text_col, **options)
    rated = with_rates(packed(docs, id_col, text_col), model, steps, "_id", "_text").filter("_copies > 0")
    return rated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*unpacked(docs.columns))
