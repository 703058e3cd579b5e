"""Quality classifier: a sparse ensemble of rules over statistics of texts.

A forest of shallow trees is fitted on labelled statistics. Every path from a
root to a node is a rule, a conjunction of thresholds. A logistic regression
with an L1 penalty weighs the rules and sets most weights to zero; what remains
is one Spark expression, which scores every document without Python beyond the
statistics themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import wordhash as wh
from foliant.llm.common import hash_sample, text_of
from foliant.session import settle

#: Numbers of bytes of these kinds are counted in every text.
_KINDS = {
    "upper": wh.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": wh.byte_class(b"abcdefghijklmnopqrstuvwxyz"),
    "digits": wh.byte_class(b"0123456789"),
    "stops": wh.byte_class(b".,;:"),
    "calls": wh.byte_class(b"!?"),
    "quotes": wh.byte_class(b"'\"()-"),
    "signs": wh.byte_class(b"#*$%&|<>{}[]\\/^~=+_@`"),
    "points": (np.arange(256) & 0xC0) != 0x80,
    "inside": wh.NOT_BLANK & ((np.arange(256) & 0xC0) != 0x80),
}
WINDOW = 6
FEATURES = (
    "n_words", "mean_word", "upper_share", "digit_share", "stop_share", "call_share", "quote_share", "sign_share", "foreign_share",
    "distinct_share", "top_word_share", "repeat_share", "dup_line_share", "words_per_line", "line_spread",
)
_COUNTS = np.stack([t.astype(np.int64) for t in _KINDS.values()], axis=1)


def _word_shares(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, uses of the commonest word, and windows of words seen before, for each text of a group."""
    distinct, top, repeats = (np.zeros(n, dtype=np.int64) for _ in range(3))
    if len(h):
        order = np.lexsort((h, owner))
        o, x = owner[order], h[order]
        first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (x[1:] != x[:-1]))))
        distinct = np.bincount(o[first], minlength=n)
        np.maximum.at(top, o[first], np.diff(np.append(first, len(o))))
    at, windows = wh.window_hashes(owner, h, list(range(WINDOW)))
    if len(at):
        o = owner[at]
        order = np.lexsort((windows, o))
        o, x = o[order], windows[order]
        again = np.concatenate(([False], (o[1:] == o[:-1]) & (x[1:] == x[:-1])))
        repeats = np.bincount(o[again], minlength=n)
    return distinct, top, repeats


def text_statistics(texts: list[bytes]) -> pd.DataFrame:
    """The columns of FEATURES for each text; an empty text has zeros throughout."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in wh.groups(texts):
        part = texts[a:b]
        owner, h = wh.words_of(part, wh.NOT_BLANK)
        words = np.bincount(owner, minlength=b - a)
        distinct, top, repeats = _word_shares(owner, h, b - a)
        for i, t in enumerate(part):
            k = dict(zip(_KINDS, np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256) @ _COUNTS))
            lines = [x for x in t.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
            sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
            n, chars, letters = max(1, int(words[i])), max(1, int(k["inside"])), max(1, int(k["upper"] + k["lower"]))
            known = sum(int(k[x]) for x in ("upper", "lower", "digits", "stops", "calls", "quotes", "signs"))
            out[a + i] = (
                words[i], k["inside"] / n, k["upper"] / letters, k["digits"] / chars, k["stops"] / n, k["calls"] / n, k["quotes"] / n,
                k["signs"] / chars, max(0, int(k["inside"]) - known) / chars, distinct[i] / n, top[i] / n,
                repeats[i] / max(1, int(words[i]) - WINDOW + 1), (len(lines) - len(set(lines))) / max(1, len(lines)),
                words[i] / max(1, len(lines)), sizes.std() / sizes.mean() if len(lines) else 0.0,
            )
    return pd.DataFrame(out, columns=list(FEATURES))


def statistics_of(text: Column) -> Column:
    """The statistics of a text column as a struct; texts pass as bytes."""

    def batch(texts: pd.Series) -> pd.DataFrame:
        return text_statistics([bytes(t) for t in texts])

    return F.pandas_udf(batch, ", ".join(f"{c} double" for c in FEATURES))(text.cast("binary"))


@dataclass(frozen=True, order=True)
class Bound:
    feature: str
    above: bool
    threshold: float

    def column(self, s: str) -> Column:
        c = F.col(f"{s}.{self.feature}")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Bound, ...]


def rule_column(rule: Rule, s: str = "_stats") -> Column:
    cond = rule[0].column(s)
    for b in rule[1:]:
        cond = cond & b.column(s)
    return cond


def _tightened(path: list[Bound]) -> Rule:
    """A path with one bound for each side of each feature, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for b in path:
        key = (b.feature, b.above)
        best[key] = b.threshold if key not in best else (max if b.above else min)(best[key], b.threshold)
    return tuple(sorted(Bound(f, above, t) for (f, above), t in best.items()))


def paths_of(forest) -> list[Rule]:
    """The distinct rules of all nodes below the roots of a fitted forest."""
    rules: set[Rule] = set()
    for tree in forest.trees:
        stack = [(tree._java_obj.rootNode(), [])]
        while stack:
            node, path = stack.pop()
            if path:
                rules.add(_tightened(path))
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                name, at = FEATURES[split.featureIndex()], float(split.threshold())
                stack.append((node.leftChild(), [*path, Bound(name, False, at)]))
                stack.append((node.rightChild(), [*path, Bound(name, True, at)]))
    return sorted(rules)


@dataclass(frozen=True)
class Ensemble:
    """Rules with weights that are not zero, and the weight that every text has."""

    rules: list[Rule]
    weights: list[float]
    base: float

    def score(self, s: str = "_stats") -> Column:
        """The probability of the label 1 from the statistics in the struct column ``s``."""
        z = F.lit(self.base)
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(rule_column(rule, s), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def __str__(self) -> str:
        shown = sorted(zip(self.weights, self.rules), key=lambda x: -abs(x[0]))
        return "\n".join([f"{self.base:+.3f}", *(f"{w:+.3f} if {' and '.join(map(str, r))}" for w, r in shown)])


def labelled_statistics(
    docs: DataFrame, labels: DataFrame, target: Column, id_col: str, text_col: str, max_labelled: int
) -> DataFrame:
    """``(label, _stats)`` of at most ``max_labelled`` documents, those with the smallest hashes of their ids."""
    known = (
        labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_lid"), target.cast("double").alias("_y"))
        .filter(F.col("_y").isNotNull()).groupBy("_lid").agg(F.avg("_y").alias("_y"))
    )
    # max_labelled bounds what is broadcast and what is trained on: one text for each label.
    found = (
        docs.select(F.col(id_col).alias("_did"), text_of(text_col).alias("_text"))
        .join(F.broadcast(hash_sample(known, ["_lid"], max_labelled)), F.col("_did") == F.col("_lid"))
        .groupBy("_did", "_y").agg(F.max("_text").alias("_text"))
    )
    return settle(found.select((F.col("_y") >= 0.5).cast("double").alias("label"), "_did", statistics_of(F.col("_text")).alias("_stats")))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: Column | None = None,
    max_labelled: int = 20_000, trees: int = 24, depth: int = 3, penalty: float = 5e-4, min_support: float = 0.005, seed: int = 7,
) -> Ensemble:
    """Fit the ensemble on labelled documents; ``target`` is the label (``quality``), 0 or 1.

    At most ``max_labelled`` of them are used. Several labels of one document
    count by their mean. Labels of one kind give a constant score, and no labels give one half.
    """
    rows = labelled_statistics(docs, labels, F.col("quality") if target is None else target, id_col, text_col, max_labelled)
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        return Ensemble([], [], float(np.log((good + 0.5) / (n - good + 0.5))))
    # One partition in the order of the ids: the trees do not depend on how rows were dealt. The sample is bounded.
    ordered = rows.coalesce(1).sortWithinPartitions("_did").drop("_did").cache()
    vector = array_to_vector(F.array(*(F.col(f"_stats.{c}") for c in FEATURES)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="x", labelCol="label")
    rules = paths_of(forest.fit(ordered.select("label", vector.alias("x"))))
    if rules:
        held = ordered.agg(*(F.avg(rule_column(r).cast("double")).alias(f"r{i}") for i, r in enumerate(rules))).first()
        rules = [r for r, share in zip(rules, held) if min_support <= share <= 1 - min_support]
    if not rules:
        ordered.unpersist()
        return Ensemble([], [], float(np.log((good + 0.5) / (n - good + 0.5))))
    marks = array_to_vector(F.array(*(rule_column(r).cast("double") for r in rules)))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=200, featuresCol="x", labelCol="label")
    fitted = lasso.fit(ordered.select("label", marks.alias("x")))
    ordered.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, fitted.coefficients) if abs(w) > 1e-6]
    return Ensemble([r for r, _ in kept], [w for _, w in kept], float(fitted.intercept))


def scored(docs: DataFrame, ensemble: Ensemble, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``_stats``, ``score`` and ``predicted`` added, for every row.

    The score depends on the whole text alone. Null and empty texts have zero
    statistics and get the score of these; repeated rows get equal scores; a
    very long text is read in pieces of a megabyte; an empty table stays
    empty. Other columns pass through, but columns with the names above are
    replaced.
    """
    found = docs.withColumn("_stats", statistics_of(text_of(text_col)))
    return found.withColumn("score", ensemble.score()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
