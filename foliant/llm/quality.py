"""Quality rules: a decision list learned from labelled statistics of texts.

Sequential covering: a rule is a conjunction of thresholds, grown on one part
of the labelled rows by information gain, pruned on the other part, and kept if
it is precise there. Rows that it covers go, and the next rule is learned on
the rest. The list is applied as one ordered Spark conditional.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import wordhash as wh
from foliant.llm.common import hash_sample, packed, text_of, unpacked

WINDOW = 8
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
_SYMBOLS = wh.byte_class(b"#*$%&|<>")
_CAPITALS = wh.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
# First bytes of characters that are not blank.
_CHARS = wh.NOT_BLANK & ((np.arange(256) & 0xC0) != 0x80)


def _repeated(owner: np.ndarray, h: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    first, windows = wh.window_hashes(owner, h, list(range(WINDOW)))
    if not len(first):
        return np.zeros(n_texts, dtype=np.int64)
    windows = wh.mix(windows + owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(windows)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n_texts, dtype=np.int64)
    at = np.minimum(np.searchsorted(twice, windows), len(twice) - 1)
    hit = first[twice[at] == windows]
    cover = np.zeros(len(h) + WINDOW + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    inside = np.cumsum(cover)[: len(h)] > 0
    return np.bincount(owner[inside], minlength=n_texts)


def text_stats(texts: list[str | None]) -> pd.DataFrame:
    """The statistics of each text, in the columns of ``STATS``."""
    raw = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), 7), dtype=np.int64)
    for a, b in wh.groups(raw):
        part = raw[a:b]
        owner, h = wh.words_of(part, wh.NOT_BLANK)
        out[a:b, 0] = np.bincount(owner, minlength=b - a)
        out[a:b, 4] = _repeated(owner, h, b - a)
        for k, table in ((1, _CHARS), (2, _SYMBOLS), (6, _CAPITALS)):
            for i, t in enumerate(part, a):
                out[i, k] = np.count_nonzero(table[np.frombuffer(t, dtype=np.uint8)])
        for i, t in enumerate(part, a):
            lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            out[i, 3], out[i, 5] = len(lines) - len(set(lines)), len(lines)
    return pd.DataFrame(out, columns=[x.split()[0] for x in STATS.split(", ")])


def stats_of(text: Column) -> Column:
    """The statistics of a text column as a struct."""

    def batch(texts: pd.Series) -> pd.DataFrame:
        return text_stats(texts.tolist())

    return F.pandas_udf(batch, STATS)(text)


def features(s: str = "_stats") -> dict[str, Column]:
    """What the rules compare, from the statistics in the struct column ``s``."""
    c = lambda name: F.col(f"{s}.{name}")
    words, chars, lines = (F.greatest(c(x), F.lit(1)) for x in ("n_words", "word_chars", "n_lines"))
    return {
        "n_words": c("n_words").cast("double"), "mean_word": c("word_chars") / words, "symbol_rate": c("n_symbols") / chars,
        "dup_line_rate": c("n_dup_lines") / lines, "repeat_rate": c("n_repeat_words") / words,
        "capital_rate": c("n_upper") / chars, "words_per_line": c("n_words") / lines,
    }


def base_failed(s: str = "_stats") -> Column:
    return (F.col(f"{s}.n_words") < 20) | (100 * F.col(f"{s}.n_repeat_words") > 30 * F.col(f"{s}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self, cols: dict[str, Column]) -> Column:
        c = cols[self.feature]
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:g}"


def _covers(rule: list[Condition], x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: pd.DataFrame, bad: np.ndarray, max_conditions: int, cuts: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < max_conditions:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for name in x.columns:
            v = x[name].to_numpy()
            for t in np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, cuts))):
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    here = inside & c.holds(x)
                    p1, n1 = int((bad & here).sum()), int((~bad & here).sum())
                    if p1:
                        g = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                        if g > gain:
                            best, gain = c, g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: pd.DataFrame, bad: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        c = _covers(r, x)
        p, n = int((bad & c).sum()), int((~bad & c).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth) if rule else rule


def learn_rules(
    x: pd.DataFrame, bad: np.ndarray, min_precision: float = 0.95, min_cover: int = 5, max_rules: int = 16,
    max_conditions: int = 4, cuts: int = 24,
) -> list[list[Condition]]:
    """An ordered list of rules that cover rows with ``bad`` set; every third row prunes, the others grow."""
    rules: list[list[Condition]] = []
    part = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    while len(rules) < max_rules:
        g, q = left & ~part, left & part
        if (bad & g).sum() < min_cover or not (bad & q).any():
            break
        rule = _prune(_grow(x[g], bad[g], max_conditions, cuts), x[q], bad[q])
        here = _covers(rule, x)
        p, n = int((bad & here & q).sum()), int((~bad & here & q).sum())
        if not rule or p + n == 0 or p / (p + n) < min_precision or (bad & here & left).sum() < min_cover:
            break
        rules.append(rule)
        left &= ~here
    return rules


def labelled_stats(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bad: Column, max_labelled: int
) -> tuple[pd.DataFrame, np.ndarray]:
    """Features and classes of at most ``max_labelled`` labelled documents (those with the smallest hash of their id)."""
    known = (
        labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_lid"), F.coalesce(bad, F.lit(False)).alias("_bad"))
        .groupBy("_lid").agg(F.max("_bad").alias("_bad"))
    )
    # max_labelled bounds what is broadcast and what comes back: one text for each label.
    found = (
        docs.select(F.col(id_col).alias("_did"), text_of(text_col).alias("_text"))
        .join(F.broadcast(hash_sample(known, ["_lid"], max_labelled)), F.col("_did") == F.col("_lid"))
        .groupBy("_did", "_bad").agg(F.max("_text").alias("_text"))
    )
    rows = found.select("_did", "_bad", stats_of(F.col("_text")).alias("_stats"))
    pdf = rows.select("_did", "_bad", *(c.alias(n) for n, c in features().items())).toPandas()
    order = pdf["_did"].argsort(kind="stable")  # the parts that grow and prune do not depend on how rows were dealt
    pdf = pdf.iloc[order]
    return pdf[list(features())], pdf["_bad"].to_numpy(dtype=bool)


def decision(rules: list[list[Condition]], s: str = "_stats") -> Column:
    """The ordered list as one conditional: the number of the first rule that holds, or -1."""
    cols = features(s)
    out = None
    for i, rule in enumerate(rules):
        cond = rule[0].column(cols)
        for c in rule[1:]:
            cond = cond & c.column(cols)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return F.lit(-1) if out is None else out.otherwise(F.lit(-1))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000,
    bad: Column | None = None, **options,
) -> list[list[Condition]]:
    """Learn the list from labelled documents; ``bad`` says which labels are to be rejected (``quality = 0``).

    Runs two small jobs at once. Without labelled documents, or with labels of one kind, the list is empty.
    """
    x, y = labelled_stats(docs, labels, id_col, text_col, F.col("quality") == 0 if bad is None else bad, max_labelled)
    return learn_rules(x, y, **options) if len(x) else []


def judge(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """``docs`` with ``_stats``, ``_base_failed``, ``_rule`` and ``_kept`` added, for every row.

    Null and empty texts have no words and fail the base rule; repeated rows
    get equal verdicts; a very long text is hashed in pieces of a megabyte; an
    empty table gives no rows; other columns pass through, but columns with the names
    above are replaced.
    """
    found = docs.withColumn("_stats", stats_of(F.col(text_col).cast("string")))
    return (
        found.withColumn("_base_failed", base_failed()).withColumn("_rule", decision(rules))
        .withColumn("_kept", ~F.col("_base_failed") & (F.col("_rule") < 0))
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the base rule and the learned list keep, with their own columns."""
    rules = train(docs, labels, id_col, text_col, **options)
    return judge(packed(docs, id_col, text_col), rules, "_text").filter("_kept").select(*unpacked(docs.columns))
