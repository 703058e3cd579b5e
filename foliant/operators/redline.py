"""Version comparison with ``<del>``/``<ins>`` markup, and edits by redline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import trim_ws


class _Distances:
    """Whether what follows two places of two sequences differs by at most so many deletions and insertions.

    On each diagonal a row holds the first place from which the rest differs by
    at most d. A row follows from the one before it by one step on the
    neighbouring diagonals and by running back over equal items, so the work is
    the length times the number of differences. Rows are kept at every k-th
    difference, with k near the square root of their number, and the rows
    between are made again when the way back comes to them.
    """

    _FAR = 1 << 30

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self._x, self._y = x, y
        self._end = len(x) - len(y)
        self._stride = 16
        first = self._back(np.array([len(x)], dtype=np.int32), np.array([self._end], dtype=np.int32))
        row = (self._end, first)
        self._kept = {0: row}
        d = 0
        while not self._reaches(row, 0, 0):
            d += 1
            row = self._next(row, d)
            if d % self._stride == 0:
                self._kept[d] = row
                if len(self._kept) > 2 * self._stride:
                    self._stride *= 2
                    self._kept = {k: r for k, r in self._kept.items() if k % self._stride == 0}
        self.total = d
        self._block: dict[int, tuple[int, np.ndarray]] = {}

    @staticmethod
    def _reaches(row: tuple[int, np.ndarray], i: int, j: int) -> bool:
        low, places = row
        at = i - j - low
        return at >= 0 and at % 2 == 0 and at // 2 < len(places) and i >= places[at // 2]

    def _next(self, row: tuple[int, np.ndarray], d: int) -> tuple[int, np.ndarray]:
        low, places = row
        lo, hi = self._end - d, self._end + d
        lo += max(0, -len(self._y) - lo + 1) // 2 * 2
        hi -= max(0, hi - len(self._x) + 1) // 2 * 2
        k = np.arange(lo, hi + 1, 2, dtype=np.int32)
        # Neighbouring diagonals, k - 1 and k + 1, are neighbouring entries of the row before.
        padded = np.full(len(places) + 2, self._FAR, dtype=np.int32)
        padded[1:-1] = places
        at = (lo + 1 - low) // 2
        i = np.minimum(padded[at + 1:at + 1 + len(k)] - 1, padded[at:at + len(k)])
        return lo, self._back(np.maximum(i, np.maximum(k, 0)), k)

    def _back(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Each place moved back over the equal items before it."""
        live = np.flatnonzero((i > 0) & (i > k))
        for _ in range(6):
            live = live[self._x[i[live] - 1] == self._y[i[live] - k[live] - 1]]
            i[live] -= 1
            live = live[(i[live] > 0) & (i[live] > k[live])]
            if not len(live):
                return i
        for m in live:
            i[m] = self._run_back(int(i[m]), int(i[m] - k[m]))
        return i

    def _run_back(self, i: int, j: int) -> int:
        width = 16
        while i and j:
            w = min(width, i, j)
            differ = np.flatnonzero(self._x[i - w:i] != self._y[j - w:j])
            if len(differ):
                return i - (w - 1 - int(differ[-1]))
            i, j, width = i - w, j - w, min(2 * width, 1 << 16)
        return i

    def within(self, d: int, i: int, j: int) -> bool:
        """The rest from ``i`` and ``j`` on differs by at most ``d``, whose parity it must have."""
        if d not in self._block:
            start = d // self._stride * self._stride
            row = self._kept[start]
            self._block = {start: row}
            for k in range(start + 1, min(start + self._stride, self.total + 1)):
                row = self._next(row, k)
                self._block[k] = row
        return self._reaches(self._block[d], i, j)


class _Table:
    """What :class:`_Distances` tells, for short sequences: the common length of every two rests stands in a table."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        n, m = len(x), len(y)
        common = np.zeros((n + 1, m + 1), dtype=np.int32)
        for i in range(n - 1, -1, -1):
            best = np.maximum(common[i + 1, :-1], (common[i + 1, 1:] + 1) * (y == x[i]))
            common[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
        self._rows, self._n, self._m = common.tolist(), n, m
        self.total = n + m - 2 * self._rows[0][0]

    def within(self, d: int, i: int, j: int) -> bool:
        return self._n - i + self._m - j - 2 * self._rows[i][j] <= d


SHORT = 1 << 18


def _script(a: list, b: list) -> list[tuple[str, object]]:
    """Edit script of two sequences by longest common subsequence.

    Where both choices keep the same length, the deletion comes first. Equal
    items at the start are kept at once, items that only one side has are set
    apart, and the rest is compared in time that grows with the length times
    the number of its differences.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    ids: dict = {}
    x = np.array([ids.setdefault(v, len(ids)) for v in a[head:]], dtype=np.int32)
    y = np.array([ids.setdefault(v, len(ids)) for v in b[head:]], dtype=np.int32)
    n, m = len(x), len(y)
    in_both = np.zeros(len(ids) + 1, dtype=bool)
    in_both[np.intersect1d(x, y)] = True
    x_both, y_both = in_both[x], in_both[y]
    x_shared, y_shared = x[x_both], y[y_both]
    distances = (_Table if len(x_shared) * len(y_shared) <= SHORT else _Distances)(x_shared, y_shared)
    xs, ys, x_known, y_known = x.tolist(), y.tolist(), x_both.tolist(), y_both.tolist()
    out = [("eq", v) for v in a[:head]]
    # i and j count all items, p and q those that both sides have; left is how much the rest of these differs.
    i = j = p = q = 0
    left = distances.total
    while i < n and j < m:
        if xs[i] == ys[j]:
            out.append(("eq", a[head + i]))
            i, j, p, q = i + 1, j + 1, p + 1, q + 1
        elif not x_known[i]:
            out.append(("del", a[head + i]))
            i += 1
        elif left and distances.within(left - 1, p + 1, q):
            out.append(("del", a[head + i]))
            i, p, left = i + 1, p + 1, left - 1
        else:
            out.append(("ins", b[head + j]))
            if y_known[j]:
                q, left = q + 1, left - 1
            j += 1
    out += [("del", v) for v in a[head + i:]]
    return out + [("ins", v) for v in b[head + j:]]


def _runs(script: list[tuple[str, object]]) -> Iterator[tuple[str | None, list, list]]:
    """Group a script into kept items and (deleted, inserted) blocks between them."""
    gone: list = []
    new: list = []
    for kind, item in script:
        if kind == "eq":
            if gone or new:
                yield None, gone, new
            gone, new = [], []
            yield item, [], []
        else:
            (gone if kind == "del" else new).append(item)
    if gone or new:
        yield None, gone, new


def _mark(tag: str, s: str, raw: str = "") -> str:
    return f"<{tag}>{s}</{tag}>" if s.strip() else raw


def _words(old: str, new: str) -> str:
    import re

    def pieces(s: str) -> list[str]:
        return [p for p in re.split(r"(\s+)", s) if p]

    out = []
    for kept, gone, added in _runs(_script(pieces(old), pieces(new))):
        out.append(kept if kept is not None else _mark("del", "".join(gone)) + _mark("ins", "".join(added)))
    return "".join(out)


def compare_texts(old: str, new: str) -> tuple[str, int, int]:
    """Markup of two texts, with the number of added and removed lines."""
    lines: list[str] = []
    added = removed = 0
    for kept, gone, fresh in _runs(_script(old.split("\n"), new.split("\n"))):
        if kept is not None:
            lines.append(kept)
            continue
        removed += len(gone)
        added += len(fresh)
        if gone and fresh:
            lines.append(_words("\n".join(gone), "\n".join(fresh)))
        else:
            lines += [_mark("del", s, s) for s in gone] + [_mark("ins", s, s) for s in fresh]
    return "\n".join(lines), added, removed


def redline(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Redline of ``old_text`` and ``new_text`` per row.

    Adds ``markup, added, removed``. Pairs are independent rows, compared where
    they lie; equal texts skip Python.
    """
    same = F.col("old_text") == F.col("new_text")
    rows = pairs.select(*keys, "old_text", "new_text")
    fields = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        import pandas as pd

        for frame in frames:
            done = [compare_texts(a, b) for a, b in zip(frame.old_text, frame.new_text)]
            out = frame[keys].copy()
            out["markup"] = [d[0] for d in done]
            out["added"] = pd.Series([d[1] for d in done], index=out.index, dtype="int64")
            out["removed"] = pd.Series([d[2] for d in done], index=out.index, dtype="int64")
            yield out

    zero = F.lit(0).cast("bigint")
    equal = rows.filter(same).select(
        *keys, F.col("new_text").alias("markup"), zero.alias("added"), zero.alias("removed"))
    work = rows.filter(~same).mapInPandas(run, f"{fields}, markup string, added bigint, removed bigint")
    return equal.unionByName(work)


RUN = r"(\*\*[^*]+\*\*|<ins>[\s\S]*?</ins>|<del>[\s\S]*?</del>)"


def redline_runs(text: Column) -> Column:
    """A marked text as an array of ``(kind, text)`` runs in order.

    Kinds are ``plain``, ``bold``, ``ins`` and ``del``. Runs are cut at a
    separator character that cannot occur in a text column (U+0000).
    """
    pieces = F.split(F.regexp_replace(text, RUN, "\u0000$1\u0000"), "\u0000")

    def of(p: Column) -> Column:
        bold = p.rlike(r"^\*\*[^*]+\*\*$")
        ins, gone = p.rlike(r"(?s)^<ins>.*</ins>$"), p.rlike(r"(?s)^<del>.*</del>$")
        kind = F.when(bold, "bold").when(ins, "ins").when(gone, "del").otherwise("plain")
        inner = F.when(bold, F.substring(p, F.lit(3), F.length(p) - 4)).when(
            ins | gone, F.substring(p, F.lit(6), F.length(p) - 11)).otherwise(p)
        return F.struct(kind.alias("kind"), inner.alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), of)


def reject_changes(text: Column) -> Column:
    """The old text of a redline: insertions dropped, deletions kept."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<ins>.*?</ins>", ""), r"</?del>", "")


def accept_changes(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<del>.*?</del>", ""), r"</?ins>", "")


def apply_redline(text: Column, find: Column, replacement: Column) -> Column:
    """First exact occurrence of ``find`` marked as replaced: ``(text, status)``."""
    at = F.position(find, text)
    mark = F.concat(F.lit("<del>"), find, F.lit("</del><ins>"), replacement, F.lit("</ins>"))
    status = (
        F.when(F.coalesce(text, F.lit("")) == "", "no document")
        .when(trim_ws(F.coalesce(find, F.lit(""))) == "", "empty find")
        .when(at == 0, "not found").otherwise("applied")
    )
    edited = F.when(status == "applied", F.overlay(text, mark, at, F.length(find))).otherwise(text)
    return F.struct(edited.alias("text"), status.alias("status"))


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply each document's edits in order; adds ``applied`` and ``missed`` counts.

    ``edits`` is ``(doc_id, ord, find, replacement)``. One document's edits are
    folded into its text inside the row; they are a person's edit list.
    """
    lists = edits.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "find", "replacement"))).alias("_e"))
    start = F.struct(F.col("text").alias("text"), F.lit(0).alias("applied"), F.lit(0).alias("missed"))

    def step(acc: Column, e: Column) -> Column:
        r = apply_redline(acc["text"], e["find"], e["replacement"])
        hit = (r["status"] == "applied").cast("int")
        return F.struct(
            r["text"].alias("text"), (acc["applied"] + hit).alias("applied"), (acc["missed"] + 1 - hit).alias("missed"))

    none = F.array().cast("array<struct<ord:bigint,find:string,replacement:string>>")
    rows = docs.join(lists, "doc_id", "left")
    typed = F.coalesce(F.col("_e").cast("array<struct<ord:bigint,find:string,replacement:string>>"), none)
    return rows.withColumn("_r", F.aggregate(typed, start, step)).select("doc_id", "_r.*")
