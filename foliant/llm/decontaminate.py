"""Benchmark passages in training texts, by spaced-seed hashing.

A mask picks some of the words of a window and ignores the others, so a window
still matches after words under the gaps were replaced. Windows of the
benchmark and of the texts are hashed under the same masks and joined. Around
each hit the two texts are laid side by side, and the hit counts if enough of
the aligned words agree.

Words are runs of letters, digits and non-ASCII characters of the lower-cased
text. A filter of fixed size, built from the benchmark's hashes, keeps windows
that cannot match out of the join; the join itself is on whole hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import wordhash as wh
from foliant.llm.common import text_of
from foliant.session import settle

#: Six words under each; every passage of 14 words or more with a fifth of them replaced at random was hit in trials.
MASKS = ("1110111", "11011011", "110101011", "1011000111")
#: Items of fewer words are seeded by every choice of words that the similarity leaves, not by the masks.
SHORT = 12
#: An aligned stretch of so many words (or the whole item, if shorter) must agree in this share.
STRETCH, SIMILARITY = 13, 0.8
FILTER_BITS = 26

_LETTERS = wh.byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
_LISTS = "array<struct<h:long,pos:int>>"


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _short_patterns(n: int) -> list[tuple[int, list[int]]]:
    """All choices of the words of an item of ``n`` words that must be equal: all of them below five, all but one or two up to eleven."""
    kept = math.ceil(SIMILARITY * n - 1e-9)
    # The number of a pattern is its bits, so equal choices of items of different lengths are one pattern.
    return [(1000 + sum(1 << o for o in offsets), list(offsets)) for offsets in itertools.combinations(range(n), kept)]


def _patterns(short: list[int]) -> list[tuple[int, list[int]]]:
    """``(number, offsets)`` of the masks, and of the choices for items of the lengths ``short``."""
    out = {i: _offsets(m) for i, m in enumerate(MASKS)}
    for n in short:
        out.update(_short_patterns(n))
    return list(out.items())


def _bytes(text: str | None) -> bytes:
    return ("" if text is None else text).lower().encode("utf-8", "surrogatepass")


def _windows(owner: np.ndarray, words: np.ndarray, pattern: tuple[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first, h = wh.window_hashes(owner, words, pattern[1])
    return first, wh.mix(h + np.uint64(pattern[0] + 1))


def benchmark_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, words, seeds)`` per benchmark row: hashes of its words and of its windows under every mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, seeds = [], []
            for t in pdf["text"]:
                w = wh.word_hashes(_bytes(t), _LETTERS)
                use = _patterns([]) if len(w) >= SHORT else _short_patterns(len(w)) if len(w) else []
                got = [_windows(np.zeros(len(w), dtype=np.int64), w, p) for p in use]
                seeds.append([{"h": int(h), "pos": int(p)} for first, hs in got for p, h in zip(first, hs.view(np.int64))])
                words.append(w.view(np.int64))
            yield pd.DataFrame({"item": pdf["item"], "words": words, "seeds": seeds})

    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    return items.mapInPandas(run, f"item {kind}, words array<long>, seeds {_LISTS}").filter(F.size("seeds") > 0)


def _slots(h: Column) -> list[Column]:
    low = (1 << FILTER_BITS) - 1
    return [F.shiftrightunsigned(h, 64 - FILTER_BITS), h.bitwiseAND(F.lit(low).cast("long"))]


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of 2 ** FILTER_BITS bits over the hashes ``h``, whatever their number.

    It is put together by Spark as words of 64 bits; at most 2 ** (FILTER_BITS - 6) of them come back.
    """
    slot = seeds.select(F.explode(F.array(*_slots(F.col("h")))).alias("s"))
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    parts = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[parts["w"].to_numpy(dtype=np.int64)] = parts["b"].to_numpy(dtype=np.int64)
    return bits.view(np.uint64)


def _may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)

    def test(s: np.ndarray) -> np.ndarray:
        return (bits[s >> np.uint64(6)] >> (s & low)) & one != 0

    out = np.flatnonzero(test(h >> np.uint64(64 - FILTER_BITS)))
    return out[test(h[out] & np.uint64((1 << FILTER_BITS) - 1))]


def regions(docs: DataFrame, bits: np.ndarray, short: list[int], id_col: str, text_col: str) -> DataFrame:
    """``(doc, tag, base, words, hits)``: stretches of texts around windows that pass the filter."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    patterns = _patterns(short)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for pdf in batches:
            raw = [_bytes(t) for t in pdf["text"]]
            out = []
            for a, b in wh.groups(raw):
                owner, words = wh.words_of(raw[a:b], _LETTERS)
                at, hs = [], []
                for p in patterns:
                    first, h = _windows(owner, words, p)
                    ok = _may_hold(table, h)
                    at.append(first[ok])
                    hs.append(h[ok].view(np.int64))
                at, hs = np.concatenate(at), np.concatenate(hs)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hs = at[order], hs[order]
                begin = np.searchsorted(owner, np.arange(b - a))
                new = (np.diff(at, prepend=at[0]) > 2 * STRETCH) | (np.diff(owner[at], prepend=owner[at[0]]) > 0)
                for part_at, part_h in zip(np.split(at, np.flatnonzero(new)), np.split(hs, np.flatnonzero(new))):
                    if not len(part_at):
                        continue
                    d = int(owner[part_at[0]])
                    lo = max(int(begin[d]), int(part_at[0]) - STRETCH)
                    hi = min(int(begin[d + 1]) if d + 1 < b - a else len(words), int(part_at[-1]) + 2 * STRETCH)
                    hits = [{"h": int(h), "pos": int(p - begin[d])} for p, h in zip(part_at, part_h)]
                    out.append((pdf["doc"].iat[a + d], pdf["tag"].iat[a + d], lo - int(begin[d]), words[lo:hi].view(np.int64), hits))
            if out:
                yield pd.DataFrame(out, columns=["doc", "tag", "base", "words", "hits"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc {kind}, tag long, base int, words array<long>, hits {_LISTS}")


def aligned(doc: np.ndarray, base: int, item: np.ndarray, shift: int) -> tuple[int, int]:
    """``(matched, length)`` of the aligned words if some stretch of them agrees closely enough, else zeros.

    ``shift`` is the place in the text of the item's first word.
    """
    lo, hi = max(shift, base), min(shift + len(item), base + len(doc))
    need = min(STRETCH, len(item))
    if hi - lo < need:
        return 0, 0
    same = doc[lo - base:hi - base] == item[lo - shift:hi - shift]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[need:] - sums[:-need] >= SIMILARITY * need - 1e-9)
    if not len(good):
        return 0, 0
    inside = np.zeros(len(same) + 1, dtype=np.int64)
    np.add.at(inside, good, 1)
    np.add.at(inside, good + need, -1)
    covered = np.cumsum(inside)[:-1] > 0
    return int((same & covered).sum()), int(covered.sum())


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id, item, n_items, matched, aligned)``: one row per document and distinct benchmark item that it holds a passage of.

    Items of equal words are one class: ``item`` is the smallest of their ids
    and ``n_items`` their number. ``aligned`` words of the item lie in stretches
    of 13 words (the whole item, if shorter) of which 80 percent agree word by
    word; ``matched`` of them are equal. The largest alignment is given. Items
    of fewer than five words must be there whole. Null and empty texts hold
    nothing and items without words are not searched for, repeated rows give
    the rows that each of them would, null ids are kept, a very long text is
    hashed in pieces of a megabyte, an empty table gives no rows, and other
    columns are ignored. One small job builds the filter at once.
    """
    listed = benchmark_seeds(benchmark, item_col, item_text_col)
    items = settle(
        listed.groupBy("words").agg(F.min("item").alias("item"), F.count("*").alias("n_items"), F.first("seeds").alias("seeds"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    seeds = items.select("class", F.size("words").alias("n"), F.explode("seeds").alias("s")).select("class", "n", "s.h", "s.pos")
    short = sorted(r[0] for r in seeds.filter(F.col("n") < SHORT).select("n").distinct().collect())
    found = settle(regions(docs, seed_filter(seeds), short, id_col, text_col).withColumn("region", F.monotonically_increasing_id()))
    hits = found.select("region", F.explode("hits").alias("x")).select("region", F.col("x.h").alias("h"), F.col("x.pos").alias("at"))
    # All shifts of an item in a region are one row, so that the region's words are there once for them.
    pairs = hits.join(seeds.withColumnRenamed("pos", "from"), "h").groupBy("region", "class").agg(
        F.collect_set(F.col("at") - F.col("from")).alias("shifts"))

    def check(words: pd.Series, base: pd.Series, item: pd.Series, shifts: pd.Series) -> pd.DataFrame:
        got = [
            max((aligned(np.asarray(w), int(b), np.asarray(i), int(x))[::-1] for x in s), default=(0, 0))
            for w, b, i, s in zip(words, base, item, shifts)
        ]
        return pd.DataFrame(got, columns=["aligned", "matched"])

    side = (
        pairs.join(found.select("region", "doc", "tag", "base", "words"), "region")
        .join(items.select("class", "item", "n_items", F.col("words").alias("item_words")), "class")
    )
    checked = side.withColumn("a", F.pandas_udf(check, "aligned int, matched int")("words", "base", "item_words", "shifts"))
    return (
        checked.filter(F.col("a.aligned") > 0).groupBy("doc", "class", "item", "n_items").agg(F.max("a").alias("m"))
        .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_items", F.col("m.matched").alias("matched"), F.col("m.aligned").alias("aligned"))
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The documents without a passage of the benchmark, with their own columns; rows that share an id go together."""
    gone = leaks(docs, benchmark, id_col, text_col, **names).select(F.col(id_col).alias("_leak")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_leak"]), "left_anti")
