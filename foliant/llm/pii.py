"""Personal data: fixed forms, and bootstrapped contextual extraction of what the forms miss.

Addresses, card and phone numbers of fixed form are the seeds. The words around
them are lexical patterns; patterns and the identifiers they surround make a
graph. In each round a pattern is worth the share of its identifiers that are
known, and an identifier is worth what its trusted patterns together say.
Identifiers of high worth are added as further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import packed, text_of, unpacked
from foliant.llm.marks import matches, parts_of, unmarked
from foliant.session import settle

KINDS = ("email", "ip", "card", "phone")
# The contract's forms. A look-behind (or the end of the match before) skips starts that can match no better; possessive
# repeats keep long runs linear. Both leave the leftmost matches as they are.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a form to be tried at all.
_HINTS = {"email": "@", "ip": ".", "card": "[0-9]", "phone": "+"}
#: What may be an identifier that the forms miss: a run of words of digits and phone signs, or a word with a digit, ``@`` or ``(at)``.
_DIGITS_WORD = r"[().+/-]*+[0-9][0-9().+/-]*+"
CANDIDATE = (
    rf"(?<![^\x20\x09-\x0D])(?:{_DIGITS_WORD}(?:\x20{_DIGITS_WORD}(?![^\x20\x09-\x0D]))*+(?![^\x20\x09-\x0D])"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+|[^\x20\x09-\x0D]*?(?i:\(at\))[^\x20\x09-\x0D]*+)"
)
_MAYBE = r"[0-9@]|(?i:\(at\))"
_WORD = r"[^\x20\x09-\x0D]+"
#: Stand for a missing neighbour at the start and the end of a text.
START, END = "\x02", "\x03"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    small = F.forall(
        F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0"))),
        lambda p: (F.length(p) < 4) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255),
    )
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
    )


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, tag, kind, start, end, value, left2, left, right)``; kind is null for candidates.

    ``tag`` is a hash of the text. Matches of a form that fail its test are not listed as that kind.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("tag"), unmarked(text).alias("text"))
    held = {k: F.col("text").contains(h) if len(h) == 1 else F.col("text").rlike(h) for k, h in _HINTS.items()}
    forms = [
        F.struct(F.lit(k).alias("kind"), F.when(held[k], parts_of(F.col("text"), p)).alias("parts")) for k, p in FORMS.items()
    ]
    other = F.struct(F.lit(None).cast("string").alias("kind"), F.when(F.col("text").rlike(_MAYBE), parts_of(F.col("text"), CANDIDATE)).alias("parts"))
    cut = rows.select("doc", "tag", F.explode(F.array(*forms, other)).alias("x")).select("doc", "tag", "x.kind", "x.parts")
    # Five parts on each side hold two words, even where the words around a match are matches themselves.
    found = matches(cut, "parts", ["doc", "tag", "kind"], near=5)
    sure = found.filter(F.col("kind").isNull() | _valid(F.col("kind"), F.col("value")))
    before = F.regexp_extract("before", rf"({_WORD})[\x20\x09-\x0D]*$", 1)
    before2 = F.regexp_extract("before", rf"({_WORD})[\x20\x09-\x0D]+{_WORD}[\x20\x09-\x0D]*$", 1)
    return sure.select(
        "doc", "tag", "kind", "start", "end", "value", _or(F.lower(before2), START).alias("left2"), _or(F.lower(before), START).alias("left"),
        _or(F.lower(F.regexp_extract("after", _WORD, 0)), END).alias("right"),
    ).distinct()


def _or(word: Column, mark: str) -> Column:
    return F.when(word == "", mark).otherwise(word)


def _free(found: DataFrame) -> DataFrame:
    """Candidates that touch no span of a fixed form."""
    up = W.partitionBy("doc", "tag").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("doc", "tag").orderBy(F.col("start").desc(), F.col("end").desc()).rowsBetween(W.unboundedPreceding, 0)
    base = F.col("kind").isNotNull()
    edged = found.withColumn("reach", F.max(F.when(base, F.col("end"))).over(up)).withColumn(
        "next", F.min(F.when(base, F.col("start"))).over(down)
    )
    return edged.filter(~base & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))


def _core(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", ""))


def _edges(found: DataFrame) -> DataFrame:
    # A pattern of the words on both sides, and one of the two words before; neither consists of marks alone.
    both = F.when((F.col("left") != START) | (F.col("right") != END), F.concat(F.lit("b\x1f"), "left", F.lit("\x1f"), "right"))
    before = F.when(F.col("left") != START, F.concat(F.lit("l\x1f"), "left2", F.lit("\x1f"), "left"))
    return found.select(
        F.explode(F.array_compact(F.array(both, before))).alias("pattern"), _core(F.col("value")).alias("item"), "kind"
    ).distinct()


def _fits(kind: Column, item: Column) -> Column:
    """Whether an identifier can be of a kind at all: an address has its sign, the others three digits or more."""
    return F.when(kind == "email", item.rlike(r"@|\(at\)")).otherwise(F.length(_digits(item)) >= 3)


def discovered(
    found: DataFrame, rounds: int = 3, min_seeds: int = 3, pattern_worth: float = 0.4, item_worth: float = 0.9
) -> DataFrame:
    """``(item, kind)``: identifiers without a fixed form that trusted patterns surround.

    ``found`` are the seeds and the free candidates of all documents. A pattern
    counts distinct identifiers, so copies of one document add nothing, and it
    needs ``min_seeds`` distinct known ones of the kind. It takes part while at
    least ``pattern_worth`` of its identifiers are known or, in later rounds,
    likely; an identifier is found when its patterns together make it
    ``item_worth`` likely: one pattern with nine of ten known, several of less,
    or one that rose above that over the rounds.
    """
    edges = settle(_edges(found))
    sizes = edges.groupBy("pattern").agg(F.count_distinct("item").alias("n"))
    seeds = edges.filter(F.col("kind").isNotNull()).groupBy("pattern", "kind").agg(F.count_distinct("item").alias("known"))
    # Only patterns with enough seeds can ever be trusted; all else leaves the graph here.
    able = settle(seeds.filter(F.col("known") >= min_seeds).join(sizes, "pattern"))
    open_ = settle(edges.filter(F.col("kind").isNull()).select("pattern", "item").join(able.select("pattern", "kind"), "pattern").filter(_fits(F.col("kind"), F.col("item"))))
    worth = None
    for _ in range(rounds):
        extra = (
            able.select("pattern", "kind").withColumn("more", F.lit(0.0)) if worth is None else
            open_.join(worth, ["item", "kind"]).groupBy("pattern", "kind").agg(F.sum("worth").alias("more"))
        )
        scored = able.join(extra, ["pattern", "kind"], "left").withColumn(
            "trust", F.least((F.col("known") + F.coalesce("more", F.lit(0.0))) / F.col("n"), F.lit(1.0))
        )
        trusted = scored.filter(F.col("trust") >= pattern_worth).select("pattern", "kind", "trust")
        worth = settle(
            open_.join(trusted, ["pattern", "kind"]).groupBy("item", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("worth"))
        )
    return worth.filter(F.col("worth") >= item_worth).groupBy("item").agg(F.max_by("kind", F.struct("worth", "kind")).alias("kind"))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc, tag, kind, start, end, base)`` for every span of every document, in code points, end exclusive.

    ``base`` spans have a fixed form; the others were discovered. Null and
    empty texts have none, rows that agree in id and text are one, long texts
    are searched whole, and other columns are ignored.
    """
    found = settle(occurrences(docs, id_col, text_col))
    base = found.filter(F.col("kind").isNotNull())
    free = settle(_free(found).select(*found.columns))
    new = discovered(base.unionByName(free), **options)
    more = free.drop("kind").withColumn("item", _core(F.col("value"))).join(new, "item")
    columns = ["doc", "tag", "kind", "start", "end"]
    return base.select(*columns, F.lit(True).alias("base")).unionByName(more.select(*columns, F.lit(False).alias("base")))


def listed(spans: Column) -> Column:
    """``kind:start:end``, by start and then kind as listed in KINDS, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"], s["kind"])))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: counts per kind, the digest of the base spans, and all spans.

    Null and empty texts have no spans, repeated rows have equal ones, very
    long texts are searched whole, an empty table gives no rows, and other
    columns are ignored.
    """
    spans = personal_spans(docs, id_col, text_col, **options)
    per = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("kind", "start", "end", "base")).alias("spans"))
    ids = docs.select(F.col(id_col), F.xxhash64(text_of(text_col)).alias("_tag"))
    all_ = ids.join(per, ids[id_col].eqNullSafe(per["doc"]) & (ids["_tag"] == per["tag"]), "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>"))
    )
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return all_.select(
        id_col, *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def redacted(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``redacted_text`` added or replaced: each span replaced by ``[KIND]``; of overlapping spans the first one counts."""
    per = spans.groupBy("doc", "tag").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("_spans"))
    text = F.col("_text")
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(
        F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"),
        x["end"].alias("at"),
    ))
    done = F.aggregate(
        "_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    found = packed(docs, id_col, text_col).join(per, F.col("_id").eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("tag")), "left")
    return found.select(
        *unpacked(docs.columns, ("redacted_text",)), F.when(F.col("_spans").isNull(), text).otherwise(done).alias("redacted_text")
    )
