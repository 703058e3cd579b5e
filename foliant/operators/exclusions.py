"""Which attachments to set aside, and why.

Attachment rows carry ``doc_id, conv, name, size, sha, dhash, img, ord``:
``conv`` is the conversation key, ``name`` trimmed and lower-case, ``dhash`` the
perceptual hash as a bigint (NULL where there is none) and ``ord`` a sortable
value giving the first-seen order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.hashing import LOGO_MAX_BYTES, MAX_BITS, MIN_CONVERSATIONS, SMALL_BYTES, hamming, long_to_hex
from foliant.functions.names import fingerprint
from foliant.operators.similarity import near_tagged, similar_edges
from foliant.session import settle


@dataclass(frozen=True)
class Rules:
    """The rules of a document set.

    Pointers are ``name|size`` fingerprints: a few as a tuple, or a table of
    any size with a column ``fp``, which is joined.
    """

    exclude_signatures: bool = False
    exclude_pointers: tuple[str, ...] | DataFrame = ()
    keep_pointers: tuple[str, ...] | DataFrame = ()
    exclude_names: tuple[str, ...] = ()
    keep_names: tuple[str, ...] = ()

    @property
    def needs_scan(self) -> bool:
        return bool(self.needs_dhash or self.exclude_names)

    @property
    def needs_dhash(self) -> bool:
        return bool(self.exclude_signatures or _given(self.exclude_pointers) or _given(self.keep_pointers))


def _given(pointers: tuple[str, ...] | DataFrame) -> bool:
    return isinstance(pointers, DataFrame) or bool(pointers)


def _lower(names: tuple[str, ...]) -> list[str]:
    # Python strips the same white space and a few control characters more, which no file name ends with.
    return [n.strip("\ufeff" + " \t\n\r\x0b\x0c\u00a0").lower() for n in names if n.strip()]


def is_small(size: Column, exclude_signatures: bool = True) -> Column:
    return F.lit(exclude_signatures) & (size > 0) & (size < SMALL_BYTES)


def recurrence_by_content(att: DataFrame) -> DataFrame:
    """Distinct conversations per exact content."""
    return att.groupBy("sha").agg(F.countDistinct("conv").alias("convs"))


def _first_seen(att: DataFrame, *fields: str) -> DataFrame:
    """``(sha, f, convs)``: the fields of each content's first instance, and its distinct conversations.

    Two aggregates, joined: in one, each conversation of a content would carry
    the fields and their order through both shuffles of the distinct count.
    """
    what = F.min_by(F.struct(*fields), "ord").alias("f")
    known = att.filter(F.col("sha").isNotNull())
    found = recurrence_by_content(known).join(known.groupBy("sha").agg(what), "sha")
    # An equality join has no place for contents that could not be read; together they are one.
    unread = att.filter(F.col("sha").isNull()).groupBy("sha").agg(F.countDistinct("conv").alias("convs"), what)
    return found.unionByName(unread)


def _small_images(att: DataFrame) -> DataFrame:
    return att.filter(F.col("img") & F.col("dhash").isNotNull() & (F.col("size") <= LOGO_MAX_BYTES))


def recurrence_by_look(att: DataFrame) -> DataFrame:
    """Distinct conversations per perceptual hash, small images only."""
    return _small_images(att).groupBy("dhash").agg(F.countDistinct("conv").alias("convs"))


def _often(rows: DataFrame, key: str) -> DataFrame:
    """Keys, as ``_often``, that are seen in three conversations: there is one between the smallest and the largest.

    Partly aggregated extremes and the few rows between them are shuffled, not every conversation of every key.
    """
    ends = rows.groupBy(F.col(key).alias("_often")).agg(F.min("conv").alias("_low"), F.max("conv").alias("_high"), F.count("conv").alias("_n"))
    ends = settle(ends.filter((F.col("_low") < F.col("_high")) & (F.col("_n") >= MIN_CONVERSATIONS)).drop("_n"))
    seen = rows.select(key, "conv").join(ends, F.col(key).eqNullSafe(F.col("_often")))
    return settle(seen.filter((F.col("conv") > F.col("_low")) & (F.col("conv") < F.col("_high"))).select("_often").distinct())


def auto_logos(att: DataFrame) -> DataFrame:
    """Contents that recur in at least three conversations as a small image; a few small jobs run at once."""
    return _logo_rows(att).distinct()


def _logo_rows(att: DataFrame) -> DataFrame:
    """:func:`auto_logos`, a content once for each reason and row that tells so."""
    first = att.join(_often(att, "sha"), F.col("sha").eqNullSafe(F.col("_often")), "left_semi").groupBy("sha").agg(
        F.min_by(F.struct("img", "size"), "ord").alias("f")
    )
    exact = first.filter(F.col("f.img") & (F.col("f.size") <= LOGO_MAX_BYTES)).select("sha")
    small = _small_images(att)
    alike = small.join(_often(small, "dhash"), F.col("dhash") == F.col("_often"), "left_semi").select("sha")
    return exact.unionByName(alike)


def matching_pointers(att: DataFrame, pointers: tuple[str, ...] | DataFrame) -> DataFrame:
    """Attachments a user's pointers name. A tuple is the user's own rule text, a table is joined."""
    fp = fingerprint(F.col("name"), F.col("size"))
    if isinstance(pointers, DataFrame):
        # Settled, so that the planner knows how few they are before it deals out all attachments.
        wanted = settle(pointers.select(F.col("fp").alias("_fp")).distinct())
        return att.withColumn("_fp", fp).join(wanted, "_fp", "left_semi").drop("_fp")
    return att.filter(fp.isin(*pointers) if pointers else F.lit(False))


def _with_look_alikes(att: DataFrame, named: DataFrame) -> DataFrame:
    """``(sha, tag)``: the contents in ``named`` (``sha, dhash, tag``) and what looks like them, all tags in one pass, with repeats."""
    named = settle(named.distinct())
    looks = att.filter(F.col("dhash").isNotNull()).select("sha", "dhash")
    # The hashes found are settled, so that the planner knows how few they are before it deals out all contents.
    near = settle(near_tagged(looks.select(F.col("dhash").alias("hash")), named.select(F.col("dhash").alias("hash"), "tag")))
    alike = looks.join(near.withColumnRenamed("hash", "dhash"), "dhash").select("sha", "tag")
    return named.select("sha", "tag").unionByName(alike)


def decide(att: DataFrame, rules: Rules) -> DataFrame:
    """``(sha, in_exclude, in_logo, in_keep)`` for every content a rule touches.

    Manual exclusions and keeps both reach exact copies and look-alikes. A keep
    removes a content from both exclusion sets.
    """
    if not rules.needs_dhash:
        att = att.withColumn("dhash", F.lit(None).cast("bigint"))
    off, on = F.lit(False), F.lit(True)
    named = []
    if rules.exclude_names:
        named.append(att.filter(F.col("name").isin(_lower(rules.exclude_names))).select("sha", "dhash", F.lit("x").alias("tag")))
    both = ((rules.exclude_pointers, "x"), (rules.keep_pointers, "k"))
    tables = [p.select(F.col("fp").alias("_fp"), F.lit(tag).alias("tag")) for p, tag in both if isinstance(p, DataFrame)]
    if tables:
        # One pass makes the fingerprints for all tables.
        wanted = settle(reduce(DataFrame.unionByName, tables).distinct())
        hits = att.select("sha", "dhash", fingerprint(F.col("name"), F.col("size")).alias("_fp")).join(wanted, "_fp")
        named.append(hits.select("sha", "dhash", "tag"))
    for pointers, tag in both:
        if _given(pointers) and not isinstance(pointers, DataFrame):
            named.append(matching_pointers(att, pointers).select("sha", "dhash", F.lit(tag).alias("tag")))
    parts = []
    if named:
        rows = named[0]
        for part in named[1:]:
            rows = rows.unionByName(part)
        tag = F.col("tag")
        parts.append(_with_look_alikes(att, rows).select("sha", (tag == "x").alias("x"), off.alias("l"), (tag == "k").alias("k")))
    if rules.exclude_signatures:
        parts.append(_logo_rows(att).select("sha", off.alias("x"), on.alias("l"), off.alias("k")))
    rows = att.select("sha", off.alias("x"), off.alias("l"), off.alias("k")).filter(F.lit(False)) if not parts else parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    flags = rows.groupBy("sha").agg(F.max("x").alias("x"), F.max("l").alias("l"), F.max("k").alias("k"))
    return flags.select(
        "sha", (F.col("x") & ~F.col("k")).alias("in_exclude"), (F.col("l") & ~F.col("k")).alias("in_logo"),
        F.col("k").alias("in_keep"),
    )


def _flagged(att: DataFrame, decisions: DataFrame) -> DataFrame:
    out = att.join(decisions, "sha", "left")
    for c in ("in_exclude", "in_logo", "in_keep"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    return out


def preview_excluded(att: DataFrame, decisions: DataFrame, rules: Rules) -> DataFrame:
    """Distinct fingerprints the rules set aside."""
    rows = _flagged(att, decisions)
    hit = (F.col("in_exclude") | F.col("in_logo")) & ~F.col("in_keep") & ~F.col("name").isin(_lower(rules.keep_names))
    if not rules.needs_scan:
        hit = F.lit(False)
    return rows.filter(hit).select(fingerprint(F.col("name"), F.col("size")).alias("fp")).distinct()


def preview_kept(att: DataFrame, decisions: DataFrame, rules: Rules) -> DataFrame:
    """Distinct fingerprints the keep rules restore."""
    hit = F.col("in_keep") | F.col("name").isin(_lower(rules.keep_names))
    if not rules.needs_scan:
        hit = F.lit(False)
    return _flagged(att, decisions).filter(hit).select(
        fingerprint(F.col("name"), F.col("size")).alias("fp")
    ).distinct()


def dispositions(att: DataFrame, decisions: DataFrame, rules: Rules) -> DataFrame:
    """What happens to each attachment.

    ``inline`` marks images the body refers to. Outcomes: ``embedded``,
    ``inline_dropped`` (recurring logo, silent), ``inline_excluded`` (by the
    user), ``excluded`` and ``produced``.
    """
    rows = _flagged(att, decisions)
    kept = F.col("in_keep") | F.col("name").isin(_lower(rules.keep_names))
    by_user = ~kept & F.col("in_exclude")
    logo = F.lit(rules.exclude_signatures) & ~kept & F.col("in_logo")
    tiny = ~kept & is_small(F.col("size"), rules.exclude_signatures)
    shown = F.col("inline") & F.col("img")
    outcome = (
        F.when(shown & by_user, "inline_excluded").when(shown & logo, "inline_dropped").when(shown, "embedded")
        .when(by_user | logo | tiny, "excluded").otherwise("produced")
    )
    return rows.withColumn("kept", kept).withColumn("disposition", outcome)


def decision_report(att: DataFrame, decisions: DataFrame, rules: Rules) -> DataFrame:
    """One row per distinct content with its decision and the reason; without any rule there is no report."""
    if not rules.needs_dhash:
        att = att.withColumn("dhash", F.lit(None).cast("bigint"))
    first = _first_seen(att, "name", "size", "dhash", "img").select("sha", "f.*", F.col("convs").alias("c"))
    looks = settle(recurrence_by_look(att).withColumnRenamed("convs", "lc"))
    rows = _flagged(first.join(looks, "dhash", "left"), decisions)
    recur = F.greatest("c", F.coalesce("lc", F.lit(0)))
    small = is_small(F.col("size"), rules.exclude_signatures)
    decision = (
        F.when(F.col("in_keep"), "kept")
        .when(F.col("in_exclude") | F.col("in_logo") | small, "excluded").otherwise("produced")
    )
    times = recur.cast("string")
    reason = (
        F.when(F.col("in_keep"), "restored / keep rule (overrides all exclusions)")
        .when(F.col("in_exclude"), "manual exclude rule")
        .when(F.col("in_logo"), F.concat(
            F.lit("recurring logo — appears in "), times, F.lit(f" conversations (>= {MIN_CONVERSATIONS})")))
        .when(small, f"under {SMALL_BYTES // 1024} KB")
        .when(~F.col("img"), "not an image (only exact-copy or manual rules apply)")
        .when(F.col("dhash").isNull(),
              "no similarity key — low-entropy/undecodable image; only exact-copy recurrence can catch it")
        .when(F.col("size") > LOGO_MAX_BYTES,
              f"image larger than {LOGO_MAX_BYTES // 1024} KB — too big to treat as a logo")
        .when(recur < MIN_CONVERSATIONS, F.concat(
            F.lit("recurs in only "), times,
            F.lit(f" conversation(s) — needs >= {MIN_CONVERSATIONS} to be auto-flagged")))
        .otherwise("kept as content")
    )
    if not rules.needs_scan:
        rows = rows.limit(0)
    return rows.select(
        "name", F.col("size").cast("bigint").alias("size"), F.substring("sha", 1, 12).alias("sha_short"),
        F.coalesce(long_to_hex(F.col("dhash")), F.lit("none")).alias("dhash"), recur.alias("conversations"),
        decision.alias("decision"), reason.alias("reason"),
    )


def sorted_report(report: DataFrame) -> DataFrame:
    return report.orderBy("dhash", "size", "name", "sha_short")


def collapse_copies(excluded: DataFrame) -> DataFrame:
    """One row per distinct content: first instance, and where all copies came from.

    ``excluded`` has ``content, name, size, source, ord``. Sources stay rows in
    the second result of :func:`restore_dirs`; here they are only counted.
    """
    return excluded.groupBy("content").agg(
        F.min_by("name", "ord").alias("name"), F.min_by("size", "ord").alias("size"), F.min("ord").alias("ord"),
        F.countDistinct("source").alias("sources"), F.count("*").alias("copies"),
    )


def restore_dirs(excluded: DataFrame) -> DataFrame:
    """Produced folders each set-aside content belongs in, one row per folder."""
    from foliant.functions.names import restore_dir

    return excluded.select("content", restore_dir(F.col("source")).alias("dir")).distinct()


def excluded_listing(excluded: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per instance with its group, for the review listing."""
    meta = groups.select("content", "group_no", F.coalesce(long_to_hex(F.col("dhash")), F.lit("none")).alias("dhash"))
    return excluded.join(meta, "content", "left").select(
        F.col("group_no").cast("bigint").alias("group_no"), "name", "size", F.coalesce("dhash", F.lit("none")).alias("dhash"),
        "source",
    )


def group_layout(groups: DataFrame) -> DataFrame:
    """Folder and file name of each distinct set-aside file; a name that is taken in its folder gets a leading ``_``."""
    from foliant.functions.names import decorate_name, safe_name
    from foliant.operators.production import claim_names

    total = groups.agg(F.max("group_no").alias("n")).scalar()
    digits = F.length(total.cast("string"))
    number = F.lpad(F.col("group_no").cast("string"), digits, F.lit("0"))
    noun = F.when(F.col("members") == 1, " file)").otherwise(" files)")
    folder = F.concat(F.lit("Group "), number, F.lit(" ("), F.col("members").cast("string"), noun)
    file = safe_name(decorate_name(F.col("name"), F.col("size"), long_to_hex(F.col("dhash"))))
    placed = groups.withColumn("folder", folder).withColumn("_file", file).withColumnRenamed("name", "_name").withColumnRenamed("_file", "name")
    claimed = claim_names(placed, ["content"])
    return claimed.drop("name").withColumnRenamed("_name", "name").withColumnRenamed("final_name", "file")


# -- browser variant ---------------------------------------------------------


def _three_smallest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """At most three distinct values per key, cut before the shuffle.

    Only "three or more" matters later, and the union of such sets has three
    members exactly when the union of the full sets has.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(value))
    return rows.select(key, value).distinct().withColumn("_p", place).filter(
        F.col("_p") <= MIN_CONVERSATIONS
    ).drop("_p")


def _dense_looks(by_look: DataFrame) -> DataFrame:
    """Hashes that are logos for sure: within half the distance of one centre, such hashes are all near each other.

    ``by_look`` has at most three conversations per hash. The centre of a
    bucket of equal 16 bits is its smallest hash; if the hashes close to it
    span three conversations, each of them has these among its neighbours.
    """
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("dhash", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint")).alias("v")) for i in range(4)))
    cells = by_look.select("dhash").distinct().select("dhash", F.explode(places).alias("cell"))
    centres = cells.groupBy("cell").agg(F.min("dhash").alias("centre"))
    close = cells.join(centres, "cell").filter(hamming(F.col("dhash"), F.col("centre")) <= MAX_BITS // 2).select("cell", "dhash")
    convs = _three_smallest(close.join(by_look, "dhash"), "cell", "conv")
    full = convs.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_CONVERSATIONS)
    return close.join(full, "cell", "left_semi").select("dhash").distinct()


def _spanning(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys whose rows name three conversations."""
    return rows.groupBy(*keys).agg(F.countDistinct("conv").alias("_n")).filter(F.col("_n") >= MIN_CONVERSATIONS).select(*keys)


def auto_flags(att: DataFrame, exclude_signatures: bool = True) -> DataFrame:
    """Browser variant of the automatic flags: logo, then duplicate, then tiny.

    A small image is a logo if its exact copies and its direct look-alikes
    (not chains of them) together span three conversations. Expects a ``key``
    column; adds ``auto_reason`` (empty where nothing applies).
    """
    # Read many times below, so written once. Most rows are told by their look or by their content alone.
    att = settle(att)
    rows = att.filter(F.col("sha").isNotNull())
    again = rows.groupBy(F.col("sha").alias("_s")).agg(F.min("ord").alias("_first"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    marks = [F.lit(False)]
    if exclude_signatures:
        images = att.filter(F.col("img") & F.col("dhash").isNotNull())
        by_sha = _three_smallest(att, "sha", "conv")
        by_look = _three_smallest(images, "dhash", "conv")
        by_look = settle(by_look)
        sure = settle(_dense_looks(by_look))
        # Only what a dense place has not settled is compared, with everything.
        open_ = by_look.join(sure, "dhash", "left_anti").select(F.col("dhash").alias("hash")).distinct()
        edges = similar_edges(by_look.select(F.col("dhash").alias("hash")), queries=settle(open_)).select("a", "b")
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ways = ways.join(sure.withColumnRenamed("dhash", "a"), "a", "left_anti")
        near = ways.join(by_look.withColumnRenamed("dhash", "b"), "b").select(F.col("a").alias("dhash"), "conv")
        ball = settle(_three_smallest(by_look.unionByName(near), "dhash", "conv"))
        looks = settle(_spanning(ball, "dhash").unionByName(sure).distinct())
        contents = _spanning(by_sha, "sha")
        # What is left needs the conversations of both.
        rest = (
            images.filter(F.col("size") <= LOGO_MAX_BYTES).join(looks, "dhash", "left_anti")
            .select("sha", "dhash").distinct().join(contents, "sha", "left_anti")
        )
        both = _spanning(
            rest.join(by_sha, "sha").unionByName(rest.join(ball, "dhash").select("sha", "dhash", "conv")), "sha", "dhash")
        again = again.join(contents.select(F.col("sha").alias("_c"), F.lit(True).alias("_full")), F.col("_s") == F.col("_c"), "left")
        rows = rows.join(looks.select(F.col("dhash").alias("_l"), F.lit(True).alias("_look")), F.col("dhash") == F.col("_l"), "left")
        rows = rows.join(again, F.col("sha") == F.col("_s"), "left")
        both = settle(both.select(F.col("sha").alias("_bs"), F.col("dhash").alias("_bd"), F.lit(True).alias("_both")))
        rows = rows.join(both, (F.col("sha") == F.col("_bs")) & (F.col("dhash") == F.col("_bd")), "left")
        marks = [F.coalesce(x, F.lit(False)) for x in ("_look", "_full", "_both")]
    else:
        rows = rows.join(again, F.col("sha") == F.col("_s"), "left")
    logo = F.col("img") & (F.col("size") <= LOGO_MAX_BYTES) & reduce(or_, marks)
    reason = (
        F.when(logo, "logo/signature image")
        .when(F.col("ord") > F.col("_first"), "duplicate")
        .when(is_small(F.col("size"), exclude_signatures), "tiny attachment").otherwise("")
    )
    return rows.withColumn("auto_reason", reason).select(*att.columns, "auto_reason")


def review_overrides(flagged: DataFrame, review: DataFrame | None) -> DataFrame:
    """Apply a manual review: with one, only its keys are excluded, for its reasons.

    ``review`` is ``(key, reason)``, or None where nobody reviewed.
    """
    if review is None:
        return flagged.withColumn("reason", F.col("auto_reason"))
    marks = review.select("key", F.when(F.col("reason") == "", "excluded").otherwise(F.col("reason")).alias("reason"))
    return flagged.join(marks, "key", "left").withColumn("reason", F.coalesce("reason", F.lit("")))


def duplicate_documents(docs: DataFrame) -> DataFrame:
    """Browser variant: later documents with the same bytes are duplicates."""
    first = docs.groupBy("sha").agg(F.min("ord").alias("_first"))
    return docs.join(first, "sha").withColumn("duplicate", F.col("ord") > F.col("_first")).drop("_first")
