"""Page numbering of document families, and the tables made from it.

A record is one numbered document: a head (email or document) or one of its
produced attachments. Records carry ``family`` (their head's position key),
``child`` (0 for the head) and the columns of the review tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.names import bates_label
from foliant.functions.text import blank, filled, trim_ws
from foliant.operators.scan import previous_row, row_position, running_max, running_sum, split_ranges
from foliant.session import settle


def production_scope(docs: DataFrame, email_to_pdf: bool, review_index: bool, load_file: bool) -> DataFrame:
    """All documents for an index or load file; only emails for conversion alone."""
    if review_index or load_file:
        return docs
    return docs.filter(F.lit(email_to_pdf) & (F.col("kind") == "email"))


def production_order(docs: DataFrame, prior: DataFrame) -> DataFrame:
    """Add ``position``: earlier productions keep their place, new ones follow by path.

    ``prior`` is ``(doc_id, prior_position)``.
    """
    placed = docs.join(prior, "doc_id", "left").withColumn(
        "_prior", F.coalesce(F.col("prior_position").cast("bigint"), F.lit((1 << 63) - 1))
    )
    return row_position(placed, ["_prior", "path", "doc_id"]).drop("_prior")


def record_span(native: Column, pages: Column) -> Column:
    """Numbers a record uses: its pages, or one when produced as a native copy."""
    return F.when(native, F.lit(1)).otherwise(pages).cast("bigint")


def family_spans(records: DataFrame) -> DataFrame:
    return records.groupBy("family").agg(F.sum("span").alias("family_span"))


def number_records(
    records: DataFrame, order: Sequence[str], prefix: str = "DOC-", start: int = 1, families: bool = False
) -> DataFrame:
    """Add ``beg_no, end_no, beg_bates, end_bates``.

    ``order`` must start with the family and put the head before its children.
    Numbers run through a family without a break, so one running sum over all
    records numbers families and members together, and a family of any size is
    cut into ranges like everything else. Records with a span of zero (failed)
    get empty labels and use no number.

    With ``families`` the rows keep the range they were numbered in (``_range``;
    a family is in one range, or marked by ``_cut``), so that what is asked of
    each family afterwards is found there and the records are dealt out once.
    """
    if families:
        records = split_ranges(records, order, whole=True)
    out = running_sum(records, order, F.col("span"), "_before", tagged=families)
    out = out.withColumn("beg_no", F.col("_before") + start).withColumn(
        "end_no", F.col("_before") + start + F.col("span") - 1
    )
    some = F.col("span") > 0
    return (
        out.withColumn("beg_bates", F.when(some, bates_label(F.col("beg_no"), prefix)).otherwise(""))
        .withColumn("end_bates", F.when(some, bates_label(F.col("end_no"), prefix)).otherwise(""))
        .drop("_before")
    )


def over_families(records: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add aggregates of each family to its members; no family is collected. Records without a family get NULL.

    Records that kept their range are aggregated there; the few families that
    are dealt over ranges, at most one for two ranges, are aggregated apart and
    joined back, as are all families of other records.
    """
    known = F.col("family").isNotNull()
    if "_range" not in records.columns:
        return records.join(records.filter(known).groupBy("family").agg(*[v.alias(n) for n, v in values.items()]), "family", "left")
    own = W.partitionBy("_range", "family")
    out = records.withColumns({n: F.when(known, v.over(own)) for n, v in values.items()})
    if "_cut" not in records.columns:
        return out
    few = records.filter("_cut").groupBy("family").agg(*[v.alias(f"_{n}") for n, v in values.items()])
    out = out.join(F.broadcast(few), "family", "left")
    return out.withColumns({n: F.when(F.col("_cut"), F.col(f"_{n}")).otherwise(F.col(n)) for n in values}).drop(*[f"_{n}" for n in values])


def family_ranges(records: DataFrame) -> DataFrame:
    """Add the family range to every member.

    It starts at the head and ends at the last member with an end number.
    Records without a family are left out.
    """
    out = over_families(records.filter(F.col("family").isNotNull()), {
        "beg_attach": F.min_by("beg_bates", F.struct("child", "beg_no")),
        "end_attach": F.max_by("end_bates", F.when(F.col("end_bates") != "", F.struct("child", "beg_no"))),
    })
    return out.withColumn("end_attach", blank(F.col("end_attach")))


def family_ranges_web(records: DataFrame) -> DataFrame:
    """Browser variant: the head alone carries the range of its attachments."""
    kid = F.when(F.col("child") > 0, F.struct("child", "beg_no"))
    head = F.col("child") == 0
    out = over_families(records, {"_b": F.min_by("beg_bates", kid), "_e": F.max_by("end_bates", kid)})
    return (
        out.withColumn("beg_attach", F.when(head, blank(F.col("_b"))).otherwise(""))
        .withColumn("end_attach", F.when(head, blank(F.col("_e"))).otherwise(""))
        .drop("_b", "_e")
    )


def count_or_blank(n: Column) -> Column:
    return F.when(n > 0, n.cast("string")).otherwise("")


REVIEW_COLUMNS = (
    "Beginning Bates", "Ending Bates", "Pages", "Date", "Type", "From", "To", "Subject / Title", "File",
    "# Attachments",
)
LOAD_COLUMNS = (
    "BEGBATES", "ENDBATES", "BEGATTACH", "ENDATTACH", "CUSTODIAN", "DATE SENT", "FROM", "TO", "CC", "SUBJECT",
    "DOC TYPE", "FILE NAME", "NATIVELINK", "PAGE COUNT", "ATTACHMENT NAMES",
)


def _named(records: DataFrame, names: Sequence[str], values: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    return records.select(*keep, *[blank(v).alias(n) for n, v in zip(names, values)])


BATCH_COLUMNS = (
    "Beginning Bates", "Ending Bates", "Pages", "Date", "From", "To", "Subject", "# Attachments", "Attachments",
)


def number_emails(mails: DataFrame, atts: DataFrame, prefix: str = "DOC-", start: int = 1) -> DataFrame:
    """A stand-alone batch: emails alone are numbered, in path order.

    ``mails`` has one row per converted email (``path, pages`` and the columns
    of the tables; one that failed has no row), ``atts`` ``(path, name, ord)``.
    Adds the labels, ``att_count`` and ``att_names``, the names in order.
    """
    names = atts.groupBy(F.col("path").alias("_p")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("a"))
    joined = mails.join(names, F.col("path") == F.col("_p"), "left").withColumns({
        "span": F.col("pages").cast("bigint"), "att_count": F.coalesce("n", F.lit(0)),
        "att_names": F.coalesce(F.array_join(F.col("a.name"), "; "), F.lit("")),
    }).drop("_p", "n", "a")
    return number_records(settle(joined), ["path"], prefix, start)


def email_batch_counts(files: DataFrame, mails: DataFrame, atts: DataFrame) -> DataFrame:
    """Emails converted, other files skipped and attachments kept, as one row; ``files`` has ``path``."""
    email = F.lower("path").endswith(".eml")
    hidden = F.col("path").rlike(r"(^|/)\.")
    return files.agg(F.count_if(~email & ~hidden).alias("skipped")).withColumns({
        "converted": mails.agg(F.count("*")).scalar(), "attachments": atts.agg(F.count("*")).scalar()})


def batch_index(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The nine-column review index of an email batch; no attachments print as 0."""
    c = F.col
    values = [
        c("beg_bates"), c("end_bates"), count_or_blank(c("pages")), c("date"), c("from"), c("to"), c("subject"),
        c("att_count").cast("string"), c("att_names"),
    ]
    return _named(records, BATCH_COLUMNS, values, keep)


def review_index(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The ten-column review index."""
    c = F.col
    values = [
        c("beg_bates"), c("end_bates"), count_or_blank(c("pages")), c("date"), c("doc_type"), c("from"), c("to"),
        c("subject"), c("file_rel"), count_or_blank(c("att_count")),
    ]
    return _named(records, REVIEW_COLUMNS, values, keep)


def load_file(
    records: DataFrame, keep: Sequence[str] = (), email_batch: bool = False, custodian: str = "",
    variant: str = "desktop",
) -> DataFrame:
    """The fifteen-column load file.

    An email batch leaves out document type and native link and repeats its own
    range as the family range. The browser variant fills the custodian and
    leaves a missing family range empty.
    """
    c = F.col
    beg, end = c("beg_bates"), c("end_bates")
    if not email_batch:
        fall = variant != "web"
        own = (beg, end) if fall else (F.lit(""), F.lit(""))
        beg_a, end_a = F.coalesce(filled(c("beg_attach")), own[0]), F.coalesce(filled(c("end_attach")), own[1])
    else:
        beg_a, end_a = beg, end
    values = [
        beg, end, beg_a, end_a, F.lit(custodian), c("date"), c("from"), c("to"), c("cc"), c("subject"),
        F.lit("") if email_batch else c("doc_type"), c("file_rel"),
        F.lit("") if email_batch else c("native_rel"),
        c("pages").cast("string") if variant == "web" else count_or_blank(c("pages")), c("att_names"),
    ]
    pairs = list(zip(LOAD_COLUMNS, values))
    if email_batch:
        pairs = [p for p in pairs if p[0] not in ("DOC TYPE", "NATIVELINK")]
    return _named(records, [p[0] for p in pairs], [p[1] for p in pairs], keep)


def opticon_rows(records: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per page: page id, image path, break flag and page count.

    Records without pages or without a readable number give no rows.
    """
    digits = F.regexp_extract(F.substring("beg_bates", len(prefix) + 1, 40), r"^\s*(\d+)", 1)
    start = filled(digits).try_cast("bigint")
    paged = records.filter((F.col("pages") > 0) & (F.col("beg_bates") != "")).withColumn("_s", start)
    # What is the same on all pages of a record is made once, before its pages.
    pages = paged.filter(F.col("_s").isNotNull()).select(
        *keep, "_s", F.col("pages").cast("string").alias("_count"), F.replace("file_rel", F.lit("/"), F.lit("\\")).alias("_image"),
        F.explode(F.sequence(F.lit(0), F.col("pages").cast("int") - 1)).alias("page")
    )
    first = F.col("page") == 0
    return pages.select(
        *keep, "page", bates_label(F.col("_s") + F.col("page"), prefix).alias("page_id"), F.lit("").alias("volume"),
        F.col("_image").alias("image"),
        F.when(first, "Y").otherwise("").alias("doc_break"), F.lit("").alias("folder_break"),
        F.lit("").alias("box_break"), F.when(first, F.col("_count")).otherwise("").alias("page_count"),
    )


def production_counters(
    families: DataFrame, removed: DataFrame, excluded: DataFrame, record_counts: bool = True
) -> DataFrame:
    """Counters of a run as one row.

    ``families`` has ``reused, records, slip_sheets, failed`` per family. With
    ``record_counts`` off, a reused family counts as one document in
    ``pdf_count``, whatever it holds, as the desktop counters do.
    """
    done = ~F.col("failed")
    reused_docs = F.col("records") if record_counts else F.lit(1)
    totals = families.agg(
        F.count_if(done & ~F.col("reused")).alias("processed"), F.count_if(done & F.col("reused")).alias("skipped"),
        F.coalesce(
            F.sum(F.when(done, F.when(F.col("reused"), reused_docs).otherwise(F.col("records")))), F.lit(0)
        ).cast("bigint").alias("pdf_count"),
        F.coalesce(F.sum(F.when(done & ~F.col("reused"), F.col("slip_sheets"))), F.lit(0)).cast("bigint").alias("slip_sheets"),
        F.count_if(F.col("failed")).alias("errors"),
    )
    return totals.withColumn("removed", removed.agg(F.count("*")).scalar()).withColumn(
        "excluded", excluded.agg(F.count("*")).scalar()
    )


def bates_range(records: DataFrame) -> DataFrame:
    """First begin and last end label of a run, in production order."""
    return records.agg(
        F.min_by("beg_bates", F.when(F.col("beg_bates") != "", F.col("beg_no"))).alias("begin"),
        F.max_by("end_bates", F.when(F.col("end_bates") != "", F.col("end_no"))).alias("end"),
    )


def same_size(a: Column, b: Column) -> Column:
    """Sizes within 2 % of the larger, or 256 bytes, count as the same file."""
    return F.abs(a - b) <= F.greatest(F.lit(256), F.floor(F.greatest(a, b) * 0.02))


def size_clusters(files: DataFrame) -> DataFrame:
    """Clusters of nearly equal sizes per name: ``name, low, high, copies``.

    Sizes are chained: a cluster ends where the gap to the previous size is too
    wide. Copies of a size are counted first, and the chain is cut in ranges
    over (name, size), so a name shared by very many files is no hot spot. The
    counted sizes are written once, because the chain reads them several times.
    """
    sizes = files.select(F.lower(trim_ws(F.col("name"))).alias("name"), F.col("size").cast("bigint").alias("size"))
    counted = sizes.groupBy("name", "size").agg(F.count("*").alias("copies"))
    order = ["name", "size"]
    cut = settle(split_ranges(settle(counted), order))
    chained = previous_row(cut, order, order, "_prev", tagged=True)
    same = (F.col("_prev.name") == F.col("name")) & same_size(F.col("_prev.size"), F.col("size"))
    starts = chained.withColumn("_start", F.when(~F.coalesce(same, F.lit(False)), F.struct("name", "size")))
    tagged = running_max(starts.drop("_prev"), order, F.col("_start"), "_c", tagged=True)
    return tagged.groupBy("name", F.col("_c.size").alias("low")).agg(
        F.max("size").alias("high"), F.sum("copies").alias("copies")
    )


def excluded_summary(files: DataFrame) -> DataFrame:
    """Total set-aside instances, and names whose sizes fall in several clusters."""
    per_name = size_clusters(files).groupBy("name").agg(F.count("*").alias("n"), F.sum("copies").alias("c"))
    return per_name.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("total"),
        F.count_if(F.col("n") > 1).alias("inconsistent_names"),
    )


# A queue of names up to this length is counted in one task.
QUEUE_LIMIT = 1 << 16


def claim_names(files: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``final_name``: a taken name gets one more leading ``_`` until free.

    Names are compared in lower case per folder, earlier files win. Names that
    differ only in leading underscores compete for the same slots, one for each
    number of underscores. Between two numbers that occur, the slots can only go
    to names that start below: the earliest of them take these slots in order,
    and the others go on together with the names that start at the next number.
    So one round for each number that occurs in a queue settles it. Each round
    counts places over ranges of the whole order, so a queue of any length is
    dealt over many tasks. Queues of up to ``QUEUE_LIMIT`` files whose names all
    start at one number take no part in the rounds: each is counted in one task.
    ``order`` must tell the files of a folder apart.

    Folders and names that are null are empty. Runs a few jobs for each round.
    """
    name = F.coalesce("name", F.lit(""))
    bare = F.ltrim(name, F.lit("_"))
    queue = ["_folder", "_bare"]
    rows = settle(
        files.withColumn("_bare", F.lower(bare)).withColumn("_folder", F.lower(F.coalesce("folder", F.lit(""))))
        .withColumn("_u", (F.length(name) - F.length(bare)).cast("int"))
    )
    shapes = rows.groupBy(*queue).agg(F.count("*").alias("_n"), F.min("_u").alias("_low"), F.max("_u").alias("_high"))
    uneven = settle(shapes.filter((F.col("_n") > QUEUE_LIMIT) | (F.col("_low") < F.col("_high"))).select(*queue))
    turn = F.row_number().over(W.partitionBy(*queue).orderBy(*order))
    plain = rows.join(uneven, queue, "left_anti").withColumn("_slot", F.col("_u") + turn - 1)
    rows = settle(rows.join(uneven, queue, "left_semi"))
    steps = W.partitionBy(*queue).orderBy("_u")
    # One row for each number of underscores of a queue: where its slots begin, and how many there are before the next number.
    levels = settle(
        rows.select(*queue, "_u").distinct().withColumn("_level", F.row_number().over(steps))
        .withColumn("_room", F.lead("_u").over(steps) - F.col("_u"))
    )
    last = levels.agg(F.max("_level")).first()[0] or 0
    waiting = rows.join(levels, [*queue, "_u"]).withColumn("_base", F.col("_u"))
    done = None
    for level in range(1, last + 1):
        waiting = settle(waiting)
        here = row_position(waiting.filter(F.col("_level") == level), [*queue, *order], "_at")
        here = settle(here)
        heads = here.groupBy(*queue).agg(F.min("_at").alias("_head"))
        ranked = here.join(heads, queue).withColumn("_rank", (F.col("_at") - F.col("_head")).cast("int")).drop("_at", "_head")
        fits = F.col("_room").isNull() | (F.col("_rank") < F.col("_room"))
        won = ranked.filter(fits).withColumn("_slot", F.col("_base") + F.col("_rank")).drop("_rank")
        done = won if done is None else done.unionByName(won)
        if level < last:
            above = levels.filter(F.col("_level") == level + 1).select(
                *queue, F.col("_level").alias("_l"), F.col("_room").alias("_r"), F.col("_u").alias("_b"))
            moved = ranked.filter(~fits).drop("_rank").join(above, queue)
            moved = moved.withColumns({"_level": F.col("_l"), "_room": F.col("_r"), "_base": F.col("_b")}).drop("_l", "_r", "_b")
            waiting = waiting.filter(F.col("_level") > level).unionByName(moved)
    if done is None:
        done = waiting.withColumn("_slot", F.col("_u"))
    final = F.concat(F.repeat(F.lit("_"), F.col("_slot") - F.col("_u")), F.coalesce("name", F.lit("")))
    done = plain.unionByName(done.select(*plain.columns))
    return done.withColumn("final_name", final).select(*files.columns, "final_name")


def produced_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def index_table(docs: DataFrame) -> DataFrame:
    """Export of the index; the columns depend on whether any email is present.

    A probe that stops at the first email runs at once.
    """
    c = F.col
    if not docs.filter(c("kind") == "email").limit(1).isEmpty():
        titled = F.coalesce(filled(c("subject")), filled(c("title")), c("name"))
        picked = [("Date", c("date")), ("From", c("from")), ("To", c("to")), ("Subject", titled),
                  ("Type", c("doc_type")), ("Summary", c("summary")), ("File", c("path"))]
    else:
        picked = [("Name", c("name")), ("Type", F.coalesce(filled(c("doc_type")), c("ext"))), ("Date", c("date")),
                  ("Summary", c("summary")), ("File", c("path"))]
    return docs.select(*[blank(v).alias(n) for n, v in picked])


def relative_path(path: Column, roots: Sequence[str]) -> Column:
    """Path below the first listed root that holds it, led by the root's name.

    The list order decides, not the longest match. A file root, or no root at
    all, gives the bare file name.
    """
    out = F.regexp_extract(path, r"([^/]*)$", 1)
    bare = out
    for root in reversed([r.rstrip("/") for r in roots]):
        top = root.rsplit("/", 1)[-1]
        inside = F.concat(F.lit(top), F.substring(path, F.lit(len(root) + 1), F.length(path)))
        out = F.when(path == root, bare).when(F.startswith(path, F.lit(root + "/")), inside).otherwise(out)
    return out


def stale_outputs(listing: DataFrame, items: DataFrame) -> DataFrame:
    """Files under ``Documents`` this run does not account for.

    ``listing`` is ``(folder, name)``; ``items`` has ``folder`` and ``files``
    (NULL where the item predates file tracking). A folder with an untracked
    item is left alone; a folder no item owns is stale as a whole.
    """
    owned = items.select(F.lower("folder").alias("_f"), "files")
    state = owned.groupBy("_f").agg(F.max(F.col("files").isNull()).alias("_untracked"))
    allowed = owned.select("_f", F.explode("files").alias("_n")).select("_f", F.lower("_n").alias("_n")).distinct()
    rows = listing.withColumn("_f", F.lower("folder")).withColumn("_n", F.lower("name"))
    left = rows.join(allowed, ["_f", "_n"], "left_anti").join(state, "_f", "left")
    return left.filter(~F.coalesce("_untracked", F.lit(False))).select(
        "folder", "name", F.col("_untracked").isNull().alias("orphan_folder")
    )


def source_map(produced: DataFrame) -> DataFrame:
    """Produced file name to source fingerprint; of equal names the last wins.

    ``produced`` has ``ord, pdf_file, native_file, fp``.
    """
    both = produced.select("ord", F.col("pdf_file").alias("file"), "fp").unionByName(
        produced.filter(F.col("native_file").isNotNull()).select("ord", F.col("native_file").alias("file"), "fp")
    )
    return both.groupBy("file").agg(F.max_by("fp", "ord").alias("fp"))


def tree_counts(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Descendant files and folders of the given roots; dot entries are skipped.

    ``files`` has ``path``. A directory root is not counted itself; a file given
    as a root counts as one file. Roots are counted separately and added up.
    """
    total = None
    for root in [r.rstrip("/") for r in roots]:
        inside = files.filter((F.col("path") == root) | F.startswith("path", F.lit(root + "/")))
        parts = F.filter(F.split(F.substring("path", len(root) + 2, 1 << 20), "/"), lambda p: p != "")
        rows = inside.select("path", parts.alias("parts")).filter(
            ~F.exists("parts", lambda p: F.startswith(p, F.lit(".")))
        )
        folders = F.transform(
            F.filter(F.sequence(F.lit(0), F.size("parts")), lambda i: (i > 0) & (i < F.size("parts"))),
            lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"),
        )
        seen = rows.select(F.explode(folders).alias("d")).distinct()
        one = rows.agg(F.countDistinct("path").alias("files")).withColumn(
            "folders", seen.agg(F.count("*")).scalar()
        )
        total = one if total is None else total.unionByName(one)
    return total.agg(F.sum("files").alias("files"), F.sum("folders").alias("folders"))
