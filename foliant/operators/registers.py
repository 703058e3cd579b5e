"""Tables a reviewer asks for: renewals, chronology, clause matrix, amendments, privilege."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import blank, filled
from foliant.operators.redline import redline
from foliant.operators.scan import previous_row

FLAG_DAYS = 90


def renewal_register(terms: DataFrame, today: Column) -> DataFrame:
    """Cancel-by date of each contract, soonest first.

    ``terms`` has ``contract, next_renewal`` (date) and ``notice_days``. Rows
    without both are marked ``ambiguous`` and listed last; ``flag`` marks a
    cancel-by date within the next 90 days.
    """
    cancel = F.date_sub("next_renewal", F.col("notice_days"))
    rows = terms.withColumn("cancel_by", cancel).withColumn("ambiguous", F.col("cancel_by").isNull())
    days = F.datediff("cancel_by", today)
    return rows.withColumn("flag", F.coalesce(days.between(0, FLAG_DAYS), F.lit(False))).orderBy(
        F.asc_nulls_last("cancel_by"), "contract")


def next_renewal(start: Column, term_months: Column, today: Column) -> Column:
    """First anniversary of the term on or after ``today``."""
    passed = F.greatest(F.ceil(F.months_between(today, start) / term_months), F.lit(1)).cast("int")
    return F.add_months(start, passed * term_months)


# Month names in dates written out.
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
    "December",
)
_MONTH = "|".join(MONTHS)
_EDGE = r"(?<![0-9A-Za-z_])"
DATES = (
    rf"{_EDGE}((?:(?:about|circa|approximately|c\.) )?(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"
    rf"|[0-9]{{1,2}} (?:{_MONTH}) [0-9]{{4}}|(?:{_MONTH}) [0-9]{{1,2}}, [0-9]{{4}}|(?:{_MONTH}) [0-9]{{4}}))(?![0-9])"
)


def chronology(docs: DataFrame) -> DataFrame:
    """One row per dated line: ``date, shown, approximate, event, source, line_no``.

    ``docs`` has ``name, text``. Dates are ISO or written out; a month without a
    day, or a hedged date, is approximate and shown with ``~``.
    """
    lines = docs.select("name", F.posexplode(F.split("text", "\n")).alias("line_no", "event"))
    found = lines.select("*", F.explode(F.regexp_extract_all("event", F.lit(DATES), F.lit(1))).alias("raw"))
    bare = F.regexp_replace("raw", r"^(?:about|circa|approximately|c\.) ", "")
    rows = found.withColumn("_b", bare)
    tries = [("yyyy-MM-dd", F.col("_b")), ("d MMMM yyyy", F.col("_b")), ("MMMM d, yyyy", F.col("_b")),
             ("d MMMM yyyy", F.concat(F.lit("1 "), F.col("_b")))]
    day = F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt, s in tries]).cast("date")
    approx = (F.col("_b") != F.col("raw")) | F.col("_b").rlike(rf"^(?:{_MONTH}) [0-9]{{4}}$")
    out = rows.withColumn("date", day).withColumn("approximate", approx).filter(F.col("date").isNotNull())
    shown = F.concat(F.when(F.col("approximate"), "~").otherwise(""), F.date_format("date", "yyyy-MM-dd"))
    return out.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), shown.alias("shown"), "approximate", "event",
        F.col("name").alias("source"), F.col("line_no").cast("bigint").alias("line_no"),
    ).orderBy("date", "source", "line_no")


def undated(docs: DataFrame) -> DataFrame:
    """Documents without any date, for the list of gaps."""
    return docs.filter(F.size(F.regexp_extract_all("text", F.lit(DATES), F.lit(1))) == 0).select("name")


def clause_matrix(docs: DataFrame, topics: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per document, one column per topic with quote and section.

    A topic's cell is the first line that holds one of its keywords, led by the
    number of the section it stands in; silent documents get ``Not addressed``.
    Each row is worked on by itself, so no pivot shuffle is needed.
    """
    lines = F.split("text", "\n")
    number = r"^\s*(?:[Ss]ection\s+|§\s*)?([0-9]{1,3}(?:\.[0-9]+)*)[.):]?\s"

    def cell(words: Sequence[str]) -> Column:
        hit = F.filter(lines, lambda line: F.lower(line).rlike("|".join(w.lower() for w in words)))
        line = F.get(hit, F.lit(0))
        cite = filled(F.regexp_extract(line, number, 1))
        return F.coalesce(
            F.concat(F.coalesce(F.concat(F.lit("§"), cite, F.lit(": ")), F.lit("")), F.trim(line)), F.lit("Not addressed"))

    return docs.select("doc_id", *[cell(words).alias(topic) for topic, words in topics.items()])


def amendment_history(versions: DataFrame) -> DataFrame:
    """Redline of each version against the one before it.

    ``versions`` has ``family, version, text``. The text of the earlier version
    is found by an equality join on its number, so no family is collected.
    """
    keys = versions.select("family", "version")
    linked = previous_row(keys, ["family", "version"], ["family", "version"], "_p")
    linked = linked.filter(F.col("_p.family") == F.col("family")).select("family", "version", F.col("_p.version").alias("base"))
    old = versions.select("family", F.col("version").alias("base"), F.col("text").alias("old_text"))
    new = versions.select("family", "version", F.col("text").alias("new_text"))
    pairs = linked.join(old, ["family", "base"]).join(new, ["family", "version"])
    # Short texts are few bytes and much work: joined rows would be merged into a few tasks.
    pairs = pairs.repartition(4 * versions.sparkSession.sparkContext.defaultParallelism)
    return redline(pairs, ["family", "version", "base"])


def privilege_log(emails: DataFrame) -> DataFrame:
    """Log skeleton; the claim, its basis and the confidence stay blank for a lawyer."""
    c = F.col
    people = F.concat(blank(c("from")), F.lit(" → "), blank(c("to")))
    return emails.select(
        "doc_id", blank(c("date")).alias("date"), people.alias("author_recipients"),
        blank(c("subject")).alias("description"), F.lit("").alias("claim"), F.lit("").alias("basis"),
        F.lit("").alias("confidence"),
    )
