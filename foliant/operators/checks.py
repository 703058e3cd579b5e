"""Deterministic checks on a text: defined terms, references, readiness, citations.

Every check works inside one row, on arrays taken from its own text, so a
corpus is checked without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import WS, S, trim_ws

# Word edges are spelled out, because \b differs between engines for letters
# beyond ASCII.
_B = r"(?<![0-9A-Za-z_])"
_E = r"(?![0-9A-Za-z_])"

# The forms of definitions, headings, references and placeholders.
_TERM = r"[\"“]([A-Z][0-9A-Za-z_ '’\-]{1,60}?)[\"”]"
DEF_MEANS = rf"{_TERM}{S}+(?:means{_E}|shall mean{_E}|refers to{_E}|has the meaning)"
DEF_PAREN = rf"\((?:the{S}+|each{S}+(?:an?{S}+)?|collectively,?{S}+|an?{S}+)?{_TERM}\)"
HEADING = rf"(?i)^{S}*(?:section{S}+|§{S}*|clause{S}+|article{S}+)?([0-9]{{1,3}})(?:\.[0-9]+)*[.):]?{S}+[^{WS}]"
# The first look at one character keeps the search fast on long texts.
_NUMBER = r"[0-9]{1,3}"
INLINE = rf"(?i)(?=[§sca])(?:§{S}*|{_B}(?:section{S}+|clause{S}+|article{S}+))({_NUMBER})(?:\.[0-9]+)*"
_CITE = (
    rf"(?=[§sScCaA])(?:§{S}*|{_B}(?i:sections?{S}+|sec\.?{S}+|clauses?{S}+|article{S}+))"
    rf"({_NUMBER}+(?:\.[0-9]++)*+)"
)
# A statute after the number makes the citation an external one.
_STATUTE = (
    rf"{S}*(?:\([0-9]+\){S}*)?(?:of{S}+the{S}+|,?{S}*)?"
    rf"(?:GDPR|CCPA|CPRA|UCC|DMCA|HIPAA|FCRA|COPPA|GLBA|TCPA|[A-Z][A-Za-z]+{S}+(?:Act|Regulation|Directive|Code))"
)
CITATION = rf"{_CITE}(?!{_STATUTE})"
EXHIBIT_REF = rf"(?=[ESA]){_B}((?:Exhibit|Schedule|Appendix|Annex){S}+(?:[A-Z]|[0-9]{{1,2}})){_E}"
EXHIBIT_HEAD = rf"(?im)^{S}*(?:Exhibit|Schedule|Appendix|Annex){S}+([A-Z]|[0-9]{{1,2}}){_E}"
PLACEHOLDERS = (
    rf"(\[{S}*_{{2,}}{S}*\])", r"(_{4,})",
    rf"(?i)(\[(?:DATE|NAME|ADDRESS|AMOUNT|TBD|INSERT[^\]]*|[•·]|{S}*)\])",
    rf"(?=T)({_B}TBD{_E})", rf"(?i)(?=t)({_B}TO BE (?:DETERMINED|COMPLETED|CONFIRMED){_E})",
)
SIGNATURE = (
    rf"(?i)(?=[ibnta_]){_B}(IN WITNESS WHEREOF|By:{S}|Name:{S}|Title:{S}|Authorized Signator|_{{6,}}{S}*\n{S}*(?:Name|Signature))"
)

_STRINGS = "array<string>"
_FINDING = "array<struct<category:string,severity:string,detail:string>>"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _finding(category: str, severity: str, detail: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), detail.alias("detail")
    )


def _none() -> Column:
    return F.array().cast(_FINDING)


def heading_sections(text: Column) -> Column:
    """Distinct heading numbers of a text."""
    numbers = F.transform(F.split(text, "\r?\n"), lambda line: F.regexp_extract(line, HEADING, 1))
    return F.array_distinct(F.transform(F.filter(numbers, lambda n: n != ""), lambda n: n.cast("int")))


def inline_sections(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, INLINE), lambda n: n.cast("int")))


def cited_sections(text: Column) -> Column:
    """Distinct citations as ``§4.2``, in order; statutes are left out."""
    return F.array_distinct(F.transform(_all(text, CITATION), lambda n: F.concat(F.lit("§"), n)))


def _top(cite: Column) -> Column:
    return F.regexp_extract(cite, "([0-9]+)", 1).cast("int")


def numbering_reliable(numbers: Column) -> Column:
    """At least two distinct numbers, and those from one up have no gap."""
    positive = F.filter(numbers, lambda n: n >= 1)
    return (F.size(numbers) >= 2) & (F.coalesce(F.array_max(positive), F.lit(0)) == F.size(positive))


def definitions(text: Column) -> Column:
    """Every definition in a text as its term; repeated terms stay repeated."""
    return F.transform(F.concat(_all(text, DEF_MEANS), _all(text, DEF_PAREN)), lambda t: trim_ws(t))


def occurrences(text: Column, term: Column) -> Column:
    """Number of places a term stands in a text, without overlaps."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return (gone / F.length(term)).cast("int")


def term_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, term, definitions, uses`` for every defined term."""
    rows = docs.select("doc_id", "text", definitions(F.col("text")).alias("defs"))
    rows = rows.select("doc_id", "text", "defs", F.explode(F.array_distinct("defs")).alias("term"))
    return rows.select(
        "doc_id", "term", (F.size("defs") - F.size(F.array_remove("defs", F.col("term")))).alias("definitions"),
        occurrences(F.col("text"), F.col("term")).alias("uses"),
    )


def _term_findings(text: Column, defs: Column) -> Column:
    def of(term: Column) -> Column:
        n = F.size(F.filter(defs, lambda d: d == term))
        twice = F.concat(F.lit('"'), term, F.lit('" is defined '), n.cast("string"),
                         F.lit(" times — consolidate to one definition to avoid conflicts."))
        idle = F.concat(F.lit('"'), term, F.lit('" is defined but never used — consider removing the definition.'))
        return F.concat(
            F.when(n > 1, F.array(_finding("Defined terms", "high", twice))).otherwise(_none()),
            F.when(occurrences(text, term) <= n, F.array(_finding("Defined terms", "low", idle))).otherwise(_none()),
        )

    return F.flatten(F.transform(F.array_distinct(defs), of))


def _reference_findings(cited: Column, headings: Column, refs: Column, heads: Column) -> Column:
    lost = F.when(
        numbering_reliable(headings), F.filter(cited, lambda s: ~F.array_contains(headings, _top(s)))
    ).otherwise(F.array().cast(_STRINGS))
    sections = F.transform(lost, lambda s: _finding(
        "Cross-references", "high",
        F.concat(F.lit("Reference to "), s, F.lit(" does not resolve to any section in this document."))))

    def missing(ref: Column) -> Column:
        kind, mark = F.regexp_extract(ref, "^([A-Za-z]+)", 1), F.regexp_extract(ref, "([A-Z]|[0-9]{1,2})$", 1)
        return _finding("Cross-references", "medium", F.concat(
            kind, F.lit(" "), mark, F.lit(" is referenced but no matching "), kind, F.lit(" heading was found.")))

    # The kind is always capitalised, so upper case does not merge two refs.
    plain = F.array_distinct(F.transform(refs, lambda r: F.regexp_replace(r, f"{S}+", " ")))
    open_refs = F.filter(plain, lambda r: ~F.array_contains(heads, F.upper(F.regexp_extract(r, "([A-Z]|[0-9]{1,2})$", 1))))
    exhibits = F.when(F.size(heads) > 0, F.transform(open_refs, missing)).otherwise(_none())
    return F.concat(sections, exhibits)


#: The report names so many placeholders and marks that there are more; ``placeholders`` gives them all.
SHOWN_PLACEHOLDERS = 8


def _readiness_findings(text: Column, blanks: Column) -> Column:
    shown = F.concat(
        F.lit("Unfilled placeholder(s) found: "), F.array_join(F.slice(blanks, 1, SHOWN_PLACEHOLDERS), ", "),
        F.when(F.size(blanks) > SHOWN_PLACEHOLDERS, " …").otherwise(""), F.lit("."),
    )
    unsigned = F.lit('No signature block detected (no "By:/Name:/Title:" or "IN WITNESS WHEREOF").')
    return F.concat(
        F.when(F.size(blanks) > 0, F.array(_finding("Execution readiness", "high", shown))).otherwise(_none()),
        F.when(~text.rlike(SIGNATURE), F.array(_finding("Execution readiness", "medium", unsigned))).otherwise(_none()),
    )


def placeholders(text: Column) -> Column:
    # A plain byte search first: most texts hold none of these.
    none = F.array().cast(_STRINGS)
    marks = ("[", "____", "[", "TBD", None)
    found = F.concat(*[
        F.when(F.contains(text, F.lit(m)) if m else F.contains(F.lower(text), F.lit("to be ")), _all(text, p)).otherwise(none)
        for m, p in zip(marks, PLACEHOLDERS)
    ])
    return F.array_distinct(F.transform(found, lambda b: trim_ws(b)))


def lint(docs: DataFrame) -> DataFrame:
    """One row per finding: ``doc_id, ord, category, severity, detail``.

    ``ord`` is the report order: by severity, then as found.
    """
    t = F.col("text")
    parts = docs.select(
        "doc_id", "text", definitions(t).alias("_defs"), cited_sections(t).alias("_cited"),
        heading_sections(t).alias("_heads"), _all(t, EXHIBIT_REF).alias("_refs"),
        F.array_distinct(F.transform(_all(t, EXHIBIT_HEAD), lambda x: F.upper(x))).alias("_exh"),
        placeholders(t).alias("_blanks"),
    )
    c = F.col
    found = parts.select("doc_id", F.concat(
        _term_findings(t, c("_defs")), _reference_findings(c("_cited"), c("_heads"), c("_refs"), c("_exh")),
        _readiness_findings(t, c("_blanks")),
    ).alias("f"))
    ranked = F.concat(*[F.filter("f", lambda x: x["severity"] == s) for s in _as_literals()])
    return found.select("doc_id", F.posexplode(ranked).alias("ord", "f")).select("doc_id", "ord", "f.*")


def _as_literals() -> list[Column]:
    return [F.lit(s) for s in ("high", "medium", "low")]


def _ordered_details(findings: DataFrame, line: Column) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return findings.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("lines")
    )


def lint_reports(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Report text and footer per document."""
    plain = F.concat(F.lit("- ["), F.upper("severity"), F.lit("] "), "category", F.lit(": "), "detail")
    rich = F.concat(F.lit("- **"), F.upper("severity"), F.lit("** · "), "category", F.lit(": "), "detail")
    a = _ordered_details(findings, plain).select("doc_id", "n", F.col("lines").alias("plain"))
    b = _ordered_details(findings, rich).select("doc_id", F.col("lines").alias("rich"))
    head = (
        "\n\n---\n### Automated document checks\n_Deterministic checks (not AI) — defined terms, internal "
        "cross-references, and execution readiness:_\n"
    )
    return docs.select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left").select(
        "doc_id",
        F.coalesce(
            F.concat(F.col("n").cast("string"), F.lit(" issue(s) found:\n"), "plain"),
            F.lit("No defined-term, cross-reference, or execution-readiness issues found."),
        ).alias("report"),
        F.coalesce(F.concat(F.lit(head), "rich"), F.lit("")).alias("footer"),
    )


def verify_citations(pairs: DataFrame) -> DataFrame:
    """Add ``cited`` and ``unverified`` for ``deliverable`` against ``source``.

    A citation is unverified when its number is in no heading or inline
    reference of the source, and the source's headings are numbered reliably.
    """
    known = pairs.withColumns({
        "_h": heading_sections(F.col("source")), "_i": inline_sections(F.col("source")),
        "cited": cited_sections(F.col("deliverable")),
    })
    missing = F.filter("cited", lambda s: ~F.array_contains(F.array_union("_h", "_i"), _top(s)))
    out = F.when(numbering_reliable(F.col("_h")), missing).otherwise(F.array().cast(_STRINGS))
    return known.withColumn("unverified", out).drop("_h", "_i")


def verify_against_sources(deliverables: DataFrame, sources: DataFrame) -> DataFrame:
    """As :func:`verify_citations`, with all sources of a matter taken together.

    ``deliverables`` is ``(matter, deliverable)``, ``sources`` ``(matter, text)``
    with any number of rows. Section numbers have at most three digits, so a
    matter's sets hold at most a thousand numbers and no texts are put together.
    """
    found = sources.select("matter", heading_sections(F.col("text")).alias("h"), inline_sections(F.col("text")).alias("i"))
    numbers = found.select("matter", F.explode("h").alias("n"), F.lit(True).alias("head")).unionByName(
        found.select("matter", F.explode("i").alias("n"), F.lit(False).alias("head")))
    sets = numbers.groupBy("matter", "n").agg(F.max("head").alias("head")).groupBy("matter").agg(
        F.collect_set("n").alias("_all"), F.collect_set(F.when(F.col("head"), F.col("n"))).alias("_h"))
    none = F.array().cast("array<int>")
    rows = deliverables.withColumn("cited", cited_sections(F.col("deliverable"))).join(sets, "matter", "left")
    rows = rows.withColumn("_all", F.coalesce("_all", none)).withColumn("_h", F.coalesce("_h", none))
    missing = F.filter("cited", lambda s: ~F.array_contains(F.col("_all"), _top(s)))
    out = F.when(numbering_reliable(F.col("_h")), missing).otherwise(F.array().cast(_STRINGS))
    return rows.withColumn("unverified", out).drop("_all", "_h")


def citation_footer(cited: Column, unverified: Column) -> Column:
    n, bad = F.size(cited), F.size(unverified)
    others = n - bad
    them = F.when(bad > 1, "them").otherwise("it")
    flagged = F.concat(
        F.lit("\n\n---\n> ⚠️ **Automated citation check:** "), F.array_join(unverified, ", "),
        F.lit(" could not be found in the source document and may be inaccurate — verify before relying on "),
        them, F.lit("."),
        F.when(others > 0, F.concat(
            F.lit(" The other "), others.cast("string"), F.lit(" cited reference(s) matched the source."))).otherwise(""),
    )
    fine = F.concat(
        F.lit("\n\n---\n> ✓ **Automated citation check:** all "), n.cast("string"),
        F.lit(" cited section references were found in the source document."))
    return F.when(n == 0, "").when(bad > 0, flagged).otherwise(fine)
