"""Text expressions: tokens, snippets, conversation keys and markup removal.

All of them are built-in Spark expressions, so they stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that never become search terms.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were",
    "be", "this", "that", "it", "as", "at", "by", "with", "from", "we", "you", "i", "he", "she",
)

# What counts as white space, as a Java character class body.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{WS}]"


def blank(col: Column) -> Column:
    """Absent values print as an empty string in every table output."""
    return F.coalesce(col.cast("string"), F.lit(""))


def filled(col: Column) -> Column:
    """The column, or NULL where it is empty."""
    return F.nullif(col, F.lit(""))


def trim_ws(col: Column) -> Column:
    return F.regexp_replace(col, f"^{S}+|{S}+$", "")


def squash_ws(col: Column) -> Column:
    """Collapse each run of white space to one space and trim."""
    return F.trim(F.regexp_replace(col, f"{S}+", " "))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    astral = F.length(F.regexp_replace(col, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(col) + astral


def tokenize(col: Column) -> Column:
    """Lower-case ASCII word tokens of 2 to 40 characters without stop words."""
    words = F.split(F.lower(col), "[^a-z0-9]+")
    return F.filter(
        words, lambda w: (F.length(w) >= 2) & (F.length(w) <= 40) & ~w.isin(*STOPWORDS)
    )


def query_terms(query: str) -> list[str]:
    """Distinct search terms of a query string, in first-seen order."""
    import re

    words = re.split("[^a-z0-9]+", query.lower())
    return list(dict.fromkeys(w for w in words if 2 <= len(w) <= 40 and w not in STOPWORDS))


def searchable_text(
    name: Column, subject: Column, sender: Column, to: Column, title: Column | None,
    highlights: Column, body: Column,
) -> Column:
    """Headers, marked passages and body joined by line breaks, blanks dropped.

    ``highlights`` is an array of passage texts. Pass ``title=None`` for the
    browser variant, which leaves the title out.
    """
    parts = [name, subject, sender, to]
    if title is not None:
        parts.append(title)
    parts += [F.array_join(highlights, "\n"), body]
    return F.concat_ws("\n", *[filled(p) for p in parts])


def snippet(text: Column, terms: Sequence[str]) -> Column:
    """220 characters around the earliest query term, with ellipses."""
    lower = F.lower(text)
    spots = [F.nullif(F.locate(t, lower), F.lit(0)) for t in terms]
    first = F.least(*spots) if len(spots) > 1 else spots[0]
    start = F.coalesce(F.greatest(F.lit(0), first - 61), F.lit(0))
    cut = squash_ws(F.substring(text, start + 1, F.lit(220)))
    found = F.concat(
        F.when(start > 0, "…").otherwise(""),
        cut,
        F.when(F.length(text) > start + 220, "…").otherwise(""),
    )
    return F.when(F.length(text) > 0, found).otherwise("")


def conversation_key(subject: Column, doc_id: Column, variant: str = "desktop") -> Column:
    """Subject without reply and forward prefixes; a blank one falls back to the id."""
    s = F.coalesce(subject, F.lit(""))
    if variant == "web":
        s = F.regexp_replace(s, f"(?i)^{S}*((re|fwd?|fw){S}*:{S}*)+", "")
        return F.coalesce(filled(F.lower(trim_ws(s))), doc_id.cast("string"))
    s = F.regexp_replace(s, f"(?i)^((re|fwd|fw|aw|tr){S}*:{S}*)+", "")
    return F.coalesce(filled(F.lower(squash_ws(s))), F.concat(F.lit("id:"), doc_id.cast("string")))


def _replace_all(col: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        col = F.regexp_replace(col, pattern, by)
    return col


# Tags whose end starts a new line, and the entities decoded.
_BLOCK_END = r"(?i)</(p|div|br|tr|li|h[1-6])>"
_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def html_to_text(html: Column, variant: str = "desktop") -> Column:
    """Readable text of an HTML body.

    ``desktop`` keeps line structure, ``web`` is the browser's email form and
    ``web_file`` its form for saved pages (everything on one line).
    """
    if variant == "web_file":
        bare = _replace_all(html, [
            (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"<[^>]+>", " "),
        ])
        return squash_ws(decode_xml_entities(bare))
    if variant == "web":
        bare = _replace_all(html, [
            (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "),
            (r"(?i)</(p|div|tr|li|h[1-6])>", "\n"), (rf"(?i)<br{S}*/?>", "\n"), (r"<[^>]+>", " "),
            *_ENTITIES, ("&quot;", '"'), ("&#39;", "'"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
        ])
        return trim_ws(bare)
    bare = _replace_all(html, [
        (r"(?is)<style.*?</style>", ""), (r"(?is)<script.*?</script>", ""),
        (_BLOCK_END, "\n"), (r"<[^>]+>", ""), *_ENTITIES, (r"\n{3,}", "\n\n"),
    ])
    return trim_ws(bare)


def decode_xml_entities(col: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def escape_html(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


# Footers removed from email bodies (device line, scan notices,
# confidentiality notices). Each is bounded so that it cannot run away.
_ANY_TAG = rf"(?:{S}|<[^>]+>)*"
_MAIL = r"This (?:e-?mail|message)"
_SCAN_END = r"(?:cloud service\.?|Symantec[^<.]*\.?)"
BOILERPLATE = (
    r"(?i)Sent from my [^<\n]{0,40}",
    rf"(?is)_{{6,}}{_ANY_TAG}{_MAIL} has been scanned by.{{0,200}}?{_SCAN_END}{_ANY_TAG}_{{6,}}",
    rf"(?is){_MAIL} has been scanned by.{{0,160}}?{_SCAN_END}",
    r"(?is)The information contained in this (?:message|e-?mail).{0,700}?"
    r"(?:\(IDSC\d+\)|delete the (?:message|e-?mail)\.?|strictly prohibited\.?)",
    rf"(?is){_MAIL}(?: and any (?:attachments?|files? transmitted with it))? (?:is|are) "
    r"(?:strictly )?(?:confidential|intended).{0,700}?"
    r"(?:delete.{0,80}?\.|prohibited\.?|notify the sender.{0,60}?\.)",
)


def strip_boilerplate(html: Column) -> Column:
    return _replace_all(html, [(p, "") for p in BOILERPLATE])


_EMPTY_DIV = rf"(?i)<div[^>]*>(?:{S}|&nbsp;|<br\b[^>]*/?>)*+</div>"
_BR_RUN = rf"(?i)(?:<br\b[^>]*/?>{S}*){{3,}}"


def tidy_blocks(html: Column, passes: int) -> Column:
    """Drop empty blocks (nested ones need several passes), shorten break runs."""
    return _replace_all(html, [(_EMPTY_DIV, "")] * passes + [(_BR_RUN, "<br><br>")])


def clean_body(html: Column, exclude_signatures: bool = False) -> Column:
    """Flatten document wrappers in an email body, tidy it, drop footers if asked."""
    flat = _replace_all(html, [(r"(?i)</?(?:html|head|body)[^>]*>", ""), (r"(?i)<meta\b[^>]*>", "")])
    flat = tidy_blocks(flat, 3)
    return tidy_blocks(strip_boilerplate(flat), 2) if exclude_signatures else flat


def strip_markdown(col: Column) -> Column:
    """Drop redline tags, bold marks, and a leading heading, quote or bullet mark."""
    return _replace_all(col, [
        (r"</?(?:ins|del)>", ""), (r"\*\*", ""), (rf"^#+{S}*", ""), (rf"^>{S}?", ""), (rf"^[-*]{S}+", "• "),
    ])


def path_id(path: Column) -> Column:
    """Short stable id of a path: a 32-bit multiply-and-add hash in base 36.

    Ids can collide, so tables are keyed by path; this is for output parity.
    Characters beyond the basic plane enter as their two UTF-16 units.
    """
    def add(h: Column, unit: Column) -> Column:
        return (h * 33 + unit).bitwiseAND(F.lit(0xFFFFFFFF))

    def step(h: Column, ch: Column) -> Column:
        cp = F.ascii(ch).cast("bigint")
        high = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10)
        low = F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(cp > 0xFFFF, add(add(h, high), low)).otherwise(add(h, cp))

    h = F.aggregate(F.split(path, ""), F.lit(5381).cast("bigint"), step)
    return F.concat(F.lit("d"), F.lower(F.conv(h.cast("string"), 10, 36)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


# From the last dot on; a dot at the head of a name starts no extension, nor does the last of two dots alone.
EXTENSION = r"(?:(?<=[^/])\.[^./]+|(?<=[^./])\.)$"


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; dot files and bare names have none."""
    return F.lower(F.regexp_extract(name, EXTENSION, 0))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, EXTENSION, "")


def address_list(addresses: Column, variant: str = "desktop") -> Column:
    return F.array_join(addresses, ", " if variant == "web" else "; ")


def iso_date(ts: Column) -> Column:
    return blank(F.date_format(ts, "yyyy-MM-dd"))
