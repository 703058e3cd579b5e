"""Email files as rows: headers and body, and one row per attachment."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.functions.hashing import content_sha


def _fields(block: str) -> dict[str, str]:
    """Header fields; folded lines are joined, the first of equal names wins."""
    flat = re.sub(r"\r?\n[ \t]+", " ", block)
    fields: dict[str, str] = {}
    for line in re.split(r"\r?\n", flat):
        name, colon, value = line.partition(":")
        if colon and name:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def _halves(raw: str) -> tuple[str, str]:
    gap = "\r\n\r\n" if "\r\n\r\n" in raw else "\n\n"
    head, _, body = raw.partition(gap)
    return head, body


def _decoded(body: str, encoding: str) -> str:
    if encoding.lower() == "quoted-printable":
        soft = re.sub(r"=\r?\n", "", body)
        return re.sub("=([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), soft)
    if encoding.lower() == "base64":
        packed = re.sub(r"[^A-Za-z0-9+/]", "", body)
        packed = packed[: len(packed) - (len(packed) % 4 == 1)]
        return base64.b64decode(packed + "=" * (-len(packed) % 4)).decode("utf-8", "replace")
    return body


def _parts(fields: dict[str, str], body: str) -> Iterator[tuple[dict[str, str], str]]:
    bound = re.search(r'boundary="?([^";]+)"?', fields.get("content-type", ""), re.I)
    if not bound:
        return
    for piece in body.split("--" + bound[1]):
        if "\n\n" in piece or "\r\n\r\n" in piece:
            head, inner = _halves(piece)
            yield _fields(head), inner


def _one(path: str, content: bytes) -> tuple:
    """(path, from, to, cc, date, subject, body, html flag, error) of a message."""
    head, body = _halves(content.decode("latin-1"))
    f = _fields(head)
    ctype = f.get("content-type", "")
    chosen, html = "", False
    if re.search(r'boundary="?([^";]+)"?', ctype, re.I):
        plain = rich = ""
        for pf, inner in _parts(f, body):
            kind = pf.get("content-type", "")
            value = _decoded(inner, pf.get("content-transfer-encoding", ""))
            if re.search("text/plain", kind, re.I) and not plain:
                plain = value
            elif re.search("text/html", kind, re.I) and not rich:
                rich = value
        chosen, html = (plain, False) if plain.strip() else (rich, True)
    else:
        chosen = _decoded(body, f.get("content-transfer-encoding", ""))
        html = bool(re.search("text/html", ctype, re.I))
    return (path, f.get("from", ""), f.get("to", ""), f.get("cc", ""), f.get("date", ""), f.get("subject", ""), chosen, html, "")


def parse_emails(files: DataFrame) -> DataFrame:
    """``path, from, to, cc, date, subject, body, error`` of ``path, content`` rows.

    Plain text is preferred; HTML bodies are turned into text by Spark after
    the bytes are parsed. A file that cannot be read keeps its row, with the
    error noted.
    """
    schema = "path string, `from` string, `to` string, cc string, date string, subject string, body string, html boolean, error string"

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                try:
                    rows.append(_one(path, bytes(content)))
                except Exception as e:  # one bad file does not stop the run
                    rows.append((path, "", "", "", "", "", "", False, str(e)))
            yield pd.DataFrame(
                rows, columns=["path", "from", "to", "cc", "date", "subject", "body", "html", "error"])

    out = files.select("path", "content").mapInPandas(run, schema)
    body = F.when(F.col("html"), text.html_to_text(F.col("body"))).otherwise(text.trim_ws(F.col("body")))
    return out.withColumn("body", body).drop("html")


ATTACHMENTS = (
    "path string, att_idx int, filename string, mime string, content_id string, disposition string, content binary, error string"
)


def _leaves(part) -> Iterator:
    """The parts of a message that are not containers; an attached message is one part, not its own parts."""
    if part.get_content_type() == "message/rfc822" or not part.is_multipart():
        yield part
    else:
        for p in part.get_payload():
            yield from _leaves(p)


def _content(part) -> bytes:
    if part.get_content_type() == "message/rfc822":
        return part.get_payload(0).as_bytes()
    return part.get_payload(decode=True) or b""


def _caching_policy():
    """The default policy, which parses a header at every access; here equal headers are parsed once while they are remembered."""
    from email.headerregistry import HeaderRegistry
    from email.policy import EmailPolicy
    from functools import lru_cache

    return EmailPolicy(header_factory=lru_cache(maxsize=4096)(HeaderRegistry()))


def parse_attachments(files: DataFrame) -> DataFrame:
    """One row per attached part of each message, empty ones left out.

    A message that cannot be read gives one row without content, with the error
    noted. An attached message is kept whole.
    """

    def run(frames):
        import email

        import pandas as pd

        policy = _caching_policy()
        names = ["path", "att_idx", "filename", "mime", "content_id", "disposition", "content", "error"]
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                # Without a single content type, in whatever part, the message is plain text and nothing is attached.
                if content is not None and b"content-type" not in bytes(content).lower():
                    continue
                try:
                    msg = email.message_from_bytes(bytes(content), policy=policy)
                    parts = [
                        p for p in _leaves(msg)
                        if p is not msg and (p.get_filename() or p.get_content_maintype() not in ("text", "multipart"))
                    ]
                    for i, p in enumerate(parts):
                        data = _content(p)
                        if data:
                            rows.append((
                                path, i, p.get_filename() or "", p.get_content_type(),
                                str(p.get("Content-ID") or "").strip().strip("<>"),
                                p.get_content_disposition() or "", data, None))
                except Exception as e:  # one bad file does not stop the run
                    rows.append((path, None, "", "", "", "", None, str(e)))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, ATTACHMENTS)


def attachment_rows(parts: DataFrame) -> DataFrame:
    """Hash and normalise attachment parts that have content."""
    rows = parts.filter(F.length("content") > 0)
    return rows.select(
        *[c for c in parts.columns if c != "content"],
        F.lower(text.trim_ws(F.col("filename"))).alias("name"), F.length("content").cast("bigint").alias("size"),
        F.startswith("mime", F.lit("image/")).alias("img"), content_sha(F.col("content")).alias("sha"), "content",
    )


def header_fields(raw: Column) -> Column:
    """Header-only fast path: a map of field names to values, without Python."""
    head = F.regexp_replace(F.regexp_extract(raw, r"(?s)^(.*?)(?:\r?\n\r?\n|$)", 1), r"\r?\n[ \t]+", " ")
    pairs = F.filter(
        F.transform(F.split(head, "\r?\n"), lambda s: F.struct(
            F.lower(text.trim_ws(F.substring_index(s, ":", 1))).alias("k"),
            text.trim_ws(F.regexp_replace(s, "^[^:]*:", "")).alias("v"), F.contains(s, F.lit(":")).alias("ok"))),
        lambda p: p["ok"] & (p["k"] != ""),
    )
    first = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
        lambda p: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == p["i"] + 1,
    )
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))


def resolve_inline(refs: DataFrame, atts: DataFrame) -> DataFrame:
    """Attachment behind each ``cid:`` reference of a body.

    ``refs`` is ``(path, ref_no, cid)``, ``atts`` ``(path, att_idx, content_id)``.
    Content ids decide; references and attachments left over are paired by
    position. Adds ``att_idx`` (NULL where nothing is left).
    """
    from pyspark.sql import Window as W

    known = atts.filter(F.col("content_id") != "").groupBy("path", F.col("content_id").alias("cid")).agg(
        F.max("att_idx").alias("att_idx"))
    by_id = refs.join(known, ["path", "cid"], "left")
    open_refs = by_id.filter(F.col("att_idx").isNull()).drop("att_idx")
    used = refs.select("path", F.col("cid").alias("content_id")).distinct()
    spare = atts.join(used, ["path", "content_id"], "left_anti")
    # One message's references and parts; a message is parsed in one task anyway.
    a = open_refs.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy("ref_no")))
    b = spare.select("path", "att_idx", F.row_number().over(W.partitionBy("path").orderBy("att_idx")).alias("_n"))
    by_place = a.join(b, ["path", "_n"], "left").drop("_n")
    return by_id.filter(F.col("att_idx").isNotNull()).unionByName(by_place)


def cid_references(html: Column) -> Column:
    """Distinct content ids a body refers to, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)cid:([^\"'\\s)>]+)"), F.lit(1)))


# Fixed value: the transparent pixel that replaces an excluded picture.
PIXEL = "data:image/gif;base64,R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7"


def strip_data_uri(body: Column, content: Column) -> Column:
    """Replace embedded copies of ``content`` by a pixel.

    Where no ``data:`` stands within 64 characters before the payload, only the
    payload goes.
    """
    payload = F.regexp_replace(F.base64(content), r"\s", "")
    # Cut at the payload: each piece but the last ends with the data: lead.
    pieces = F.split(F.replace(body, payload, F.lit("\u0000")), "\u0000")
    lead = r"(?s)data:(?:(?!data:).){0,59}$"
    last = F.size(pieces) - 1
    joined = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i < last, F.regexp_replace(p, lead, PIXEL)).otherwise(p)), "")
    return F.when(F.length(content) > 0, joined).otherwise(body)


def drop_inline_images(body: Column, cid: Column) -> Column:
    """Remove an excluded picture from a body: its tag, then any bare reference."""
    tag = F.concat(F.lit(r"(?i)<img[^>]*cid:\Q"), cid, F.lit(r"\E[^>]*>"))
    return F.replace(F.regexp_replace(body, tag, F.lit("")), F.concat(F.lit("cid:"), cid), F.lit(PIXEL))
