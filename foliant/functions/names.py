"""File names, attachment pointers and page labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import EXTENSION, filled, stem, trim_ws

PAD = 6


def bates_label(number: Column, prefix: str) -> Column:
    """Prefix plus the number padded to six digits; longer numbers stay whole."""
    # The formatter is slow, so it is left to what is not a plain number.
    digits = F.when(number >= 10 ** PAD, number.cast("string")).when(number >= 0, F.lpad(number.cast("string"), PAD, "0"))
    return F.concat(F.lit(prefix), digits.otherwise(F.format_string(f"%0{PAD}d", number)))


def fingerprint(name: Column, size: Column) -> Column:
    """Pointer to an attachment: trimmed lower-case name and size."""
    return F.concat_ws("|", F.lower(trim_ws(name)), size.cast("string"))


def fingerprint_name(fp: Column) -> Column:
    return F.regexp_extract(fp, r"(?s)^(.*)\|(\d+)$", 1)


def fingerprint_size(fp: Column) -> Column:
    return F.regexp_extract(fp, r"\|(\d+)$", 1).try_cast("bigint")


def safe_name(name: Column, max_chars: int | None = None) -> Column:
    """Characters a file system may refuse become ``_``.

    ``max_chars`` cuts longer names (200 is the desktop's number); cut names
    can be equal and lose their extension, so there is no cut by default.
    """
    cleaned = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    if max_chars is not None:
        cleaned = F.substring(cleaned, 1, max_chars)
    return F.coalesce(filled(cleaned), F.lit("attachment"))


def _ext(name: Column) -> Column:
    return F.regexp_extract(name, EXTENSION, 0)


def decorate_name(name: Column, size: Column, dhash: Column) -> Column:
    """``name (N bytes, dh=HASH).ext``, the shape used for set-aside copies."""
    return F.concat(
        stem(name), F.lit(" ("), size.cast("string"), F.lit(" bytes, dh="),
        F.coalesce(dhash, F.lit("none")), F.lit(")"), _ext(name),
    )


def undecorate_name(name: Column, prefix: str = "") -> Column:
    """Original name of a produced or set-aside copy."""
    if prefix:
        name = F.regexp_replace(name, "^" + re.sub(r"(\W)", r"\\\1", prefix) + r"\d+ - ", "")
    return F.regexp_replace(name, r"^(.*) \(\d+ bytes(?:, dh=[^)]*)?\)(\.[^.]*)$", "$1$2")


def bates_name(bates: Column, base: Column) -> Column:
    return F.when(bates != "", F.concat(bates, F.lit(" - "), base)).otherwise(base)


def pdf_name(base: Column) -> Column:
    return F.when(base.rlike(r"(?i)\.pdf$"), base).otherwise(F.concat(base, F.lit(".pdf")))


def single_pdf_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)(\.pdf)\.pdf$", "$1")


def attachment_pdf_name(name: Column) -> Column:
    return F.concat(safe_name(stem(name)), F.lit(".pdf"))


def restore_dir(source: Column) -> Column:
    """Folder under ``Documents`` where a restored attachment lands."""
    norm = F.regexp_replace(source, r"\\", "/")
    return F.concat(F.lit("Documents/"), F.regexp_replace(stem(norm), r"^\./", ""))


# Document type labels by extension (browser variant).
TYPE_BY_EXT = {
    ".pdf": "PDF", ".docx": "Word", ".doc": "Word", ".rtf": "Word",
    ".xlsx": "Spreadsheet", ".xls": "Spreadsheet", ".csv": "Spreadsheet", ".tsv": "Spreadsheet",
    ".pptx": "Presentation", ".ppsx": "Presentation", ".ppt": "Presentation",
    ".jpg": "Image", ".jpeg": "Image", ".png": "Image", ".gif": "Image", ".bmp": "Image",
    ".tif": "Image", ".tiff": "Image",
    ".txt": "Text", ".md": "Text", ".log": "Text", ".eml": "Email", ".msg": "Email",
}


def doc_type(kind: Column, explicit: Column) -> Column:
    """An explicit type, else Email or Document."""
    return F.coalesce(filled(explicit), F.when(kind == "email", "Email").otherwise("Document"))


def doc_type_web(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    labels = F.create_map(*[F.lit(x) for pair in TYPE_BY_EXT.items() for x in pair])
    return F.coalesce(
        F.try_element_at(labels, ext), filled(F.upper(F.substring(ext, F.lit(2), F.length(ext)))), F.lit("Document")
    )


def is_image_name(name: Column) -> Column:
    """Browser variant: an image is known by its extension, not its MIME type."""
    return name.rlike(r"(?i)\.(jpe?g|png|gif|bmp|tiff?)$")
