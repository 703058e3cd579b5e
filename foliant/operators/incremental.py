"""What has to be done again between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.hashing import HASH_VERSION
from foliant.functions.names import bates_label
from foliant.operators.scan import running_sum


def change_set(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current files marked ``reused``, ``changed`` or ``new`` against the last run.

    Both have ``path, mtime, size``; ``previous`` also ``text_chars``. A file
    without text is read again every time.
    """
    prev = previous.select(
        "path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("text_chars").alias("_t")
    )
    same = F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s"))
    status = (
        F.when(F.col("_m").isNull() & F.col("_s").isNull(), "new")
        .when(same & (F.coalesce("_t", F.lit(0)) > 0), "reused").otherwise("changed")
    )
    return current.join(prev, "path", "left").withColumn("status", status).drop("_m", "_s", "_t")


def vanished(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current, "path", "left_anti")


def refresh_table(old: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Old rows of untouched documents plus the new rows.

    ``touched`` lists every key that changed or vanished; their old rows go
    first, so no stale posting survives.
    """
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(fresh)


def changed_decisions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Contents present in exactly one of two decision sets (``sha`` columns)."""
    a = previous.select("sha").distinct().withColumn("_a", F.lit(True))
    b = current.select("sha").distinct().withColumn("_b", F.lit(True))
    return a.join(b, "sha", "full").filter(F.col("_a").isNull() | F.col("_b").isNull()).select("sha")


def decision_shas(decisions: DataFrame) -> DataFrame:
    """Every content some decision is about."""
    some = F.col("in_exclude") | F.col("in_logo") | F.col("in_keep")
    return decisions.filter(some).select("sha").distinct()


def affected_documents(att: DataFrame, changed: DataFrame) -> DataFrame:
    """Documents that carry an attachment whose decision changed."""
    return att.join(changed, "sha", "left_semi").select("doc_id").distinct()


def config_key(settings: Column) -> Column:
    """A short key of the set-wide settings; a new key voids the whole manifest."""
    return F.sha2(F.to_json(settings), 256)


def plan_reuse(
    targets: DataFrame, manifest: DataFrame, affected: DataFrame, outputs: DataFrame, config: Column | None = None
) -> DataFrame:
    """Add ``reuse``: the family can stay as it is.

    ``config`` is the key of this run's settings (:func:`config_key`); rows of
    the manifest with another key in their ``config`` column are void.

    ``manifest`` has ``doc_id, mtime, size, file_rel, family_span, beg_bates``;
    ``outputs`` the ``file_rel`` that exist.
    """
    if config is not None:
        manifest = manifest.filter(F.col("config") == config)
    prev = manifest.join(outputs.select("file_rel").distinct().withColumn("_out", F.lit(True)), "file_rel", "left")
    prev = prev.select(
        "doc_id", F.col("mtime").alias("_m"), F.col("size").alias("_s"), "_out",
        F.col("family_span").alias("prev_span"), F.col("beg_bates").alias("prev_beg"),
    )
    hit = affected.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    rows = targets.join(prev, "doc_id", "left").join(hit, "doc_id", "left")
    same = (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))
    reuse = F.coalesce(same & F.col("_out"), F.lit(False)) & F.col("_hit").isNull()
    return rows.withColumn("reuse", reuse).drop("_m", "_s", "_out", "_hit")


def drifted_families(plans: DataFrame, prefix: str = "DOC-", start: int = 1) -> DataFrame:
    """Add ``planned_beg`` and ``drifted``: reusable, but its number moved.

    ``plans`` has ``position, reuse, prev_span, prev_beg, new_span``.
    """
    span = F.when(F.col("reuse"), F.coalesce("prev_span", F.lit(0))).otherwise(F.coalesce("new_span", F.lit(0)))
    numbered = running_sum(plans, ["position", "doc_id"], span.cast("bigint"), "_before")
    planned = bates_label(F.col("_before") + start, prefix)
    return (
        numbered.withColumn("planned_beg", planned)
        .withColumn("drifted", F.col("reuse") & (F.col("prev_beg") != F.col("planned_beg")))
        .drop("_before")
    )


def removed_families(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    return manifest.join(targets, "doc_id", "left_anti")


def reusable_hashes(cache: DataFrame, docs: DataFrame, need_dhash: bool) -> DataFrame:
    """Cached attachment hashes that are still valid, as ``(doc_id)`` rows.

    ``cache`` has ``doc_id, mtime, size, perceptual, version`` per document.
    """
    now = docs.select("doc_id", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    valid = (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))
    if need_dhash:
        valid = valid & F.col("perceptual") & (F.col("version") == HASH_VERSION)
    return cache.join(now, "doc_id").filter(valid).select("doc_id")


def merge_enrichment(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Fill type, summary and parties by id; unmatched documents stay as they are."""
    if "error" in found.columns:
        found = found.filter(F.col("error").isNull())
    new = found.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("doc_type", "summary", "parties")], F.lit(True).alias("_hit"))
    out = docs.join(new, "doc_id", "left")
    for c in ("doc_type", "summary", "parties"):
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.drop("_hit", "_doc_type", "_summary", "_parties")


def enrich(docs: DataFrame, label, batch_size: int = 5, excerpt: int | None = None) -> DataFrame:
    """Run a user-supplied labelling function over documents without a summary.

    ``label`` gets a list of dicts (id, name, kind, subject, from, to, excerpt)
    and returns dicts with id, docType, summary and parties. The whole text goes
    in unless ``excerpt`` cuts it (the desktop sends 1,500 characters). A batch that fails
    gives its documents rows with the error noted, which a merge passes over.
    Result: ``doc_id, doc_type, summary, parties, error``.
    """
    pending = docs.filter(F.coalesce("summary", F.lit("")) == "").select(
        "doc_id", "name", "kind", "subject", "from", "to", (F.col("head") if excerpt is None else F.substring("head", 1, excerpt)).alias("excerpt")
    )

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for at in range(0, len(frame), batch_size):
                items = frame.iloc[at:at + batch_size].rename(columns={"doc_id": "id"}).to_dict("records")
                try:
                    known = {i["id"] for i in items}
                    rows += [
                        (r["id"], r.get("docType"), r.get("summary"), list(r.get("parties") or []), None)
                        for r in label(items) if r.get("id") in known
                    ]
                except Exception as e:  # best effort: the batch stays without labels
                    rows += [(i["id"], None, None, None, str(e)) for i in items]
            yield pd.DataFrame(rows, columns=["doc_id", "doc_type", "summary", "parties", "error"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return pending.mapInPandas(run, f"doc_id {id_type}, doc_type string, summary string, parties array<string>, error string")


_REPLY = "array<struct<id:string,docType:string,summary:string,parties:array<string>>>"


def parse_reply(raw: Column) -> Column:
    """Rows in a reply text: what lies between the first ``[`` and the last ``]``."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), _REPLY)


def parse_replies(replies: DataFrame, raw_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """``(rows, malformed)`` of a table of replies.

    ``rows`` has the reply's columns and ``doc_id, doc_type, summary, parties``,
    one row for each entry with an id; of entries with one id in a reply the
    last counts. ``malformed`` has the replies without a list that can be read,
    with ``reason`` ("no list" or "not json"). Both come from one parse, and a
    malformed reply does not disturb the others.
    """
    keep = [c for c in replies.columns if c != raw_col]
    raw = F.coalesce(F.col(raw_col), F.lit(""))
    parsed = replies.withColumn("_list", F.regexp_extract(raw, r"(?s)\[.*\]", 0)).withColumn("_rows", F.from_json("_list", _REPLY))
    bad = F.col("_rows").isNull()
    entries = parsed.filter(~bad).select(*keep, F.posexplode("_rows").alias("_at", "_r")).filter(F.col("_r.id").isNotNull())
    last = entries.groupBy(*keep, F.col("_r.id").alias("doc_id")).agg(F.max_by("_r", "_at").alias("_r"))
    rows = last.select(*keep, "doc_id", F.col("_r.docType").alias("doc_type"), "_r.summary", "_r.parties")
    reason = F.when(F.col("_list") == "", "no list").otherwise("not json")
    return rows, parsed.filter(bad).select(*keep, raw_col, reason.alias("reason"))
