"""The registered queries: each maps an operator onto the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import hashing, names, text
from foliant.operators import exclusions as ex
from foliant.operators import incremental as inc
from foliant.operators import production as prod
from foliant.operators import search, segments, similarity
from foliant.plans import views as v
from foliant.session import settle, work_path
from foliant.sources import snapshots

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def c(name: str):
    return F.col(name)


# -- search ------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOK = f"""tok AS (
  SELECT doc_id, source AS collection, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
    lambda w: length(w) BETWEEN 2 AND 40 AND NOT list_contains([{STOP}], w)) AS tokens FROM documents),
post AS (SELECT doc_id, collection, term, count(*) AS tf FROM
  (SELECT doc_id, collection, unnest(tokens) AS term FROM tok) GROUP BY ALL)"""

SEARCH_FOR = "anat tion, nicht retion the para"
TERMS = ", ".join(f"'{t}'" for t in text.query_terms(SEARCH_FOR))


def bm25_sql(part: str = "") -> str:
    by = f"{part}," if part else ""
    on = f"USING ({part})" if part else "ON true"
    return f"""WITH {TOK}, hit AS (SELECT * FROM post WHERE term IN ({TERMS})),
st AS (SELECT {by} count(*) AS n, avg(len(tokens)) AS a FROM tok {'GROUP BY ' + part if part else ''}),
dfr AS (SELECT {by} term, count(*) AS df FROM hit GROUP BY ALL),
sc AS (SELECT hit.collection, hit.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5)
    / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / a))) AS score
  FROM hit JOIN dfr USING ({by} term) JOIN tok ON tok.doc_id = hit.doc_id
  JOIN st {'ON st.' + part + ' = hit.' + part if part else on} GROUP BY ALL)"""


@query("posting_lists", f"WITH {TOK} SELECT doc_id, term, tf::BIGINT AS tf FROM post")
def posting_lists(spark, sf):
    return search.postings(v.corpus(spark, sf)).select("doc_id", "term", "tf")


@query("document_lengths", f"WITH {TOK} SELECT doc_id, len(tokens)::BIGINT AS dl FROM tok")
def document_lengths(spark, sf):
    return search.doc_lengths(v.corpus(spark, sf))


@query("document_frequency", f"WITH {TOK} SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term")
def document_frequency(spark, sf):
    return search.document_frequency(search.postings(v.corpus(spark, sf)))


@query("corpus_statistics", f"WITH {TOK} SELECT count(*)::BIGINT AS n_docs, round(avg(len(tokens)), 6) AS avg_dl FROM tok")
def corpus_statistics(spark, sf):
    return search.corpus_stats(search.doc_lengths(v.corpus(spark, sf))).select(
        "n_docs", F.round("avg_dl", 6).alias("avg_dl")
    )


SPOT = "least(" + ", ".join(f"nullif(instr(lower(h), '{t}'), 0)" for t in text.query_terms(SEARCH_FOR)) + ")"


@query("bm25_search", bm25_sql() + f""", top AS (SELECT * FROM sc ORDER BY round(score, 9) DESC, doc_id LIMIT 50),
sn AS (SELECT doc_id, text AS h FROM documents),
sp AS (SELECT doc_id, h, coalesce(greatest(0, {SPOT} - 61), 0) AS s FROM sn)
SELECT top.doc_id, d.lang, round(score, 6) AS score,
  (CASE WHEN s > 0 THEN '…' ELSE '' END) || trim(regexp_replace(substr(h, (s + 1)::BIGINT, 220), '\\s+', ' ', 'g'))
  || (CASE WHEN length(h) > s + 220 THEN '…' ELSE '' END) AS snippet
FROM top JOIN sp USING (doc_id) JOIN documents d USING (doc_id)""")
def bm25_search(spark, sf):
    docs = v.corpus(spark, sf)
    index, lengths = search.query_index(docs, SEARCH_FOR)
    # The texts of the best hits alone are read again, where they lie.
    bodies = search.snippet_sources(v.table(spark, sf, "documents"))
    hits = search.search_collection(index, lengths, bodies, docs.drop("text"), SEARCH_FOR)
    return hits.select("doc_id", "lang", F.round("score", 6).alias("score"), "snippet")


@query("bm25_without_index", bm25_sql() + """
SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, doc_id LIMIT 50""")
def bm25_without_index(spark, sf):
    return search.search_texts(v.corpus(spark, sf), SEARCH_FOR).select("doc_id", F.round("score", 6).alias("score"))


@query("stored_index_search", bm25_sql() + """
SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY round(score, 9) DESC, doc_id LIMIT 50""")
def stored_index_search(spark, sf):
    """Save the index of the corpus as a snapshot, sorted by term, and search the stored tables."""
    docs, root = v.corpus(spark, sf), work_path(spark, "library")
    tables = {"postings": search.postings(docs), "lengths": search.doc_lengths(docs)}
    snapshots.save_snapshot(root, "vault", tables, {"postings": ["term", "doc_id"]})
    stored = [snapshots.load_snapshot(spark, root, "vault", t) for t in ("postings", "lengths")]
    return search.bm25(*stored, SEARCH_FOR).select("doc_id", F.round("score", 6).alias("score"))


@query("search_library", bm25_sql("collection") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY round(score, 9) DESC, doc_id) AS p FROM sc)
SELECT collection, doc_id, round(score, 6) AS score FROM r WHERE p <= 20
ORDER BY round(r.score, 9) DESC, collection, doc_id LIMIT 20""")
def search_library(spark, sf):
    index, lengths = search.query_index(v.corpus(spark, sf), SEARCH_FOR, ("collection", "doc_id"))
    return search.search_library(index, lengths, SEARCH_FOR).select(
        "collection", "doc_id", F.round("score", 6).alias("score")
    )


CORPUS = """corpus AS (SELECT doc_id, text, lang, source AS collection, 'doc-' || doc_id || '.txt' AS name,
  concat_ws('/', '/vault', source, lang, 'doc-' || doc_id || '.txt') AS path FROM documents)"""


@query("find_files", f"WITH {CORPUS} SELECT path, name FROM corpus WHERE contains(lower(name), '-1') ORDER BY path")
def find_files(spark, sf):
    files = v.corpus(spark, sf).select("path", "name", F.lit(False).alias("is_dir"))
    return search.find_files(files, "-1").select("path", "name")


@query("find_in_files", f"""WITH {CORPUS} SELECT path, name, CASE WHEN contains(name, '77') THEN 'filename' ELSE 'content' END AS match
FROM corpus WHERE contains(name, '77') OR contains(lower(text), '77')""")
def find_in_files(spark, sf):
    return search.find_in_files(v.corpus(spark, sf).withColumn("depth", F.lit(2)), "77")


@query("searchable_text", f"""WITH {CORPUS} SELECT doc_id, md5(concat_ws(chr(10), name,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Re ' || collection END, 'a@x.example', lang, 'doc-' || doc_id,
  CASE WHEN doc_id % 2 = 0 THEN 'mark one' || chr(10) || 'mark two' END, nullif(text, ''))) AS digest FROM corpus""")
def searchable_text(spark, sf):
    docs = v.corpus(spark, sf)
    marks = F.when(c("doc_id") % 2 == 0, F.array(F.lit("mark one"), F.lit("mark two"))).otherwise(
        F.array().cast("array<string>"))
    joined = text.searchable_text(
        c("name"), F.when(c("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Re "), "collection")),
        F.lit("a@x.example"), c("lang"), text.stem(c("name")), marks, c("text"),
    )
    return docs.select("doc_id", F.md5(joined).alias("digest"))


@query("searchable_text_web", f"""WITH {CORPUS} SELECT doc_id, md5(concat_ws(chr(10), name, 'a@x.example', lang, nullif(text, ''))) AS digest FROM corpus""")
def searchable_text_web(spark, sf):
    """The browser leaves the title out."""
    docs = v.corpus(spark, sf)
    joined = text.searchable_text(
        c("name"), F.lit(""), F.lit("a@x.example"), c("lang"), None, F.array().cast("array<string>"), c("text"))
    return docs.select("doc_id", F.md5(joined).alias("digest"))


@query("text_digests", "SELECT doc_id, length(text)::BIGINT AS text_chars, md5(text) AS digest FROM documents")
def text_digests(spark, sf):
    bodies = search.snippet_sources(v.corpus(spark, sf))
    return bodies.select("doc_id", F.length("body").cast("bigint").alias("text_chars"), F.md5("body").alias("digest"))


@query("document_skeleton", f"""WITH {CORPUS}, f AS (SELECT CASE WHEN doc_id % 4 = 0 THEN replace(path, '.txt', '.EML') ELSE path END AS path FROM corpus),
n AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM f)
SELECT path, name, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext,
  CASE WHEN name LIKE '%.EML' THEN 'email' ELSE 'doc' END AS kind,
  CASE WHEN name LIKE '%.EML' THEN '' ELSE replace(name, '.txt', '') END AS title,
  'd' || lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(path, ''), lambda x: unicode(x)::BIGINT)),
    lambda h, x: (h * 33 + x) % 4294967296), 36)) AS id FROM n""")
def document_skeleton(spark, sf):
    from foliant.sources.files import skeleton

    files = v.corpus(spark, sf).select(
        F.when(c("doc_id") % 4 == 0, F.replace("path", F.lit(".txt"), F.lit(".EML"))).otherwise(c("path")).alias("path"))
    return skeleton(files).select("path", "name", "ext", "kind", text.blank(c("title")).alias("title"), "id")


# -- families and numbering ----------------------------------------------------

EMAILS = """emails AS (SELECT o_orderkey AS doc_id, o_custkey AS conv,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE (['', 'RE: ', 'Fwd: re :', 'AW: Tr:'])[(o_orderkey % 4 + 1)::INT] || 'Account  ' || o_custkey END AS subject,
  'clerk' || (o_orderkey % 7) || '@a.example' AS sender, 'c' || o_custkey || '@b.example' AS recipient,
  strftime(o_orderdate, '%Y-%m-%d') AS date, (1 + o_orderkey % 3)::BIGINT AS pages FROM orders),
convs AS (SELECT *, CASE WHEN subject = '' THEN 'id:' || doc_id ELSE 'account ' || conv END AS ckey FROM emails)"""

RECORDS = EMAILS + """,
rec0 AS (
  SELECT doc_id AS family, 0 AS child, NULL::BIGINT AS part_id, NULL::BIGINT AS supp_id, NULL::TIMESTAMP AS ship,
    NULL::DOUBLE AS qty, NULL::DOUBLE AS price, NULL::DOUBLE AS disc, NULL::DOUBLE AS tax, NULL::VARCHAR AS rf, NULL::VARCHAR AS ls,
    pages AS span, subject, 'Email' AS doc_type, date, sender, recipient, 'Documents/' || doc_id || '.pdf' AS file_rel FROM emails
  UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
    CASE WHEN l_partkey % 37 = 0 THEN 0 ELSE l_quantity END::BIGINT, 'part ' || l_partkey, 'Attachment',
    strftime(l_shipdate, '%Y-%m-%d'), '', '', 'Documents/' || l_orderkey || '/' || l_partkey || '.pdf' FROM lineitem),
rec1 AS (SELECT *, coalesce(sum(span) OVER (ORDER BY family, child, part_id, supp_id, ship, qty, price, disc, tax, rf, ls
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM rec0),
rec AS (SELECT *, before + 1 AS beg_no, before + span AS end_no,
    CASE WHEN span > 0 THEN 'DOC-' || printf('%06d', before + 1) ELSE '' END AS beg_bates,
    CASE WHEN span > 0 THEN 'DOC-' || printf('%06d', before + span) ELSE '' END AS end_bates FROM rec1)"""

FAM = RECORDS + """,
fam AS (SELECT family, max(CASE WHEN child = 0 THEN beg_bates END) AS beg_attach,
   arg_max(end_bates, before) FILTER (WHERE span > 0) AS end_attach FROM rec GROUP BY family)"""


def numbered(spark, sf, families: bool = False) -> DataFrame:
    return prod.number_records(v.family_records(spark, sf), v.RECORD_ORDER, families=families)


@query("conversation_keys", f"""WITH {EMAILS} SELECT doc_id, ckey AS desktop,
  CASE WHEN subject = '' THEN doc_id::VARCHAR WHEN doc_id % 4 = 3 THEN 'aw: tr:account  ' || conv ELSE 'account  ' || conv END AS web FROM convs""")
def conversation_keys(spark, sf):
    return v.emails(spark, sf).select(
        "doc_id", text.conversation_key(c("subject"), c("doc_id")).alias("desktop"),
        text.conversation_key(c("subject"), c("doc_id"), "web").alias("web"),
    )


@query("bates_numbering", f"""WITH {RECORDS} SELECT family, child::BIGINT AS child, coalesce(part_id, -1) AS part_id, coalesce(supp_id, -1) AS supp_id,
  beg_no, end_no, beg_bates, end_bates FROM rec""")
def bates_numbering(spark, sf):
    return numbered(spark, sf).select(
        "family", c("child").cast("bigint").alias("child"), F.coalesce("part_id", F.lit(-1)).alias("part_id"),
        F.coalesce("supp_id", F.lit(-1)).alias("supp_id"), "beg_no", "end_no", "beg_bates", "end_bates",
    )


@query("family_ranges", f"WITH {FAM} SELECT family, child::BIGINT AS child, beg_bates, beg_attach, end_attach FROM rec JOIN fam USING (family)")
def family_ranges(spark, sf):
    return prod.family_ranges(numbered(spark, sf, families=True)).select(
        "family", c("child").cast("bigint").alias("child"), "beg_bates", "beg_attach", "end_attach")


@query("family_ranges_web", f"""WITH {RECORDS}, kid AS (SELECT family, arg_min(beg_bates, before) AS b, arg_max(end_bates, before) AS e
  FROM rec WHERE child > 0 AND span > 0 GROUP BY family)
SELECT family, beg_bates, coalesce(CASE WHEN child = 0 THEN b END, '') AS beg_attach, coalesce(CASE WHEN child = 0 THEN e END, '') AS end_attach
FROM rec LEFT JOIN kid USING (family) WHERE span > 0""")
def family_ranges_web(spark, sf):
    # The browser numbers only what it renders.
    return prod.family_ranges_web(numbered(spark, sf, families=True).filter(c("span") > 0)).select(
        "family", "beg_bates", "beg_attach", "end_attach")


@query("family_spans", f"WITH {RECORDS} SELECT family, sum(span)::BIGINT AS family_span FROM rec0 GROUP BY family")
def family_spans(spark, sf):
    return prod.family_spans(v.family_records(spark, sf))


@query("bates_range", f"""WITH {RECORDS} SELECT 'DOC-000001' AS begin, 'DOC-' || printf('%06d', max(before + span)) AS end FROM rec""")
def bates_range(spark, sf):
    return prod.bates_range(numbered(spark, sf))


@query("production_order", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 7919) % 100003 END AS prior FROM documents)
SELECT doc_id, (row_number() OVER (ORDER BY coalesce(prior, 9223372036854775807), doc_id::VARCHAR, doc_id) - 1)::BIGINT AS position FROM d""")
def production_order(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", c("doc_id").cast("string").alias("path"))
    prior = docs.filter(c("doc_id") % 3 != 0).select("doc_id", ((c("doc_id") * 7919) % 100003).alias("prior_position"))
    return prod.production_order(docs, prior).select("doc_id", "position")


@query("production_scope", """SELECT doc_id, kind FROM (SELECT doc_id, 'doc' AS kind FROM documents UNION ALL SELECT o_orderkey, 'email' FROM orders)
WHERE kind = 'email'""")
def production_scope(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", F.lit("doc").alias("kind")).unionByName(
        v.emails(spark, sf).select("doc_id", F.lit("email").alias("kind")))
    return prod.production_scope(docs, email_to_pdf=True, review_index=False, load_file=False)


def full_records(spark, sf) -> DataFrame:
    """Numbered records with every column of the review tables; failed ones produce no row."""
    rows = prod.family_ranges(numbered(spark, sf, families=True).filter(c("span") > 0))
    rows = prod.over_families(rows, {"kids": F.count(F.when(c("child") > 0, 1))})
    native = c("part_id") % 5 == 0
    return rows.withColumns({
        "att_count": F.when(c("child") == 0, c("kids")).otherwise(0),
        "cc": F.lit(""), "att_names": F.lit(""),
        "native_rel": F.when(native, F.replace("file_rel", F.lit(".pdf"), F.lit(".xls"))),
    })


FULL = FAM + """,
kids AS (SELECT family, count(*) AS n FROM rec WHERE child > 0 AND span > 0 GROUP BY family),
full_rec AS (SELECT rec.*, beg_attach, end_attach, CASE WHEN child = 0 THEN coalesce(n, 0) ELSE 0 END AS att_count,
   CASE WHEN part_id % 5 = 0 THEN replace(file_rel, '.pdf', '.xls') ELSE '' END AS native_rel
 FROM rec JOIN fam USING (family) LEFT JOIN kids USING (family) WHERE span > 0)"""


@query("review_index", f"""WITH {FULL} SELECT beg_bates AS "Beginning Bates", end_bates AS "Ending Bates", span::VARCHAR AS "Pages", date AS "Date",
 doc_type AS "Type", sender AS "From", recipient AS "To", subject AS "Subject / Title", file_rel AS "File",
 CASE WHEN att_count > 0 THEN att_count::VARCHAR ELSE '' END AS "# Attachments" FROM full_rec""")
def review_index(spark, sf):
    return prod.review_index(full_records(spark, sf))


LOADED = """beg_bates AS "BEGBATES", end_bates AS "ENDBATES", beg_attach AS "BEGATTACH", end_attach AS "ENDATTACH", '{cust}' AS "CUSTODIAN",
 date AS "DATE SENT", sender AS "FROM", recipient AS "TO", '' AS "CC", subject AS "SUBJECT", doc_type AS "DOC TYPE", file_rel AS "FILE NAME",
 native_rel AS "NATIVELINK", span::VARCHAR AS "PAGE COUNT", '' AS "ATTACHMENT NAMES" """


@query("load_file", f"WITH {FULL} SELECT {LOADED.format(cust='')} FROM full_rec")
def load_file(spark, sf):
    return prod.load_file(full_records(spark, sf))


@query("load_file_web", f"""WITH {FULL}, k AS (SELECT family, arg_min(beg_bates, before) AS b, arg_max(end_bates, before) AS e FROM rec
  WHERE child > 0 AND span > 0 GROUP BY family)
SELECT {LOADED.format(cust='Smith matter').replace('beg_attach AS', "coalesce(CASE WHEN child = 0 THEN b END, '') AS").replace('end_attach AS', "coalesce(CASE WHEN child = 0 THEN e END, '') AS")}
FROM full_rec LEFT JOIN k USING (family)""")
def load_file_web(spark, sf):
    rows = prod.family_ranges_web(full_records(spark, sf).drop("beg_attach", "end_attach"))
    return prod.load_file(rows, custodian="Smith matter", variant="web")


# Emails stand in the folders of their customers; every 40th cannot be read and takes no number.
BATCH = EMAILS + f""", em AS (SELECT *, 'Mailbox/' || conv || '/' || doc_id || '.eml' AS path FROM convs WHERE doc_id % 40 <> 3),
an AS (SELECT l_orderkey AS doc_id, count(*) AS n, string_agg('part ' || l_partkey || '.pdf', '; ' ORDER BY {', '.join(v.ATT_ORDER)}) AS names FROM lineitem GROUP BY l_orderkey),
bt AS (SELECT em.*, coalesce(n, 0) AS att_count, coalesce(names, '') AS att_names, replace(path, '.eml', '.pdf') AS file_rel,
  coalesce(sum(pages) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS beg_no FROM em LEFT JOIN an USING (doc_id)),
full_rec AS (SELECT *, 'DOC-' || printf('%06d', beg_no) AS beg_bates, 'DOC-' || printf('%06d', beg_no + pages - 1) AS end_bates, pages AS span FROM bt)"""


def batch_parts(spark, sf):
    path = lambda conv, doc: F.concat(F.lit("Mailbox/"), conv.cast("string"), F.lit("/"), doc.cast("string"), F.lit(".eml"))
    mails = v.emails(spark, sf).filter(c("doc_id") % 40 != 3).withColumn("path", path(c("conv"), c("doc_id"))).withColumns({
        "cc": F.lit(""), "file_rel": F.replace("path", F.lit(".eml"), F.lit(".pdf"))})
    owner = mails.select("doc_id", "path")
    atts = v.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "doc_id").withColumn("l_orderkey", c("doc_id")).select(
        "doc_id", F.struct(*v.ATT_ORDER).alias("ord"), F.concat(F.lit("part "), c("l_partkey").cast("string"), F.lit(".pdf")).alias("name"))
    return mails, atts.join(owner, "doc_id").select("path", "name", "ord")


@query("email_batch_index", f"""WITH {BATCH} SELECT beg_bates AS "Beginning Bates", end_bates AS "Ending Bates", span::VARCHAR AS "Pages", date AS "Date",
 sender AS "From", recipient AS "To", subject AS "Subject", att_count::VARCHAR AS "# Attachments", att_names AS "Attachments" FROM full_rec""")
def email_batch_index(spark, sf):
    return prod.batch_index(prod.number_emails(*batch_parts(spark, sf)))


@query("email_batch_counts", f"""WITH {BATCH} SELECT (SELECT count(*) FROM documents)::BIGINT AS skipped, count(*)::BIGINT AS converted, sum(att_count)::BIGINT AS attachments FROM bt""")
def email_batch_counts(spark, sf):
    mails, atts = batch_parts(spark, sf)
    files = mails.select("path").unionByName(v.table(spark, sf, "documents").select(F.concat(F.lit("Mailbox/"), c("doc_id").cast("string"), F.lit(".txt")).alias("path")))
    return prod.email_batch_counts(files, mails, atts)


@query("email_batch_load_file", f"""WITH {BATCH} SELECT beg_bates AS "BEGBATES", end_bates AS "ENDBATES", beg_bates AS "BEGATTACH", end_bates AS "ENDATTACH",
 '' AS "CUSTODIAN", date AS "DATE SENT", sender AS "FROM", recipient AS "TO", '' AS "CC", subject AS "SUBJECT", file_rel AS "FILE NAME",
 span::VARCHAR AS "PAGE COUNT", att_names AS "ATTACHMENT NAMES" FROM full_rec""")
def email_batch_load_file(spark, sf):
    return prod.load_file(prod.number_emails(*batch_parts(spark, sf)).withColumn("native_rel", F.lit("")).withColumn("doc_type", F.lit("")), email_batch=True)


@query("opticon_rows", f"""WITH {FULL}, p AS (SELECT *, unnest(range(span)) AS page FROM full_rec)
SELECT 'DOC-' || printf('%06d', beg_no + page) AS page_id, '' AS volume, replace(file_rel, '/', chr(92)) AS image,
 CASE WHEN page = 0 THEN 'Y' ELSE '' END AS doc_break, '' AS folder_break, '' AS box_break,
 CASE WHEN page = 0 THEN span::VARCHAR ELSE '' END AS page_count FROM p""")
def opticon_rows(spark, sf):
    return prod.opticon_rows(numbered(spark, sf), "DOC-").drop("page")


@query("production_counters", f"""WITH {RECORDS}, f AS (SELECT family, count(*) FILTER (WHERE span > 0) AS records, family % 4 <> 0 AS reused,
  family % 50 = 7 AS failed, family % 9 AS slips FROM rec0 GROUP BY family)
SELECT count(*) FILTER (WHERE NOT failed AND NOT reused)::BIGINT AS processed, count(*) FILTER (WHERE NOT failed AND reused)::BIGINT AS skipped,
 (sum(CASE WHEN reused THEN 1 ELSE records END) FILTER (WHERE NOT failed))::BIGINT AS pdf_count,
 (sum(slips) FILTER (WHERE NOT failed AND NOT reused))::BIGINT AS slip_sheets, count(*) FILTER (WHERE failed)::BIGINT AS errors,
 (SELECT count(*) FROM documents WHERE doc_id % 17 = 0)::BIGINT AS removed, (SELECT count(*) FROM lineitem WHERE l_extendedprice < 3072)::BIGINT AS excluded
FROM f""")
def production_counters(spark, sf):
    families = v.family_records(spark, sf).groupBy("family").agg(F.count_if(c("span") > 0).alias("records")).select(
        "records", (c("family") % 4 != 0).alias("reused"), (c("family") % 50 == 7).alias("failed"),
        (c("family") % 9).alias("slip_sheets"))
    removed = v.table(spark, sf, "documents").filter(c("doc_id") % 17 == 0)
    tiny = v.table(spark, sf, "lineitem").filter(c("l_extendedprice") < 3072)
    return prod.production_counters(families, removed, tiny, record_counts=False)


CLUSTERS = """s AS (SELECT lower(p_name) AS name, floor(l_extendedprice)::BIGINT AS size, count(*) AS copies FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
g AS (SELECT *, CASE WHEN size - lag(size) OVER (PARTITION BY name ORDER BY size) <= greatest(256, floor(size * 0.02)) THEN 0 ELSE 1 END AS f FROM s),
k AS (SELECT *, sum(f) OVER (PARTITION BY name ORDER BY size) AS k FROM g)"""


@query("size_clusters", f"""WITH {CLUSTERS} SELECT name, min(size) AS low, max(size) AS high, sum(copies)::BIGINT AS copies FROM k GROUP BY name, k""")
def size_clusters(spark, sf):
    return prod.size_clusters(v.attachments(spark, sf))


@query("excluded_summary", f"""WITH {CLUSTERS}, n AS (SELECT name, sum(copies) AS c, max(k) AS m FROM k GROUP BY name)
SELECT sum(c)::BIGINT AS total, count(*) FILTER (WHERE m > 1)::BIGINT AS inconsistent_names FROM n""")
def excluded_summary(spark, sf):
    return prod.excluded_summary(v.attachments(spark, sf))


@query("index_table", """SELECT * FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS "Date", 'clerk' || (o_orderkey % 7) || '@a.example' AS "From",
 'c' || o_custkey || '@b.example' AS "To", CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey || '.eml' ELSE
  (['', 'RE: ', 'Fwd: re :', 'AW: Tr:'])[(o_orderkey % 4 + 1)::INT] || 'Account  ' || o_custkey END AS "Subject", '' AS "Type", '' AS "Summary", '/mail/' || o_orderkey || '.eml' AS "File" FROM orders
 UNION ALL SELECT '', '', '', doc_id || '.txt', source, '', '/docs/' || doc_id || '.txt' FROM documents)""")
def index_table(spark, sf):
    mails = v.emails(spark, sf).select(
        "date", "from", "to", "subject", F.lit(None).cast("string").alias("title"), F.lit("email").alias("kind"),
        F.concat(c("doc_id").cast("string"), F.lit(".eml")).alias("name"), F.lit(None).cast("string").alias("doc_type"))
    none = F.lit(None).cast("string")
    docs = v.table(spark, sf, "documents").select(
        none.alias("date"), none.alias("from"), none.alias("to"), none.alias("subject"), none.alias("title"),
        F.lit("doc").alias("kind"), F.concat(c("doc_id").cast("string"), F.lit(".txt")).alias("name"), c("source").alias("doc_type"))
    root = F.when(c("kind") == "email", "/mail/").otherwise("/docs/")
    both = mails.unionByName(docs).withColumns({"path": F.concat(root, "name"), "summary": none, "ext": text.extension(c("name"))})
    return prod.index_table(both)


@query("claimed_names", """WITH a AS (SELECT p_partkey AS k, p_brand AS folder, repeat('_', (p_size % 5)::INT) ||
  (CASE WHEN p_partkey % 3 = 0 THEN 'image001.png' ELSE upper(p_name[1:1]) || p_name[2:] END) AS name FROM part),
q AS (SELECT folder, ltrim(lower(name), '_') AS bare, list(length(name) - length(ltrim(name, '_')) ORDER BY k) AS us, list(k ORDER BY k) AS ks FROM a GROUP BY ALL),
-- The queue in order: each name takes the smallest free slot from its own underscores on.
s AS (SELECT ks, list_reduce(list_transform(us, lambda u: [u]), lambda taken, u:
  list_append(taken, list_filter(range(u[1], u[1] + len(taken) + 1), lambda x: NOT list_contains(taken, x))[1]), []::BIGINT[]) AS slots FROM q)
SELECT a.k, a.folder, repeat('_', (slot - (length(name) - length(ltrim(name, '_'))))::INT) || name AS final_name
FROM a JOIN (SELECT unnest(ks) AS k, unnest(slots) AS slot FROM s) t ON t.k = a.k""")
def claimed_names(spark, sf):
    name = F.when(c("p_partkey") % 3 == 0, "image001.png").otherwise(
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")))
    files = v.table(spark, sf, "part").select(
        c("p_partkey").alias("k"), c("p_brand").alias("folder"), F.concat(F.repeat(F.lit("_"), c("p_size") % 5), name).alias("name"))
    return prod.claim_names(files, ["k"]).select("k", "folder", "final_name")


# -- exclusions ----------------------------------------------------------------

ORD = ", ".join(v.ATT_ORDER)
ATT = f"""att AS (SELECT l_orderkey AS doc_id, o_custkey AS conv, lower(p_name) AS name, floor(l_extendedprice)::BIGINT AS size,
  l_partkey || '-' || l_suppkey AS sha, l_partkey % 2 = 0 AS img, l_linenumber = 1 AS inline, l_partkey AS part_id,
  CASE WHEN l_partkey % 2 = 0 THEN substr(md5((l_partkey % 400)::VARCHAR), 1, 15) || substr('0123456789abcdef', (l_suppkey % 16 + 1)::BIGINT, 1) END AS dhash,
  row_number() OVER (ORDER BY {ORD}) AS ord
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""
LOGOS = ATT + """,
small AS (SELECT * FROM att WHERE img AND dhash IS NOT NULL AND size <= 153600),
looks AS (SELECT dhash, count(DISTINCT conv) AS convs FROM small GROUP BY dhash),
shas AS (SELECT sha, count(DISTINCT conv) AS convs, arg_min(img, ord) AS img, arg_min(size, ord) AS size, arg_min(name, ord) AS name, arg_min(dhash, ord) AS dhash FROM att GROUP BY sha),
logo AS (SELECT sha FROM shas WHERE convs >= 3 AND img AND size <= 153600
  UNION SELECT sha FROM small JOIN looks USING (dhash) WHERE convs >= 3)"""


def near(a: str, b: str) -> str:
    return f"bit_count(xor(('0x' || {a})::UBIGINT, ('0x' || {b})::UBIGINT))"


RULE_NAME = "blue bolt"
DECIDE = LOGOS + f""",
xn AS (SELECT * FROM att WHERE name || '|' || size IN (SELECT name || '|' || size FROM att WHERE part_id = 6) OR name = '{RULE_NAME}' AND doc_id % 1 = 0),
xs AS (SELECT sha FROM xn UNION SELECT a.sha FROM (SELECT DISTINCT sha, dhash FROM att WHERE dhash IS NOT NULL) a
  SEMI JOIN (SELECT DISTINCT dhash FROM xn WHERE dhash IS NOT NULL) r ON {near('a.dhash', 'r.dhash')} <= 8),
kn AS (SELECT * FROM att WHERE name || '|' || size IN (SELECT name || '|' || size FROM att WHERE part_id IN (8, 9))),
ks AS (SELECT sha FROM kn UNION SELECT a.sha FROM (SELECT DISTINCT sha, dhash FROM att WHERE dhash IS NOT NULL) a
  SEMI JOIN (SELECT DISTINCT dhash FROM kn WHERE dhash IS NOT NULL) r ON {near('a.dhash', 'r.dhash')} <= 8),
dec AS (SELECT sha, bool_or(x) AND NOT bool_or(k) AS in_exclude, bool_or(l) AND NOT bool_or(k) AS in_logo, bool_or(k) AS in_keep FROM
 (SELECT sha, true AS x, false AS l, false AS k FROM xs UNION ALL SELECT sha, false, true, false FROM logo UNION ALL SELECT sha, false, false, true FROM ks) GROUP BY sha),
flag AS (SELECT att.*, coalesce(in_exclude, false) AS x, coalesce(in_logo, false) AS l, coalesce(in_keep, false) AS k FROM att LEFT JOIN dec USING (sha))"""


def hashed(spark, sf) -> DataFrame:
    """Attachment rows written once: the rules below read them several times."""
    return settle(v.attachments(spark, sf).drop("pages"))


def rules_of(att: DataFrame) -> ex.Rules:
    """The user's rules of the sample queries: pointers to the files of three parts, as tables."""
    picked = att.select("part_id", names.fingerprint(c("name"), c("size")).alias("fp"))
    return ex.Rules(
        exclude_signatures=True, exclude_pointers=picked.filter(c("part_id") == 6).select("fp").distinct(),
        keep_pointers=picked.filter(c("part_id").isin(8, 9)).select("fp").distinct(), exclude_names=(RULE_NAME.upper() + " ",),
        keep_names=("Hot Gear",),
    )


@query("recurrence_by_content", f"WITH {ATT} SELECT sha, count(DISTINCT conv)::BIGINT AS convs FROM att GROUP BY sha")
def recurrence_by_content(spark, sf):
    return ex.recurrence_by_content(v.attachments(spark, sf))


@query("recurrence_by_look", f"WITH {LOGOS} SELECT dhash, convs::BIGINT AS convs FROM looks")
def recurrence_by_look(spark, sf):
    return ex.recurrence_by_look(v.attachments(spark, sf)).select(hashing.long_to_hex(c("dhash")).alias("dhash"), "convs")


@query("auto_logos", f"WITH {LOGOS} SELECT sha FROM logo")
def auto_logos(spark, sf):
    return ex.auto_logos(hashed(spark, sf))


@query("exclusion_decisions", f"WITH {DECIDE} SELECT * FROM dec")
def exclusion_decisions(spark, sf):
    att = hashed(spark, sf)
    return ex.decide(att, rules_of(att))


@query("pointer_matches", f"WITH {DECIDE} SELECT DISTINCT doc_id, sha, name, size FROM kn")
def pointer_matches(spark, sf):
    att = v.attachments(spark, sf)
    return ex.matching_pointers(att, rules_of(att).keep_pointers).select("doc_id", "sha", "name", "size").distinct()


@query("preview_excluded", f"WITH {DECIDE} SELECT DISTINCT name || '|' || size AS fp FROM flag WHERE (x OR l) AND NOT k AND name <> 'hot gear'")
def preview_excluded(spark, sf):
    att = hashed(spark, sf)
    rules = rules_of(att)
    return ex.preview_excluded(att, ex.decide(att, rules), rules)


@query("preview_kept", f"WITH {DECIDE} SELECT DISTINCT name || '|' || size AS fp FROM flag WHERE k OR name = 'hot gear'")
def preview_kept(spark, sf):
    att = hashed(spark, sf)
    rules = rules_of(att)
    return ex.preview_kept(att, ex.decide(att, rules), rules)


DISPO = DECIDE + """,
dispo AS (SELECT *, k OR name = 'hot gear' AS kept,
 CASE WHEN inline AND img AND NOT (k OR name = 'hot gear') AND x THEN 'inline_excluded'
  WHEN inline AND img AND NOT (k OR name = 'hot gear') AND l THEN 'inline_dropped' WHEN inline AND img THEN 'embedded'
  WHEN NOT (k OR name = 'hot gear') AND (x OR l OR size BETWEEN 1 AND 3071) THEN 'excluded' ELSE 'produced' END AS disposition FROM flag)"""


def disposed(spark, sf):
    att = hashed(spark, sf)
    rules = rules_of(att)
    return ex.dispositions(att, ex.decide(att, rules), rules)


@query("attachment_dispositions", f"WITH {DISPO} SELECT doc_id, sha, name, size, kept, disposition FROM dispo")
def attachment_dispositions(spark, sf):
    return disposed(spark, sf).select("doc_id", "sha", "name", "size", "kept", "disposition")


@query("decision_report", f"""WITH {DECIDE}, r AS (SELECT s.*, coalesce(in_exclude, false) AS x, coalesce(in_logo, false) AS l, coalesce(in_keep, false) AS k,
  greatest(s.convs, coalesce(looks.convs, 0)) AS recur FROM shas s LEFT JOIN looks USING (dhash) LEFT JOIN dec ON dec.sha = s.sha)
SELECT name, size, substr(sha, 1, 12) AS sha_short, coalesce(dhash, 'none') AS dhash, recur::BIGINT AS conversations,
 CASE WHEN k THEN 'kept' WHEN x OR l OR size BETWEEN 1 AND 3071 THEN 'excluded' ELSE 'produced' END AS decision,
 CASE WHEN k THEN 'restored / keep rule (overrides all exclusions)' WHEN x THEN 'manual exclude rule'
  WHEN l THEN 'recurring logo — appears in ' || recur || ' conversations (>= 3)' WHEN size BETWEEN 1 AND 3071 THEN 'under 3 KB'
  WHEN NOT img THEN 'not an image (only exact-copy or manual rules apply)'
  WHEN dhash IS NULL THEN 'no similarity key — low-entropy/undecodable image; only exact-copy recurrence can catch it'
  WHEN size > 153600 THEN 'image larger than 150 KB — too big to treat as a logo'
  WHEN recur < 3 THEN 'recurs in only ' || recur || ' conversation(s) — needs >= 3 to be auto-flagged' ELSE 'kept as content' END AS reason FROM r""")
def decision_report(spark, sf):
    att = hashed(spark, sf)
    rules = rules_of(att)
    return ex.sorted_report(ex.decision_report(att, ex.decide(att, rules), rules))


@query("small_attachments", f"WITH {ATT} SELECT doc_id, sha, size FROM att WHERE size > 0 AND size < 3072")
def small_attachments(spark, sf):
    return v.attachments(spark, sf).filter(ex.is_small(c("size"))).select("doc_id", "sha", "size")


@query("fingerprints", f"WITH {ATT} SELECT DISTINCT name || '|' || size AS fp, name AS fp_name, size AS fp_size FROM att")
def fingerprints(spark, sf):
    fp = v.attachments(spark, sf).select(names.fingerprint(c("name"), c("size")).alias("fp")).distinct()
    return fp.select("fp", names.fingerprint_name(c("fp")).alias("fp_name"), names.fingerprint_size(c("fp")).alias("fp_size"))


@query("near_references", f"""WITH {ATT}, d AS (SELECT DISTINCT dhash FROM att WHERE dhash IS NOT NULL), r AS (SELECT DISTINCT dhash FROM att WHERE part_id % 100 = 4)
SELECT dhash FROM d SEMI JOIN r ON {near('d.dhash', 'r.dhash')} <= 8""")
def near_references(spark, sf):
    att = v.attachments(spark, sf)
    h = att.select(c("dhash").alias("hash"), "part_id")
    return similarity.near_references(h, h.filter(c("part_id") % 100 == 4)).select(hashing.long_to_hex(c("hash")).alias("dhash"))


@query("auto_flags_web", f"""WITH {ATT}, sh AS (SELECT DISTINCT sha, conv FROM att), lk AS (SELECT DISTINCT dhash, conv FROM att WHERE img AND dhash IS NOT NULL),
h AS (SELECT DISTINCT dhash, ('0x' || dhash)::UBIGINT AS b FROM lk),
pr AS (SELECT x.dhash AS dhash, y.dhash AS other FROM h x JOIN h y ON bit_count(xor(x.b, y.b)) <= 8),
bl AS (SELECT DISTINCT pr.dhash, conv FROM pr JOIN lk ON lk.dhash = pr.other),
u AS (SELECT p.sha, p.dhash, sh.conv FROM (SELECT DISTINCT sha, dhash FROM att WHERE img AND size <= 153600) p JOIN sh USING (sha)
  UNION SELECT p.sha, p.dhash, bl.conv FROM (SELECT DISTINCT sha, dhash FROM att WHERE img AND size <= 153600) p JOIN bl USING (dhash)),
lg AS (SELECT sha, dhash FROM u GROUP BY ALL HAVING count(DISTINCT conv) >= 3),
f AS (SELECT att.*, min(ord) OVER (PARTITION BY att.sha) AS fo, lg.sha IS NOT NULL AS is_logo FROM att LEFT JOIN lg ON lg.sha = att.sha AND lg.dhash IS NOT DISTINCT FROM att.dhash)
SELECT doc_id, sha, size, CASE WHEN img AND size <= 153600 AND is_logo THEN 'logo/signature image' WHEN ord > fo THEN 'duplicate'
 WHEN size BETWEEN 1 AND 3071 THEN 'tiny attachment' ELSE '' END AS auto_reason FROM f""")
def auto_flags_web(spark, sf):
    att = v.attachments(spark, sf).select("doc_id", "conv", "size", "sha", "dhash", "img", "ord")
    return ex.auto_flags(att).select("doc_id", "sha", "size", "auto_reason")


@query("review_overrides", f"""WITH {ATT}, m AS (SELECT DISTINCT doc_id || '::' || sha AS key FROM att WHERE part_id % 9 = 0)
SELECT doc_id, sha, size, CASE WHEN m.key IS NULL THEN '' WHEN part_id % 2 = 0 THEN 'excluded' ELSE 'reviewed' END AS reason
FROM att LEFT JOIN m ON m.key = att.doc_id || '::' || att.sha""")
def review_overrides(spark, sf):
    att = v.attachments(spark, sf).withColumns({
        "key": F.concat_ws("::", c("doc_id").cast("string"), c("sha")), "auto_reason": F.lit("")})
    review = att.filter(c("part_id") % 9 == 0).select(
        "key", F.when(c("part_id") % 2 == 0, "").otherwise("reviewed").alias("reason")).distinct()
    return ex.review_overrides(att, review).select("doc_id", "sha", "size", "reason")


@query("duplicate_documents", """SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents""")
def duplicate_documents(spark, sf):
    docs = v.corpus(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha"), c("doc_id").alias("ord"))
    return ex.duplicate_documents(docs).select("doc_id", "duplicate")


EXCL = DISPO + """,
out AS (SELECT sha AS content, name, size, dhash, ord, 'Mailbox/' || (doc_id % 10) || '/' || doc_id || '.eml' AS source FROM dispo WHERE disposition IN ('excluded', 'inline_excluded'))"""


def excluded(spark, sf, *fields):
    """Set-aside rows: their content, where they came from, and the ``fields`` that are read."""
    out = disposed(spark, sf).filter(c("disposition").isin("excluded", "inline_excluded"))
    rows = settle(out.select("doc_id", "sha", *fields))
    source = F.concat(F.lit("Mailbox/"), (c("doc_id") % 10).cast("string"), F.lit("/"), c("doc_id").cast("string"), F.lit(".eml"))
    return rows.select(c("sha").alias("content"), *fields, source.alias("source"))


@query("excluded_copies", f"""WITH {EXCL} SELECT content, arg_min(name, ord) AS name, arg_min(size, ord) AS size, count(DISTINCT source)::BIGINT AS sources, count(*)::BIGINT AS copies
FROM out GROUP BY content""")
def excluded_copies(spark, sf):
    return ex.collapse_copies(excluded(spark, sf, "name", "size", "ord")).drop("ord")


@query("restore_folders", f"""WITH {EXCL} SELECT DISTINCT content, 'Documents/' || replace(source, '.eml', '') AS dir FROM out""")
def restore_folders(spark, sf):
    return ex.restore_dirs(excluded(spark, sf))


COMPONENTS = """
comp AS (WITH RECURSIVE reach(a, b) AS (SELECT h, h FROM hs UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b) SELECT a AS h, min(b) AS root FROM reach GROUP BY a)"""


GROUPED = f"""{EXCL}, rep AS (SELECT content, arg_min(name, ord) AS name, arg_min(size, ord) AS size, arg_min(dhash, ord) AS dhash, min(ord) AS ord FROM out GROUP BY content),
hs AS (SELECT DISTINCT dhash AS h, ('0x' || dhash)::UBIGINT AS b FROM rep WHERE dhash IS NOT NULL),
e AS (SELECT x.h AS a, y.h AS b FROM hs x JOIN hs y ON bit_count(xor(x.b, y.b)) <= 8), {COMPONENTS},
t AS (SELECT rep.*, coalesce(root, 'c' || content) AS g FROM rep LEFT JOIN comp ON comp.h = rep.dhash),
gr AS (SELECT g, count(*) AS members, arg_min(name, ord) AS rn, min(ord) AS o FROM t GROUP BY g),
rk AS (SELECT *, row_number() OVER (ORDER BY members DESC, rn, o) AS no FROM gr)"""


def grouped(rows: DataFrame) -> DataFrame:
    """The set-aside contents of ``rows`` in groups of look-alikes."""
    reps = rows.groupBy("content").agg(F.min_by(F.struct("name", "size", "dhash"), "ord").alias("f"), F.min("ord").alias("ord"))
    return settle(similarity.excluded_groups(settle(reps.select("content", "f.*", "ord"))))


@query("excluded_groups", f"""WITH {GROUPED},
gl AS (SELECT content, 'Group ' || lpad(no::VARCHAR, length((SELECT max(no) FROM rk)::VARCHAR)::INT, '0') || ' (' || members || CASE WHEN members = 1 THEN ' file)' ELSE ' files)' END AS folder,
  name || ' (' || size || ' bytes, dh=' || coalesce(dhash, 'none') || ')' AS file, members::BIGINT AS members FROM t JOIN rk USING (g))
SELECT content, folder, members, repeat('_', (row_number() OVER (PARTITION BY folder, lower(file) ORDER BY content) - 1)::INT) || file AS file FROM gl""")
def excluded_groups(spark, sf):
    return ex.group_layout(grouped(excluded(spark, sf, "name", "size", "dhash", "ord"))).select("content", "folder", "file", "members")


@query("excluded_listing", f"""WITH {GROUPED} SELECT no AS group_no, out.name, out.size, coalesce(t.dhash, 'none') AS dhash, source FROM out JOIN t USING (content) JOIN rk USING (g)""")
def excluded_listing(spark, sf):
    rows = excluded(spark, sf, "name", "size", "dhash", "ord")
    return ex.excluded_listing(rows.drop("dhash"), grouped(rows)).orderBy("name", "source", "size")


# -- similarity ----------------------------------------------------------------

SIG = """bits AS (SELECT vec_id, list_reduce(list_prepend(0::UBIGINT, list_transform(embedding, lambda x: (CASE WHEN x > 0 THEN 1 ELSE 0 END)::UBIGINT)),
   lambda h, x: ((h % 9223372036854775808::UBIGINT) * 2 + x)::UBIGINT) AS base FROM embeddings),
flips AS (SELECT * FROM (VALUES (0, 0), (1, 7), (2, 16128), (3, 2146435072)) t(variant, flip)),
sig AS (SELECT vec_id, variant, xor(base, flip::UBIGINT) AS h FROM bits, flips),
hs AS (SELECT DISTINCT h FROM sig),
e AS (SELECT x.h AS a, y.h AS b, bit_count(xor(x.h, y.h)) AS bits FROM hs x JOIN hs y ON bit_count(xor(x.h, y.h)) <= 8)"""
HEX = "lpad(lower(to_hex({})), 16, '0')"


@query("similar_pairs", f"WITH {SIG} SELECT least({HEX.format('a')}, {HEX.format('b')}) AS a, greatest({HEX.format('a')}, {HEX.format('b')}) AS b, bits::BIGINT AS bits FROM e WHERE a < b")
def similar_pairs(spark, sf):
    pairs = similarity.similar_edges(v.signatures(spark, sf).select("hash"))
    a, b = hashing.long_to_hex(c("a")), hashing.long_to_hex(c("b"))
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), c("bits").cast("bigint").alias("bits"))


@query("hash_groups", f"WITH {SIG}, {COMPONENTS} SELECT {HEX.format('h')} AS hash, count(*) OVER (PARTITION BY root)::BIGINT AS members FROM comp")
def hash_groups(spark, sf):
    groups = similarity.hash_groups(v.signatures(spark, sf))
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    return groups.join(sizes, "root").select(hashing.long_to_hex(c("hash")).alias("hash"), "members")


@query("group_distances", f"""WITH {SIG}, g AS (SELECT DISTINCT h, vec_id * 4 + variant AS g FROM sig)
SELECT least(x.g, y.g)::BIGINT AS group_a, greatest(x.g, y.g)::BIGINT AS group_b, min(bit_count(xor(x.h, y.h)))::BIGINT AS bits
FROM g x JOIN g y ON x.g < y.g AND bit_count(xor(x.h, y.h)) <= 12 GROUP BY ALL""")
def group_distances(spark, sf):
    groups = v.signatures(spark, sf).select((c("vec_id") * 4 + c("variant")).alias("group_no"), c("hash").alias("dhash"))
    return similarity.group_distances(groups).select("group_a", "group_b", c("bits").cast("bigint").alias("bits"))


@query("leader_groups", f"""WITH {SIG}, f AS (SELECT (vec_id * 4 + variant)::BIGINT AS ord,
  CASE WHEN vec_id % 10 = 0 AND variant = 3 THEN NULL ELSE h END AS h, 'n' || (vec_id % 7) AS content FROM sig),
d AS (SELECT h, min(ord) AS ord FROM f WHERE h IS NOT NULL GROUP BY h),
ls AS (SELECT list_reduce(list([h] ORDER BY ord), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y, x[1])) <= 8)) > 0 THEN acc ELSE list_append(acc, x[1]) END) AS l FROM d),
ld AS (SELECT u.h, d.ord FROM (SELECT unnest(l) AS h FROM ls) u JOIN d USING (h)),
led AS (SELECT d.h, arg_min(ld.h, ld.ord) AS leader FROM d JOIN ld ON ld.ord <= d.ord AND bit_count(xor(ld.h, d.h)) <= 8 GROUP BY d.h),
g AS (SELECT f.ord, coalesce('h' || leader, 'c' || content) AS g FROM f LEFT JOIN led USING (h)),
s AS (SELECT g, count(*) AS members, row_number() OVER (ORDER BY count(*) DESC, min(ord)) AS group_no FROM g GROUP BY g)
SELECT ord, group_no::BIGINT AS group_no, members::BIGINT AS members FROM g JOIN s USING (g)""")
def leader_groups(spark, sf):
    bare = (c("vec_id") % 10 == 0) & (c("variant") == 3)
    files = v.signatures(spark, sf).select(
        (c("vec_id") * 4 + c("variant")).cast("bigint").alias("ord"), F.when(~bare, c("hash")).alias("dhash"),
        F.concat(F.lit("n"), (c("vec_id") % 7).cast("string")).alias("content"))
    return similarity.leader_listing(files).select("ord", "group_no", "members")


LUMA = "list_transform(range(72), lambda i: embedding[(i % 64 + 1)::INT])"


def luma_sql(sign: str) -> str:
    return f"""WITH l AS (SELECT vec_id, {LUMA} AS m FROM embeddings),
b AS (SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN m[((i // 8) * 9 + i % 8 + 1)::INT] {sign} m[((i // 8) * 9 + i % 8 + 2)::INT] THEN 1 ELSE 0 END) AS bits FROM l),
n AS (SELECT vec_id, list_sum(bits) AS ones, list_reduce(list_prepend(0::UBIGINT, list_transform(bits, lambda x: x::UBIGINT)),
  lambda h, x: ((h % 9223372036854775808::UBIGINT) * 2 + x)::UBIGINT) AS h FROM b)
SELECT vec_id, CASE WHEN ones BETWEEN 10 AND 54 THEN {HEX.format('h')} ELSE '' END AS dhash FROM n"""


def _luma(spark, sf, variant: str) -> DataFrame:
    luma = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.element_at("embedding", (i % 64 + 1).cast("int")))
    return v.table(spark, sf, "embeddings").select("vec_id", text.blank(hashing.dhash_from_luma(luma, variant)).alias("dhash"))


@query("luma_hashes", luma_sql("<"))
def luma_hashes(spark, sf):
    return _luma(spark, sf, "desktop")


@query("luma_hashes_web", luma_sql(">"))
def luma_hashes_web(spark, sf):
    """The browser sets a bit where a pixel is brighter than its right neighbour."""
    return _luma(spark, sf, "web")


PAL = ", ".join(f"('{p[0]}', {p[1]}, {p[2]}, {p[3]}, {i})" for i, p in enumerate(similarity.PALETTE))


@query("nearest_colors", f"""WITH pal AS (SELECT * FROM (VALUES {PAL}) t(name, r, g, b, i)),
k AS (SELECT l_orderkey AS doc, l_partkey AS p, l_partkey % 256 AS r, (l_partkey * 7) % 256 AS g, (l_suppkey * 13) % 256 AS b FROM lineitem),
d AS (SELECT DISTINCT k.r, k.g, k.b, (k.r - pal.r) ** 2 + (k.g - pal.g) ** 2 + (k.b - pal.b) ** 2 AS d, pal.name, pal.i FROM (SELECT DISTINCT r, g, b FROM k) k, pal),
n AS (SELECT r, g, b, arg_min(name, d * 10 + i) AS name, min(d) AS d FROM d GROUP BY ALL)
SELECT r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b, CASE WHEN d <= 3600 THEN name ELSE '#' || lower(printf('%02x%02x%02x', r, g, b)) END AS color FROM n""")
def nearest_colors(spark, sf):
    rgb = v.table(spark, sf, "lineitem").select(
        (c("l_partkey") % 256).alias("r"), (c("l_partkey") * 7 % 256).alias("g"), (c("l_suppkey") * 13 % 256).alias("b")
    ).distinct()
    return rgb.withColumn("color", similarity.nearest_color(c("r"), c("g"), c("b")))


# -- what changed ----------------------------------------------------------------

SNAP = """prev AS (SELECT doc_id, doc_id::VARCHAR AS path, doc_id % 1000 AS mtime, n_chars AS size, CASE WHEN doc_id % 29 = 0 THEN 0 ELSE n_chars END AS text_chars, text FROM documents),
cur AS (SELECT doc_id, doc_id::VARCHAR AS path, CASE WHEN doc_id % 13 = 0 THEN doc_id % 1000 + 1 ELSE doc_id % 1000 END AS mtime, n_chars AS size,
   CASE WHEN doc_id % 13 = 0 THEN text || ' amended clause' ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0
 UNION ALL SELECT doc_id + 1000000, (doc_id + 1000000)::VARCHAR, doc_id % 1000, n_chars, text FROM documents WHERE doc_id % 19 = 0)"""


@query("change_set", f"""WITH {SNAP} SELECT cur.path, CASE WHEN prev.path IS NULL THEN 'new' WHEN prev.mtime = cur.mtime AND prev.size = cur.size AND text_chars > 0 THEN 'reused'
 ELSE 'changed' END AS status FROM cur LEFT JOIN prev USING (path)""")
def change_set(spark, sf):
    prev, cur = v.snapshots(spark, sf)
    return inc.change_set(cur, prev).select("path", "status")


@query("vanished_documents", f"WITH {SNAP} SELECT path FROM prev ANTI JOIN cur USING (path)")
def vanished_documents(spark, sf):
    prev, cur = v.snapshots(spark, sf)
    return inc.vanished(cur, prev).select("path")


@query("incremental_reindex", f"""WITH {SNAP}, tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
    lambda w: length(w) BETWEEN 2 AND 40 AND NOT list_contains([{STOP}], w)) AS tokens FROM cur)
SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL""")
def incremental_reindex(spark, sf):
    """The stored index of the old state, brought up to date: equal to a full rebuild."""
    prev, cur = v.snapshots(spark, sf)
    root = work_path(spark, "index")
    segments.create(search.postings(prev), prev, root)
    todo = settle(inc.change_set(cur, prev).filter(c("status") != "reused").select("doc_id", "text"))
    touched = todo.select("doc_id").unionByName(inc.vanished(cur, prev).select("doc_id"))
    segments.refresh(search.postings(todo), touched, root)
    return segments.read(spark, root).select("doc_id", "term", "tf")


@query("merged_segments", ORACLE["incremental_reindex"])
def merged_segments(spark, sf):
    """The same changes in five refreshes, by the documents' last digit, with a merge of like segments after each."""
    prev, cur = v.snapshots(spark, sf)
    root = work_path(spark, "index")
    segments.create(search.postings(prev), prev, root)
    todo = settle(inc.change_set(cur, prev).filter(c("status") != "reused"))
    touched = settle(todo.select("doc_id").unionByName(inc.vanished(cur, prev).select("doc_id")))
    for part in range(5):
        now = F.floor(c("doc_id") % 10 / 2) == part
        segments.refresh(search.postings(todo.filter(now)), touched.filter(now), root)
        segments.merge_tiers(spark, root)
    return segments.read(spark, root).select("doc_id", "term", "tf")


CHANGED = ATT + """,
d1 AS (SELECT DISTINCT sha FROM att WHERE part_id % 23 = 0), d2 AS (SELECT DISTINCT sha FROM att WHERE part_id % 46 = 0 OR part_id % 31 = 0),
ch AS ((SELECT sha FROM d1 EXCEPT SELECT sha FROM d2) UNION (SELECT sha FROM d2 EXCEPT SELECT sha FROM d1))"""


def decision_change(att: DataFrame) -> DataFrame:
    return inc.changed_decisions(
        att.filter(c("part_id") % 23 == 0), att.filter((c("part_id") % 46 == 0) | (c("part_id") % 31 == 0)))


@query("changed_decisions", f"WITH {CHANGED} SELECT sha FROM ch")
def changed_decisions(spark, sf):
    return decision_change(v.attachments(spark, sf))


@query("affected_documents", f"WITH {CHANGED} SELECT DISTINCT doc_id FROM att SEMI JOIN ch USING (sha)")
def affected_documents(spark, sf):
    att = v.attachments(spark, sf)
    return inc.affected_documents(att, decision_change(att))


PLAN = CHANGED + """,
aff AS (SELECT DISTINCT doc_id FROM att SEMI JOIN ch USING (sha)),
man AS (SELECT o_orderkey AS doc_id, o_orderkey % 100 AS mtime, (1 + o_orderkey % 3)::BIGINT AS span,
  'DOC-' || printf('%06d', 1 + coalesce(sum(1 + o_orderkey % 3) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS beg FROM orders),
pl AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5001 = 77 THEN 4 ELSE (1 + o_orderkey % 3) END::BIGINT AS new_span, span, beg,
  (o_orderkey % 5001 <> 77) AND o_orderkey % 61 <> 0 AND aff.doc_id IS NULL AS reuse FROM orders JOIN man ON man.doc_id = o_orderkey LEFT JOIN aff ON aff.doc_id = o_orderkey)"""


def reuse_plan(spark, sf, settings: str | None = None) -> DataFrame:
    mails = v.emails(spark, sf)
    rel = F.concat(c("doc_id").cast("string"), F.lit(".pdf"))
    manifest = prod.number_records(mails.withColumn("span", c("pages")), ["doc_id"]).select(
        "doc_id", (c("doc_id") % 100).alias("mtime"), F.lit(1).alias("size"), rel.alias("file_rel"),
        c("span").alias("family_span"), "beg_bates", inc.config_key(F.struct(F.lit("DOC-").alias("prefix"))).alias("config"))
    grown = c("doc_id") % 5001 == 77
    targets = mails.select(
        "doc_id", c("doc_id").alias("position"), (F.when(grown, 999).otherwise(c("doc_id") % 100)).alias("mtime"), F.lit(1).alias("size"),
        F.when(grown, 4).otherwise(c("pages")).cast("bigint").alias("new_span"))
    outputs = mails.filter(c("doc_id") % 61 != 0).select(rel.alias("file_rel"))
    att = v.attachments(spark, sf)
    # The manifest of the last run is a stored table.
    manifest = settle(manifest)
    key = inc.config_key(F.struct(F.lit(settings or "DOC-").alias("prefix")))
    return inc.plan_reuse(targets, manifest, inc.affected_documents(att, decision_change(att)), outputs, key)


@query("reuse_plan", f"WITH {PLAN} SELECT doc_id, reuse FROM pl")
def reuse_plan_query(spark, sf):
    return reuse_plan(spark, sf).select("doc_id", "reuse")


@query("plan_after_config_change", f"WITH {PLAN} SELECT doc_id, false AS reuse FROM pl")
def plan_after_config_change(spark, sf):
    """Another label prefix voids the whole manifest."""
    return reuse_plan(spark, sf, "NEW-").select("doc_id", "reuse")


@query("drifted_families", f"""WITH {PLAN}, n AS (SELECT *, 'DOC-' || printf('%06d', 1 + coalesce(sum(CASE WHEN reuse THEN span ELSE new_span END)
  OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS planned_beg FROM pl)
SELECT doc_id, planned_beg, reuse AND beg <> planned_beg AS drifted FROM n""")
def drifted_families(spark, sf):
    return inc.drifted_families(reuse_plan(spark, sf)).select("doc_id", "planned_beg", "drifted")


@query("reusable_hashes", """SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0""")
def reusable_hashes(spark, sf):
    docs = v.emails(spark, sf).select("doc_id", F.lit(1).alias("mtime"), c("pages").alias("size"))
    cache = docs.select(
        "doc_id", F.when(c("doc_id") % 7 == 0, 0).otherwise(1).alias("mtime"), "size",
        (c("doc_id") % 5 != 0).alias("perceptual"), F.when(c("doc_id") % 3 == 0, 1).otherwise(2).alias("version"))
    return inc.reusable_hashes(cache, docs, need_dhash=True)


@query("relative_paths", f"""WITH {CORPUS} SELECT path, CASE WHEN path LIKE '/vault/src1/%' THEN 'src1' || substr(path, 12)
 WHEN path LIKE '/vault/src2/en/%' THEN 'en' || substr(path, 15) WHEN path LIKE '/vault/src3/%' THEN 'vault' || substr(path, 7) WHEN path LIKE '/vault/%' THEN 'vault' || substr(path, 7)
 ELSE name END AS rel FROM corpus""")
def relative_paths(spark, sf):
    roots = ["/vault/src1", "/vault/src2/en/", "/vault", "/vault/src3"]
    return v.corpus(spark, sf).select("path", prod.relative_path(c("path"), roots).alias("rel"))


@query("tree_counts", f"""WITH {CORPUS} SELECT count(*)::BIGINT AS files, (count(DISTINCT collection) + count(DISTINCT collection || '/' || lang))::BIGINT AS folders FROM corpus""")
def tree_counts(spark, sf):
    return prod.tree_counts(v.corpus(spark, sf), ["/vault"])


@query("stale_outputs", """WITH l AS (SELECT p_brand AS folder, p_partkey || '.pdf' AS name, p_partkey AS k FROM part),
st AS (SELECT p_brand AS folder, bool_or(p_partkey % 97 = 0) AS untracked FROM part WHERE p_brand NOT LIKE '%1' GROUP BY p_brand)
SELECT l.folder, l.name, st.folder IS NULL AS orphan_folder FROM l LEFT JOIN st USING (folder)
WHERE coalesce(NOT untracked, true) AND (st.folder IS NULL OR k % 3 = 0)""")
def stale_outputs(spark, sf):
    part = v.table(spark, sf, "part")
    file = F.concat(c("p_partkey").cast("string"), F.lit(".pdf"))
    items = part.filter(~c("p_brand").like("%1")).select(
        c("p_brand").alias("folder"),
        F.when(c("p_partkey") % 97 != 0, F.when(c("p_partkey") % 3 != 0, F.array(F.upper(file))).otherwise(F.array().cast("array<string>"))).alias("files"))
    return prod.stale_outputs(part.select(c("p_brand").alias("folder"), file.alias("name")), items)


@query("source_map", """WITH p AS (SELECT p_partkey AS ord, p_name || '.pdf' AS pdf, CASE WHEN p_partkey % 2 = 0 THEN p_name || '.xls' END AS nat, p_name || '|' || p_size AS fp FROM part),
b AS (SELECT ord, pdf AS file, fp FROM p UNION ALL SELECT ord, nat, fp FROM p WHERE nat IS NOT NULL)
SELECT file, arg_max(fp, ord) AS fp FROM b GROUP BY file""")
def source_map(spark, sf):
    name = c("p_name")
    return prod.source_map(v.table(spark, sf, "part").select(
        c("p_partkey").alias("ord"), F.concat(name, F.lit(".pdf")).alias("pdf_file"),
        F.when(c("p_partkey") % 2 == 0, F.concat(name, F.lit(".xls"))).alias("native_file"),
        names.fingerprint(name, c("p_size")).alias("fp")))
