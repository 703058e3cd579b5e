"""Registered queries over files that Spark writes from the given tables and reads back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from foliant.operators import incremental as inc
from foliant.plans import views as v
from foliant.plans.catalog import STOP, c, query
from foliant.session import settle, small_batches, whole_files, work_path
from foliant.sources import email, files, office, quarantine
from foliant.streaming import reindex

# -- folders ---------------------------------------------------------------------


@query("corpus_scan", """WITH d AS (SELECT source, lang, count(*) AS docs, string_agg(text || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY ALL),
t(top, ext, shown) AS (VALUES ('letters', '.txt', true), ('pages', '.txt', true), ('tables', '.parquet', false))
SELECT CASE WHEN top = 'pages' THEN 'deep/1/2/3/4/5/6/7/8/9/' ELSE '' END || top || '/source=' || source || '/lang=' || lang AS folder, ext, 1::BIGINT AS files,
  CASE WHEN shown THEN strlen(text) END::BIGINT AS bytes, md5(CASE WHEN shown THEN text ELSE '' END) AS text FROM d, t
UNION ALL SELECT '', '.txt', 1, strlen(text)::BIGINT, md5(text) FROM d QUALIFY row_number() OVER (ORDER BY source, lang) = 1""")
def corpus_scan(spark, sf):
    """The texts as files in folders: plain, deep, of an unknown format, in dot folders and module folders; and one file as a root."""
    root = work_path(spark, "vault")
    docs = v.texts(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    # One file for each folder, in the order of the ids; the others are written from it, file by file.
    rows = docs.repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id")
    rows.write.partitionBy("source", "lang").parquet(f"{root}/tables")
    with whole_files(spark):
        rows = spark.read.schema(docs.schema).parquet(f"{root}/tables")
        for top in ("letters", "deep/1/2/3/4/5/6/7/8/9/pages", ".trash/old", "node_modules/pkg"):
            rows.select("source", "lang", "text").write.partitionBy("source", "lang").text(f"{root}/{top}")
    listed = files.scan_files(spark, [root])
    one = listed.filter(F.contains("path", F.lit("/letters/"))).orderBy("path").first().path
    found = files.plain_text(files.scan_files(spark, [root, f"{root}/missing", one], with_content=True))
    below = F.substring("path", len(root) + 2, 1 << 20) if "://" not in root else F.regexp_replace("path", f"^.*/{root.rsplit('/', 1)[1]}/", "")
    folder = F.when(c("root_no") == 0, F.regexp_replace(below, "/[^/]*$", "")).otherwise("")
    txt = F.endswith("name", F.lit(".txt"))
    return found.groupBy(folder.alias("folder"), F.regexp_extract("name", r"(\.[a-z]+)$", 1).alias("ext")).agg(
        F.count("*").alias("files"), F.sum(F.when(txt, c("size"))).alias("bytes"), F.md5(F.max("text")).alias("text"))


@query("corpus_scan_web", """SELECT source AS folder, count(*)::BIGINT AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source""")
def corpus_scan_web(spark, sf):
    """The browser leaves out files of unknown extensions: here every text has a twin named .bin, which goes."""
    docs = v.texts(spark, sf, "documents").select(c("source").alias("folder"), "doc_id", F.encode("text", "UTF-8").alias("content"))
    both = docs.withColumn("ext", F.explode(F.array(F.lit(".TXT"), F.lit(".bin")))).withColumn("name", F.concat(c("doc_id").cast("string"), "ext"))
    return files.plain_text(both, "web").groupBy("folder").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


CHUNK = 50_000


@query("matter_chunks", f"""WITH m AS (SELECT source AS matter, string_agg(text, chr(10) || chr(10) ORDER BY 'doc-' || doc_id) AS whole FROM documents WHERE text <> '' GROUP BY source)
SELECT matter, k AS chunk, md5(substr(whole, k * {CHUNK} + 1, {CHUNK})) AS text FROM (SELECT *, unnest(range((length(whole) - 1) // {CHUNK} + 1)) AS k FROM m)""")
def matter_chunks(spark, sf):
    """The source text of each collection in pieces of a fixed size."""
    docs = v.texts(spark, sf, "documents").select(
        c("source").alias("matter"), F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("name"), "text")
    return files.source_chunks(docs, size=CHUNK).withColumn("text", F.md5("text"))


# -- Office files ------------------------------------------------------------------

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_NA = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_NX = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zipped(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, body in entries.items():
            box.writestr(name, body)
    return out.getvalue()


def _run(words: str, colour: str = "", page_break: bool = False) -> str:
    pen = f'<w:rPr><w:highlight w:val="{colour}"/></w:rPr>' if colour else ""
    turn = '<w:br w:type="page"/>' if page_break else ""
    return f'<w:r>{pen}{turn}<w:t xml:space="preserve">{escape(words)}</w:t></w:r>'


def _docx(text: str) -> bytes:
    """Each line a paragraph: two yellow runs and a plain one; every tenth line begins a page, every third has a green end."""
    paragraphs = []
    for n, line in enumerate(text.split("\n")):
        a, b, d = line[:5], line[5:12], line[12:]
        paragraphs.append(
            "<w:p>" + _run(a, "yellow", n > 0 and n % 10 == 0) + _run(b, "yellow") + _run("") + _run(d, "green" if n % 3 == 0 else "") + "</w:p>")
    return _zipped({"word/document.xml": f"<w:document {_NS}><w:body>{''.join(paragraphs)}</w:body></w:document>"})


def _pptx(text: str) -> bytes:
    """Each line a slide."""
    return _zipped({
        f"ppt/slides/slide{n + 1}.xml": f"<s {_NA}><a:t>{escape(line)}</a:t><a:t> </a:t></s>" for n, line in enumerate(text.split("\n"))})


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _xlsx(text: str, name: str) -> bytes:
    """Each line a row, each word a cell; every second cell is left out of the file and so is blank."""
    rows = []
    for n, line in enumerate(text.split("\n"), 1):
        cells = [(f"{_letters(k)}{n}", w) for k, w in enumerate(line.split(" "), 1) if k % 2]
        rows.append("<row>" + "".join(f'<c r="{r}" t="inlineStr"><is><t>{escape(w)}</t></is></c>' for r, w in cells) + "</row>")
    return _zipped({
        "xl/workbook.xml": f'<workbook {_NX} xmlns:r="{_REL}"><sheets><sheet name="{escape(name)}" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {_NX}><sheetData>{''.join(rows)}</sheetData></worksheet>",
    })


def _containers(spark, sf, kind=None):
    """``(path, content)``: the documents packed as Office files inside the tasks, by their number modulo three.

    ``kind`` (0 to 2) packs files of that kind alone.
    """

    def pack(frames):
        import pandas as pd

        for frame in frames:
            kinds = {0: ".docx", 1: ".pptx", 2: ".xlsx"}
            makers = (lambda t, g: _docx(t), lambda t, g: _pptx(t), _xlsx)
            made = [makers[i % 3](t, g) for i, t, g in zip(frame.doc_id, frame.text, frame.lang)]
            yield pd.DataFrame({"doc_id": frame.doc_id, "path": [f"/vault/{i}{kinds[i % 3]}" for i in frame.doc_id], "content": made})

    docs = v.texts(spark, sf, "documents").select("doc_id", "text", "lang")
    if kind is not None:
        docs = docs.filter(F.pmod("doc_id", F.lit(3)) == kind)
    return docs.mapInPandas(pack, "doc_id bigint, path string, content binary")


OFFICE = """o AS (SELECT doc_id, '/vault/' || doc_id || (['.docx', '.pptx', '.xlsx'])[(doc_id % 3 + 1)::INT] AS path, CASE doc_id % 3
  WHEN 0 THEN replace(text, chr(10), chr(10) || chr(10))
  WHEN 1 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda l: trim(l)), chr(10) || chr(10))
  ELSE '# Sheet: ' || lang || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda l:
    array_to_string(list_transform(string_split(l, ' ')[1:(len(string_split(l, ' ')) - 1) // 2 * 2 + 1], lambda w, i: CASE WHEN i % 2 = 1 THEN w ELSE '' END), chr(9))), chr(10)) || chr(10)
  END AS text FROM documents)"""


@query("office_texts", f"WITH {OFFICE} SELECT path, md5(text) AS text FROM o")
def office_texts(spark, sf):
    """Texts of Word, slide and sheet files."""
    with small_batches(spark):
        parts = settle(office.office_parts(_containers(spark, sf)))
    return office.office_text(parts).select("path", F.md5("text").alias("text"))


@query("office_highlights", """WITH l AS (SELECT doc_id, i - 1 AS n, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE doc_id % 3 = 0)),
r AS (SELECT *, 'yellow' AS color, 0 AS run, substr(line, 1, 12) AS t FROM l UNION ALL SELECT *, 'green', 3, substr(line, 13) FROM l WHERE n % 3 = 0),
s AS (SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM r)
SELECT '/vault/' || doc_id || '.docx' AS path, n::BIGINT AS para, run::BIGINT AS run, text, color, md5(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS context, n // 10 + 1 AS page
FROM s WHERE text <> ''""")
def office_highlights(spark, sf):
    """Marked passages of the Word files, with their pages."""
    with small_batches(spark):
        runs = settle(office.highlight_runs(_containers(spark, sf, 0).filter(F.endswith("path", F.lit(".docx")))))
    return office.highlight_passages(runs).select(
        "path", c("para").cast("bigint").alias("para"), c("run").cast("bigint").alias("run"), "text", "color", F.md5("context").alias("context"), "page")


@query("quarantined_files", f"""WITH {OFFICE} SELECT path, CASE WHEN doc_id % 7 <> 0 THEN 'read' WHEN doc_id % 14 = 0 THEN 'read again' ELSE 'failed' END AS state,
  CASE WHEN doc_id % 7 = 0 AND doc_id % 14 <> 0 THEN '' ELSE md5(text) END AS text, CASE WHEN doc_id % 7 = 0 AND doc_id % 14 <> 0 THEN 2 ELSE 0 END::BIGINT AS attempts FROM o""")
def quarantined_files(spark, sf):
    """Every seventh file is cut short; half of these are whole at the second attempt, the others stay in quarantine."""
    root = work_path(spark, "quarantine")
    whole = settle(_containers(spark, sf))
    cut = F.expr("substring(content, 1, length(content) - 30)")
    first = whole.withColumn("content", F.when(c("doc_id") % 7 == 0, cut).otherwise(c("content")))
    second = whole.withColumn("content", F.when((c("doc_id") % 7 == 0) & (c("doc_id") % 14 != 0), cut).otherwise(c("content")))
    quarantine.attempt(office.office_parts(first), root)
    quarantine.retry(second, root, office.office_parts, 2)
    read = quarantine.read_rows(spark, root)
    tried = read.groupBy("path").agg(F.max("attempt").alias("n"))
    good = office.office_text(read).join(tried, "path").select(
        "path", F.when(c("n") == 1, "read").otherwise("read again").alias("state"), F.md5("text").alias("text"), F.lit(0).cast("bigint").alias("attempts"))
    bad = quarantine.failures(spark, root).select("path", F.lit("failed").alias("state"), F.lit("").alias("text"), "attempts")
    return good.unionByName(bad)


# -- bodies and replies --------------------------------------------------------------


@query("data_uri_removal", f"""WITH p AS (SELECT doc_id, lang, text, to_base64(encode(text)) AS b FROM documents)
SELECT doc_id, md5(CASE WHEN text = '' THEN 'a <img src="data:image/png;base64,"> ' || lang || '  end'
  ELSE 'a <img src="{email.PIXEL}"> ' || lang || '  end' END) AS body FROM p""")
def data_uri_removal(spark, sf):
    """Each text embedded in a body as a picture would be, and once bare."""
    docs = v.texts(spark, sf, "documents").select("doc_id", "lang", F.encode("text", "UTF-8").alias("content"))
    packed = F.regexp_replace(F.base64("content"), r"\s", "")
    body = F.concat(F.lit('a <img src="data:image/png;base64,'), packed, F.lit('"> '), "lang", F.lit(" "), packed, F.lit(" end"))
    return docs.select("doc_id", F.md5(email.strip_data_uri(body, c("content"))).alias("body"))


@query("parsed_replies", """SELECT doc_id AS reply, doc_id::VARCHAR AS doc_id, upper(lang) AS doc_type, md5(text) AS summary, source || ',' || lang AS parties, '' AS reason FROM documents WHERE doc_id % 5 > 1
UNION ALL SELECT doc_id, doc_id || 'b', '', '', '', '' FROM documents WHERE doc_id % 5 > 1
UNION ALL SELECT doc_id, '', '', '', '', CASE WHEN doc_id % 5 = 0 THEN 'no list' ELSE 'not json' END FROM documents WHERE doc_id % 5 < 2""")
def parsed_replies(spark, sf):
    """Replies with whole texts in them; of two entries with one id the last counts; some have no list, some a broken one."""
    entry = F.to_json(F.struct(
        c("doc_id").cast("string").alias("id"), F.upper("lang").alias("docType"), c("text").alias("summary"), F.array("source", "lang").alias("parties")))
    again = F.concat(F.lit('{"id":"'), c("doc_id").cast("string"), F.lit('","docType":"old"}'))
    other = F.concat(F.lit('{"id":"'), c("doc_id").cast("string"), F.lit('b"}'))
    good = F.concat(F.lit("Here it is:\n["), F.concat_ws(",", again, entry, other, F.lit('{"docType":"lost"}')), F.lit("]\nDone."))
    raw = F.when(c("doc_id") % 5 == 0, F.lit("I could not do that.")).when(
        c("doc_id") % 5 == 1, F.concat(F.lit("["), F.substring(entry, 1, 20), F.lit("]"))).otherwise(good)
    docs = v.texts(spark, sf, "documents").select(c("doc_id").alias("reply"), raw.alias("raw"))
    rows, malformed = inc.parse_replies(docs)
    blank = F.lit("")
    found = rows.select(
        "reply", "doc_id", F.coalesce("doc_type", blank).alias("doc_type"), F.coalesce(F.md5("summary"), blank).alias("summary"),
        F.coalesce(F.array_join("parties", ","), blank).alias("parties"), blank.alias("reason"))
    return found.unionByName(malformed.select("reply", *(blank.alias(x) for x in ("doc_id", "doc_type", "summary", "parties")), "reason"))


# -- pause and resume ----------------------------------------------------------------


@query("resumed_reindex", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || ' second state' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0),
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) BETWEEN 2 AND 40 AND NOT list_contains([{STOP}], w)) AS tokens FROM d)
SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL""")
def resumed_reindex(spark, sf):
    """A stream of changes that is paused twice, each time in the middle of a batch, and goes on from its checkpoint."""
    base = work_path(spark, "resumed")
    docs = v.texts(spark, sf, "documents").select("doc_id", "text")
    later = docs.filter("doc_id % 4 = 0").select("doc_id", F.lit(1).alias("seq"), F.concat("text", F.lit(" second state")).alias("text"))
    gone = docs.filter("doc_id % 9 = 0").select("doc_id", F.lit(2).alias("seq"), F.lit(None).cast("string").alias("text"))
    changes = docs.select("doc_id", F.lit(0).alias("seq"), "text").unionByName(later).unionByName(gone)
    # Three waves in the order of the changes, each taken in two batches; a file is a part of a batch that one task can hold.
    many = spark.sparkContext.defaultParallelism
    for wave in range(3):
        changes.filter(c("seq") == wave).repartition(2 * many).write.mode("append").parquet(f"{base}/in")
    source = spark.read.parquet(f"{base}/in").schema
    seen: list[int] = []

    def pause(number: int) -> None:
        seen.append(number)
        if number in (1, 3) and seen.count(number) == 1:
            raise reindex.Paused(f"batch {number}")

    while True:
        stream = spark.readStream.schema(source).option("maxFilesPerTrigger", many).parquet(f"{base}/in")
        if reindex.run_until_paused(reindex.index_changes(stream, f"{base}/index", f"{base}/state", on_batch=pause)):
            break
    return reindex.current_postings(spark, f"{base}/index").select("doc_id", "term", "tf")
