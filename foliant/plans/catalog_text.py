"""Registered queries on texts, messages, registers and output formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import markdown, names, text, tokens
from foliant.operators import checks, highlights, messages, redline, registers
from foliant.operators import production as prod
from foliant.plans import views as v
from foliant.plans.catalog import ATT, CORPUS, EMAILS, FULL, STOP, c, full_records, query
from foliant.sources import sinks

# -- markup --------------------------------------------------------------------

PLAIN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<style.*?</style>', '', 'g'), '(?is)<script.*?</script>', '', 'g'),
  '(?i)</(p|div|br|tr|li|h[1-6])>', chr(10), 'g'), '<[^>]+>', '', 'g')"""
UNESC = "replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
NL3 = "regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("html_to_text", f"SELECT page_id, {TRIM.format(NL3.format(UNESC.format(PLAIN.format('html'))))} AS text FROM pages")
def html_to_text(spark, sf):
    return v.texts(spark, sf, "pages").select("page_id", text.html_to_text(c("html")).alias("text"))


@query("html_to_text_web", f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)</(p|div|tr|li|h[1-6])>', chr(10), 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS m,
  regexp_replace(h, '<[^>]+>', ' ', 'g') AS f FROM a),
d AS (SELECT page_id, regexp_replace(replace(replace({UNESC.format('m')}, '&quot;', '"'), '&#39;', ''''), '[ \\t]+', ' ', 'g') AS m,
  replace(replace(replace(replace(replace(f, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS f FROM b)
SELECT page_id, {TRIM.format(NL3.format('m'))} AS mail, trim(regexp_replace(f, '\\s+', ' ', 'g')) AS file FROM d""")
def html_to_text_web(spark, sf):
    return v.texts(spark, sf, "pages").select(
        "page_id", text.html_to_text(c("html"), "web").alias("mail"), text.html_to_text(c("html"), "web_file").alias("file"))


NOTICES = (
    "This e-mail is confidential and more. Please delete it now. Regards", "This message has been scanned by X cloud service. ok",
    "______ <br>This email has been scanned by the Symantec Security.cloud service<br> ________ tail",
    "The information contained in this message is private, whatever it says (IDSC0012) end",
    "This e-mail and any files transmitted with it are strictly intended for you, any use is prohibited. bye",
)
BODY = f"""m AS (SELECT page_id, html || '<div> <br>&nbsp;<div></div></div><br><br/> <br ><br>Sent from my phone 12, bye<p>'
  || ([{", ".join(f"'{n}'" for n in NOTICES)}])[(page_id % 5 + 1)::INT] AS html FROM pages)"""
EMPTY = "regexp_replace({}, '(?i)<div[^>]*>(?:\\s|&nbsp;|<br\\b[^>]*/?>)*</div>', '', 'g')"
RUN = "regexp_replace({}, '(?i)(?:<br\\b[^>]*/?>\\s*){{3,}}', '<br><br>', 'g')"


def _tidy(x: str, n: int) -> str:
    for _ in range(n):
        x = EMPTY.format(x)
    return RUN.format(x)


FLAT = "regexp_replace(regexp_replace(html, '(?i)</?(?:html|head|body)[^>]*>', '', 'g'), '(?i)<meta\\b[^>]*>', '', 'g')"
SCANNED = "(?:cloud service\\.?|Symantec[^<.]*\\.?)"
CUT = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{}}, '(?i)Sent from my [^<\\n]{{{{0,40}}}}', '', 'g'),
  '(?is)_{{{{6,}}}}(?:\\s|<[^>]+>)*This (?:e-?mail|message) has been scanned by.{{{{0,200}}}}?{SCANNED}(?:\\s|<[^>]+>)*_{{{{6,}}}}', '', 'g'),
  '(?is)This (?:e-?mail|message) has been scanned by.{{{{0,160}}}}?{SCANNED}', '', 'g'),
  '(?is)The information contained in this (?:message|e-?mail).{{{{0,700}}}}?(?:\\(IDSC\\d+\\)|delete the (?:message|e-?mail)\\.?|strictly prohibited\\.?)', '', 'g'),
  '(?is)This (?:e-?mail|message)(?: and any (?:attachments?|files? transmitted with it))? (?:is|are) (?:strictly )?(?:confidential|intended).{{{{0,700}}}}?(?:delete.{{{{0,80}}}}?\\.|prohibited\\.?|notify the sender.{{{{0,60}}}}?\\.)', '', 'g')"""


@query("clean_email_body", f"""WITH {BODY}, f AS (SELECT page_id, {_tidy(FLAT, 3)} AS b FROM m)
SELECT page_id, md5(b) AS kept, md5({_tidy(CUT.format('b'), 2)}) AS stripped FROM f""")
def clean_email_body(spark, sf):
    tail = F.get(F.array(*map(F.lit, NOTICES)), (c("page_id") % 5).cast("int"))
    html = F.concat("html", F.lit("<div> <br>&nbsp;<div></div></div><br><br/> <br ><br>Sent from my phone 12, bye<p>"), tail)
    return v.texts(spark, sf, "pages").select(
        "page_id", F.md5(text.clean_body(html)).alias("kept"), F.md5(text.clean_body(html, True)).alias("stripped"))


@query("markdown_tables", f"""WITH {EMAILS} SELECT DISTINCT ckey, 0::BIGINT AS row_no, 'id;day' AS cells FROM convs
UNION ALL SELECT ckey, row_number() OVER (PARTITION BY ckey ORDER BY doc_id)::BIGINT, doc_id || ';' || date FROM convs
UNION ALL SELECT ckey, count(*) + 1, 'End;of table' FROM convs GROUP BY ckey""")
def markdown_tables(spark, sf):
    mails = v.emails(spark, sf)
    key = text.conversation_key(c("subject"), c("doc_id"))
    line = F.concat_ws(" | ", F.lit(""), c("doc_id").cast("string"), c("date"), F.lit(""))
    made = mails.groupBy(key.alias("ckey")).agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))).alias("l"))
    doc = F.concat(F.lit("Dates\n\n| id | day |\n|---|:--|\n"), F.array_join(F.transform("l", lambda r: r["line"]), "\n"), F.lit("\nEnd | of table\nnone"))
    rows = markdown.first_table(made.select("ckey", doc.alias("text")), keys=("ckey",))
    return rows.select("ckey", c("row_no").cast("bigint").alias("row_no"), F.array_join("cells", ";").alias("cells"))


@query("stripped_markdown", """SELECT doc_id, regexp_replace(replace(CASE WHEN doc_id % 4 = 0 THEN '## ' WHEN doc_id % 4 = 1 THEN '> ' WHEN doc_id % 4 = 2 THEN '- ' ELSE '' END || '**' || text || '**', '**', ''),
  CASE WHEN doc_id % 4 = 2 THEN '^- ' ELSE '^(## |> )' END, CASE WHEN doc_id % 4 = 2 THEN '• ' ELSE '' END) AS text,
  replace(replace(replace('<' || lang || '>&"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents""")
def stripped_markdown(spark, sf):
    n = c("doc_id") % 4
    lead = F.when(n == 0, "## ").when(n == 1, "> ").when(n == 2, "- ").otherwise("")
    raw = F.concat(lead, F.lit("**<ins>"), "text", F.lit("</ins>**"))
    return v.table(spark, sf, "documents").select(
        "doc_id", text.strip_markdown(raw).alias("text"),
        text.escape_html(F.concat(F.lit("<"), "lang", F.lit('>&"'))).alias("escaped"))


# -- checks ----------------------------------------------------------------------

CONTRACT = """con AS (SELECT doc_id, lang, text AS body, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: i || '. ' || l), chr(10)) AS numbered,
  upper(lang[1:1]) || lang[2:] || ' Fee' AS term FROM documents),
ct AS (SELECT doc_id, term, numbered, numbered || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '"' || term || '" means the amount in Section ' || (doc_id % 9 + 1) || '.' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN 'The charge (the "' || term || '") is due. See Section ' || (doc_id % 23 + 1) || '.4 and Exhibit B.' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 4 = 0 THEN 'Exhibit A' || chr(10) || 'Clause 2 and Schedule C apply on [DATE], fee [TBD].' ELSE '' END || chr(10)
  || CASE WHEN doc_id % 5 = 0 THEN 'IN WITNESS WHEREOF the parties sign. ____' ELSE '' END AS text FROM con)"""
HEAD = "(?i)^\\s*(?:section\\s+|§\\s*|clause\\s+|article\\s+)?([0-9]{1,3})(?:\\.[0-9]+)*[.):]?\\s+\\S"
SECT = f"""{CONTRACT},
hd AS (SELECT doc_id, list_distinct(list_transform(list_filter(list_transform(string_split({{src}}, chr(10)), lambda l: regexp_extract(l, '{HEAD}', 1)), lambda x: x <> ''), lambda x: x::INT)) AS heads FROM ct),
ci AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:§\\s*|\\bsections?\\s+|\\bclauses?\\s+|\\barticle\\s+)([0-9]{{1,3}}(?:\\.[0-9]+)*)', 1), lambda x: '§' || x)) AS cited FROM ct),
sec AS (SELECT ct.*, heads, cited, len(heads) >= 2 AND coalesce(list_max(list_filter(heads, lambda h: h >= 1)), 0) = len(list_filter(heads, lambda h: h >= 1)) AS reliable
  FROM ct JOIN hd USING (doc_id) JOIN ci USING (doc_id))"""
LOST = "CASE WHEN reliable THEN list_filter(cited, lambda s: NOT list_contains(heads, regexp_extract(s, '([0-9]+)', 1)::INT)) ELSE []::VARCHAR[] END"
SECT_OWN = SECT.replace("{{", "{").replace("}}", "}").replace("{src}", "text")
SECT_SRC = SECT.replace("{{", "{").replace("}}", "}").replace("{src}", "numbered")


@query("defined_terms", f"""WITH {CONTRACT} SELECT doc_id, term, ((doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT)::BIGINT AS definitions,
  ((length(text) - length(replace(text, term, ''))) // length(term))::BIGINT AS uses FROM ct WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def defined_terms(spark, sf):
    rows = checks.term_counts(v.contracts(spark, sf))
    return rows.select("doc_id", "term", c("definitions").cast("bigint").alias("definitions"), c("uses").cast("bigint").alias("uses"))


@query("section_inventory", f"""WITH {SECT_OWN} SELECT doc_id, array_to_string(list_sort(heads), ',') AS headings, array_to_string(list_sort(cited), ',') AS cited, reliable FROM sec""")
def section_inventory(spark, sf):
    t = c("text")
    rows = v.contracts(spark, sf).select(
        "doc_id", checks.heading_sections(t).alias("h"), checks.cited_sections(t).alias("s"))
    return rows.select(
        "doc_id", F.array_join(F.sort_array("h"), ",").alias("headings"), F.array_join(F.sort_array("s"), ",").alias("cited"),
        checks.numbering_reliable(c("h")).alias("reliable"))


LINT = f"""WITH {SECT_OWN}, defs AS (SELECT doc_id, term, (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT AS n, (length(text) - length(replace(text, term, ''))) // length(term) AS u FROM ct),
finding AS (SELECT doc_id, 'Defined terms' AS category, 'high' AS severity, '"' || term || '" is defined ' || n || ' times — consolidate to one definition to avoid conflicts.' AS detail FROM defs WHERE n > 1
UNION ALL SELECT doc_id, 'Defined terms', 'low', '"' || term || '" is defined but never used — consider removing the definition.' FROM defs WHERE n > 0 AND u <= n
UNION ALL SELECT doc_id, 'Cross-references', 'high', 'Reference to ' || s || ' does not resolve to any section in this document.' FROM (SELECT doc_id, unnest({LOST}) AS s FROM sec)
UNION ALL SELECT doc_id, 'Cross-references', 'medium', 'Schedule C is referenced but no matching Schedule heading was found.' FROM ct WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'Cross-references', 'medium', 'Exhibit B is referenced but no matching Exhibit heading was found.' FROM ct WHERE doc_id % 12 = 0
UNION ALL SELECT doc_id, 'Execution readiness', 'high', 'Unfilled placeholder(s) found: ' || concat_ws(', ', CASE WHEN doc_id % 5 = 0 THEN '____' END,
   CASE WHEN doc_id % 4 = 0 THEN '[DATE], [TBD], TBD' END) || '.' FROM ct WHERE doc_id % 5 = 0 OR doc_id % 4 = 0
UNION ALL SELECT doc_id, 'Execution readiness', 'medium', 'No signature block detected (no "By:/Name:/Title:" or "IN WITNESS WHEREOF").' FROM ct WHERE doc_id % 5 <> 0)"""


@query("lint_findings", f"{LINT} SELECT * FROM finding")
def lint_findings(spark, sf):
    return checks.lint(v.contracts(spark, sf)).drop("ord")


@query("lint_reports", f"""{LINT}, raw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)(?:§\\s*|\\bsections?\\s+|\\bclauses?\\s+|\\barticle\\s+)([0-9]{{1,3}}(?:\\.[0-9]+)*)', 1), lambda x: '§' || x) AS marks FROM ct),
placed AS (SELECT f.*, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS a, CASE WHEN category = 'Defined terms' THEN 1 WHEN detail LIKE 'Reference%' THEN 2
    WHEN detail LIKE 'Exhibit%' THEN 3 WHEN detail LIKE 'Schedule%' THEN 4 WHEN detail LIKE 'Unfilled%' THEN 5 ELSE 6 END AS b,
  coalesce(list_position(marks, regexp_extract(detail, '(§[0-9.]*[0-9])', 1)), 0) AS c FROM finding f JOIN raw USING (doc_id)),
l AS (SELECT doc_id, count(*) AS n, string_agg('- [' || upper(severity) || '] ' || category || ': ' || detail, chr(10) ORDER BY a, b, c) AS plain,
  string_agg('- **' || upper(severity) || '** · ' || category || ': ' || detail, chr(10) ORDER BY a, b, c) AS rich FROM placed GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(n || ' issue(s) found:' || chr(10) || plain, 'No defined-term, cross-reference, or execution-readiness issues found.')) AS report,
  md5(coalesce(chr(10) || chr(10) || '---' || chr(10) || '### Automated document checks' || chr(10) ||
    '_Deterministic checks (not AI) — defined terms, internal cross-references, and execution readiness:_' || chr(10) || rich, '')) AS footer
FROM documents d LEFT JOIN l USING (doc_id)""")
def lint_reports(spark, sf):
    docs = v.contracts(spark, sf)
    reports = checks.lint_reports(docs, checks.lint(docs))
    return reports.select("doc_id", F.md5("report").alias("report"), F.md5("footer").alias("footer"))


@query("citation_checks", f"""WITH {SECT_SRC}, u AS (SELECT doc_id, cited, {LOST} AS bad FROM sec)
SELECT doc_id, array_to_string(list_sort(cited), ',') AS cited, array_to_string(list_sort(bad), ',') AS unverified,
 CASE WHEN len(cited) = 0 THEN '' WHEN len(bad) > 0 THEN 'warn' ELSE 'ok' END AS footer FROM u""")
def citation_checks(spark, sf):
    docs = v.contracts(spark, sf)
    source = F.array_join(F.transform(F.split("body", "\n"), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    bodies = v.texts(spark, sf, "documents").select("doc_id", c("text").alias("body"))
    pairs = docs.select("doc_id", c("text").alias("deliverable")).join(bodies, "doc_id").withColumn("source", source)
    out = checks.verify_citations(pairs)
    foot = checks.citation_footer(c("cited"), c("unverified"))
    return out.select(
        "doc_id", F.array_join(F.sort_array("cited"), ",").alias("cited"), F.array_join(F.sort_array("unverified"), ",").alias("unverified"),
        F.when(foot == "", "").when(F.contains(foot, F.lit("could not be found")), "warn").otherwise("ok").alias("footer"))


# -- redlines ----------------------------------------------------------------------

@query("version_redlines", r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\s+|\S+') AS tok FROM documents),
m AS (SELECT doc_id, text, coalesce(tok[-1], '') = 'the' AS at_end, contains(string_split(text, chr(10))[-1], 'the') AND
    list_contains(regexp_extract_all(string_split(text, chr(10))[-1], '\S+'), 'the') AS last_changes,
  len(list_filter(string_split(text, chr(10)), lambda l: list_contains(regexp_extract_all(l, '\S+'), 'the')))::BIGINT AS k,
  coalesce(array_to_string(list_transform(tok, lambda w: CASE WHEN w = 'the' THEN '<del>the</del><ins>§the</ins>' ELSE w END), ''), '') AS markup FROM t)
SELECT doc_id, k + 1 AS added, k AS removed, md5(CASE WHEN at_end THEN markup[:-7] || chr(10) || 'added line</ins>'
  WHEN last_changes THEN markup || '<ins>' || chr(10) || 'added line</ins>' ELSE markup || chr(10) || '<ins>added line</ins>' END) AS markup FROM m""")
def version_redlines(spark, sf):
    """Every word ``the`` changed, and a line added: the exact markup, white space included."""
    docs = v.texts(spark, sf, "documents").select("doc_id", c("text").alias("old_text"))
    words = F.transform(F.regexp_extract_all("old_text", F.lit(r"(\s+|\S+)")), lambda w: F.when(w == "the", "§the").otherwise(w))
    out = redline.redline(docs.withColumn("new_text", F.concat(F.array_join(words, ""), F.lit("\nadded line"))), ["doc_id"])
    return out.select("doc_id", "added", "removed", F.md5("markup").alias("markup"))


@query("amendment_history", """WITH m AS (SELECT conv_id, turn, text, lag(turn) OVER w AS base, lag(text) OVER w AS old_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
-- Two turns of the given conversations share one line at most, so that the lines they share are the longest common sequence.
k AS (SELECT *, len(list_intersect(string_split(old_text, chr(10)), string_split(text, chr(10)))) AS same FROM m WHERE base IS NOT NULL)
SELECT conv_id AS family, turn AS version, base, md5(regexp_replace(old_text, '\\s+', '', 'g')) AS old_text, md5(regexp_replace(text, '\\s+', '', 'g')) AS new_text,
  len(string_split(text, chr(10))) - same AS added, len(string_split(old_text, chr(10))) - same AS removed FROM k""")
def amendment_history(spark, sf):
    out = registers.amendment_history(v.table(spark, sf, "conversations").select(
        c("conv_id").alias("family"), c("turn").alias("version"), "text"))

    def bare(col):
        return F.md5(F.regexp_replace(col, r"\s+", ""))

    return out.select("family", "version", "base", bare(redline.reject_changes(c("markup"))).alias("old_text"),
                      bare(redline.accept_changes(c("markup"))).alias("new_text"), "added", "removed")


@query("applied_redlines", """SELECT doc_id, CASE WHEN contains(text, ' of ') THEN substr(text, 1, instr(text, ' of ') - 1) || '<del> of </del><ins> under </ins>' || substr(text, instr(text, ' of ') + 4) ELSE text END AS text,
  CASE WHEN contains(text, ' of ') THEN 1 ELSE 0 END::BIGINT AS applied, (CASE WHEN contains(text, ' of ') THEN 0 ELSE 1 END + 1)::BIGINT AS missed FROM documents""")
def applied_redlines(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    steps = F.array(
        F.struct(F.lit(1).cast("bigint").alias("ord"), F.lit(" of ").alias("find"), F.lit(" under ").alias("replacement")),
        F.struct(F.lit(2).cast("bigint").alias("ord"), F.lit("@@nowhere@@").alias("find"), F.lit("x").alias("replacement")))
    edits = docs.select("doc_id", F.explode(steps).alias("e")).select("doc_id", "e.*")
    out = redline.apply_edits(docs, edits)
    return out.select("doc_id", "text", c("applied").cast("bigint").alias("applied"), c("missed").cast("bigint").alias("missed"))


@query("redline_runs", """WITH t AS (SELECT doc_id, lang, replace(text, '*', '') AS text FROM documents)
SELECT doc_id, 0::BIGINT AS pos, 'bold' AS kind, lang AS text FROM t UNION ALL SELECT doc_id, 1, 'plain', text FROM t WHERE text <> ''
UNION ALL SELECT doc_id, CASE WHEN text = '' THEN 1 ELSE 2 END, 'del', 'old ' || lang FROM t UNION ALL SELECT doc_id, CASE WHEN text = '' THEN 2 ELSE 3 END, 'ins', 'new' FROM t""")
def redline_runs(spark, sf):
    docs = v.table(spark, sf, "documents")
    marked = F.concat(F.lit("**"), "lang", F.lit("**"), F.replace("text", F.lit("*"), F.lit("")), F.lit("<del>old "), "lang", F.lit("</del><ins>new</ins>"))
    runs = docs.select("doc_id", F.posexplode(redline.redline_runs(marked)).alias("pos", "r"))
    return runs.select("doc_id", c("pos").cast("bigint").alias("pos"), "r.kind", "r.text")


# -- messages and progress --------------------------------------------------------

@query("deliverable_and_chat", """SELECT conv_id, turn, CASE WHEN turn = min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) THEN 'deliverable' ELSE 'chat' END AS part FROM conversations""")
def deliverable_and_chat(spark, sf):
    return messages.deliverable_and_chat(v.table(spark, sf, "conversations")).select("conv_id", "turn", "part")


@query("token_totals", """WITH t AS (SELECT conv_id, (sum(ceil(length(text) / 4.0)) + 900)::BIGINT AS tokens FROM conversations GROUP BY conv_id)
SELECT conv_id, tokens, round(tokens / 1e6 * 3, 6) AS input_usd, round(tokens / 1e6 * 15, 6) AS output_usd FROM t""")
def token_totals(spark, sf):
    out = messages.token_totals(v.table(spark, sf, "conversations"), ["conv_id"], prompt=True)
    return out.select("conv_id", "tokens", F.round("input_usd", 6).alias("input_usd"), F.round("output_usd", 6).alias("output_usd"))


WEIGHTS = "(VALUES ('Reading documents', 0, 3), ('Summarizing', 3, 3), ('Scanning for repeated logos', 6, 2), ('Checking for changes', 8, 1), ('Rendering documents', 9, 5), ('Numbering documents', 14, 1))"
PROGRESS = f"""pr AS (SELECT user_id AS collection, ts, event_id, CASE event_type WHEN 'view' THEN 'Reading documents' WHEN 'click' THEN 'Scanning for repeated logos'
  WHEN 'signup' THEN 'Checking for changes' WHEN 'purchase' THEN 'Rendering documents' ELSE 'Cleaning up' END AS phase, floor(value)::BIGINT AS done, 400 AS total FROM events),
pc AS (SELECT pr.*, CASE WHEN w.phase IS NULL THEN floor(done / 400.0 * 100 + 0.5) ELSE floor((b + k * least(1.0, done / 400.0)) / 15.0 * 100 + 0.5) END::BIGINT AS pct
  FROM pr LEFT JOIN {WEIGHTS} w(phase, b, k) USING (phase))"""


@query("run_progress", f"WITH {PROGRESS} SELECT collection, event_id, pct, max(pct) OVER (PARTITION BY collection ORDER BY ts, event_id)::BIGINT AS shown FROM pc")
def run_progress(spark, sf):
    return messages.never_retreating(v.progress(spark, sf)).select("collection", "event_id", "pct", "shown")


@query("paired_activities", """WITH e AS (SELECT event_id // 2 AS id, event_id % 2 = 0 AS s, epoch_us(ts) AS t, event_type, value FROM events)
SELECT id, max(CASE WHEN s THEN event_type END) AS name, max(CASE WHEN s THEN t END)::BIGINT AS started_us, coalesce(max(CASE WHEN NOT s THEN t END), -1)::BIGINT AS ended_us,
 coalesce(max(CASE WHEN NOT s THEN CASE WHEN event_type <> 'error' THEN 'ok' ELSE 'failed' END END), 'open') AS state FROM e GROUP BY id HAVING max(CASE WHEN s THEN t END) IS NOT NULL""")
def paired_activities(spark, sf):
    e = v.table(spark, sf, "events")
    rows = e.select(
        F.floor(c("event_id") / 2).cast("bigint").alias("id"), F.when(c("event_id") % 2 == 0, "start").otherwise("end").alias("type"),
        c("ts").cast("timestamp").alias("ts"), c("event_type").alias("name"), (c("event_type") != "error").alias("ok"), c("event_type").alias("summary"))
    out = messages.paired_activities(rows)
    state = F.when(c("ok").isNull(), "open").when(c("ok"), "ok").otherwise("failed")
    return out.select(
        "id", "name", F.unix_micros("started_at").alias("started_us"), F.coalesce(F.unix_micros("ended_at"), F.lit(-1)).alias("ended_us"),
        state.alias("state"))


# -- registers -----------------------------------------------------------------------

@query("renewal_register", """WITH t AS (SELECT o_orderkey AS contract, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS nr, (30 + o_orderkey % 4 * 15)::INT AS nd FROM orders),
u AS (SELECT contract, nr - nd AS cb FROM t)
SELECT contract, coalesce(cb::VARCHAR, '') AS cancel_by, cb IS NULL AS ambiguous, coalesce(cb - DATE '1998-01-01' BETWEEN 0 AND 90, false) AS flag FROM u""")
def renewal_register(spark, sf):
    terms = v.table(spark, sf, "orders").select(
        c("o_orderkey").alias("contract"), F.when(c("o_orderkey") % 10 != 0, F.to_date("o_orderdate")).alias("next_renewal"),
        (30 + c("o_orderkey") % 4 * 15).cast("int").alias("notice_days"))
    out = registers.renewal_register(terms, F.to_date(F.lit("1998-01-01")))
    return out.select("contract", text.blank(c("cancel_by")).alias("cancel_by"), "ambiguous", "flag")


@query("chronology", """SELECT strftime(CASE WHEN o_orderkey % 4 = 2 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') AS date,
  CASE WHEN o_orderkey % 4 IN (2, 3) THEN '~' ELSE '' END || strftime(CASE WHEN o_orderkey % 4 = 2 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') AS shown,
  o_orderkey % 4 IN (2, 3) AS approximate, 'note-' || o_orderkey AS source, 1::BIGINT AS line_no FROM orders WHERE o_orderkey % 5 <> 0""")
def chronology(spark, sf):
    return registers.chronology(_notes(spark, sf)).drop("event")


@query("undated_documents", "SELECT 'note-' || o_orderkey AS name FROM orders WHERE o_orderkey % 5 = 0")
def undated_documents(spark, sf):
    return registers.undated(_notes(spark, sf))


def _notes(spark, sf):
    d, n = c("o_orderdate"), c("o_orderkey") % 4
    day = (
        F.when(n == 0, F.date_format(d, "yyyy-MM-dd")).when(n == 1, F.date_format(d, "d MMMM yyyy"))
        .when(n == 2, F.date_format(d, "MMMM yyyy")).otherwise(F.concat(F.lit("about "), F.date_format(d, "MMMM d, yyyy"))))
    body = F.when(c("o_orderkey") % 5 == 0, "no date given").otherwise(F.concat(F.lit("Order placed on "), day, F.lit(" by the client.")))
    return v.table(spark, sf, "orders").select(
        F.concat(F.lit("note-"), c("o_orderkey").cast("string")).alias("name"), F.concat(F.lit("File note\n"), body).alias("text"))


def _cell(word: str) -> str:
    hit = f"list_filter(string_split(numbered, chr(10)), lambda l: contains(lower(l), '{word}'))[1]"
    return f"coalesce('§' || regexp_extract({hit}, '^\\s*([0-9]{{1,3}})[.]\\s', 1) || ': ' || trim({hit}), 'Not addressed')"


@query("clause_matrix", f"""WITH {CONTRACT} SELECT doc_id, {_cell('nicht')} AS denial, {_cell('tion')} AS action FROM ct""")
def clause_matrix(spark, sf):
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    docs = v.table(spark, sf, "documents").select("doc_id", numbered.alias("text"))
    return registers.clause_matrix(docs, {"denial": ["nicht"], "action": ["tion"]})


@query("privilege_log", f"""WITH {EMAILS} SELECT doc_id, date, sender || ' → ' || recipient AS author_recipients, subject AS description, '' AS claim, '' AS basis, '' AS confidence FROM emails""")
def privilege_log(spark, sf):
    return registers.privilege_log(v.emails(spark, sf))


# -- outputs ---------------------------------------------------------------------------

@query("csv_lines", f"""WITH {FULL} SELECT concat_ws(',', beg_bates, end_bates, span::VARCHAR, date, doc_type, sender, recipient, '"' || subject || ', ""x""' || chr(34), file_rel,
  CASE WHEN att_count > 0 THEN att_count::VARCHAR ELSE '' END) AS line FROM full_rec""")
def csv_lines(spark, sf):
    rows = full_records(spark, sf).withColumn("subject", F.concat("subject", F.lit(', "x"')))
    table = prod.review_index(rows)
    return table.select(sinks.lines(table, "csv", prod.REVIEW_COLUMNS).alias("line"))


@query("dat_lines", f"""WITH {FULL} SELECT 'þ' || concat_ws('þ' || chr(20) || 'þ', beg_bates, end_bates, beg_attach, end_attach, '', date, sender, recipient, '', subject || ' a b', doc_type, file_rel, native_rel, span::VARCHAR, '') || 'þ' AS line FROM full_rec""")
def dat_lines(spark, sf):
    rows = full_records(spark, sf).withColumn("subject", F.concat("subject", F.lit(" \u0014aþ\r\nb")))
    table = prod.load_file(rows)
    return table.select(sinks.lines(table, "dat", prod.LOAD_COLUMNS).alias("line"))


@query("dat_lines_web", f"""WITH {FULL} SELECT 'þ' || concat_ws('þ' || chr(20) || 'þ', beg_bates, end_bates, beg_attach, end_attach, '', date, sender, recipient, '',
  subject || ' ' || chr(20) || 'a' || chr(13) || chr(10) || 'b', doc_type, file_rel, native_rel, span::VARCHAR, '') || 'þ' AS line FROM full_rec""")
def dat_lines_web(spark, sf):
    """The browser takes only the qualifier out of values."""
    rows = full_records(spark, sf).withColumn("subject", F.concat("subject", F.lit(" \u0014aþ\r\nb")))
    table = prod.load_file(rows)
    return table.select(sinks.lines(table, "dat", prod.LOAD_COLUMNS, "web").alias("line"))


@query("address_lists", """SELECT o_orderkey AS doc_id, 'c' || o_custkey || '@b.example; ' || o_orderpriority || '; ' || o_clerk AS desktop, 'c' || o_custkey || '@b.example, ' || o_orderpriority || ', ' || o_clerk AS web FROM
 (SELECT o_orderkey, o_custkey, o_orderpriority, 'clerk' || (o_orderkey % 7) AS o_clerk FROM orders)""")
def address_lists(spark, sf):
    people = F.array(F.concat(F.lit("c"), c("o_custkey").cast("string"), F.lit("@b.example")), "o_orderpriority", F.concat(F.lit("clerk"), (c("o_orderkey") % 7).cast("string")))
    return v.table(spark, sf, "orders").select(
        c("o_orderkey").alias("doc_id"), text.address_list(people).alias("desktop"), text.address_list(people, "web").alias("web"))


@query("sql_functions", f"""WITH {CORPUS} SELECT doc_id, lower(name) || '|' || length(text) AS fp, 'DOC-' || printf('%06d', doc_id) AS label,
  bit_count(xor(doc_id, length(text)))::BIGINT AS bits, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) BETWEEN 2 AND 40 AND NOT list_contains([{STOP}], w)))::BIGINT AS tokens FROM corpus""")
def sql_functions(spark, sf):
    """The same functions from SQL text; the id of a path agrees with the column form."""
    from foliant.functions.sql import register_functions

    register_functions(spark)
    v.corpus(spark, sf).createOrReplaceTempView("sql_corpus")
    out = spark.sql("""SELECT doc_id, path, fingerprint(concat('\u00a0 ', upper(name), '\t'), length(text)) AS fp, bates_label('DOC-', doc_id) AS label,
      CAST(hamming64(doc_id, length(text)) AS BIGINT) AS bits, CAST(size(tokenize(text)) AS BIGINT) AS tokens, djb2_id(path) AS id FROM sql_corpus""")
    return out.filter(c("id") == text.path_id(c("path"))).drop("path", "id")


@query("opt_lines", f"""WITH {FULL}, p AS (SELECT *, unnest(range(span)) AS page FROM full_rec)
SELECT concat_ws(',', 'DOC-' || printf('%06d', beg_no + page), '', replace(replace(file_rel, '/', chr(92)), '.pdf', ' x.pdf'),
  CASE WHEN page = 0 THEN 'Y' ELSE '' END, '', '', CASE WHEN page = 0 THEN span::VARCHAR ELSE '' END) AS line FROM p""")
def opt_lines(spark, sf):
    rows = full_records(spark, sf).withColumn("file_rel", F.replace("file_rel", F.lit(".pdf"), F.lit(",x.pdf")))
    pages = prod.opticon_rows(rows, "DOC-").drop("page")
    return pages.select(sinks.lines(pages, "opt", pages.columns).alias("line"))


@query("output_names", f"""WITH {ATT}, n AS (SELECT DISTINCT name || CASE WHEN part_id % 3 = 0 THEN '.pdf' WHEN part_id % 3 = 1 THEN ':a.png' ELSE '' END AS nm, size, coalesce(dhash, 'none') AS dh FROM att)
SELECT nm, size, dh, replace(nm, ':', '_') AS safe, CASE WHEN nm LIKE '%.pdf' THEN nm ELSE nm || '.pdf' END AS pdf,
  regexp_extract(nm, '^(.*?)(\\.[^.]*)?$', 1) || ' (' || size || ' bytes, dh=' || dh || ')' || regexp_extract(nm, '(\\.[^.]*)$', 1) AS decorated,
  CASE WHEN nm LIKE '%.%' THEN nm ELSE 'DOC-000007 - ' || nm || ' (' || size || ' bytes, dh=' || dh || ')' END AS back,
  replace(regexp_extract(nm, '^(.*?)(\\.[^.]*)?$', 1), ':', '_') || '.pdf' AS imaged FROM n""")
def output_names(spark, sf):
    part = c("part_id") % 3
    nm = F.concat("name", F.when(part == 0, ".pdf").when(part == 1, ":a.png").otherwise(""))
    rows = v.attachments(spark, sf).select(
        nm.alias("nm"), "size", F.coalesce(_hex(c("dhash")), F.lit("none")).alias("dh")).distinct()
    deco = names.decorate_name(c("nm"), c("size"), c("dh"))
    full = names.bates_name(F.lit("DOC-000007"), deco)
    back = names.undecorate_name(full, "DOC-")
    return rows.select(
        "nm", "size", "dh", names.safe_name(c("nm")).alias("safe"), names.single_pdf_ext(names.pdf_name(c("nm"))).alias("pdf"),
        deco.alias("decorated"), F.when(F.contains("nm", F.lit(".")), back).otherwise(full).alias("back"),
        names.attachment_pdf_name(c("nm")).alias("imaged"))


def _hex(col):
    from foliant.functions.hashing import long_to_hex

    return long_to_hex(col)


@query("document_types", f"""WITH {ATT}, n AS (SELECT DISTINCT part_id, name || (['.pdf', '.xlsx', '.PNG', '.zip', ''])[(part_id % 5 + 1)::INT] AS nm FROM att)
SELECT nm, CASE part_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'Spreadsheet' WHEN 2 THEN 'Image' WHEN 3 THEN 'ZIP' ELSE 'Document' END AS web, part_id % 5 = 2 AS image,
  CASE WHEN part_id % 3 = 0 THEN 'NDA' WHEN part_id % 3 = 1 THEN 'Email' ELSE 'Document' END AS desktop, part_id FROM n""")
def document_types(spark, sf):
    rows = v.attachments(spark, sf).select("part_id", F.concat("name", F.element_at(
        F.array(*[F.lit(x) for x in (".pdf", ".xlsx", ".PNG", ".zip", "")]), (c("part_id") % 5 + 1).cast("int"))).alias("nm")).distinct()
    kind = F.when(c("part_id") % 3 == 1, "email").otherwise("doc")
    return rows.select(
        "nm", names.doc_type_web(c("nm")).alias("web"), names.is_image_name(c("nm")).alias("image"),
        names.doc_type(kind, F.when(c("part_id") % 3 == 0, "NDA")).alias("desktop"), "part_id")


@query("highlight_table", """WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT 'doc-' || doc_id AS "Document", CASE WHEN i = 1 THEN '' ELSE i::VARCHAR END AS "Page", lang AS "Colour", trim(line) AS "Highlight", line AS "Context" FROM l""")
def highlight_table(spark, sf):
    """Every line of every document is marked, with the whole line as its context."""
    return highlights.highlight_table(_marked(spark, sf))


def _marked(spark, sf):
    marks = F.transform(F.split("text", "\n", -1), lambda s, i: F.struct(
        F.trim(s).alias("text"), c("lang").alias("color"), F.when(i > 0, i + 1).alias("page"), s.alias("context")))
    return v.texts(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("name"), marks.alias("highlights"))


@query("highlight_totals", "SELECT sum(len(string_split(text, chr(10))))::BIGINT AS marks, count(*)::BIGINT AS docs FROM documents")
def highlight_totals(spark, sf):
    return highlights.highlight_totals(_marked(spark, sf))


# A page of 50 lines; every third line slopes down by 3 units from left to right, so that it still is one line.
PAGE = """l AS (SELECT doc_id, lang, i - 1 AS n, regexp_extract_all(string_split(text, chr(10))[i], '\\S+') AS words
  FROM (SELECT doc_id, lang, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
items AS (SELECT doc_id, n // 50 AS page, w AS str, 7.0 * (j - 1) AS x0, 7.0 * (j - 1) + 6 AS x1, y0, y0 + 10 AS y1 FROM (
  SELECT doc_id, n, words[j] AS w, j, 700.0 - 12 * (n % 50) - CASE WHEN n % 3 = 0 THEN 3 * (j - 1) / len(words) ELSE 0 END AS y0
  FROM (SELECT doc_id, n, words, unnest(range(1, len(words) + 1)) AS j FROM l)))"""


def _lines(spark, sf):
    words = F.regexp_extract_all("line", F.lit(r"(\S+)"))
    lines = v.texts(spark, sf, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("doc_id", "lang", "n", words.alias("words"))


def _items(spark, sf):
    slope = F.when(c("n") % 3 == 0, 3 * c("j") / F.size("words")).otherwise(0.0)
    rows = _lines(spark, sf).select("doc_id", "n", "words", F.posexplode("words").alias("j", "str"))
    rows = rows.select("doc_id", F.floor(c("n") / 50).alias("page"), "str", (7.0 * c("j")).alias("x0"), (700.0 - 12 * (c("n") % 50) - slope).alias("y0"))
    return rows.withColumn("x1", c("x0") + 6).withColumn("y1", c("y0") + 10)


@query("reading_order", f"""WITH {PAGE}, g AS (SELECT *, CASE WHEN lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, x0, str) - y0 <= 4 THEN 0 ELSE 1 END AS opens FROM items),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, x0, str ROWS UNBOUNDED PRECEDING) - 1 AS line FROM g),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page, line ORDER BY x0, y0 DESC, str) - 1) // 4096 AS piece FROM n)
SELECT doc_id, page, line::BIGINT AS line, piece, md5(string_agg(str, ' ' ORDER BY x0, y0 DESC, str)) AS text FROM r GROUP BY ALL""")
def reading_order(spark, sf):
    """Every word of every document, placed on pages and put back into lines."""
    return highlights.reading_lines(_items(spark, sf), ["doc_id", "page"]).withColumn("text", F.md5("text"))


@query("marked_passages", f"""WITH {PAGE}, marks AS (SELECT doc_id, n // 50 AS page, n AS mark_no, lang, len(words) AS k, 700.0 - 12 * (n % 50) AS top FROM l WHERE len(words) > 0),
-- Two boxes: the second to fourth word of the line, and all but the first of the line below.
boxes AS (SELECT doc_id, page, mark_no, 7.0 AS bx0, 27.0 AS bx1, top + 1 AS by0, top + 9 AS by1 FROM marks
  UNION ALL SELECT doc_id, page, mark_no, 7.0, 7.0 * k, top - 11, top - 3 FROM marks),
pairs AS (SELECT m.doc_id, m.page, m.mark_no, i.*, EXISTS (SELECT 1 FROM boxes b WHERE b.doc_id = m.doc_id AND b.page = m.page AND b.mark_no = m.mark_no
    AND (x0 + x1) / 2 >= bx0 - 1 AND (x0 + x1) / 2 <= bx1 + 1 AND i.y1 > by0 AND i.y0 < by1) AS under
  FROM marks m JOIN items i ON i.doc_id = m.doc_id AND i.page = m.page AND i.y1 > m.top - 13 AND i.y0 < m.top + 11),
ordered AS (SELECT *, 1 AS part FROM pairs WHERE under UNION ALL SELECT *, 2 FROM pairs),
g AS (SELECT *, CASE WHEN lag(y0) OVER w - y0 <= 4 THEN 0 ELSE 1 END AS opens FROM ordered WINDOW w AS (PARTITION BY doc_id, page, mark_no, part ORDER BY y0 DESC, x0, str)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page, mark_no, part ORDER BY y0 DESC, x0, str ROWS UNBOUNDED PRECEDING) AS line FROM g),
t AS (SELECT doc_id, page, mark_no, part, string_agg(str, ' ' ORDER BY line, x0, y0 DESC, str) AS text FROM n GROUP BY ALL)
SELECT a.doc_id, a.page, a.mark_no, md5(a.text) AS text, CASE WHEN lang = 'en' THEN 'yellow' ELSE '#0a6440' END AS color, md5(b.text) AS context
FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND a.mark_no = b.mark_no AND a.part = 1 AND b.part = 2
JOIN marks m ON m.doc_id = a.doc_id AND m.mark_no = a.mark_no""")
def marked_passages(spark, sf):
    """Every line of every document marked with two boxes, against all words of its page."""
    top = 700.0 - 12 * (c("n") % 50)
    k = F.size("words").cast("double")

    def quad(x0, x1, y0, y1):
        return [x0, y1, x1, y1, x0, y0, x1, y0]

    corners = F.array(*(F.lit(p) if isinstance(p, float) else p for p in [*quad(7.0, 27.0, top + 1, top + 9), *quad(7.0, 7.0 * k, top - 11, top - 3)]))
    none = F.array(*[F.lit(0.0)] * 4)
    marks = _lines(spark, sf).filter(F.size("words") > 0).select(
        "doc_id", F.floor(c("n") / 50).alias("page"), c("n").cast("bigint").alias("mark_no"), highlights.quad_boxes(corners, none).alias("boxes"),
        F.when(c("lang") == "en", F.array(F.lit(250), F.lit(240), F.lit(10))).otherwise(F.array(F.lit(10), F.lit(100), F.lit(64))).alias("rgb"))
    out = highlights.marked_passages(marks, _items(spark, sf))
    return out.withColumns({"text": F.md5("text"), "context": F.md5("context")})


@query("collection_catalogue", "SELECT source AS id, max(doc_id)::BIGINT AS updated_at, count(*)::BIGINT AS files FROM documents GROUP BY source")
def collection_catalogue(spark, sf):
    from foliant.sources.snapshots import collections

    return collections(v.table(spark, sf, "documents").groupBy(c("source").alias("id")).agg(
        F.max("doc_id").alias("updated_at"), F.count("*").alias("files")))


@query("enrichment_merge", """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN upper(lang) ELSE 'old' END AS doc_type, CASE WHEN doc_id % 3 <> 0 THEN 'about ' || md5(text) ELSE 'kept' END AS summary FROM documents""")
def enrichment_merge(spark, sf):
    """Labels from a deterministic stand-in for the user's labelling function, which reads whole texts."""
    import hashlib

    from foliant.operators.incremental import enrich, merge_enrichment

    done = c("doc_id") % 3 == 0
    docs = v.table(spark, sf, "documents").select(
        "doc_id", c("lang").alias("name"), F.lit("doc").alias("kind"), F.lit("").alias("subject"), F.lit("").alias("from"), F.lit("").alias("to"),
        c("text").alias("head"), F.when(done, "kept").alias("summary"), F.when(done, "old").alias("doc_type"),
        F.lit(None).cast("array<string>").alias("parties"))

    def label(items):
        return [{"id": i["id"], "docType": i["name"].upper(), "summary": "about " + hashlib.md5(i["excerpt"].encode()).hexdigest(), "parties": []} for i in items]

    return merge_enrichment(docs, enrich(docs, label)).select("doc_id", "doc_type", "summary")


# -- messages from bytes -----------------------------------------------------------

MAILS = """m AS (SELECT o_orderkey AS id, 'mail/' || o_orderkey || '.eml' AS path, 'clerk' || (o_orderkey % 7) || '@a.example' AS sender,
  'c' || o_custkey || '@b.example' AS recipient, CASE WHEN o_orderkey % 3 = 0 THEN 'cc@c.example' ELSE '' END AS cc,
  'Order ' || o_orderkey AS subject, 'Total is ' || o_orderstatus || ' for ' || o_custkey AS body FROM orders)"""


def mail_files(spark, sf):
    """Messages as bytes, put together by Spark: a plain part, and two attachments in every second message."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit("\r\n"))
    key, cust = c("o_orderkey"), c("o_custkey")
    plain = F.concat(F.lit("Total is "), c("o_orderstatus"), F.lit(" for "), cust.cast("string"))
    head = F.concat(
        line("From: clerk", key % 7, "@a.example"), line("To: c", cust, "@b.example"),
        F.when(key % 3 == 0, line("Cc: cc@c.example")).otherwise(""), line("Subject: Order", "\r\n ", key))
    packed = lambda tag: F.base64(F.concat(F.lit(tag), key.cast("string")).cast("binary"))
    attached = lambda tag, name: F.concat(
        line("--b1"), line("Content-Type: image/png"), line("Content-ID: <", F.lit(tag), ">"),
        line('Content-Disposition: attachment; filename="', F.lit(name), '"'), line("Content-Transfer-Encoding: base64"), line(""), line(packed(tag)))
    multi = F.concat(
        head, line('Content-Type: multipart/mixed; boundary="b1"'), line(""), line("--b1"), line("Content-Type: text/plain"), line(""), line(plain),
        attached("one", "One.PNG "), attached("two", "two.png"), line("--b1--"))
    text_ = F.when(key % 2 == 0, multi).otherwise(F.concat(head, line(""), plain))
    orders = v.spread(v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return orders.select(
        F.concat(F.lit("mail/"), key.cast("string"), F.lit(".eml")).alias("path"), F.encode(text_, "UTF-8").alias("content"))


@query("parsed_emails", f"""WITH {MAILS} SELECT path, sender AS "from", recipient AS "to", cc, subject, body FROM m""")
def parsed_emails(spark, sf):
    from foliant.sources import email

    return email.parse_emails(mail_files(spark, sf)).select("path", "from", "to", "cc", "subject", "body")


@query("parsed_attachments", f"""WITH {MAILS}, a(i, tag, name) AS (VALUES (0, 'one', 'one.png'), (1, 'two', 'two.png'))
SELECT path, i AS att_idx, tag AS content_id, name, length(tag || id)::BIGINT AS size, sha256(tag || id) AS sha FROM m, a WHERE id % 2 = 0""")
def parsed_attachments(spark, sf):
    from foliant.sources import email

    rows = email.attachment_rows(email.parse_attachments(mail_files(spark, sf)))
    return rows.select("path", "att_idx", "content_id", "name", "size", "sha")


@query("mail_header_fields", f"""WITH {MAILS} SELECT path, subject, cc FROM m""")
def mail_header_fields(spark, sf):
    from foliant.sources import email

    fields = email.header_fields(F.decode("content", "UTF-8"))
    return mail_files(spark, sf).select("path", fields.alias("h")).select(
        "path", c("h.subject").alias("subject"), F.coalesce(c("h.cc"), F.lit("")).alias("cc"))


INLINE = """li AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem),
refs AS (SELECT path, n AS ref_no, CASE WHEN n % 2 = 0 THEN 'c' || n ELSE 'gone' || n END AS cid FROM li),
atts AS (SELECT path, n AS att_idx, CASE WHEN n % 2 = 0 OR n % 5 = 1 THEN 'c' || n ELSE '' END AS content_id FROM li)"""


@query("inline_references", f"""WITH {INLINE}, known AS (SELECT path, content_id AS cid, max(att_idx) AS att_idx FROM atts WHERE content_id <> '' GROUP BY ALL),
b AS (SELECT refs.*, known.att_idx FROM refs LEFT JOIN known USING (path, cid)),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ref_no) AS n FROM b WHERE att_idx IS NULL),
s AS (SELECT path, att_idx, row_number() OVER (PARTITION BY path ORDER BY att_idx) AS n FROM atts a WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.path = a.path AND r.cid = a.content_id))
SELECT path, ref_no, att_idx FROM b WHERE att_idx IS NOT NULL UNION ALL SELECT o.path, o.ref_no, s.att_idx FROM o LEFT JOIN s ON s.path = o.path AND s.n = o.n""")
def inline_references(spark, sf):
    from pyspark.sql import Window as W

    from foliant.sources import email

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = v.table(spark, sf, "lineitem").select(c("l_orderkey").alias("path"), (F.row_number().over(order) - 1).cast("bigint").alias("n"))
    n = c("n").cast("string")
    refs = rows.select("path", c("n").alias("ref_no"), F.when(c("n") % 2 == 0, F.concat(F.lit("c"), n)).otherwise(F.concat(F.lit("gone"), n)).alias("cid"))
    atts = rows.select("path", c("n").alias("att_idx"), F.when((c("n") % 2 == 0) | (c("n") % 5 == 1), F.concat(F.lit("c"), n)).otherwise("").alias("content_id"))
    return email.resolve_inline(refs, atts).select("path", "ref_no", "att_idx")
