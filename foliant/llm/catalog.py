"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import (
    chat, decontaminate, frames, licences, line_dedup, merkle, mixing, pii, quality, rule_ensemble, secret_scan, sharding, simhash,
)
from foliant.llm.common import table
from foliant.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHARD_BYTES = 8 << 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    r"""
    WITH lines AS (
      SELECT doc_id, pos, line,
        translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
    ), homes AS (
      SELECT k, max(doc_id) AS home FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
    )
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE home IS NOT NULL AND home <> doc_id)::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE home IS NULL OR home = doc_id), '')) AS kept_sha256
    FROM lines LEFT JOIN homes USING (k) GROUP BY doc_id
    """
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    f"""
    WITH rows_ AS (
      SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
    ), up AS (
      SELECT doc_id, n_bytes, d, h >> (60 - d) AS prefix FROM rows_, (SELECT unnest(generate_series(0, 40))::INTEGER AS d)
    ), fits AS (
      SELECT d, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM up GROUP BY d, prefix
      HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1
    ), leaf AS (
      SELECT doc_id, n_bytes, min(d) AS local_depth, arg_min(prefix, d) AS prefix, arg_min(shard_bytes, d) AS shard_bytes,
        arg_min(shard_rows, d) AS shard_rows
      FROM up JOIN fits USING (d, prefix) GROUP BY doc_id, n_bytes
    )
    SELECT doc_id, n_bytes, 'b' || CASE WHEN local_depth = 0 THEN '' ELSE lpad(bin(prefix), local_depth, '0') END AS shard,
      local_depth, shard_bytes, shard_rows FROM leaf
    """
)
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


CHAT_BUDGET, CHAT_HISTORY = 2048, 512


@query(
    rf"""
    WITH rows_ AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
    ), turns AS (
      SELECT *, (ceil(strlen(text) / 4.0) + 4)::BIGINT AS tok,
        length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24 AS piece,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM rows_
    ), placed AS (
      SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p,
        n = 1 AND role = 'system' AS is_sys,
        coalesce(max(CASE WHEN n = 1 AND role = 'system' THEN tok END) OVER (PARTITION BY conv_id), 0) AS sys_tok,
        coalesce(max(CASE WHEN n = 1 AND role = 'system' THEN piece END) OVER (PARTITION BY conv_id), 0) AS sys_piece FROM turns
    ), celled AS (
      SELECT *, greatest({CHAT_BUDGET - CHAT_HISTORY} - sys_tok, {CHAT_BUDGET // 4}) AS g FROM placed
    ), spanned AS (
      SELECT *, 2 * (p // g) + ((p + tok - 1) // g > p // g)::INTEGER AS span FROM celled
    ), spans AS (
      SELECT conv_id, span, min(p) AS s, sum(piece) + CASE WHEN bool_or(is_sys) THEN 0 ELSE max(sys_piece) END AS chars
      FROM spanned GROUP BY conv_id, span
    ), history AS (
      SELECT a.conv_id, sum(b.piece) AS chars FROM spans a JOIN placed b
        ON a.conv_id = b.conv_id AND b.p BETWEEN a.s - {CHAT_HISTORY} AND a.s - 1 AND NOT b.is_sys GROUP BY a.conv_id
    ), sizes AS (
      SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM
        (SELECT conv_id, chars FROM spans UNION ALL SELECT conv_id, chars FROM history) GROUP BY conv_id
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      any_value(formatted_chars) AS formatted_chars
    FROM turns JOIN sizes USING (conv_id) GROUP BY conv_id
    """
)
def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.digests(chat.format_windows(turns, CHAT_BUDGET, CHAT_HISTORY))


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select(
        "doc_id", *(f"_stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"),
    )


@query()
def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.document_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Domains of the labels, and the shares of tokens that they are to have.
DOMAIN = "CASE WHEN quality = 0 THEN 'low' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'clean' END"
TARGETS = {"clean": 0.90, "low": 0.04, "toxic": 0.06}


@query()
def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, steps, _ = mixing.fit_rates(docs, table(spark, sf_dir, "labels"), F.expr(DOMAIN), TARGETS)
    rated = mixing.with_rates(docs, model, steps)
    return rated.select(
        "doc_id", F.col("_n").alias("n_tokens"), *(F.get("_p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)),
        F.col("_rate").alias("rate"), F.col("_copies").alias("copies"),
    )


@query()
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The texts have no file names: a document lies in its source and language, and short ones stand for notice files.
PATH = "concat_ws('/', source, lang, CAST(floor(doc_id / 64) AS STRING), CASE WHEN n_chars < 200 THEN 'NOTICE' ELSE concat(doc_id, '.md') END)"
#: Labels of findings in the labelled documents. Surely real: letters and digits that a key's name is assigned, or a provider's
#: form. Surely not: without such a name, a hash or identifier that is called so, a part of an address, a UUID, a path of words,
#: words, digits alone and bare signs. Everything else is null and is not trained on.
REAL_SECRET = f"""CASE WHEN value RLIKE '^(AKIA|ASIA)[0-9A-Z]{{16}}$' THEN true
  WHEN context = 'key' THEN CASE WHEN value RLIKE '[0-9]' AND value RLIKE '[A-Za-z]' THEN true END
  WHEN context IN ('hash', 'url') OR value RLIKE '{secret_scan.UUID}' THEN false
  WHEN value RLIKE '^([A-Z]?[a-z]+[0-9]{{0,4}}|[A-Z]+)([/_-]+([A-Z]?[a-z]+[0-9]{{0,4}}|[A-Z]+))*$' OR value RLIKE '^[0-9]+(-[0-9]+)*$' OR value RLIKE '^[+/_=-]+$' THEN false END"""


@query()
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.expr(REAL_SECRET), path=F.expr(PATH)
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
_ANCHOR = f"regexp_matches({{}}, {_quoted(licences.ANCHOR)})"
_FOLDER = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


@query(
    f"""
    WITH tpl(licence, template, title) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)}, {full})" for full, some in (("false", licences.TEMPLATES), ("true", licences.TITLES)) for n, t in some)}),
    t AS (SELECT row_number() OVER () AS t, licence, template, title FROM tpl),
    tt AS (SELECT t, licence, title, term, count(*) AS tf FROM (SELECT t, licence, title, unnest({_TERMS.format("template")}) AS term FROM t) GROUP BY ALL),
    docs AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, (doc_id // 64)::VARCHAR,
      CASE WHEN n_chars < 200 THEN 'NOTICE' ELSE doc_id || '.md' END) AS path FROM documents),
    n AS (SELECT count(*) AS n FROM docs),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS.format("text")})) AS term FROM docs) GROUP BY term),
    idf AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), n),
    held AS (SELECT * FROM docs WHERE {_ANCHOR.format("text")}),
    bare AS (SELECT *, array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, {_quoted(licences.MARKS)}, '')), chr(10)) AS plain FROM held),
    parts AS (SELECT doc_id, path, text, unnest(string_split(text, chr(10))) AS u FROM held
      UNION ALL SELECT doc_id, path, text, replace(unnest(regexp_split_to_array(plain, '\n\n+')), chr(10), ' ') FROM bare),
    units AS (SELECT DISTINCT doc_id, path, length(text) >= {licences.FULL_CHARS} AS long, false AS whole, u AS unit FROM parts
      WHERE {_ANCHOR.format("u")} UNION ALL SELECT doc_id, path, length(text) >= {licences.FULL_CHARS}, true, text FROM held),
    du AS (SELECT row_number() OVER () AS h, unit FROM (SELECT DISTINCT unit FROM units)),
    uw AS (SELECT h, term, count(*) * coalesce(any_value(idf), any_value(ln(n + 1) + 1)) AS w, any_value(idf) IS NOT NULL AS known
      FROM (SELECT h, unnest({_TERMS.format("unit")}) AS term FROM du) LEFT JOIN idf USING (term), n GROUP BY h, term),
    un AS (SELECT h, sqrt(sum(w * w)) AS norm FROM uw GROUP BY h),
    tn AS (SELECT t, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tt JOIN idf USING (term) GROUP BY t),
    score AS (SELECT h, licence, title, round(sum(uw.w / un.norm * tf * idf / tn.norm), 6) AS score FROM uw JOIN un USING (h) JOIN tt USING (term)
      JOIN idf USING (term) JOIN tn USING (t) WHERE known GROUP BY h, licence, title, t),
    per AS (SELECT h, licence, title, score FROM score QUALIFY row_number() OVER (PARTITION BY h, licence ORDER BY score DESC, title DESC) = 1),
    best AS (SELECT h, licence, title, score FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY score DESC, licence) AS place,
      lead(score, 1, 0) OVER (PARTITION BY h ORDER BY score DESC, licence) AS second FROM per)
      WHERE place = 1 AND score >= 0.6 AND round(score - second, 6) >= {licences.MARGIN}),
    hit AS (SELECT doc_id, path, whole OR (title AND long) AS whole, licence, score FROM units JOIN du USING (unit) JOIN best USING (h)),
    own AS (SELECT doc_id, path, licence, score, bool_or(whole) OVER (PARTITION BY doc_id, path) AS whole FROM hit
      QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, licence) = 1),
    dir AS (SELECT {_FOLDER} AS above, licence, score FROM own
      WHERE whole OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), {_quoted(licences.FILE_NAMES)})
      QUALIFY row_number() OVER (PARTITION BY {_FOLDER} ORDER BY score DESC, path, licence) = 1),
    ids AS (SELECT doc_id, path, {_FOLDER} AS folder FROM docs),
    near AS (SELECT folder, above, licence, score FROM (SELECT DISTINCT folder FROM ids) f JOIN dir
      ON above = folder OR above = '' OR starts_with(folder, above || '/') QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) = 1)
    SELECT ids.doc_id, ids.path, coalesce(own.licence, near.licence) AS licence,
      CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' END AS origin,
      coalesce(own.score, near.score) AS score, CASE WHEN own.licence IS NULL THEN near.above END AS from_folder
    FROM ids LEFT JOIN own ON own.doc_id = ids.doc_id AND own.path = ids.path LEFT JOIN near ON near.folder = ids.folder
    """
)
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"), F.expr(PATH))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"


@query(
    f"""
    WITH RECURSIVE crc_table AS (
      SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ), docs AS (
      SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, crc_table
    ), leaves AS (
      SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
        {_LEAF.format("(CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS claim FROM docs
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM leaves
    ), nodes(g, level, i, n, h) AS (
      SELECT g, 0, i, n, leaf FROM placed
      UNION ALL
      SELECT g, level + 1, i // 3, ceil(n / 3)::BIGINT, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 3, n
    ), subroots AS (SELECT g, h AS subroot FROM nodes WHERE n = 1
    ), above(level, i, n, h) AS (
      SELECT 0, g, (SELECT count(*) FROM subroots), subroot FROM subroots
      UNION ALL
      SELECT level + 1, i // 3, ceil(n / 3)::BIGINT, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY level, i // 3, n
    ), sides AS (
      SELECT p.g, p.i, level, coalesce(string_agg(h, '' ORDER BY o.i) FILTER (WHERE o.i < p.i // pow(3, level)::BIGINT), '') AS l,
        coalesce(string_agg(h, '' ORDER BY o.i) FILTER (WHERE o.i > p.i // pow(3, level)::BIGINT), '') AS r
      FROM placed p JOIN nodes o ON o.g = p.g AND o.n > 1 AND o.i // 3 = (p.i // pow(3, level)::BIGINT) // 3 GROUP BY p.g, p.i, level
      UNION ALL
      SELECT p.g, p.i, 1000 + level, coalesce(string_agg(h, '' ORDER BY o.i) FILTER (WHERE o.i < p.g // pow(3, level)::BIGINT), ''),
        coalesce(string_agg(h, '' ORDER BY o.i) FILTER (WHERE o.i > p.g // pow(3, level)::BIGINT), '')
      FROM placed p JOIN above o ON o.n > 1 AND o.i // 3 = (p.g // pow(3, level)::BIGINT) // 3 GROUP BY p.g, p.i, level
    ), proof AS (
      SELECT g, i, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs
      FROM sides GROUP BY g, i
    ), done AS (
      SELECT doc_id, leaf, subroot, (SELECT h FROM above WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
        list_reduce(list_concat([claim], list_transform(range(1, coalesce(len(ls), 0) + 1), lambda k: ls[k] || '/' || rs[k])),
          lambda h, s: sha256(split_part(s, '/', 1) || h || split_part(s, '/', 2))) AS folded_root
      FROM placed JOIN subroots USING (g) LEFT JOIN proof USING (g, i)
    )
    SELECT *, folded_root = root AS verified FROM done
    """
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": deleted}))


@query()
def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    ensemble = rule_ensemble.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return rule_ensemble.scored(docs, ensemble).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query(
    r"""
    WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id::VARCHAR) AS d FROM documents),
    h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(d, 1, 8))::BIGINT AS h1,
      ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM drawn),
    c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
      coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
    SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
    """
)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = settle(frames.store_frames(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return frames.fim_digests(store)
