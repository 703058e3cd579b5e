"""Inverted index tables and BM25 ranking.

The index is three long tables: ``postings(doc_id, term, tf, dl)``,
``doc_len(doc_id, dl)`` and ``snippets(doc_id, body)``. The document length is
repeated in each posting so that scoring a query reads postings alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import query_terms, snippet, tokenize
from foliant.session import settle

K1 = 1.5
B = 0.75


def _tokens(corpus: DataFrame, keep: list[str]) -> DataFrame:
    return corpus.select(*keep, tokenize(F.col("text")).alias("tokens"))


def doc_lengths(corpus: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token count of every document, empty ones included."""
    return _tokens(corpus, list(keys)).select(*keys, F.size("tokens").cast("bigint").alias("dl"))


def postings(corpus: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document and term: frequency, and the document's length."""
    exploded = _tokens(corpus, list(keys)).select(
        *keys, F.size("tokens").cast("bigint").alias("dl"), F.explode("tokens").alias("term")
    )
    return exploded.groupBy(*keys, "term", "dl").agg(F.count("*").alias("tf"))


def query_index(corpus: DataFrame, query: str, keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """``(postings, lengths)`` for the terms of one query, for a corpus without a stored index.

    Each text is read and cut into tokens once; only its length and the tokens
    that the query asks for are kept, in a small table.
    """
    terms = query_terms(query)
    wanted = F.filter("tokens", lambda w: w.isin(terms)) if terms else F.array().cast("array<string>")
    kept = settle(_tokens(corpus, list(keys)).select(*keys, F.size("tokens").cast("bigint").alias("dl"), wanted.alias("hits")))
    index = kept.select(*keys, "dl", F.explode("hits").alias("term")).groupBy(*keys, "term", "dl").agg(F.count("*").alias("tf"))
    return index, kept.select(*keys, "dl")


def snippet_sources(corpus: DataFrame) -> DataFrame:
    """The whole texts: a snippet may come from anywhere in them, and only those of the top hits are read."""
    return corpus.select("doc_id", F.col("text").alias("body"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of documents and average length, over all or per collection."""
    aggs = [F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl")]
    return lengths.groupBy(*by).agg(*aggs) if by else lengths.agg(*aggs)


def term_score(tf: Column, dl: Column, df: Column, n: Column, avg_dl: Column) -> Column:
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    length = F.when(dl == 0, F.lit(1)).otherwise(dl)
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / avg_dl))


def _top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def bm25(index: DataFrame, lengths: DataFrame, query: str, k: int = 50) -> DataFrame:
    """Best ``k`` documents for a query; ties go to the smaller id.

    The term filter reaches the postings scan. The frequency table has at most
    one row per query term, so it is broadcast.
    """
    terms = query_terms(query)
    hits = index.filter(F.col("term").isin(terms) if terms else F.lit(False))
    stats = corpus_stats(lengths).select(F.struct("n_docs", "avg_dl")).scalar()
    scored = hits.join(F.broadcast(document_frequency(hits)), "term").withColumn("_s", stats)
    score = term_score(F.col("tf"), F.col("dl"), F.col("df"), F.col("_s.n_docs"), F.col("_s.avg_dl"))
    return _top(scored.groupBy("doc_id").agg(F.sum(score).alias("score")), k)


def search_collection(
    index: DataFrame, lengths: DataFrame, bodies: DataFrame, docs: DataFrame, query: str, k: int = 50
) -> DataFrame:
    """Ranked hits with a snippet and the document's columns.

    Texts are joined only after the top ``k`` is known; that side has at most
    ``k`` rows and is broadcast.
    """
    terms = query_terms(query)
    top = F.broadcast(bm25(index, lengths, query, k))
    shown = snippet(F.col("body"), terms) if terms else F.lit("")
    hits = bodies.join(top, "doc_id").select("doc_id", "score", shown.alias("snippet"))
    return docs.join(F.broadcast(hits), "doc_id").orderBy(F.desc("score"), "doc_id")


def search_texts(corpus: DataFrame, query: str, k: int = 50) -> DataFrame:
    """The same ranking straight from texts, for a corpus without an index.

    Each row counts the few query terms in its own token array, so documents
    are not shuffled. Texts are read and cut once; the counts are written as a
    small table, which gives the totals and the scores.
    """
    terms = query_terms(query)
    if not terms:
        return corpus.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    # inline() has each text tokenized once, not once for each use of a count.
    tf = [(F.size("tokens") - F.size(F.array_remove("tokens", w))).alias(f"_t{i}") for i, w in enumerate(terms)]
    counts = F.struct(F.size("tokens").cast("bigint").alias("dl"), *tf)
    counted = settle(_tokens(corpus, ["doc_id"]).select("doc_id", F.inline(F.array(counts))))
    totals = counted.agg(
        F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"),
        *[F.count_if(F.col(f"_t{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    )
    totals = totals.select(F.struct("*")).scalar()
    rows = counted.filter(F.greatest(*[F.col(f"_t{i}") for i in range(len(terms))], F.lit(0)) > 0)
    rows = rows.withColumn("_s", totals)
    score = sum(
        (
            F.when(
                F.col(f"_t{i}") > 0,
                term_score(
                    F.col(f"_t{i}"), F.col("dl"), F.col(f"_s.df{i}"), F.col("_s.n_docs"), F.col("_s.avg_dl")
                ),
            ).otherwise(0.0)
            for i in range(len(terms))
        ),
        F.lit(0.0),
    )
    return _top(rows.select("doc_id", score.alias("score")), k)


def search_library(
    index: DataFrame, lengths: DataFrame, query: str, k: int = 20, scope: str | None = None,
    shared_statistics: bool = False,
) -> DataFrame:
    """Top ``k`` of each collection, merged and cut to the best ``k`` overall.

    Statistics are per collection unless ``shared_statistics`` is set. ``index``
    and ``lengths`` carry a ``collection`` column.
    """
    terms = query_terms(query)
    if scope is not None:
        wanted = F.lower("collection") == scope.lower()
        index, lengths = index.filter(wanted), lengths.filter(wanted)
    hits = index.filter(F.col("term").isin(terms) if terms else F.lit(False))
    by = () if shared_statistics else ("collection",)
    freq = hits.groupBy(*by, "term").agg(F.count("*").alias("df"))
    scored = hits.join(freq, [*by, "term"])
    stats = corpus_stats(lengths, by)
    if by:
        scored = scored.join(stats.select("collection", F.struct("n_docs", "avg_dl").alias("_s")), "collection")
    else:
        scored = scored.withColumn("_s", stats.select(F.struct("n_docs", "avg_dl")).scalar())
    score = term_score(F.col("tf"), F.col("dl"), F.col("df"), F.col("_s.n_docs"), F.col("_s.avg_dl"))
    scores = scored.groupBy("collection", "doc_id").agg(F.sum(score).alias("score"))
    place = F.row_number().over(W.partitionBy("collection").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    best = scores.withColumn("_p", place).filter(F.col("_p") <= k).drop("_p")
    return best.orderBy(F.desc(F.round("score", 9)), "collection", "doc_id").limit(k)


def find_files(files: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Files whose name contains the query, ignoring case, by path; ``limit`` makes it a top report (the desktop shows 500)."""
    hits = files.filter(~F.col("is_dir") & F.contains(F.lower("name"), F.lit(query.lower())))
    return hits.orderBy("path").limit(limit) if limit else hits


def find_in_files(files: DataFrame, query: str, max_depth: int | None = None) -> DataFrame:
    """Match by name, else by content for plain-text files; name wins.

    ``files`` has ``path, name, depth, text``. Every match is returned, at any
    depth unless ``max_depth`` is given (the desktop looks four folders down).
    """
    q = F.lit(query.lower())
    texty = F.col("name").rlike(r"(?i)\.(txt|md|csv|json|log)$")
    kind = F.when(F.contains(F.lower("name"), q), "filename").when(
        texty & F.contains(F.lower("text"), q), "content"
    )
    return (
        (files if max_depth is None else files.filter(F.col("depth") <= max_depth))
        .select("path", "name", kind.alias("match"))
        .filter(F.col("match").isNotNull())
    )
