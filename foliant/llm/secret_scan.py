"""Secrets in texts: long tokens, and a random forest that removes false positives.

A candidate is a run of at least 16 key characters, without a name and '=' before it. The forest sees its length,
how often its characters change class, how much of it dictionary words cover,
what kind of context it stands in, and how often its path and its neighbouring
words went with real secrets among the labelled findings. A small table of
written-out examples (hashes after ``commit``, checksums, identifiers, paths,
addresses; keys of all lengths under usual names) goes into the training, so
that kinds of findings that the labelled documents lack are known too.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import hash_sample, text_of
from foliant.llm.marks import matches, parts_of, unmarked
from foliant.session import settle

_KEY = r"[A-Za-z0-9+/_=-]"
_VALUE = rf"[A-Za-z0-9+/_-]{_KEY}{{15}}"
#: The look-behind starts a candidate only at the head of its run, so a text is passed once.
CANDIDATE = rf"(?<!{_KEY})(?={_KEY}{{16}}){_KEY}++"
#: Of a run NAME=value, with a value that is long enough on its own, the value is the candidate.
_NAMED_RUN = rf"^([A-Za-z_][A-Za-z0-9_-]*+=)({_VALUE}{_KEY}*+)$"
FEATURES = (
    "length", "change_rate", "digit_share", "upper_share", "slash_share", "is_uuid", "entropy", "coverage", "path_prior", "context_prior",
    "left_prior", "left2_prior", "right_prior",
)
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
# Names before a finding, in lower case and without signs but '=' and ':'.
_KEY_NAME = "[a-z0-9]*(token|key|keyid|secret|password|passwd|pwd|credential|credentials)[0-9]*"
_HASH_NAME = "(git)?(commit|commits|merge|revision|rev|sha|sha1|sha256|sha512|md5|checksum|digest|hash|etag|uuid|guid|id|blob|tree|ref|fingerprint|integrity)"
_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """``(doc, tag, path, start, end, value, left, left2, right, context)`` of every candidate, in code points, end exclusive.

    ``tag`` is a hash of the text; rows that agree in id, text and path are one.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("tag"),
        F.coalesce((F.lit("") if path is None else path).cast("string"), F.lit("")).alias("path"),
        parts_of(unmarked(text), CANDIDATE).alias("parts"),
    )
    found = matches(rows, "parts", ["doc", "tag", "path"])
    word = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}=:]", ""))
    last = word(F.regexp_extract("before", rf"({_WORD}){_BLANK}*[\x22\x27`(]*$", 1))
    last2 = word(F.regexp_extract("before", rf"({_WORD}){_BLANK}+{_WORD}{_BLANK}*[\x22\x27`(]*$", 1))
    name = F.regexp_extract("value", _NAMED_RUN, 1)
    cut = name != ""
    split = found.select(
        "doc", "tag", "path", (F.col("start") + F.length(name)).alias("start"), "end",
        F.when(cut, F.regexp_extract("value", _NAMED_RUN, 2)).otherwise(F.col("value")).alias("value"),
        F.when(cut, word(name)).otherwise(last).alias("left"), F.when(cut, last).otherwise(last2).alias("left2"),
        word(F.regexp_extract("after", rf"{_BLANK}({_WORD})", 1)).alias("right"),
    )
    return split.withColumn("context", context(F.col("left"), F.col("left2"))).distinct()


def context(left: Column, left2: Column) -> Column:
    """What the words before a finding say: ``key`` (a key's name and a sign), ``hash`` (a word for a checksum or an identifier), ``url``, or ``other``."""
    signs = ("=", ":", ":=")
    key = left.rlike(f"^{_KEY_NAME}(=|:|:=)$") | (left.isin(*signs) & left2.rlike(f"^{_KEY_NAME}[:=]?$"))
    hashed = left.rlike(f"^{_HASH_NAME}[:=]*$") | (left.isin(*signs, "is", "of", "no") & left2.rlike(f"^{_HASH_NAME}[:=]?$"))
    url = left.rlike("^(https?|ftp|git|ssh|file):|^www")
    return F.when(key, "key").when(hashed, "hash").when(url, "url").otherwise("other")


def examples(spark: SparkSession, each: int = 150) -> DataFrame:
    """Labelled findings of common kinds, ``each`` of a kind, made from hashes of numbers and short word lists.

    Not real: hashes and identifiers under such a name, UUIDs anywhere, file
    paths, parts of addresses, long words. Real: keys of 16 to 64 signs under a
    key's name in the usual forms, and bare ones between plain words.
    """
    n = F.col("id")

    def draw(salt: int, *words: str) -> Column:
        return F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(words))).cast("int"))

    def digits(salt: int, size: int) -> Column:
        return F.substring(F.sha2(F.concat_ws(":", n, F.lit(salt)), 256), 1, size)

    def tail(salt: int) -> Column:
        return F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(97)).cast("string")

    size = (16 + F.pmod(F.xxhash64(n, F.lit(9)), F.lit(49))).cast("int")
    hexed = F.substring(F.sha2(F.concat_ws("-", n), 256), F.lit(1), size)
    mixed = F.rtrim(F.base64(F.unhex(F.substring(F.sha2(F.concat_ws("+", n), 256), 1, 48))), F.lit("="))
    mixed = F.substring(F.concat(mixed, F.reverse(mixed)), F.lit(1), size)
    plain = F.substring(F.regexp_replace(F.concat(mixed, F.upper(hexed), F.lower(mixed)), "[^A-Za-z0-9]", "7"), F.lit(1), size)
    key = F.when(n % 3 == 0, hexed).when(n % 3 == 1, mixed).otherwise(plain)
    part = lambda k: draw(k, "src", "main", "lib", "test", "core", "index", "page", "report", "module", "common", "service", "handler")
    uuid = F.concat_ws("-", *(digits(20 + k, m) for k, m in enumerate((8, 4, 4, 4, 12))))
    path = F.concat_ws("/", part(1), part(2), F.concat(part(3), tail(4)), F.concat(part(5), F.lit("_"), part(6)))
    name = draw(7, "password", "passwd", "db_password", "token", "api_token", "access_token", "api_key", "secret", "client_secret", "secret_key", "credential")
    form = draw(8, '{} = "{}"', '{}="{}"', "{}: '{}'", '"{}": "{}"', "{}={}", "{} := {}", "{}: {}")
    named = F.replace(form, F.lit("{}"), F.lit("\x1f"))
    written = F.concat(F.substring_index(named, "\x1f", 1), name, F.regexp_extract(named, "\x1f([^\x1f]*)\x1f", 1), key, F.substring_index(named, "\x1f", -1))
    kinds = [
        (False, F.concat(draw(1, "commit ", "merge ", "revision ", "commit: ", "sha1 ", "tree "), digits(1, 40))),
        (False, F.concat(draw(2, "md5 ", "md5: ", "checksum ", "checksum: ", "digest = ", "hash is "), digits(2, 32))),
        (False, F.concat(draw(3, "sha256 ", "sha256: ", "integrity = ", "fingerprint ", "etag: "), digits(3, 64))),
        (False, F.concat(draw(4, "id ", "uuid: ", "request ", "session ", "job "), uuid)),
        (False, F.concat(draw(5, "in ", "file ", "see ", "open ", "./"), path)),
        (False, F.concat(draw(6, "https://www.example.com/", "http://example.org/", "see https://cdn.example.net/"), path, F.lit("-"), tail(7))),
        (False, F.concat_ws("-", part(7), part(8), part(9), part(10), tail(11))),
        (False, F.initcap(F.concat(part(12), part(13), part(14), part(15), part(16)))),
        (False, F.concat(part(17), part(18), part(19), part(20))),
        (False, F.rpad(F.conv(digits(5, 15), 16, 10), F.lit(16 + 3), F.lit("4"))),
        (True, written), (True, written), (True, written), (True, written),
        (True, F.concat(draw(10, "use ", "with ", "sent ", "curl "), F.when(n % 2 == 0, digits(4, 40)).otherwise(plain))),
    ]
    kind = F.floor(n / each)
    core, real = F.lit(""), F.lit(False)
    for k, (secret, written_out) in enumerate(kinds):
        core = F.when(kind == k, written_out).otherwise(core)
        real = F.when(kind == k, F.lit(secret)).otherwise(real)
    texts = spark.range(0, each * len(kinds), 1, 1).select(
        n.alias("doc"), real.alias("real"),
        F.concat_ws(" ", draw(11, "the", "of", "and", "a", "to"), draw(12, "new", "old", "last", "one", "this"), core, draw(13, "was", "is", "and", "then", "for")).alias("text"))
    labels = texts.select("doc", F.col("real").alias("secret"))
    return findings(texts, "doc", "text").join(labels, "doc").withColumn("doc", F.lit(None).cast("long"))


def dictionary(docs: DataFrame, text_col: str = "text", min_docs: int = 20) -> DataFrame:
    """``piece``: the letter triples of words of 3 to 12 letters that ``min_docs`` documents hold."""
    words = F.array_distinct(F.split(F.lower(text_of(text_col)), r"[^\p{L}]+"))
    common = (
        docs.select(F.explode(words).alias("w")).filter(F.length("w").between(3, 12)).groupBy("w").count()
        .filter(F.col("count") >= min_docs)
    )
    return common.select(F.explode(_triples(F.col("w"))).alias("piece")).distinct()


def _triples(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3)))


def _shape(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per distinct value with what its characters say."""
    values = found.select("value").distinct()
    n = F.length("value")
    classes = F.translate(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "+/_=-", "-----"
    )
    changes = F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1
    counts = F.transform(
        F.array_distinct(F.split("value", "")), lambda c: F.length("value") - F.length(F.replace(F.col("value"), c, F.lit("")))
    )
    entropy = F.aggregate(
        F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda s, k: s - (k / n) * F.log2(k / n)
    )
    covered = (
        values.select("value", F.explode(F.array_distinct(_triples(F.lower("value")))).alias("piece"))
        .join(pieces.withColumn("known", F.lit(1)), "piece", "left")
        .groupBy("value").agg((F.count("known") / F.count("*")).alias("coverage"))
    )
    return values.select(
        "value", n.cast("double").alias("length"), (changes / n).alias("change_rate"),
        (F.length(F.regexp_replace("value", "[^0-9]", "")) / n).alias("digit_share"),
        (F.length(F.regexp_replace("value", "[^A-Z]", "")) / n).alias("upper_share"),
        (F.length(F.regexp_replace("value", "[^/_-]", "")) / n).alias("slash_share"), F.col("value").rlike(UUID).cast("double").alias("is_uuid"),
        entropy.alias("entropy"),
    ).join(covered, "value")


def _priors(labelled: DataFrame, mean: float) -> dict[str, DataFrame]:
    """How often a path's first folder, a kind of context or a neighbouring word went with a secret, drawn to the mean by four cases."""
    out = {}
    for name, key in _prior_keys():
        sums = labelled.groupBy(key.alias("k")).agg(F.sum(F.col("secret").cast("double")).alias("yes"), F.count("*").alias("n"))
        out[name] = sums.select("k", ((F.col("yes") + 4 * mean) / (F.col("n") + 4)).alias("prior"))
    return out


def _prior_keys() -> list[tuple[str, Column]]:
    return [("path", _folder())] + [(c, F.col(c)) for c in ("context", "left", "left2", "right")]


def _folder() -> Column:
    return F.substring_index("path", "/", 1)


def featured(found: DataFrame, pieces: DataFrame, priors: dict[str, DataFrame], mean: float) -> DataFrame:
    """``found`` with the columns of FEATURES."""
    out = found.join(_shape(found, pieces), "value")
    for name, key in _prior_keys():
        p = priors[name].select(F.col("k").alias("_k"), F.col("prior").alias("_prior"))
        out = out.withColumn("_key", key).join(p, F.col("_key") == F.col("_k"), "left").withColumn(
            f"{name}_prior", F.coalesce("_prior", F.lit(mean))
        ).drop("_key", "_k", "_prior")
    return out


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features")


def train(
    labelled: DataFrame, pieces: DataFrame, max_labelled: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 7
) -> tuple[Model, dict[str, DataFrame], float] | None:
    """Fit the forest on labelled findings (a boolean column ``secret``), at most ``max_labelled`` with the smallest hashes, and the examples.

    The priors are counted on one half of these and the forest sees the other,
    so that a rare word does not give its own label away. None where the
    labels are all alike.
    """
    known = hash_sample(labelled.filter(F.col("secret").isNotNull()), ["doc", "start", "value", "path"], max_labelled)
    some = settle(
        known.unionByName(examples(labelled.sparkSession).select(*(F.col(c).cast(labelled.schema[c].dataType) for c in labelled.columns)))
        .withColumn("half", F.pmod(F.xxhash64("value", F.lit(3)), F.lit(2)))
    )
    kinds = [r[0] for r in some.select("secret").distinct().collect()]
    if len(kinds) < 2:
        return None
    mean = float(some.agg(F.avg(F.col("secret").cast("double"))).first()[0])
    priors = {k: settle(v) for k, v in _priors(some.filter("half = 0"), mean).items()}
    rows = featured(some.filter("half = 1"), pieces, priors, mean).withColumn("label", F.col("secret").cast("double"))
    if rows.select("label").distinct().count() < 2:
        rows = featured(some, pieces, priors, mean).withColumn("label", F.col("secret").cast("double"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    return forest.fit(settle(_assembler().transform(rows).select("features", "label"))), priors, mean


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, is_secret: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    path: Column | None = None, threshold: float = 0.5, **options,
) -> DataFrame:
    """``(id, path, start, end, value_sha256, score, secret)`` for every candidate of every document.

    ``labelled`` are ids of documents whose findings are labelled, and
    ``is_secret`` says of a finding whether it is real. ``secret`` is the
    verdict after the removal of false positives; without usable labels all
    candidates stay, with a null score. Values are only given as digests.

    Null and empty texts have no candidates, a null path is empty, rows that
    agree in id, text and path are one, equal values in equal contexts get
    equal scores, a text of any length is searched whole in one pass, an empty
    table gives no rows, and other columns are ignored.
    """
    found = settle(findings(docs, id_col, text_col, path))
    pieces = settle(dictionary(docs, text_col))
    model = None
    if labelled is not None and is_secret is not None:
        ids = labelled.select(F.col(id_col).alias("doc")).distinct()
        model = train(found.join(ids, "doc", "left_semi").withColumn("secret", is_secret), pieces, **options)
    digest = F.sha2("value", 256).alias("value_sha256")
    columns = [F.col("doc").alias(id_col), "path", "start", "end", digest]
    if model is None:
        return found.select(*columns, F.lit(None).cast("double").alias("score"), F.lit(True).alias("secret"))
    forest, priors, mean = model
    scored = forest.transform(_assembler().transform(featured(found, pieces, priors, mean)))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 9)
    return scored.select(*columns, score.alias("score"), (score >= threshold).alias("secret"))
