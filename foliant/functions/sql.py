"""The same functions for use in SQL text, as Spark SQL functions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from foliant.functions.text import STOPWORDS, S

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

FUNCTIONS = {
    "hamming64": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    "tokenize": (
        "t STRING", "ARRAY<STRING>",
        f"filter(split(lower(t), '[^a-z0-9]+'), w -> length(w) BETWEEN 2 AND 40 AND NOT w IN ({_STOP}))",
    ),
    "fingerprint": (
        "name STRING, size BIGINT", "STRING", f"concat_ws('|', lower(regexp_replace(name, r'^{S}+|{S}+$', '')), CAST(size AS STRING))",
    ),
    "djb2_id": (
        "path STRING", "STRING",
        "concat('d', lower(conv(CAST(aggregate(flatten(transform(split(path, ''), c -> CASE WHEN ascii(c) > 65535 "
        "THEN array(55296L + shiftright(ascii(c) - 65536L, 10), 56320L + ((ascii(c) - 65536L) & 1023L)) ELSE array(CAST(ascii(c) AS BIGINT)) END)), "
        "5381L, (h, u) -> (h * 33L + u) & 4294967295L) AS STRING), 10, 36)))",
    ),
    "bates_label": ("prefix STRING, n BIGINT", "STRING", "concat(prefix, format_string('%06d', n))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions available in this session's SQL; returns their names."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
