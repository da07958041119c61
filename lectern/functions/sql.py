"""The engine's functions for use in SQL; temporary SQL functions, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "kb_tokens(text STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)",
    "kb_strip(text STRING) RETURNS STRING": r"regexp_replace(text, '(?U)^\\s+|\\s+$', '')",
    "kb_ellipsis(text STRING, n INT) RETURNS STRING": "CASE WHEN length(text) > n THEN concat(substring(text, 1, n), '...') ELSE text END",
    "kb_snippet(text STRING) RETURNS STRING": "concat(substring(text, 1, 200), '...')",
    "kb_suffix(path STRING) RETURNS STRING": r"lower(regexp_extract(path, '\\.[^./]+$', 0))",
    "kb_windows(text STRING, size INT, overlap INT) RETURNS ARRAY<STRING>": (
        "CASE WHEN length(text) > 0 AND size > 0 THEN transform(sequence(0, greatest(0, CAST(ceil((length(text) - size) / CASE WHEN size > overlap THEN size - overlap ELSE size END) AS INT))), "
        "i -> substring(text, i * CASE WHEN size > overlap THEN size - overlap ELSE size END + 1, size)) ELSE array() END"
    ),
    "kb_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
        "nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
