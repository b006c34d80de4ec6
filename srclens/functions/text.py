"""Column helpers: counting, masking, trimming, classification, record pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The substrings that each count as one decision.
DECISION_SUBSTRINGS = ["if", "for", "while", "case", "catch", "&&", "||", "?"]
# Fixed value: what a masked secret reads as.
MASK = "***TOKEN***"
# Error classes in order of precedence, with the texts that mark them.
AUTH_MARKS = ["Authentication failed", "could not read Username"]
NOT_FOUND_MARK = "Repository not found"
RATE_LIMIT_MARK = "rate limit"
# Text used where a model gave none.
NO_SUMMARY = "Summary unavailable"
NO_OVERVIEW = "Overview unavailable"
NO_PACKAGE = "N/A"


def count_substring(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal, by what its removal takes away."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / len(needle.encode())).cast("long")


def decision_score(df: DataFrame, text: str, out: str) -> DataFrame:
    """1 + the decision substrings in the lower-cased text; 1 for an empty or null text."""
    lowered = df.withColumn("__lower", F.lower(F.coalesce(F.col(text), F.lit(""))))
    total = F.lit(1).cast("long")
    for needle in DECISION_SUBSTRINGS:
        total = total + count_substring(F.col("__lower"), needle)
    return lowered.withColumn(out, total).drop("__lower")


def strip(text: Column) -> Column:
    """Trim every kind of white space, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def has_suffix(text: Column, suffixes: list[str]) -> Column:
    """Case-sensitive suffix test against a list."""
    test = F.lit(False)
    for suffix in suffixes:
        test = test | F.endswith(text, F.lit(suffix))
    return test


def mask_secret(text: Column, secret: str | None) -> Column:
    """Replace a secret; without one the text stays as it is."""
    return F.replace(text, F.lit(secret), F.lit(MASK)) if secret else text


def error_class(message: Column) -> Column:
    """auth, not_found, rate_limit or other: the first that matches."""
    auth = F.lit(False)
    for mark in AUTH_MARKS:
        auth = auth | F.contains(message, F.lit(mark))
    return (
        F.when(auth, "auth")
        .when(F.contains(message, F.lit(NOT_FOUND_MARK)), "not_found")
        .when(F.contains(F.lower(message), F.lit(RATE_LIMIT_MARK)), "rate_limit")
        .otherwise("other")
    )


def or_default(value: Column, default: str) -> Column:
    """The default for null or empty text."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def iso_timestamp(ts: Column) -> Column:
    """ISO text; the fraction appears only when there is one."""
    return F.when(
        F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def json_text(record: Column) -> Column:
    """Compact JSON with nulls kept."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def pruned(value: Column, data_type: T.DataType, drop: list[str]) -> Column:
    """Drop the named fields on every level; other than basic values become text.

    Walks the schema, not the rows: the result is one column expression.
    """
    if isinstance(data_type, T.StructType):
        kept = [f for f in data_type.fields if f.name not in drop]
        built = F.struct(*[pruned(value[f.name], f.dataType, drop).alias(f.name) for f in kept])
        return F.when(value.isNotNull(), built)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: pruned(x, data_type.elementType, drop))
    if isinstance(data_type, T.MapType):
        wanted = F.map_filter(value, lambda k, _: ~k.cast("string").isin(drop))
        return F.transform_values(wanted, lambda _, v: pruned(v, data_type.valueType, drop))
    if isinstance(data_type, (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType, T.NullType)):
        return value
    return value.cast("string")
