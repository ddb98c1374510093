"""Outcome of a tool call, read from its result text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text

# Cues per error kind, looked for in the lower-cased text, in this order.
FAILED_MATCH = ["no match", "did not match", "string to replace", "not unique"]
NOT_FOUND = [
    "no such file",
    "enoent",
    "command not found",
    "file not found",
    "path not found",
    "does not exist",
]
PERMISSION = ["permission denied", "eacces", "not permitted"]
TIMEOUT = ["timed out", "timeout", "etimedout"]
INVALID_ARGS = ["invalid", "parse error", "parsing error", "bad argument", "expected", "must be"]
NONZERO_EXIT = ["nonzero exit", "killed"]
NONZERO_EXIT_CODE = r"exit code\s+[1-9]"

ERROR_MESSAGE_MAX = 500


def _any(col: Column, cues: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(c) for c in cues])


def with_error_kind(df: DataFrame, failure: str, out: str) -> DataFrame:
    """Closed error class of the failure text in column ``failure``; null for null."""
    low = F.col("__low")
    kind = (
        F.when(_any(low, FAILED_MATCH), "invalid_args")
        .when(_any(low, NOT_FOUND), "not_found")
        .when(_any(low, PERMISSION), "permission")
        .when(_any(low, TIMEOUT), "timeout")
        .when(_any(low, INVALID_ARGS), "invalid_args")
        .when(low.rlike(NONZERO_EXIT_CODE) | _any(low, NONZERO_EXIT), "nonzero_exit")
        .otherwise("other")
    )
    return (
        df.withColumn("__low", F.lower(failure))
        .withColumn(out, F.when(low.isNotNull(), kind))
        .drop("__low")
    )


def with_error_message(df: DataFrame, failure: str, out: str) -> DataFrame:
    """Trimmed failure text of at most 500 characters; null when empty."""
    clean = F.col("__clean")
    cut = F.concat(text.rtrim(F.substring(clean, 1, ERROR_MESSAGE_MAX - 1)), F.lit("…"))
    fits = text.utf16_length(clean) <= ERROR_MESSAGE_MAX
    return (
        df.withColumn("__clean", text.trim(F.col(failure)))
        .withColumn(out, F.when(clean != "", F.when(fits, clean).otherwise(cut)))
        .drop("__clean")
    )
