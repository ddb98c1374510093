"""Entries of native session logs (one JSON object per line)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = """
STRUCT<uuid: STRING, parentUuid: STRING, type: STRING, subtype: STRING, timestamp: STRING,
  sessionId: STRING, isMeta: STRING, requestId: STRING, cwd: STRING, gitBranch: STRING,
  message: STRUCT<id: STRING, model: STRING, stop_reason: STRING, content: STRING,
    usage: STRUCT<input_tokens: STRING, output_tokens: STRING, cache_read_input_tokens: STRING,
      cache_creation_input_tokens: STRING>>,
  _corrupt_record: STRING>
"""
CONTENT_BLOCKS = "STRUCT<message: STRUCT<content: ARRAY<STRING>>>"


def entries(lines: DataFrame) -> DataFrame:
    """Parsed log entries, one row per readable line that names a uuid or a session.

    ``lines`` is ``(path, block, line, value)``. ``blocks`` holds array content as JSON texts and
    ``content`` string content. Times are nanoseconds at millisecond precision.
    """
    parsed = lines.withColumn("e", F.from_json("value", ENTRY)).filter(
        "e is not null and e._corrupt_record is null"
        " and (e.uuid is not null or e.sessionId is not null)"
    )
    blocks = F.from_json("value", CONTENT_BLOCKS)["message"]["content"]
    millis = F.unix_millis(F.expr("try_to_timestamp(e.timestamp)"))
    usage = F.col("e.message.usage")
    tokens = {
        "tokens_in": "input_tokens",
        "tokens_out": "output_tokens",
        "cache_read_tokens": "cache_read_input_tokens",
        "cache_write_tokens": "cache_creation_input_tokens",
    }
    return parsed.select(
        "path",
        "block",
        "line",
        F.col("e.uuid").alias("uuid"),
        F.col("e.parentUuid").alias("parent_uuid"),
        F.col("e.type").alias("kind"),
        F.col("e.subtype").alias("subtype"),
        (millis * 1_000_000).alias("at"),
        F.col("e.sessionId").alias("harness_session"),
        F.coalesce(F.lower("e.isMeta") == "true", F.lit(False)).alias("is_meta"),
        F.coalesce("e.requestId", "e.message.id").alias("request_key"),
        F.col("e.cwd").alias("cwd"),
        F.col("e.gitBranch").alias("branch"),
        F.coalesce("e.message.model", F.lit("")).alias("model"),
        F.coalesce("e.message.stop_reason", F.lit("")).alias("stop_reason"),
        *[
            F.coalesce(usage[raw].try_cast("double"), F.lit(0.0)).alias(name)
            for name, raw in tokens.items()
        ],
        blocks.alias("blocks"),
        F.when(blocks.isNull(), F.col("e.message.content")).alias("content"),
    )


def file_sessions(parsed: DataFrame) -> DataFrame:
    """Session of each file: the first one named in it, on any line."""
    named = parsed.filter("harness_session is not null and harness_session <> ''")
    return named.groupBy("path").agg(
        F.min_by("harness_session", F.struct("block", "line")).alias("harness_session")
    )


def session_files(sessions: DataFrame, merge_files: bool = False) -> DataFrame:
    """The file read for each session: its first by path, or all of them with ``merge_files``."""
    if merge_files:
        return sessions
    return sessions.groupBy("harness_session").agg(F.min("path").alias("path"))


def is_user_prompt():
    """An entry typed by the user, which starts an interaction."""
    return (
        (F.col("kind") == "user")
        & ~F.col("is_meta")
        & F.col("content").isNotNull()
        & ~F.col("content").startswith("<")
        & F.col("uuid").isNotNull()
        & F.col("at").isNotNull()
    )

