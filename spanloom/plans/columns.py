"""Columns of canonical nodes, shared by every source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANONICAL = {
    "id": "string",
    "type": "string",
    "parent": "string",
    "session_id": "string",
    "harness_session": "string",
    "origin": "string",
    "start_time_ns": "bigint",
    "end_time_ns": "bigint",
    "duration_ms": "double",
    "model": "string",
    "source": "string",
    "stop_reason": "string",
    "tokens_in": "double",
    "tokens_out": "double",
    "cache_read_tokens": "double",
    "cache_write_tokens": "double",
    "cost_usd": "double",
    "name": "string",
    "tool_use_id": "string",
    "tool_input": "string",
    "sequence": "int",
    "prompt": "string",
    "user_id": "string",
    "cwd": "string",
    "branch": "string",
    "request_messages": "array<string>",
    "response_messages": "array<string>",
    "is_error": "boolean",
    "error_kind": "string",
    "output_size": "int",
    "error_message": "string",
}

PSEUDO_USER = "pseudo_user_id"
MAIN_THREAD = "repl_main_thread"

# Ties on the start time: a wait sorts before its execution, both before anything else.
SORT_RANK = (
    "case type when 'tool.blocked_on_user' then 0 when 'tool.execution' then 1 else 2 end"
)


def canonical(df: DataFrame, extra: Sequence[str] = (), **given: Column) -> DataFrame:
    """Project to the canonical columns; those neither given nor present become null.

    Columns of ``df`` named in ``extra`` are kept too.
    """
    cols = []
    for name, dtype in CANONICAL.items():
        col = given.get(name)
        if col is None:
            col = F.col(name) if name in df.columns else F.lit(None)
        cols.append(col.cast(dtype).alias(name))
    return df.select(*cols, *extra)


def session_key(harness_session: Column) -> Column:
    return F.concat(F.lit("session-"), harness_session)


def stable_id(kind: str, natural: Column) -> Column:
    """Deterministic node id from a kind and a natural key."""
    return F.concat(
        F.lit("s"), F.substring(F.sha2(F.concat(F.lit(f"{kind}:"), natural), 256), 1, 16)
    )


def millis(start: Column, end: Column) -> Column:
    return (end - start) / 1e6
