"""Spans and log events of OpenTelemetry exports, and the session each file belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.sources.files import file_columns

SPAN = """
STRUCT<traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING,
  startTimeUnixNano: STRING, endTimeUnixNano: STRING,
  attributes: ARRAY<STRUCT<key: STRING, value: STRUCT<stringValue: STRING, boolValue: BOOLEAN,
    intValue: STRING, doubleValue: DOUBLE>>>>
"""
BATCH = f"STRUCT<scopeSpans: ARRAY<STRUCT<spans: ARRAY<{SPAN}>>>>"
TRACE = f"STRUCT<batches: ARRAY<{BATCH}>>"
EVENT = """
STRUCT<timestamp_ns: BIGINT, event_sequence: STRING, span_id: STRING, session_id: STRING,
  event_name: STRING, hook_name: STRING, request_id: STRING, query_source: STRING, body: STRING,
  tool_name: STRING, prompt: STRING, tool_use_id: STRING, tool_input: STRING, cost_usd: STRING,
  total_duration_ms: STRING>
"""
LOGS = f"ARRAY<{EVENT}>"
#: Depth at which batches of a trace and events of a log open.
BATCH_LEVEL, EVENT_LEVEL = 2, 1
SPAN_BYTES, TRACE_BYTES = 8, 16


def attribute(attributes: Column, key: str) -> Column:
    """Value struct of the first attribute with this key.

    Found by position in the list of keys, which needs no lambda per span.
    """
    at = F.array_position(attributes["key"], F.lit(key)).cast("int") - 1
    return F.get(attributes["value"], at)


def string_attribute(attributes: Column, key: str) -> Column:
    return attribute(attributes, key)["stringValue"]


def flat_spans(documents: DataFrame) -> DataFrame:
    """One row per span with its place in the file: ``(path, name, dir, pos, span)``."""
    spans = F.flatten(
        F.transform(
            F.from_json("content", TRACE)["batches"],
            lambda b: F.flatten(F.transform(b["scopeSpans"], lambda s: s["spans"])),
        )
    )
    return documents.select("path", "name", "dir", F.posexplode(spans).alias("pos", "span"))


def flat_logs(documents: DataFrame) -> DataFrame:
    """One row per log event: ``(path, dir, pos, ...event)``."""
    return documents.select(
        "path", "dir", F.posexplode(F.from_json("content", LOGS)).alias("pos", "e")
    ).select("path", "dir", "pos", "e.*")


def record_spans(batches: DataFrame) -> DataFrame:
    """``flat_spans`` of batches read one by one, ``(path, offset, record)``; ``pos`` keeps their order."""
    spans = F.flatten(F.transform(F.from_json("record", BATCH)["scopeSpans"], lambda s: s["spans"]))
    return batches.select("path", "offset", F.posexplode(spans).alias("i", "span")).select(
        "path", *_names("name", "dir"), (F.col("offset") + F.col("i")).alias("pos"), "span"
    )


def record_logs(events: DataFrame) -> DataFrame:
    """``flat_logs`` of events read one by one, ``(path, offset, record)``."""
    return events.select(
        "path", *_names("dir"), F.col("offset").alias("pos"), F.from_json("record", EVENT).alias("e")
    ).select("path", "dir", "pos", "e.*")


def _names(*wanted: str) -> list[Column]:
    columns = file_columns(F.col("path"))
    return [columns[n].alias(n) for n in wanted]


def trace_sessions(spans: DataFrame) -> DataFrame:
    """Session of each trace file: the first span that names one."""
    named = string_attribute(F.col("span.attributes"), "session.id")
    return (
        spans.select("path", "dir", "pos", named.alias("s"))
        .filter("s is not null")
        .groupBy("path", "dir")
        .agg(F.min_by("s", "pos").alias("harness_session"))
    )


def log_sessions(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Session of each log file: its own, else that of the last trace file beside it."""
    own = logs.groupBy("path", "dir").agg(
        F.min_by("session_id", F.when(F.col("session_id").isNotNull(), F.col("pos"))).alias("own")
    )
    beside = traces.groupBy("dir").agg(F.max_by("harness_session", "path").alias("beside"))
    return (
        own.join(beside, "dir", "left")
        .select("path", F.coalesce("own", "beside").alias("harness_session"))
        .filter("harness_session is not null")
    )


def session_inputs(
    chat_files: DataFrame, traces: DataFrame, logs: DataFrame
) -> DataFrame:
    """Inputs by session with its kind: ``(harness_session, kind, path, input_type)``.

    Each argument is ``(path, harness_session)``. A session with any native file is native.
    """
    every = (
        chat_files.select("path", "harness_session", F.lit("native").alias("input_type"))
        .unionByName(
            traces.select("path", "harness_session", F.lit("otel-trace").alias("input_type"))
        )
        .unionByName(logs.select("path", "harness_session", F.lit("otel-log").alias("input_type")))
    )
    kinds = every.groupBy("harness_session").agg(
        F.bool_or(F.col("input_type") == "native").alias("native")
    )
    return every.join(kinds, "harness_session").select(
        "harness_session",
        F.when(F.col("native"), "native").otherwise("otel").alias("kind"),
        "path",
        "input_type",
    )


def violations(spans: DataFrame) -> DataFrame:
    """Broken spans as ``(path, span_id, rule)``."""

    def size(col):
        return F.coalesce(F.octet_length(F.try_to_binary(col, F.lit("base64"))), F.lit(-1))

    span = F.col("span")
    start, end = span["startTimeUnixNano"], span["endTimeUnixNano"]
    digits = r"^[0-9]+\z"
    as_int = [c.try_cast("decimal(38,0)") for c in (start, end)]
    rules = {
        "trace_id_size": size(span["traceId"]) != TRACE_BYTES,
        "span_id_size": size(span["spanId"]) != SPAN_BYTES,
        "parent_id_size": span["parentSpanId"].isNotNull()
        & (size(span["parentSpanId"]) != SPAN_BYTES),
        "empty_name": F.coalesce(span["name"], F.lit("")) == "",
        "start_not_digits": ~F.coalesce(start.rlike(digits), F.lit(False)),
        "end_not_digits": ~F.coalesce(end.rlike(digits), F.lit(False)),
        "ends_before_start": F.coalesce(as_int[1] < as_int[0], F.lit(False)),
    }
    found = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), rule) for rule, bad in rules.items()]),
        lambda r: r.isNotNull(),
    )
    row_level = spans.select("path", span["spanId"].alias("span_id"), F.explode(found).alias("rule"))
    ids = spans.groupBy("path", span["spanId"].alias("span_id")).count()
    duplicate = ids.filter("count > 1").select(
        "path", "span_id", F.lit("duplicate_span_id").alias("rule")
    )
    parents = spans.filter("span.parentSpanId is not null").select(
        "path", span["spanId"].alias("child"), span["parentSpanId"].alias("span_id")
    )
    dangling = parents.join(ids.select("path", "span_id"), ["path", "span_id"], "left_anti").select(
        "path", F.col("child").alias("span_id"), F.lit("unknown_parent").alias("rule")
    )
    return row_level.unionByName(duplicate).unionByName(dangling)
