"""Columns over JSON messages, kept as JSON text so key order survives.

A field that may be a string or an array is read twice: ``ARRAY<STRING>`` gives the elements as
JSON text and is null for a string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import text

BLOCK = (
    "STRUCT<type: STRING, text: STRING, name: STRING, id: STRING, input: STRING, "
    "tool_use_id: STRING, is_error: BOOLEAN>"
)


def block(col: Column) -> Column:
    """The fields of one content block."""
    return F.from_json(col, BLOCK)


def blocks_of(message: Column) -> Column:
    """Content blocks of a message as JSON texts; null when the content is not an array."""
    return F.from_json(message, "STRUCT<content: ARRAY<STRING>>")["content"]


def plain_content(message: Column) -> Column:
    """Content of a message when it is a string."""
    raw = F.from_json(message, "STRUCT<content: STRING>")["content"]
    return F.when(blocks_of(message).isNull(), raw)


def message_text(message: Column) -> Column:
    """String content, or the texts of the text blocks joined by newlines."""
    parts = F.transform(F.coalesce(blocks_of(message), F.array().cast("array<string>")), block)
    texts = F.transform(
        F.filter(parts, lambda b: (b["type"] == "text") & b["text"].isNotNull()),
        lambda b: b["text"],
    )
    return F.coalesce(plain_content(message), F.array_join(texts, "\n"))


def _element_text(element: Column) -> Column:
    inner = F.from_json(element, "STRUCT<text: STRING>")["text"]
    is_object = element.startswith("{")
    return F.when(is_object, F.coalesce(inner, F.lit(""))).otherwise(element)


def result_text(block_json: Column) -> Column:
    """Text of a tool result: its string content, or its elements' texts joined and trimmed."""
    as_array = blocks_of(block_json)
    as_text = F.from_json(block_json, "STRUCT<content: STRING>")["content"]
    joined = F.array_join(F.transform(as_array, _element_text), "\n")
    return F.when(as_array.isNotNull(), text.trim(joined)).otherwise(
        F.coalesce(as_text, F.lit(""))
    )


def json_array(col: Column) -> Column:
    """Array of JSON texts to one JSON array text."""
    return F.when(col.isNotNull(), F.concat(F.lit("["), F.array_join(col, ","), F.lit("]")))


def user_message(content_json: Column) -> Column:
    return F.concat(F.lit('{"role":"user","content":'), content_json, F.lit("}"))


def quoted(col: Column) -> Column:
    """A string as a JSON string literal, ``null`` for null."""
    boxed = F.to_json(F.struct(col.alias("v")))
    inside = F.regexp_extract(boxed, r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(col.isNull(), F.lit("null")).otherwise(inside)
