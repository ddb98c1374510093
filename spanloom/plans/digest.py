"""What later steps need to know of message bodies, read from each body once.

Bodies are large and every request repeats those before it. One narrow pass turns each inference into a row of message
keys and references to tool blocks; lanes, deltas, causes and outcomes are worked out on these alone, and texts are
picked from the bodies by position at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REF = "struct<at: int, pos: int, use_id: string, is_error: boolean>"


def _bare(messages: Column) -> Column:
    """Messages without the members ``cache_control``, every other character as it is."""

    # Everything the function needs is inside it, so workers need not import this package.
    def drop(rows):
        import json
        import re

        token = re.compile(r'"(?:\\.|[^"\\])*"', re.S)
        named = re.compile(r"\s*:\s*")
        decoder = json.JSONDecoder()

        def strip(raw):
            if raw is None or '"cache_control"' not in raw:
                return raw
            kept, at, look = [], 0, 0
            while (m := token.search(raw, look)) is not None:
                colon = named.match(raw, m.end()) if m.group() == '"cache_control"' else None
                if colon is None:
                    look = m.end()
                    continue
                head = raw[at : m.start()].rstrip()
                if not head and kept:
                    head = kept.pop()
                look = at = decoder.raw_decode(raw, colon.end())[1]
                if head.endswith(","):
                    head = head[:-1]
                elif comma := re.compile(r"\s*,").match(raw, at):
                    look = at = comma.end()
                kept.append(head)
            return "".join(kept) + raw[at:]

        return rows.map(lambda row: None if row is None else [strip(m) for m in row])

    return F.pandas_udf(drop, T.ArrayType(T.StringType()))(messages)


def message_keys(messages: Column) -> Column:
    """Identities of messages, which ignore ``cache_control`` at any depth.

    Only lists that mention the key take the Python step.
    """
    marked = F.when(F.exists(messages, lambda m: m.contains('"cache_control"')), messages)
    return F.transform(F.coalesce(_bare(marked), messages), lambda m: F.unhex(F.sha2(m, 256)))


def _field(block: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(block, f"$.{name}", kind)


def _refs(blocks: Column, at: Column, kind: str, id_field: str) -> Column:
    """References to the blocks of one kind among a message's ``blocks`` (variants)."""
    numbered = F.transform(
        F.coalesce(blocks, F.array().cast("array<variant>")),
        lambda b, pos: F.struct(
            at.alias("at"), pos.alias("pos"), F.when(_field(b, "type") == kind, _field(b, id_field)).alias("use_id"),
            F.coalesce(_field(b, "is_error", "boolean"), F.lit(False)).alias("is_error"),
        ),
    )
    return F.filter(numbered, lambda r: r["use_id"].isNotNull())


def _may_hold(text: Column, word: str) -> Column:
    """Whether JSON text can spell ``word``, in plain letters or with escapes."""
    return text.contains(word) | text.contains("\\u")


def digest(nodes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, keys, results, calls)`` and the columns ``extra`` of inferences: message keys, tool results handed in, tool calls given back.

    ``keys`` is null without a request. ``results`` tells message, position in its content, id and error mark; ``calls`` the position in
    the response. Messages that are no JSON, or whose content is no list, have no blocks.
    """
    asked, said = F.col("request_messages"), F.col("response_messages")
    content = lambda m: F.when(_may_hold(m, "tool_result"), F.try_variant_get(F.try_parse_json(m), "$.content", "array<variant>"))
    results = F.flatten(F.transform(asked, lambda m, at: _refs(content(m), at, "tool_result", "tool_use_id")))
    given = F.transform(said, lambda b: F.when(_may_hold(b, "tool_use"), F.try_parse_json(b)))
    calls = _refs(given, F.lit(0), "tool_use", "id")
    nothing = F.array().cast(f"array<{REF}>")
    bodies = nodes.filter("type = 'llm_request' and (request_messages is not null or response_messages is not null)")
    return bodies.select(
        "id", *extra, message_keys(asked).alias("keys"), F.coalesce(results, nothing).alias("results"), F.coalesce(calls, nothing).alias("calls")
    )


def fingerprint(keys: Column) -> Column:
    """One value for a list of keys."""
    return F.sha2(F.array_join(F.transform(keys, F.hex), ""), 256)
