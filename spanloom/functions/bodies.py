"""Raw request bodies of log events, which may be double-encoded or cut short."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import text

# Fixed value: what the exporter writes where it cut a body.
CUT_MARK = "[TRUNCATED"


def _repair(bodies: Column) -> Column:
    # Everything the function needs is inside it, so workers need not import this package.
    cut_mark, blanks = CUT_MARK, text.BLANKS

    def repair(texts: pd.Series) -> pd.Series:
        import json
        import re

        token = re.compile(r'"(?:\\.|[^"\\])*(?P<shut>")?|\\.|[\[\]{}]', re.S)
        closing = {"[": "]", "{": "}"}
        missing = object()

        def load(raw):
            try:
                return json.loads(raw)
            except ValueError:
                return missing

        def close(raw):
            """Close what a cut left open."""
            stack, in_string = [], False
            for m in token.finditer(raw):
                t = m.group()
                if t[0] == '"':
                    in_string = m.group("shut") is None
                elif t in closing:
                    stack.append(t)
                elif stack and closing[stack[-1]] == t:
                    stack.pop()
            tail = raw.rstrip(blanks)
            tail = tail[:-1] if tail.endswith(",") else tail
            return tail + ('"' if in_string else "") + "".join(
                closing[b] for b in reversed(stack)
            )

        def unwrap(value):
            if not isinstance(value, str):
                return value
            for candidate in (value, close(value)):
                inner = load(candidate)
                if inner is not missing and inner is not None:
                    return inner
            return value

        def decode(raw):
            if raw is None:
                return None
            body = raw.lstrip(blanks).split(cut_mark, 1)[0].rstrip(blanks)
            for candidate in (body, f'"{body}"', close(body)):
                value = load(candidate)
                if value is not missing:
                    value = unwrap(value)
                    if isinstance(value, dict):
                        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
                    return None
            return None

        return texts.map(decode)

    return F.pandas_udf(repair, T.StringType())(bodies)


def decoded(body: Column) -> Column:
    """Request body as a JSON object text; null when nothing can be read.

    Sound bodies never leave the JVM: only those that do not parse, are wrapped in a string or
    carry the cut mark take the Python step.
    """
    sound = (
        F.call_function("try_parse_json", body).isNotNull()
        & F.ltrim(body).startswith("{")
        & ~body.contains(CUT_MARK)
    )
    broken = F.when(~F.coalesce(sound, F.lit(False)), body)
    return F.when(sound, body).otherwise(_repair(broken))


def request_messages(body: Column) -> Column:
    """Messages of a request body as JSON texts, a system prompt first; null when it has none."""
    read = F.from_json(body, "STRUCT<messages: ARRAY<STRING>, system: STRING>")
    listed = F.from_json(body, "STRUCT<system: ARRAY<STRING>>")["system"]
    system = read["system"]
    as_list = F.concat(F.lit('{"role":"system","content":'), system, F.lit("}"))
    as_text = F.to_json(F.struct(F.lit("system").alias("role"), system.alias("content")))
    first = F.when(listed.isNotNull(), as_list).otherwise(as_text)
    return F.when(system.isNull(), read["messages"]).otherwise(
        F.concat(F.array(first), read["messages"])
    )


def _sound(body: Column) -> Column:
    return F.when(F.call_function("try_parse_json", body).isNotNull(), body)


def response_messages(body: Column) -> Column:
    """Content blocks of a response body as JSON texts."""
    return F.from_json(_sound(body), "STRUCT<content: ARRAY<STRING>>")["content"]


def stop_reason(body: Column) -> Column:
    return F.from_json(_sound(body), "STRUCT<stop_reason: STRING>")["stop_reason"]
