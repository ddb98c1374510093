"""OpenTelemetry spans and log events to canonical nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import bodies, text
from spanloom.operators.ordered import has_hot_group, position, scan, upcoming
from spanloom.operators.stab import best_covering, latest_ended
from spanloom.plans.columns import canonical, millis, session_key, stable_id
from spanloom.runtime import settle
from spanloom.sources.otel import attribute, string_attribute

SESSION = "harness_session"
NODE_TYPES = ["llm_request", "tool", "tool.execution", "tool.blocked_on_user", "hook"]

# Hooks that belong to a whole interaction.
INTERACTION_HOOKS = [
    "UserPromptSubmit",
    "UserPromptExpansion",
    "Stop",
    "StopFailure",
    "SubagentStop",
    "SubagentStart",
]

STRING_ATTRIBUTES = {
    "model": "model",
    "tool_name": "tool_name",
    "own_tool_use_id": "tool_use_id",
    "call_id": "gen_ai.tool.call.id",
    "prompt": "user_prompt",
    "session_attr": "session.id",
    "user_id": "user.id",
    "own_source": "query_source",
    "own_request": "raw_request_body",
    "own_response": "raw_response_body",
    "own_cost": "cost_usd",
    "own_input": "tool_input",
    "hook_name": "hook.name",
    "cwd": "cwd",
    "branch": "git.branch",
    "request_id": "request_id",
}
INT_ATTRIBUTES = {
    "tokens_in": "input_tokens",
    "tokens_out": "output_tokens",
    "cache_read": "cache_read_tokens",
    "cache_write": "cache_creation_tokens",
    "sequence": "interaction.sequence",
}


def node_id(base64_id: Column) -> Column:
    return F.concat(F.lit("s"), F.lower(F.hex(F.try_to_binary(base64_id, F.lit("base64")))))


def _int_attribute(attributes: Column, key: str) -> Column:
    value = attribute(attributes, key)
    return text.leading_int(F.coalesce(value["intValue"], value["stringValue"]))


def span_columns(spans: DataFrame) -> DataFrame:
    """Typed columns of spans; ``spans`` is ``(harness_session, name, path, pos, span)``."""
    span, attrs = F.col("span"), F.col("span.attributes")
    start, end = (span[f"{n}TimeUnixNano"].try_cast("bigint") for n in ("start", "end"))
    parent = F.when(span["parentSpanId"] != "", span["parentSpanId"])
    return spans.select(
        SESSION,
        F.struct("name", "path", "pos").alias("place"),
        F.col("path").alias("origin"),
        node_id(span["spanId"]).alias("id"),
        node_id(parent).alias("parent"),
        start.alias("start_ns"),
        end.alias("end_ns"),
        F.coalesce(string_attribute(attrs, "span.type"), span["name"]).alias("span_type"),
        *[string_attribute(attrs, key).alias(n) for n, key in STRING_ATTRIBUTES.items()],
        *[_int_attribute(attrs, key).alias(n) for n, key in INT_ATTRIBUTES.items()],
    )


def ordered_logs(logs: DataFrame) -> DataFrame:
    """Log events with a unique, time-ordered key per session."""
    return logs.withColumn(
        "order", F.struct(text.leading_int(F.col("event_sequence")).alias("n"), "path", "pos")
    ).withColumn("log_id", F.concat_ws("\u0001", "path", F.col("pos").cast("string")))


def attribute_logs(spans: DataFrame, logs: DataFrame, cold: bool) -> DataFrame:
    """``(harness_session, log_id, span_id)``: the span each event belongs to.

    By request id; without one by its own span if that has a parent; else by the narrowest span
    around its time. An unknown request id leaves the event unattributed.
    """
    keyed = logs.select(SESSION, "log_id", "request_id", "span_id", "timestamp_ns")
    requests = (
        spans.filter("request_id is not null")
        .groupBy(SESSION, "request_id")
        .agg(F.max_by("id", F.struct("start_ns", "place")).alias("target"))
    )
    by_request = keyed.filter("request_id is not null").join(requests, [SESSION, "request_id"])
    rest = keyed.filter("request_id is null").withColumn(
        "target", F.concat(F.lit("s"), "span_id")
    )
    children = spans.filter("parent is not null").select(SESSION, F.col("id").alias("target")).distinct()
    by_span = rest.join(children, [SESSION, "target"], "left_semi")
    timed = rest.filter("timestamp_ns is not null").join(
        children, [SESSION, "target"], "left_anti"
    )
    around = best_covering(
        timed,
        spans,
        [SESSION],
        "log_id",
        "timestamp_ns",
        "start_ns",
        "end_ns",
        [F.col("end_ns") - F.col("start_ns"), F.col("start_ns"), F.col("place")],
        F.col("id"),
        "target",
        cold,
    )
    keep = [SESSION, "log_id", F.col("target").alias("span_id")]
    return by_request.select(*keep).unionByName(by_span.select(*keep)).unionByName(
        around.select(*keep)
    )


def zipped_bodies(logs: DataFrame, cold: bool) -> DataFrame:
    """Request body per request id: the i-th request body goes with the i-th response."""
    asked = logs.filter("event_name = 'api_request_body' and body is not null").select(
        SESSION, "order", "body"
    )
    replied = logs.filter("event_name = 'api_response_body' and request_id is not null").select(
        SESSION, "order", "request_id"
    )
    nth = [position("nth")]
    left = scan(asked, [SESSION], ["order"], nth, cold).drop("order")
    right = scan(replied, [SESSION], ["order"], nth, cold).drop("order")
    return (
        left.join(right, [SESSION, "nth"])
        .groupBy(SESSION, "request_id")
        .agg(F.max_by("body", "nth").alias("zipped_body"))
    )


def llm_enrichment(attributed: DataFrame) -> DataFrame:
    """What log events add to llm spans: ``(session, id, log_source, log_cost, log bodies)``."""
    event = F.col("event_name")

    def first(value, condition):
        return F.min_by(value, F.when(condition, F.col("order")))

    has_body = F.col("body").isNotNull()
    return attributed.groupBy(SESSION, F.col("span_id").alias("id")).agg(
        first(F.struct("query_source", "cost_usd"), event == "api_request").alias("api"),
        first(F.col("body"), (event == "api_request_body") & has_body).alias("log_request"),
        first(F.col("body"), (event == "api_response_body") & has_body).alias("log_response"),
    )


def tool_enrichment(spans: DataFrame, logs: DataFrame, attributed: DataFrame) -> DataFrame:
    """Call id and input of tools, from the decision on the wait inside them."""
    inputs = (
        logs.filter("tool_use_id is not null and tool_input is not null")
        .groupBy(SESSION, F.col("tool_use_id").alias("log_use_id"))
        .agg(F.max_by("tool_input", F.struct("path", "pos")).alias("log_input"))
    )
    decisions = (
        attributed.filter("tool_use_id is not null")
        .groupBy(SESSION, F.col("span_id").alias("id"))
        .agg(F.min_by("tool_use_id", "order").alias("log_use_id"))
    )
    return (
        spans.filter("span_type = 'tool.blocked_on_user' and parent is not null")
        .select(SESSION, "id", "parent", "start_ns", "place")
        .join(decisions, [SESSION, "id"])
        .groupBy(SESSION, F.col("parent").alias("id"))
        .agg(F.max_by("log_use_id", F.struct("start_ns", "place")).alias("log_use_id"))
        .join(inputs, [SESSION, "log_use_id"], "left")
    )


def hook_runs(logs: DataFrame, cold: bool) -> DataFrame:
    """Hook executions: the n-th start of a hook with its n-th completion."""
    nth = [position("nth")]
    events = logs.filter("hook_name is not null").select(
        SESSION, "hook_name", "event_name", "order", F.col("timestamp_ns").alias("at"), "path"
    )
    starts = scan(
        events.filter("event_name = 'hook_execution_start'"), [SESSION], ["order"],
        [position("index")], cold,
    )
    starts = scan(starts, [SESSION, "hook_name"], ["order"], nth, cold)
    stops = scan(
        events.filter("event_name = 'hook_execution_complete'"), [SESSION, "hook_name"], ["order"],
        nth, cold,
    ).select(SESSION, "hook_name", "nth", F.col("at").alias("end_ns"))
    return starts.join(stops, [SESSION, "hook_name", "nth"], "left").select(
        SESSION,
        "hook_name",
        F.col("path").alias("origin"),
        F.col("at").alias("start_ns"),
        F.coalesce("end_ns", "at").alias("end_ns"),
        stable_id(
            "hook", F.concat_ws(":", F.col(SESSION), F.col("index").cast("string"))
        ).alias("id"),
    )


def hook_parent_hints(hooks: DataFrame, spans: DataFrame, cold: bool) -> DataFrame:
    """``(session, id, hint)``: the span a hook ran for, read from its name and time."""
    event = F.split_part("hook_name", F.lit(":"), F.lit(1))
    named = hooks.withColumn("event", event).withColumn(
        "tool_name",
        F.when(F.col("hook_name").contains(":"),
               F.regexp_extract("hook_name", r"(?s)^[^:]*:(.+)$", 1)),
    ).withColumn("tool_name", F.when(F.col("tool_name") != "", F.col("tool_name")))
    tools = spans.filter("span_type = 'tool' and tool_name is not null").select(
        SESSION, "tool_name", "id", "start_ns", "end_ns"
    )

    pre = named.filter("tool_name is not null and event = 'PreToolUse'")
    lined = pre.select(
        SESSION, "tool_name", "start_ns", F.lit(0).alias("kind"), "id",
        F.lit(None).cast("string").alias("tool_id"),
    ).unionByName(
        tools.select(
            SESSION, "tool_name", "start_ns", F.lit(1).alias("kind"), "id",
            F.col("id").alias("tool_id"),
        )
    )
    before_tool = (
        scan(lined, [SESSION, "tool_name"], ["start_ns", "kind", "id"],
             [upcoming("hint", F.col("tool_id"))], cold)
        .filter("kind = 0 and hint is not null")
        .select(SESSION, "id", "hint")
    )
    post = named.filter("tool_name is not null and event = 'PostToolUse'")
    after_tool = latest_ended(
        post, tools, [SESSION, "tool_name"], "id", "start_ns", "end_ns", [F.col("id")],
        F.col("id"), "hint", cold,
    ).select(SESSION, "id", "hint")

    plain = named.filter("tool_name is null")
    turns = (
        spans.filter("span_type = 'interaction'")
        .groupBy(SESSION)
        .agg(F.min_by("id", F.struct("start_ns", "place")).alias("hint"))
    )
    whole = plain.filter(F.col("event").isin(INTERACTION_HOOKS)).join(turns, SESSION).select(
        SESSION, "id", "hint"
    )
    loose = plain.filter(~F.col("event").isin(INTERACTION_HOOKS))
    ended = latest_ended(
        loose, spans, [SESSION], "id", "start_ns", "end_ns", [F.col("start_ns"), F.col("place")],
        F.col("id"), "ended", cold,
    )
    around = best_covering(
        loose, spans, [SESSION], "id", "start_ns", "start_ns", "end_ns",
        [F.col("end_ns") - F.col("start_ns"), F.col("start_ns"), F.col("place")],
        F.col("id"), "around", cold,
    )
    timed = (
        ended.join(around, [SESSION, "id"], "full_outer")
        .select(SESSION, "id", F.coalesce("ended", "around").alias("hint"))
    )
    return before_tool.unionByName(after_tool).unionByName(whole).unionByName(timed)


def missing_attributes(kind: Column) -> Column:
    """Names of the required attributes a span lacks."""
    required = {
        "interaction": ["session_attr", "sequence", "prompt", "user_id"],
        "llm_request": ["model", "tokens_in", "tokens_out"],
        "hook": ["hook_name"],
    }
    return F.filter(
        F.array(
            *[
                F.when((kind == k) & F.col(c).isNull(), c)
                for k, cols in required.items()
                for c in cols
            ]
        ),
        lambda c: c.isNotNull(),
    )


def enriched_spans(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Typed spans of whole sessions with what their log events add, hooks included."""
    typed = settle(span_columns(spans))
    events = settle(ordered_logs(logs))
    cold = not (has_hot_group(typed, [SESSION]) or has_hot_group(events, [SESSION]))

    links = attribute_logs(typed, events, cold)
    attributed = settle(
        events.drop("span_id").join(links, [SESSION, "log_id"])
    )
    for_llm = llm_enrichment(attributed)
    for_tools = tool_enrichment(typed, events, attributed)
    # Spans without a request id stay out of the join on it.
    asked = typed.filter("request_id is not null").join(
        zipped_bodies(events, cold), [SESSION, "request_id"], "left"
    )
    others = typed.filter("request_id is null").withColumn(
        "zipped_body", F.lit(None).cast("string")
    )
    full = (
        asked.unionByName(others)
        .join(for_llm, [SESSION, "id"], "left")
        .join(for_tools, [SESSION, "id"], "left")
    )
    is_llm, is_tool = F.col("span_type") == "llm_request", F.col("span_type") == "tool"
    enriched = full.withColumns(
        {
            "source": F.coalesce("own_source", F.when(is_llm, F.col("api.query_source"))),
            "cost": F.coalesce("own_cost", F.when(is_llm, F.col("api.cost_usd"))),
            "request_body": F.coalesce(
                "own_request", F.when(is_llm, F.coalesce("zipped_body", "log_request"))
            ),
            "response_body": F.coalesce(
                "own_response", F.when(is_llm, F.col("log_response"))
            ),
            "tool_use_id": F.coalesce(
                "own_tool_use_id", F.when(is_tool, F.col("log_use_id")), "call_id"
            ),
            "tool_input": F.coalesce("own_input", F.when(is_tool, F.col("log_input"))),
        }
    ).drop("api", "log_request", "log_response", "zipped_body", "log_use_id", "log_input")

    traced = typed.select(SESSION).distinct()
    hooks = settle(hook_runs(events, cold).join(traced, SESSION, "left_semi"))
    # Hooks of a session with a root hang below it; only others need to be placed by name and time.
    is_root = F.coalesce(F.col("parent").isNull() & (F.col("span_type") != "hook"), F.lit(False))
    rootless = typed.groupBy(SESSION).agg(F.bool_or(is_root).alias("rooted")).filter("not rooted").select(SESSION)
    rootless = settle(rootless)
    hints = hook_parent_hints(
        hooks.join(rootless, SESSION, "left_semi"), typed.join(rootless, SESSION, "left_semi"), cold
    )
    hook_spans = hooks.join(hints, [SESSION, "id"], "left").select(
        SESSION, "origin", "id", F.col("hint").alias("parent"), "start_ns", "end_ns",
        F.lit("hook").alias("span_type"), "hook_name",
    )
    return enriched.unionByName(hook_spans, allowMissingColumns=True)


def otel_nodes(
    spans: DataFrame, logs: DataFrame, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Canonical nodes of traced sessions, and the spans that lack required attributes.

    ``spans`` is ``(harness_session, name, path, pos, span)`` and ``logs`` the events with their
    ``harness_session``. With ``strict`` a lacking span fails the job instead.
    """
    ready = settle(enriched_spans(spans, logs))
    # Per session: the root that takes in the hooks, and the session named by the first span.
    roots = ready.groupBy(SESSION).agg(
        F.min_by("id", F.when(F.col("parent").isNull() & (F.col("span_type") != "hook"),
                              F.col("id"))).alias("root"),
        F.min_by("session_attr", F.when(F.col("session_attr").isNotNull(), F.col("id"))).alias(
            "named_session"
        ),
        F.min("origin").alias("first_origin"),
    )
    kind = F.when(F.col("span_type").isin(NODE_TYPES), F.col("span_type")).otherwise("interaction")
    typed = (
        ready.join(roots, SESSION)
        .withColumn("type", kind)
        .withColumn("missing", missing_attributes(F.col("type")))
    )
    lacks = F.size("missing") > 0
    if strict:
        message = F.concat(
            F.lit("span "), "id", F.lit(": missing required attributes "),
            F.array_join("missing", ", "),
        )
        typed = typed.withColumn("id", F.when(lacks, F.raise_error(message)).otherwise(F.col("id")))
    rejects = typed.filter(lacks).select(SESSION, "id", "type", "missing")
    # A filter would drop the lacking rows before they can fail.
    good = typed if strict else typed.filter(~lacks)

    is_llm = F.col("type") == "llm_request"
    is_turn = F.col("type") == "interaction"
    is_tool = F.col("type") == "tool"
    is_hook = F.col("type") == "hook"
    read = good.withColumn(
        "request_body", bodies.decoded(F.when(is_llm, F.col("request_body")))
    )

    def only(condition, col):
        return F.when(condition, F.col(col) if isinstance(col, str) else col)

    nodes = canonical(
        read,
        parent=F.when(is_hook, F.coalesce("root", "parent")).otherwise(F.col("parent")),
        session_id=F.coalesce(session_key(F.col("named_session")), F.lit("")),
        harness_session=F.coalesce("session_attr", SESSION),
        origin=F.col("first_origin"),
        start_time_ns=F.col("start_ns"),
        end_time_ns=F.col("end_ns"),
        duration_ms=millis(F.col("start_ns"), F.col("end_ns")),
        model=only(is_llm, "model"),
        source=only(is_llm, "source"),
        stop_reason=only(is_llm, bodies.stop_reason(F.col("response_body"))),
        tokens_in=only(is_llm, "tokens_in"),
        tokens_out=only(is_llm, "tokens_out"),
        cache_read_tokens=only(is_llm, F.coalesce("cache_read", F.lit(0))),
        cache_write_tokens=only(is_llm, F.coalesce("cache_write", F.lit(0))),
        cost_usd=only(is_llm, text.leading_float(F.col("cost"))),
        name=F.when(is_tool, F.col("tool_name")).when(is_hook, F.col("hook_name")),
        tool_use_id=only(is_tool, "tool_use_id"),
        tool_input=only(is_tool, "tool_input"),
        sequence=only(is_turn, "sequence"),
        prompt=only(is_turn, "prompt"),
        user_id=only(is_turn, "user_id"),
        cwd=only(is_turn, "cwd"),
        branch=only(is_turn, "branch"),
        request_messages=only(is_llm, bodies.request_messages(F.col("request_body"))),
        response_messages=only(is_llm, bodies.response_messages(F.col("response_body"))),
    )
    return nodes, rejects
