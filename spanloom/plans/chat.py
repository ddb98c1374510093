"""Native session logs to canonical nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import messages
from spanloom.operators.climb import nearest_stop
from spanloom.operators.ordered import after, before, has_hot_group, latest, position, scan
from spanloom.operators.stab import best_covering
from spanloom.plans.columns import PSEUDO_USER, canonical, millis, session_key, stable_id
from spanloom.runtime import settle
from spanloom.sources import chatlog

SESSION = "harness_session"
PLACE = ["path", "block", "line"]
OPEN_END = 1 << 62


def _place() -> Column:
    return F.struct(*PLACE)


def _time_place() -> Column:
    return F.struct("at", *PLACE)


def session_entries(parsed: DataFrame, merge_files: bool = False) -> DataFrame:
    """Entries of the file(s) each session is read from."""
    chosen = chatlog.session_files(chatlog.file_sessions(parsed), merge_files)
    return parsed.drop(SESSION).join(chosen, "path").filter("uuid is not null")


def interactions(entries: DataFrame, cold: bool) -> DataFrame:
    """One row per user prompt with the half-open time window it owns."""
    prompts = entries.filter(chatlog.is_user_prompt()).select(
        SESSION, *PLACE, "uuid", "at", "content", "cwd", "branch"
    )
    return scan(
        prompts, [SESSION], PLACE, [position("sequence"), after("next_at", F.col("at"))], cold
    ).withColumn("interaction_id", stable_id("interaction", F.col("uuid")))


def assign_to_windows(items: DataFrame, windows: DataFrame, cold: bool) -> DataFrame:
    """``(session, place..., owner)`` of the interaction whose window holds each item's time.

    Windows in time order need one as-of scan. A log whose prompts run backwards in time can have
    overlapping windows; there the earliest interaction wins.
    """
    owner = F.col("interaction_id")
    backwards = (
        windows.filter(F.col("next_at") < F.col("at")).select(SESSION).distinct()
    )
    opened = windows.join(backwards, SESSION, "left_anti").select(
        SESSION, "at", F.lit(0).alias("kind"), *PLACE, owner.alias("owner")
    )
    slim = items.select(SESSION, "at", F.lit(1).alias("kind"), *PLACE)
    in_order = slim.join(backwards, SESSION, "left_anti").withColumn(
        "owner", F.lit(None).cast("string")
    )
    found = (
        scan(
            opened.unionByName(in_order),
            [SESSION],
            ["at", "kind", *PLACE],
            [latest("held_by", F.col("owner"))],
            cold,
        )
        .filter("kind = 1 and held_by is not null")
        .select(SESSION, *PLACE, F.col("held_by").alias("owner"))
    )
    spans = (
        windows.join(backwards, SESSION, "left_semi")
        .withColumn("until", F.coalesce(F.col("next_at") - 1, F.lit(OPEN_END)))
        .filter("at <= until")
    )
    points = slim.join(backwards, SESSION, "left_semi").withColumn("spot", _place())
    overlapping = best_covering(
        points, spans, [SESSION], "spot", "at", "at", "until", [F.col("sequence")], owner, "owner",
        cold,
    ).select(SESSION, "spot.*", "owner")
    return found.unionByName(overlapping)


def request_groups(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per inference: its chunks in time order, folded."""
    chunks = entries.filter("kind = 'assistant' and at is not null and request_key is not null")
    usage = F.struct(
        "model", "tokens_in", "tokens_out", "cache_read_tokens", "cache_write_tokens", "uuid"
    )
    folded = chunks.groupBy(SESSION, "request_key").agg(
        F.min_by(usage, _time_place()).alias("first"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.max_by("stop_reason", _time_place()).alias("stop_reason"),
        F.min_by(F.struct("at", *PLACE), _place()).alias("lead"),
        F.sort_array(
            F.collect_list(
                F.struct(
                    "at",
                    *PLACE,
                    F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"),
                )
            )
        ).alias("chunks"),
    )
    return (
        folded.select(
            SESSION, "request_key", "first", "first_at", "last_at", "stop_reason", "lead.*",
            F.flatten(F.transform("chunks", lambda c: c["blocks"])).alias("response_messages"),
        )
        .withColumnRenamed("at", "lead_at")
        .join(owners, [SESSION, *PLACE])
    )


def triggering_users(entries: DataFrame) -> DataFrame:
    """Nearest user entry above each entry: ``(session, uuid, trigger_at, trigger_content)``."""
    by_uuid = entries.groupBy(SESSION, "uuid").agg(
        F.max_by(F.struct("parent_uuid", "kind", "at"), _place()).alias("e")
    )
    links = by_uuid.select(SESSION, "uuid", "e.*")
    found = nearest_stop(links, "uuid", "parent_uuid", F.col("kind") == "user", [SESSION])
    body = F.coalesce(messages.json_array(F.col("blocks")), messages.quoted(F.col("content")))
    users = (
        entries.filter("kind = 'user'")
        .groupBy(SESSION, F.col("uuid").alias("stop"))
        .agg(
            F.max_by(
                F.struct(F.col("at").alias("trigger_at"), body.alias("trigger_content")), _place()
            ).alias("u")
        )
        .select(SESSION, "stop", "u.*")
    )
    return found.filter("found").join(users, [SESSION, "stop"]).drop("stop", "found")


def result_entries(entries: DataFrame) -> DataFrame:
    """Which user entry answers a tool call: ``(session, tool_use_id, result_at, place...)``."""
    answered = (
        entries.filter("kind = 'user' and at is not null and blocks is not null")
        .select(SESSION, "at", *PLACE, F.explode("blocks").alias("b"))
        .select(SESSION, "at", *PLACE, messages.block(F.col("b")).alias("b"))
        .filter("b.type = 'tool_result' and b.tool_use_id is not null")
    )
    return (
        answered.groupBy(SESSION, F.col("b.tool_use_id").alias("tool_use_id"))
        .agg(F.max_by(F.struct(F.col("at").alias("result_at"), *PLACE), _place()).alias("r"))
        .select(SESSION, "tool_use_id", "r.*")
    )


def tool_calls(entries: DataFrame) -> DataFrame:
    """First occurrence of every tool_use block of an inference."""
    calls = (
        entries.filter("kind = 'assistant' and at is not null and request_key is not null")
        .filter("blocks is not null")
        .select(SESSION, "request_key", "at", *PLACE, F.posexplode("blocks").alias("pos", "b"))
        .withColumn("b", messages.block(F.col("b")))
        .filter("b.type = 'tool_use' and b.id is not null")
    )
    order = F.struct("at", *PLACE, "pos")
    return (
        calls.groupBy(SESSION, "request_key", F.col("b.id").alias("tool_use_id"))
        .agg(
            F.min(order).alias("order"),
            F.min_by(F.struct("at", "b.name", "b.input"), order).alias("call"),
        )
        .select(SESSION, "request_key", "tool_use_id", "order", "call.*")
    )


def answers(entries: DataFrame, groups: DataFrame, calls: DataFrame, results: DataFrame):
    """Blocks fed back to an inference: the results of the calls made by the one before it."""
    link = groups.select(
        SESSION, "request_key", F.col("previous_key").alias("asked_by")
    ).filter("asked_by is not null")
    asked = calls.select(SESSION, F.col("request_key").alias("asked_by"), "tool_use_id", "order")
    answering = (
        link.join(asked, [SESSION, "asked_by"])
        .join(results.drop("result_at"), [SESSION, "tool_use_id"])
        .groupBy(SESSION, "request_key", *PLACE)
        .agg(F.min("order").alias("order"))
    )
    bodies = entries.filter("kind = 'user' and blocks is not null").select(
        SESSION, *PLACE, "blocks"
    )
    return (
        answering.join(bodies, [SESSION, *PLACE])
        .groupBy(SESSION, "request_key")
        .agg(F.sort_array(F.collect_list(F.struct("order", "blocks"))).alias("fed"))
        .select(
            SESSION, "request_key",
            F.flatten(F.transform("fed", lambda f: f["blocks"])).alias("answer_blocks"),
        )
    )


def chat_nodes(parsed: DataFrame, merge_files: bool = False) -> DataFrame:
    """Canonical nodes of native session logs, from stored parsed entries."""
    entries = settle(session_entries(parsed, merge_files))
    cold = not has_hot_group(entries, [SESSION])
    turns = settle(interactions(entries, cold))
    items = entries.filter(
        "at is not null and (kind = 'assistant' or (kind = 'system' and subtype = 'turn_duration'))"
    )
    owners = settle(assign_to_windows(items, turns, cold))

    placed = items.select(SESSION, *PLACE, "kind", "at").join(owners, [SESSION, *PLACE])
    ends = placed.groupBy(F.col("owner").alias("interaction_id")).agg(
        F.min_by(F.when(F.col("kind") == "system", F.col("at")),
                 F.when(F.col("kind") == "system", _place())).alias("turn_end"),
        F.max_by(F.when(F.col("kind") == "assistant", F.col("at")),
                 F.when(F.col("kind") == "assistant", _place())).alias("last_reply"),
    )
    common = {
        "harness_session": F.col(SESSION),
        "session_id": session_key(F.col(SESSION)),
        "origin": F.col("path"),
    }
    end = F.greatest(F.coalesce("turn_end", "last_reply", "at"), "at")
    interaction_nodes = canonical(
        turns.join(ends, "interaction_id", "left"),
        **common,
        id=F.col("interaction_id"),
        type=F.lit("interaction"),
        start_time_ns=F.col("at"),
        end_time_ns=end,
        duration_ms=millis(F.col("at"), end),
        prompt=F.col("content"),
        user_id=F.lit(PSEUDO_USER),
    )

    groups = scan(
        request_groups(entries, owners),
        ["owner"],
        ["lead_at", *PLACE, "request_key"],
        [before("previous_key", F.col("request_key"))],
        cold,
    )
    groups = settle(groups)
    calls = settle(tool_calls(entries))
    results = settle(result_entries(entries))
    full = (
        groups.withColumn("uuid", F.col("first.uuid"))
        .join(triggering_users(entries), [SESSION, "uuid"], "left")
        .join(answers(entries, groups, calls, results), [SESSION, "request_key"], "left")
    )
    start = F.coalesce("trigger_at", "first_at")
    end = F.greatest(start, F.col("last_at"))
    fed = F.when(F.size("answer_blocks") > 0, messages.json_array(F.col("answer_blocks")))
    body = F.coalesce(fed, F.col("trigger_content"), F.lit("null"))
    inference_nodes = canonical(
        full.select("*", "first.model", "first.tokens_in", "first.tokens_out",
                    "first.cache_read_tokens", "first.cache_write_tokens"),
        **common,
        id=stable_id("llm_request", F.col("request_key")),
        type=F.lit("llm_request"),
        parent=F.col("owner"),
        start_time_ns=start,
        end_time_ns=end,
        duration_ms=millis(start, end),
        request_messages=F.array(messages.user_message(body)),
    )

    owned = calls.join(
        groups.select(SESSION, "request_key", "owner", "path"), [SESSION, "request_key"]
    )
    end = F.greatest(F.col("at"), F.coalesce("result_at", "at"))
    tool_nodes = canonical(
        owned.join(
            results.select(SESSION, "tool_use_id", "result_at"), [SESSION, "tool_use_id"], "left"
        ),
        **common,
        id=stable_id("tool", F.col("tool_use_id")),
        type=F.lit("tool"),
        parent=F.col("owner"),
        start_time_ns=F.col("at"),
        end_time_ns=end,
        duration_ms=millis(F.col("at"), end),
        name=F.coalesce("name", F.lit("unknown")),
        tool_input=F.col("input"),
    )
    return interaction_nodes.unionByName(inference_nodes).unionByName(tool_nodes)
