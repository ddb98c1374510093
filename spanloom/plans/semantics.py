"""Semantic entries of tools and inferences, and their grounding in the repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import labels, messages, paths, text

ENTRY = "struct<kind: string, label: string, name: string, input: string>"


def _entry(kind: str, label=None, name=None, tool_input=None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        (F.lit(label) if isinstance(label, str) else nothing if label is None else label).alias(
            "label"
        ),
        (nothing if name is None else name).alias("name"),
        (nothing if tool_input is None else tool_input).alias("input"),
    )


def tool_entries(nodes: DataFrame) -> DataFrame:
    """Entry seeds of tool nodes: the call itself, then what it hands to a weak model."""
    tools = nodes.filter("type = 'tool'").select(
        "id",
        "session_id",
        "name",
        F.when(F.expr("try_parse_json(tool_input) is not null"), F.col("tool_input")).alias("ti"),
    )
    call = _entry("tool", name=F.col("name"), tool_input=F.col("ti"))
    extra = _entry("label", labels.WEAK_MODEL_LABEL)
    both = F.when(
        F.coalesce(labels.hands_to_weak_model(F.col("name"), F.col("ti")), F.lit(False)),
        F.array(call, extra),
    ).otherwise(F.array(call))
    return tools.select("id", "session_id", both.alias("entries"))


def inference_entries(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Entry seeds of inferences, read from their message deltas."""
    empty = F.array().cast("array<string>")
    read = (
        nodes.filter("type = 'llm_request'")
        .select("id", "session_id", "model")
        .join(deltas, "id", "left")
        .withColumn("said", F.transform(F.coalesce("response", empty), messages.block))
    )
    first_text = F.get(
        F.filter("said", lambda b: (b["type"] == "text") & b["text"].isNotNull()), F.lit(0)
    )["text"]
    read = read.withColumns(
        {
            "reply": text.first_non_empty(text.trim(first_text)),
            "calls": F.filter(
                "said", lambda b: (b["type"] == "tool_use") & b["name"].isNotNull()
            ),
            "thinks": F.exists("said", lambda b: F.coalesce(b["type"] == "thinking", F.lit(False))),
        }
    )
    reply = F.col("reply")
    titled = reply.startswith("{") & F.expr(
        f"try_variant_get(try_parse_json(reply), '$.{labels.TITLE_KEY}', 'string') is not null"
    )
    suggests = F.exists(
        F.coalesce("request", empty),
        lambda m: text.ltrim(messages.message_text(m)).startswith(labels.SUGGESTION_PREFIX),
    )
    thinking = F.when(F.col("thinks"), F.array(_entry("label", labels.PLAN_LABEL))).otherwise(
        F.array().cast(f"array<{ENTRY}>")
    )
    calls = F.transform(
        "calls", lambda b: _entry("call", name=b["name"], tool_input=F.when(
            b["input"].startswith("{"), b["input"]))
    )
    respond = F.array(_entry("label", labels.action_label(labels.RESPOND_ACTION)))
    structural = F.concat(thinking, calls)
    entries = (
        F.when(F.coalesce(titled, F.lit(False)),
               F.array(_entry("label", labels.action_label(labels.TITLE_ACTION))))
        .when(F.coalesce(suggests, F.lit(False)),
              F.array(_entry("label", labels.action_label(labels.SUGGESTION_ACTION))))
        .when(reply.isNotNull() & (F.size("calls") == 0), F.concat(thinking, respond))
        .when(F.size(structural) > 0, structural)
        .otherwise(F.array(_entry("label", F.col("model"))))
    )
    return read.select("id", "session_id", entries.alias("entries"))


def label_entries(seeds: DataFrame) -> DataFrame:
    """One labelled row per entry: ``(id, session_id, sequence_in_node, action, ...)``."""
    rows = seeds.select(
        "id", "session_id", F.posexplode("entries").alias("sequence_in_node", "e")
    ).select("id", "session_id", "sequence_in_node", "e.*")
    labelled = labels.with_tool_labels(rows, "name", "input")
    is_call = F.col("kind") == "call"
    action = (
        F.when(F.col("kind") == "label", F.col("label"))
        .when(is_call & (F.col("name") == "Skill"), labels.SKILL_CALL_LABEL)
        .when(is_call, F.concat(F.lit(labels.CALL_PREFIX), F.col("tool_label")))
        .otherwise(F.col("tool_label"))
    )
    heads_tool = (F.col("kind") == "tool") & (F.col("sequence_in_node") == 0)
    return labelled.select(
        "id",
        "session_id",
        "sequence_in_node",
        action.alias("action"),
        "raw_path",
        "url",
        F.when(heads_tool, F.col("tool_comment")).alias("comment"),
    )


def ground(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turn raw paths into repo paths and packages with the session's working directory."""
    cwds = sessions.select(F.col("id").alias("session_id"), "cwd")
    known = rows.join(cwds, "session_id", "left")
    grounded = paths.with_repo_path(known, "raw_path", "cwd", "repo_path")
    return grounded.select(
        "id",
        "sequence_in_node",
        "action",
        "repo_path",
        paths.package(F.col("repo_path")).alias("package"),
        "url",
        "comment",
    )


def enrich(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Node-local entries of every tool and inference, before grounding."""
    return label_entries(tool_entries(nodes).unionByName(inference_entries(nodes, deltas)))


def semantics(nodes: DataFrame, deltas: DataFrame, sessions: DataFrame) -> DataFrame:
    return ground(enrich(nodes, deltas), sessions)
