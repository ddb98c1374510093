"""Traces read from general tables, so every step can run on data of any size.

``events`` becomes one session per user: a signup is a prompt, a view an inference, a click or an
error a tool call, a purchase a hook. ``conversations`` becomes native session logs. Other tables
supply paths, commands, URLs and texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.ordered import has_hot_group, latest, scan
from spanloom.plans import graph, semantics, tables
from spanloom.plans.columns import MAIN_THREAD, canonical, millis
from spanloom.runtime import spread

CWD = "/repo"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost far more to process than to move."""
    return spread(read(spark, sf_dir, name))


def utc_micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: ``(event_id, user_id, event_type, value, k, id, s, e)``."""
    start = utc_micros(F.col("ts")) * 1000
    seconds = F.round(F.col("value") * 600).cast("bigint")
    return read(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        start.alias("s"),
        (start + seconds * 1_000_000_000).alias("e"),
    )


def is_cold(spark: SparkSession, sf_dir: str) -> bool:
    """No user owns more events than one task should hold."""
    return not has_hot_group(read(spark, sf_dir, "events"), ["user_id"])


def _pick(index: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


USES = 3  # few call ids, so that calls and results meet


def use_id(k: Column) -> Column:
    return F.concat(F.lit("tu"), (k % USES).cast("string"))


def result_message(k: Column) -> Column:
    """A message that hands a tool result back."""
    texts = ["no such file", "Permission denied", "timed out", "exit code 2", "done"]
    failed = F.when(k % 5 != 4, F.lit("true")).otherwise("false")
    return F.concat(
        F.lit('{"role":"user","content":[{"type":"tool_result","tool_use_id":"'),
        use_id(k), F.lit('","is_error":'), failed,
        F.lit(',"content":"'), _pick(k, texts), F.lit('"}]}'),
    )


def call_block(use: Column, k: Column) -> Column:
    """A response block that calls a tool."""
    edit = F.concat(
        F.lit('{"file_path":"/repo/packages/p'), (k % 3).cast("string"),
        F.lit("/src/f"), (k % 5).cast("string"), F.lit('.ts"}'),
    )
    command = F.concat(
        F.lit('{"command":"'), _pick(k, ["git status", "pnpm test", "grep x y", "ls"]), F.lit('"}')
    )
    return F.when(k % 2 == 0, edit).otherwise(command)


def event_nodes(spark: SparkSession, sf_dir: str, cold: bool) -> DataFrame:
    """Canonical nodes of ``events`` with their ``interaction_id``.

    Some clicks are executions inside the latest tool, some views run inside the latest execution,
    so the tree is up to four levels deep.
    """
    kind = (
        F.when(F.col("event_type") == "signup", "interaction")
        .when(F.col("event_type") == "purchase", "hook")
        .when(F.col("event_type") == "view", "llm_request")
        .when((F.col("event_type") == "click") & (F.col("k") % 9 == 0), "tool.execution")
        .otherwise("tool")
    )
    typed = event_rows(spark, sf_dir).withColumn("type", kind)
    owned = scan(
        typed,
        ["user_id"],
        ["s", "event_id"],
        [latest("interaction_id", F.when(F.col("type") == "interaction", F.col("id")))],
        cold,
    ).filter("interaction_id is not null")
    placed = scan(
        owned,
        ["interaction_id"],
        ["s", "event_id"],
        [
            latest("last_tool", F.when(F.col("type") == "tool", F.col("id"))),
            latest("last_run", F.when(F.col("type") == "tool.execution", F.col("id"))),
        ],
        cold,
    )
    k = F.col("k")
    parent = (
        F.when(F.col("type") == "interaction", None)
        .when(F.col("type") == "tool.execution", F.coalesce("last_tool", "interaction_id"))
        .when((F.col("type") == "llm_request") & (k % 13 == 0),
              F.coalesce("last_run", "interaction_id"))
        .otherwise(F.col("interaction_id"))
    )
    is_llm, is_tool = F.col("type") == "llm_request", F.col("type") == "tool"
    is_turn, failed = F.col("type") == "interaction", F.col("event_type") == "error"
    hooks = ["PreToolUse:Edit", "PreToolUse:Bash", "PostToolUse:Edit", "PostToolUse:Bash",
             "UserPromptSubmit", "Stop"]
    blocks = F.array(
        *[
            F.concat(
                F.lit('{"type":"tool_use","id":"'), use_id(k + shift),
                F.lit('","name":"'), _pick(k + shift, ["Edit", "Bash"]), F.lit('","input":'),
                call_block(k, k + shift), F.lit("}"),
            )
            for shift in (0, 1)
        ]
    )
    text_reply = F.array(F.lit('{"type":"text","text":"All done."}'))
    plain = F.concat(F.lit('{"role":"user","content":"m'), (k % 4).cast("string"), F.lit('"}'))
    session = F.concat(F.lit("session-"), F.col("user_id").cast("string"))
    return canonical(
        placed,
        extra=["interaction_id"],
        parent=parent,
        session_id=session,
        harness_session=F.col("user_id").cast("string"),
        origin=session,
        start_time_ns=F.col("s"),
        end_time_ns=F.col("e"),
        duration_ms=millis(F.col("s"), F.col("e")),
        model=F.when(is_llm, F.when(k % 10 == 0, "small-haiku").otherwise("big")),
        source=F.when(is_llm, F.when(k % 2 == 0, MAIN_THREAD).otherwise("side")),
        stop_reason=F.when(is_llm, F.when(k % 3 == 0, "end_turn").otherwise("tool_use")),
        tokens_in=F.when(is_llm, k),
        tokens_out=F.when(is_llm, F.col("value")),
        cache_read_tokens=F.when(is_llm, F.lit(0)),
        cache_write_tokens=F.when(is_llm, F.lit(0)),
        cost_usd=F.when(is_llm & (k % 4 == 0), F.col("value") / 100),
        name=F.when(is_tool, _pick(k, ["Edit", "Bash"]))
        .when(F.col("type") == "hook", _pick(k, hooks)),
        tool_use_id=F.when(is_tool & (k % 5 != 0), use_id(k)),
        tool_input=F.when(is_tool, call_block(k, k)),
        sequence=F.when(is_turn, k),
        prompt=F.when(is_turn, F.concat(F.lit("please fix item "), k.cast("string"))),
        user_id=F.when(is_turn, F.col("user_id").cast("string")),
        cwd=F.when(is_turn, F.lit(CWD)),
        request_messages=F.when(is_llm, F.array(plain, result_message(k + 2), result_message(k + 3))),
        response_messages=F.when(is_llm, F.when(k % 3 == 0, text_reply).otherwise(blocks)),
        is_error=F.when(is_tool, failed),
        error_kind=F.when(
            is_tool & failed,
            _pick(k, ["not_found", "invalid_args", "permission", "timeout", "nonzero_exit"]),
        ),
        error_message=F.when(is_tool & failed, F.concat(F.lit("bad "), k.cast("string"))),
    )


def event_semantics(nodes: DataFrame) -> DataFrame:
    """Grounded entries of the tools of ``events``."""
    entries = semantics.label_entries(semantics.tool_entries(nodes))
    return semantics.ground(entries, graph.session_facts(nodes))


def event_tables(nodes: DataFrame, cold: bool) -> dict[str, DataFrame]:
    """``nodes``, ``semantics``, ``sessions`` and ``interaction_metrics`` over event nodes."""
    made = {
        "nodes": graph.with_seq(nodes, cold),
        "semantics": event_semantics(nodes),
        "sessions": graph.sessions(nodes),
    }
    made["interaction_metrics"] = tables.interaction_metrics(nodes, made["semantics"])
    return made


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as lines of native session logs: ``(path, block, line, value)``."""
    talk = read(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    uuid = F.concat_ws("-", conv, turn.cast("string"))
    at = F.date_format(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + turn * 10),
        "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    )
    is_reply = F.col("role") == "assistant"
    usage = F.to_json(
        F.struct(F.length("text").alias("input_tokens"), turn.alias("output_tokens"))
    )
    reply = F.concat(
        F.lit('{"id":"m'), uuid, F.lit('","model":"big","stop_reason":"end_turn","usage":'), usage,
        F.lit(',"content":['),
        F.to_json(F.struct(F.lit("text").alias("type"), F.col("text"))), F.lit("]}"),
    )
    said = F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    head = F.to_json(
        F.struct(
            uuid.alias("uuid"),
            F.when(turn > 0, F.concat_ws("-", conv, (turn - 1).cast("string"))).alias(
                "parentUuid"
            ),
            F.col("role").alias("type"),
            at.alias("timestamp"),
            F.concat(F.lit("c"), conv).alias("sessionId"),
            F.when(is_reply, F.concat(F.lit("r"), uuid)).alias("requestId"),
            F.lit(CWD).alias("cwd"),
        )
    )
    value = F.concat(
        F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"message":'),
        F.when(is_reply, reply).otherwise(said), F.lit("}"),
    )
    return talk.select(
        F.concat(F.lit("/logs/c"), conv, F.lit(".jsonl")).alias("path"),
        F.lit(0).cast("bigint").alias("block"),
        turn.cast("bigint").alias("line"),
        value.alias("value"),
    )


def tool_chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as native logs with tool calls: ``(path, block, line, value)``.

    A reply comes in two chunks of one request; the second calls a tool, twice by the same id. Two in three
    calls are answered, some replies are followed by the end of their turn, and every fourth user entry is no
    prompt. Blank and broken lines lie between, and each session has a second file of other entries.
    """
    talk = read(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    turn, key = F.col("turn"), F.col("key")
    above = F.when(turn > 0, F.concat_ws("-", "conv_id", (turn - 1).cast("string")))

    def entry(kind: Column, seconds: int, uuid: Column, parent: Column, message: Column | None, **more: Column) -> Column:
        at = F.timestamp_seconds(F.lit(1_700_000_000 + seconds) + F.col("conv_id") * 1000 + turn * 10)
        fields = {
            "uuid": uuid, "parentUuid": parent, "type": kind, "sessionId": F.concat(F.lit("c"), F.col("conv_id")),
            "timestamp": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "message": message, **more,
        }
        return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items() if c is not None]))

    def call(name: Column) -> Column:
        path = F.struct(F.concat(F.lit("/repo/"), key, F.lit(".ts")).alias("file_path"))
        return F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("u"), key).alias("id"), name.alias("name"), path.alias("input"))

    def chunk(stop: Column, tokens: Column, *blocks: Column) -> Column:
        return F.struct(stop.alias("stop_reason"), F.struct(tokens.alias("input_tokens")).alias("usage"), F.array(*blocks).alias("content"))

    said = F.when(turn % 4 == 2, F.concat(F.lit("<note>"), "text")).otherwise(F.col("text"))
    text = F.struct(F.lit("text").alias("type"), F.col("text"))
    tool = F.when(turn % 5 != 0, _pick(turn, ["Edit", "Bash", "Read"]))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("u"), key).alias("tool_use_id"), F.col("text").alias("content"))
    reply, user, request = F.lit("assistant"), F.lit("user"), F.concat(F.lit("r"), key)
    second, third = F.concat(key, F.lit("b")), F.concat(key, F.lit("r"))
    none = F.lit(None).cast("string")
    lines = {
        0: entry(reply, 0, key, above, chunk(none, F.length("text"), text), requestId=request),
        1: entry(reply, 1, second, key, chunk(F.lit("tool_use"), F.lit(1_000_000), call(tool), call(F.lit("Other"))), requestId=request),
        2: F.when((F.col("conv_id") + turn) % 3 != 0, entry(user, 3, third, second, F.struct(F.array(result).alias("content")))),
        3: F.lit(""),
        4: F.lit('{"uuid":"broken'),
        5: F.when(F.col("conv_id") % 2 == 0, entry(F.lit("system"), 5, F.concat(key, F.lit("d")), key, None, subtype=F.lit("turn_duration"))),
    }
    line = F.array(*[F.struct((turn * 10 + i).alias("line"), value.alias("value")) for i, value in lines.items()])
    other = entry(F.col("role"), 0, key, above, F.struct(said.alias("content")))
    plain = F.array(F.struct((turn * 10).alias("line"), other.alias("value")))
    path = F.concat(F.lit("/logs/c"), F.col("conv_id"))
    written = talk.select(
        F.concat(path, F.lit(".jsonl")).alias("path"), F.inline(F.when(F.col("role") == "assistant", line).otherwise(plain))
    ).unionByName(talk.select(F.concat(path, F.lit(".z.jsonl")).alias("path"), F.inline(plain)))
    return written.filter("value IS NOT NULL").select("path", F.lit(0).cast("bigint").alias("block"), "line", "value")


def trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trace files of one span each: ``(path, name, dir, content)``.

    Some spans are broken on purpose, for the span checks.
    """
    rows = spread(event_rows(spark, sf_dir))
    k = F.col("k")

    def span_id(number: Column) -> Column:
        return F.base64(F.unhex(F.lpad(F.hex(number), 16, "0")))

    types = {"signup": "interaction", "view": "llm_request", "error": "tool",
             "click": "tool.execution", "purchase": "tool.blocked_on_user"}
    kind = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in types.items()])

    def attr(key: str, value: Column, name: str = "stringValue") -> Column:
        boxed = F.to_json(F.struct(value.alias("v")))
        return F.when(
            value.isNotNull(),
            F.concat(F.lit(f'{{"key":"{key}","value":{{"{name}":'),
                     F.regexp_extract(boxed, r'(?s)^\{"v":(.*)\}$', 1), F.lit("}}")),
        )

    is_llm, is_turn = F.col("event_type") == "view", F.col("event_type") == "signup"
    attributes = F.concat_ws(
        ",",
        attr("span.type", kind),
        attr("session.id", F.col("user_id").cast("string")),
        attr("model", F.when(is_llm, F.lit("big"))),
        attr("input_tokens", F.when(is_llm, k.cast("string")), "intValue"),
        attr("output_tokens", F.when(is_llm & (k % 17 != 0), F.concat(k.cast("string"), F.lit(".9")))),
        attr("request_id", F.when(is_llm & (k % 3 == 0), F.concat(F.lit("q"), k.cast("string")))),
        attr("cost_usd", F.when(is_llm & (k % 4 == 0), F.concat(F.col("value").cast("string"), F.lit(" usd")))),
        attr("tool_name", F.when(F.col("event_type") == "error", _pick(k, ["Edit", "Bash"]))),
        attr("user_prompt", F.when(is_turn, F.concat(F.lit("prompt "), k.cast("string")))),
        attr("user.id", F.when(is_turn, F.lit("someone"))),
        attr("interaction.sequence", F.when(is_turn, k.cast("string")), "intValue"),
    )
    parent = F.when(
        ~is_turn & (k % 7 != 0),
        F.concat(F.lit('"parentSpanId":"'), span_id(F.col("event_id") - 1), F.lit('",')),
    ).otherwise("")
    own_id = F.when(k == 50, F.lit("AAAA")).otherwise(span_id(F.col("event_id")))
    end = F.when(k == 51, F.col("s") - 1).otherwise(F.col("e")).cast("string")
    end = F.when(k == 52, F.concat(end, F.lit("x"))).otherwise(end)
    content = F.concat(
        F.lit('{"batches":[{"scopeSpans":[{"spans":[{"traceId":"'),
        F.base64(F.unhex(F.lpad(F.hex("user_id"), 32, "0"))),
        F.lit('","spanId":"'), own_id, F.lit('",'), parent,
        F.lit('"name":"'), F.when(k == 53, "").otherwise(F.col("event_type")),
        F.lit('","startTimeUnixNano":"'), F.col("s").cast("string"),
        F.lit('","endTimeUnixNano":"'), end,
        F.lit('","attributes":['), attributes, F.lit("]}]}]}]}"),
    )
    number = F.lpad(F.col("event_id").cast("string"), 12, "0")
    return rows.select(
        F.concat(F.lit("/t/"), F.col("user_id").cast("string"), F.lit("/trace-"), number,
                 F.lit(".json")).alias("path"),
        F.concat(F.lit("trace-"), number, F.lit(".json")).alias("name"),
        F.concat(F.lit("/t/"), F.col("user_id").cast("string")).alias("dir"),
        content.alias("content"),
    )


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log events of traced sessions, one per event."""
    rows = event_rows(spark, sf_dir)
    k = F.col("k")
    names = ["api_request", "api_request_body", "api_response_body", "hook_execution_start",
             "hook_execution_complete", "tool_decision"]
    nothing = F.lit(None).cast("string")
    return rows.select(
        F.col("user_id").cast("string").alias("harness_session"),
        F.concat(F.lit("/t/"), F.col("user_id").cast("string"), F.lit("/logs.json")).alias("path"),
        F.col("event_id").cast("int").alias("pos"),
        (F.col("s") + 60_000_000_000).alias("timestamp_ns"),
        F.col("event_id").cast("string").alias("event_sequence"),
        F.lower(F.lpad(F.hex(F.col("event_id") + k % 3), 16, "0")).alias("span_id"),
        _pick(k, names).alias("event_name"),
        F.when(k % 7 != 0, F.concat(F.lit("h"), (k % 5).cast("string"))).alias("hook_name"),
        F.when(k % 4 == 0, F.concat(F.lit("q"), k.cast("string"))).alias("request_id"),
        nothing.alias("query_source"),
        F.when(k % 11 != 0, F.concat(F.lit("b"), F.col("event_id").cast("string"))).alias("body"),
        F.when(k % 8 == 1, F.concat(F.lit("tu"), (k % 30).cast("string"))).alias("tool_use_id"),
        nothing.alias("tool_input"),
        F.col("value").cast("string").alias("cost_usd"),
    )


def event_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one log array per user, in pieces ``(path, block, piece, text)``.

    Each event is cut in the middle of a string that holds quotes, braces and a backslash.
    """
    rows = event_rows(spark, sf_dir)
    path = F.concat(F.lit("/t/"), F.col("user_id").cast("string"), F.lit("/logs.json"))
    event = F.struct(
        F.col("event_id").cast("string").alias("event_sequence"), F.col("event_type").alias("event_name"),
        F.concat(F.lit('{"[\\'), F.col("k").cast("string"), F.lit('"} é ]"')).alias("body"),
    )
    text = rows.select(path.alias("path"), F.col("event_id").alias("block"), F.concat(F.to_json(event), F.lit(",")).alias("text"))
    at = F.instr("text", "}")
    halves = F.array(
        F.struct(F.lit(0).cast("bigint").alias("piece"), F.substr("text", F.lit(1), at).alias("text")),
        F.struct(F.lit(1).cast("bigint").alias("piece"), F.substr("text", at + 1).alias("text")),
    )
    begun = rows.select(path.alias("path")).distinct().select(
        "path", F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("piece"), F.lit(" [\n").alias("text")
    )
    return text.select("path", "block", F.inline(halves)).unionByName(begun)


def tool_call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as calls of every listed tool and two others: ``(id, session_id, type, name, tool_input)``.

    Paths, commands, addresses and modes vary; some are blank or padded, and some inputs are broken JSON.
    """
    tools = ["Read", "NotebookRead", "LS", "Edit", "MultiEdit", "Write", "NotebookEdit", "Glob", "Grep", "WebFetch",
             "WebSearch", "Task", "Agent", "TodoWrite", "ExitPlanMode", "AskUserQuestion", "Skill", "SlashCommand",
             "ToolSearch", "TaskCreate", "TaskUpdate", "SendUserFile", "BashOutput", "KillShell", "Bash",
             "mcp__Box__Open  It", "Mystery"]
    found = ["/repo/src/a.ts", "/repo/src/a.test.ts", "/repo/x.e2e.test.tsx", "/repo/README.md", "/repo/package.json",
             "/repo/pnpm-lock.yaml", "/repo/.env.local", "/repo/data.bin", "/repo/.gitignore", "/repo/tsconfig.json"]
    commands = ["git status", "pnpm test", "cd /x && rg foo", "npm run lint", "make all", "echo hi", "yarn install",
                "pnpm exec jest", "  ", "pytest -x"]
    k = F.col("o_orderkey")
    at = F.expr("o_orderkey div 27")
    path = F.when(at % 11 == 0, "  ").otherwise(F.concat(F.when(at % 5 == 0, "  ").otherwise(""), _pick(at, found)))
    given = F.struct(
        path.alias("file_path"), F.concat(F.lit("/nb"), path).alias("notebook_path"), F.concat(F.lit("/ls"), path).alias("path"),
        _pick(at, commands).alias("command"), F.when(at % 3 != 0, F.concat(F.lit(" why "), at)).alias("description"),
        _pick(at, ["https://www.example.org/a/b", "http://docs.example.net", "odd", " "]).alias("url"),
        F.when(at % 2 == 0, "read it").when(at % 3 == 0, "\n").alias("prompt"),
        _pick(at, ["insert", "delete", "replace"]).alias("edit_mode"),
    )
    return read(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.lit("s").alias("session_id"), F.lit("tool").alias("type"), _pick(k, tools).alias("name"),
        F.when(at % 13 == 0, '{"file_path":').otherwise(F.to_json(given)).alias("tool_input"),
    )


def hook_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``events`` as hooks of all kinds, and as the spans they may belong to."""
    names = ["PreToolUse:Edit", "PostToolUse:Edit", "PreToolUse:Bash", "PostToolUse:Bash", "Stop", "Notification",
             "PreToolUse:", "Other:Edit", "SessionStart", "UserPromptSubmit"]
    types = {"signup": "interaction", "view": "llm_request", "error": "tool", "purchase": "tool.execution"}
    rows = event_rows(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("harness_session"), "id", "event_type", "k", F.col("event_id").alias("place"),
        F.col("s").alias("start_ns"), F.col("e").alias("end_ns"),
    )
    hooks = rows.filter("event_type = 'click'").withColumn("hook_name", _pick(F.col("k"), names))
    kind = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in types.items()])
    tool = F.when(F.col("event_type") == "error", _pick(F.col("k"), ["Edit", "Bash"]))
    return hooks, rows.filter("event_type <> 'click'").select("*", kind.alias("span_type"), tool.alias("tool_name"))


def path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as file paths: ``(l_orderkey, l_linenumber, path, cwd)``."""
    a, b = F.col("l_orderkey"), F.col("l_linenumber")
    roots = ["/repo/", "/repo/.claude/worktrees/w1/", "/home/me/worktrees/x/", "/home/me/", "",
             "/home/me/.claude/"]
    names = ["src/a.ts", "packages/core/x.test.ts", "README.md", "package.json", ".env.local",
             "apps/site/main.e2e.test.tsx", ".github/workflows/ci.yml", "settings.json",
             "libs/u/tsconfig.base.json", "data.bin", "pnpm-lock.yaml"]
    return read_spread(spark, sf_dir, "lineitem").select(
        a.alias("l_orderkey"),
        b.alias("l_linenumber"),
        F.concat(_pick(a, roots), _pick(a + b, names)).alias("path"),
        F.when(a % 4 != 0, F.lit(CWD)).alias("cwd"),
    )


def command_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as shell commands: ``(o_orderkey, command)``."""
    heads = ["git commit -m x", "cd pkg && pnpm run test", "npm install", "rg foo", "ls -la",
             "cd /tmp; make all", "yarn exec eslint", "", "pytest tests", "pnpm", "cd a;b;grep x",
             "docker ps", "npx tsc"]
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(""),
                 _pick(F.col("o_orderkey"), heads)).alias("command"),
    )


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as file names: ``(o_orderkey, name)``."""
    names = ["a.jsonl", "logs.json", "trace.json", "trace-1.json", "trace-x.txt", "mylogs.json",
             "notes.md"]
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", _pick(F.col("o_orderkey"), names).alias("name")
    )


def directory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as encoded log directories: ``(directory)``."""
    suffix = _pick(
        F.col("c_custkey"),
        ["", "--claude-worktrees-a1", "-.claude-worktrees-b2", "-claude-worktrees-c"],
    )
    key = F.floor(F.col("c_custkey") / 4).cast("string")
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("-home-me-repo"), key, suffix).alias("directory")
    )
