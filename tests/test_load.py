"""Loading files end to end, and the query surface over the loaded tables."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom import Workbench
from spanloom.plans import analyses, tables
from spanloom.plans import guard
from spanloom.plans.workbench import build_stages, preview
from spanloom.sources import files, otel
from traces import (
    at, b64, failed_edit, lines, log, reply, result, span, trace, traced_session, use, user, write,
)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    spans, logs = traced_session()
    write(root / "chat", "a.jsonl", lines(failed_edit()))
    write(root / "chat", "copy-of-a.jsonl", lines(failed_edit()))
    write(root / "traces", "trace-1.json", spans)
    write(root / "traces", "logs.json", logs)
    write(root / "traces", "notes.txt", "nothing")
    out, dump = str(root / "out" / "tables"), str(root / "out" / "stages")
    bench = Workbench.load(spark, [str(root / "chat"), str(root / "traces")], out=out, dump_to=dump)
    return bench, out, dump


def nodes_of(bench, session):
    rows = bench.table("nodes").filter(F.col("session_id") == f"session-{session}")
    return rows.orderBy("interaction_id", "seq").collect()


def test_chat_log(loaded):
    bench, *_ = loaded
    rows = nodes_of(bench, "S1")
    assert sorted(r.type for r in rows) == ["interaction", "llm_request", "llm_request", "tool", "tool"]
    by_name = {r.name: r for r in rows if r.type == "tool"}
    read, edit = by_name["Read"], by_name["Edit"]
    assert (read.is_error, read.error_kind, read.output_size, read.error_message) == (False, None, 9, None)
    assert (edit.is_error, edit.error_kind) == (True, "invalid_args")
    assert edit.error_message == "String to replace not found"
    assert (edit.duration_ms, read.duration_ms) == (2000.0, 1500.0)
    first, second = sorted((r for r in rows if r.type == "llm_request"), key=lambda r: r.start_time_ns)
    assert (first.tokens_in, first.tokens_out, first.stop_reason, first.cost_usd) == (10, 5, "tool_use", None)
    assert (second.duration_ms, second.stop_reason) == (2000.0, "end_turn")
    turn = next(r for r in rows if r.type == "interaction")
    assert (turn.duration_ms, turn.sequence, turn.intent_category) == (8000.0, 0, "debug")
    assert sorted(r.seq for r in rows) == list(range(5))
    session, = bench.table("sessions").filter("session_id = 'S1'").collect()
    assert (session.cwd, session.branch, session.user_id) == ("/repo", "main", "pseudo_user_id")


def test_chat_semantics_and_deltas(loaded):
    bench, *_ = loaded
    sem = bench.table("semantics").join(
        bench.table("nodes").filter("session_id = 'session-S1'").select("id", "type", "start_time_ns"), "id")
    rows = sem.orderBy("start_time_ns", "type", "id", "sequence_in_node").collect()
    assert [(r.action, r.repo_path, r.package) for r in rows if r.type == "llm_request"] == [
        ("plan next steps", None, None), ("invoke read source code", "config.ts", None),
        ("invoke edit source code", "packages/web/foo.ts", "web"), ("respond", None, None)]
    assert {r.action for r in rows if r.type == "tool"} == {"read source code", "edit source code"}
    last = max((r for r in nodes_of(bench, "S1") if r.type == "llm_request"), key=lambda r: r.start_time_ns)
    delta, = bench.table("deltas").filter(F.col("id") == last.id).collect()
    asked, = json.loads(delta.request_messages_delta)
    assert [b["tool_use_id"] for b in asked["content"]] == ["S1t1", "S1t2"]
    assert json.loads(last.data)["request_messages"] == [asked]


def test_traced_session(loaded):
    bench, *_ = loaded
    rows = {r.id: r for r in nodes_of(bench, "O1")}
    spans = {int(i[1:], 16): r for i, r in rows.items() if i.startswith("s00000000")}
    assert len(spans) == 7 and len(rows) == 10
    assert (spans[2].cost_usd, spans[2].stop_reason, spans[2].tokens_out) == (0.25, "tool_use", 4)
    assert spans[6].cost_usd is None and spans[6].stop_reason == "end_turn"
    assert (spans[3].tool_use_id, spans[3].tool_input) == ("tu1", '{"file_path":"/x/a.py"}')
    assert (spans[3].is_error, spans[3].output_size) == (False, 2)
    hooks = {r.name: r for r in rows.values() if r.type == "hook"}
    assert {h.parent for h in hooks.values()} == {spans[1].id}
    assert (hooks["PreToolUse:Read"].duration_ms, hooks["Stop"].duration_ms) == (5.0, 0.0)
    edges = {(r.from_id, r.to_id) for r in bench.table("causal_edges").collect()}
    assert (hooks["PreToolUse:Read"].id, spans[3].id) in edges
    assert (hooks["PostToolUse:Read"].id, spans[6].id) in edges
    delta, = bench.table("deltas").filter(F.col("id") == spans[6].id).collect()
    assert [m["content"] for m in json.loads(delta.request_messages_delta)][1] == "cut"
    weak, = bench.table("semantics").filter(F.col("id") == spans[7].id).collect()
    assert weak.action == "Small-Haiku"
    assert json.loads(spans[2].data)["start_time_ns"] == "100000000"


def test_invariants(loaded):
    bench, *_ = loaded
    n = bench.table("nodes")
    assert n.groupBy("id").count().filter("count > 1").count() == 0
    assert n.groupBy("interaction_id").agg(
        (F.max("seq") + 1 == F.count("*")).alias("dense")).filter("not dense").count() == 0
    assert bench.table("causal_edges").filter("from_id = to_id").count() == 0
    assert bench.table("semantics").filter("repo_path like '/%'").count() == 0
    assert n.filter("type = 'interaction' and intent_category is null").count() == 0
    total = bench.query("select sum(tool_count) c from interaction_metrics").first().c
    assert total == n.filter("type = 'tool'").count()
    for name, table in tables.TABLES.items():
        df = bench.table(name)
        assert df.columns == table.column_names, name
        assert [f.dataType for f in df.schema] == [f.dataType for f in table.schema], name


def test_metrics_view(loaded):
    bench, *_ = loaded
    row, = bench.query("select * from interaction_metrics where session_id = 'session-S1'").collect()
    assert (row.shape, row.tool_count, row.llm_count, row.error_count, row.distinct_files) == (
        "agentic", 2, 2, 1, 2)
    assert row.prompt_len == 21 and row.cost_usd is None


def test_walks(loaded):
    bench, *_ = loaded
    rows = nodes_of(bench, "O1")
    turn = next(r.id for r in rows if r.type == "interaction")
    below = [r.id for r in bench.subtree(turn).collect()]
    assert len(below) == 9 and turn not in below
    tool = next(r.id for r in rows if r.type == "tool")
    assert {r.type for r in bench.subtree(tool).collect()} == {
        "tool.blocked_on_user", "tool.execution", "llm_request"}
    last = max((r for r in rows if r.type == "llm_request"), key=lambda r: r.start_time_ns).id
    up = [r.type for r in bench.causal_path(last).collect()]
    assert up == ["llm_request", "hook", "tool", "hook"]
    down = {r.id for r in bench.causal_path(tool, "downstream").collect()}
    assert last in down and bench.causal_path("nothing").count() == 0
    with pytest.raises(ValueError):
        bench.causal_path(last, "sideways")


def test_resolve_and_descriptions(loaded):
    bench, *_ = loaded
    some = next(r.id for r in nodes_of(bench, "S1") if r.name == "Edit")
    row, = bench.resolve(some).collect()
    assert row.id == some and [e.action for e in row.entries] == ["edit source code"]
    schema = bench.schema()
    assert schema.select("table").distinct().count() == 12 and schema.filter("doc = ''").count() == 0
    assert bench.vocabulary().count() > 50
    assert bench.summary()["sessions"] == 2 and bench.summary()["nodes"] == 15
    assert all(df.columns for df in bench.examples().values())


def test_reopen_and_dump(loaded, spark):
    bench, out, dump = loaded
    again = Workbench.open(spark, out)
    assert again.summary()["nodes"] == 15
    kinds = {r.name: r.input_type for r in spark.read.json(f"{dump}/01-classified").collect()}
    assert kinds == {"a.jsonl": "native", "copy-of-a.jsonl": "native", "trace-1.json": "otel-trace",
                     "logs.json": "otel-log", "notes.txt": "unsupported"}
    assert spark.read.json(f"{dump}/02-sessions").count() == 4
    assert spark.read.json(f"{dump}/07-nodes").count() == 15


def test_analyses(loaded):
    bench, *_ = loaded
    t = bench.relations
    facts, = analyses.failure_facts(t).collect()
    assert (facts.kind, facts.message) == ("invalid_args", "String to replace not found")
    files_, = analyses.misleading_files(t).collect()
    assert (files_.repo_path, files_.failed_edits) == ("packages/web/foo.ts", 1)
    lost, = analyses.recovery_windows(t).collect()
    assert lost.recovered_id is None and lost.tokens_between is None
    context = {(r.package, r.repo_path) for r in analyses.node_context(t).collect()}
    assert ("web", "packages/web/foo.ts") in context
    causes = analyses.tools_with_causes(t, only_inferences=True).collect()
    assert {r.name for r in causes} == {"Read", "Edit"}
    assert {r.intent_category: r.interactions for r in analyses.intent_counts(t).collect()} == {
        "debug": 1, "feature": 1}


RELATIONS = ["nodes", "tools"]


@pytest.mark.parametrize("sql", [
    " select 1 ; ", "select * from NODES where id like '%;%'",
    "with x as (select * from nodes) select count(*) from x join tools t on t.id = x.id having count(*) > 1 order by 1 limit 3",
    "with recursive r as (select 1 as n union all select n + 1 from r where n < 3) select * from r",
    "select id from nodes where exists (select 1 from tools) union all select id from tools",
    "select *, row_number() over (partition by id order by seq) from nodes lateral view explode(split(a, ',')) t as y",
    "select * from range(5)", "values (1)",
])
def test_guard_lets_queries_pass(spark, sql):
    assert guard.checked(spark, sql, RELATIONS) == sql.strip().rstrip(";").strip()


@pytest.mark.parametrize("sql", [
    "", "selecting", "drop table x", "select 1; select 2", "create view v as select 1", "set a = b", "cache table nodes",
    "with x as (select 1) insert overwrite directory '/tmp/x' using parquet select * from x",
    "with x as (select 1) insert into nodes select * from x", "with x as (select 1) delete from nodes",
    "merge into nodes using tools on 1 = 1 when matched then delete", "from nodes insert into tools select *",
    "select * from parquet.`/etc`", "select 1 from nodes where id in (select id from text.`/a`)",
    "select (select max(x) from json.`/a`)", "with nodes2 as (select * from nodes2) select * from nodes2",
    "select * from other", "select * from spark_catalog.default.nodes", "select reflect('java.lang.System', 'exit', 1)",
    "select upper(java_method('a', 'b'))", "select input_file_name() from nodes", "select transform(a) using 'cat' from nodes",
])
def test_guard_refuses_the_rest(spark, sql):
    with pytest.raises(guard.RefusedQuery):
        guard.checked(spark, sql, RELATIONS)


def test_workbenches_keep_apart(spark, loaded, tmp_path):
    first, *_ = loaded
    before = first.query("select count(*) c from nodes").first().c
    write(tmp_path / "one", "a.jsonl", lines(failed_edit()))
    second = Workbench.load(spark, [str(tmp_path / "one")])
    assert second.query("select count(*) c from nodes").first().c == 5 != before
    assert first.query("select count(*) c from nodes").first().c == before
    assert not spark.catalog.tableExists("nodes")
    with pytest.raises(guard.RefusedQuery):
        first.query("with x as (select 1) delete from nodes")


def test_rejects_are_told(loaded, spark):
    bench, out, _ = loaded
    told = bench.summary()["rejects"]
    assert told == bench.query("select count(*) c from rejects").first().c
    assert Workbench.open(spark, out).summary()["rejects"] == told


def test_a_failed_save_keeps_the_snapshot(loaded, spark, tmp_path):
    bench, *_ = loaded
    path = str(tmp_path / "kept")
    bench.save(path)
    whole = Workbench.open(spark, path).summary()
    broken = {**bench.relations, "sessions": bench.relations["sessions"].withColumn("x", F.raise_error(F.lit("stop")))}
    from spanloom.plans import tables

    with pytest.raises(Exception, match="stop"):
        tables.write_tables(broken, path)
    assert Workbench.open(spark, path).summary() == {**whole, "dirs": [path]}


def test_snapshots_follow_each_other(loaded, spark, tmp_path, monkeypatch):
    from spanloom.plans import tables

    bench, *_ = loaded
    path = str(tmp_path / "many")
    with pytest.raises(FileNotFoundError):
        Workbench.open(spark, path)
    seen = []
    for _ in range(3):
        bench.save(path)
        seen.append(tables.snapshots(spark, path)[-1])
    assert seen == sorted(seen) and tables.snapshots(spark, path) == seen[-tables.KEPT :]
    folders = {p.name for p in (tmp_path / "many").iterdir()}
    assert folders == {tables.COMMITS, *(name.split("-")[1] for name in seen[-tables.KEPT :])}
    # Two writers that saw the same snapshots: both are whole, and one of them is current.
    monkeypatch.setattr(tables, "snapshots", lambda *_: seen[:1])
    bench.save(path)
    monkeypatch.undo()
    assert Workbench.open(spark, path).summary() == {**bench.summary(), "dirs": [path]}


def test_preview_runs_a_query_once_if_all_rows_fit(spark):
    rows = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch

    df = spark.range(100, numPartitions=7).mapInPandas(counting, "id bigint").orderBy(F.desc("id"))
    seen = preview(df, max_rows=100)
    assert seen.rows[0]["id"] == 99 and (seen.row_count, seen.truncated) == (100, False)
    assert rows.value == 100
    assert (preview(df, max_rows=99).row_count, preview(df, max_rows=99).dropped_rows) == (100, 1)
    for empty in (spark.range(0), spark.range(5).filter("id > 9"), spark.range(5).limit(0)):
        assert (preview(empty).row_count, preview(empty).rows) == (0, [])
    assert preview(spark.range(5), max_rows=0).row_count == 5


def test_preview_caps(spark):
    df = spark.range(30).select("id", F.lit("x" * 50).alias("t")).orderBy("id")
    whole = preview(df)
    assert (whole.row_count, whole.returned_rows, whole.truncated, whole.notice) == (30, 30, False, None)
    rows = preview(df, max_rows=4)
    assert (rows.row_count, rows.returned_rows, rows.dropped_rows) == (30, 4, 26)
    assert "row cap" in rows.notice
    size = preview(df, max_chars=10)
    assert size.returned_rows == 1 and "size budget" in size.notice
    cells = preview(df.limit(2), max_cell_chars=5)
    assert cells.rows[0]["t"] == "xxxxx…[clipped]" and cells.truncated and "clipped" in cells.notice


def chat_stages(spark, tmp_path, entries, name="a.jsonl"):
    write(tmp_path, name, lines(entries))
    return build_stages(spark, [str(tmp_path)])


def test_windows_of_several_prompts(spark, tmp_path):
    entries = [
        reply("a0", 0, [{"type": "text", "text": "before any prompt"}], "r0"),
        user("p1", 1, "first"),
        user("meta", 1.5, "hidden", isMeta=True),
        user("tag", 1.6, "<command>"),
        reply("a1", 2, [{"type": "text", "text": "one"}], "r1", "p1"),
        user("p2", 10, "second", "a1"),
        reply("a2", 12, [use("t1", "Bash", command="ls")], None, "p2"),
        user("p3", 20, "third", "a2"),
    ]
    nodes = chat_stages(spark, tmp_path, entries).canonical.collect()
    turns = sorted((r for r in nodes if r.type == "interaction"), key=lambda r: r.sequence)
    assert [(r.prompt, r.sequence, r.duration_ms) for r in turns] == [
        ("first", 0, 1000.0), ("second", 1, 2000.0), ("third", 2, 0.0)]
    calls = [r for r in nodes if r.type == "llm_request"]
    assert {r.parent for r in calls} == {turns[0].id, turns[1].id}
    tool, = [r for r in nodes if r.type == "tool"]
    # The call was never answered in a later request.
    assert (tool.parent, tool.is_error, tool.duration_ms) == (turns[1].id, None, 0.0)


def test_prompts_that_run_backwards(spark, tmp_path):
    entries = [
        user("p1", 5, "one"), user("p2", 20, "two"), user("p3", 10, "three"),
        reply("a1", 7, [], "r1", "p1"), reply("a2", 15, [], "r2", "p3"),
        reply("a3", 30, [], "r3", "p2"),
    ]
    nodes = chat_stages(spark, tmp_path, entries).canonical.collect()
    names = {r.id: r.prompt for r in nodes if r.type == "interaction"}
    owners = {r.end_time_ns // 10**9 % 60: names[r.parent] for r in nodes if r.type == "llm_request"}
    # Windows in file order: one [5, 20), two is empty, three [10, ...); the first that holds wins.
    assert owners == {7: "one", 15: "one", 30: "three"}


def test_trigger_is_the_nearest_user_above(spark, tmp_path):
    entries = [
        user("p1", 1, "go"),
        {"uuid": "att", "parentUuid": "p1", "type": "attachment", "timestamp": at(1.2), "sessionId": "S1"},
        reply("a1", 2, [{"type": "text", "text": "x"}], "r1", "att"),
        reply("a2", 4, [{"type": "text", "text": "y"}], "r2", "gone"),
    ]
    nodes = chat_stages(spark, tmp_path, entries).canonical.collect()
    first, second = sorted((r for r in nodes if r.type == "llm_request"), key=lambda r: r.end_time_ns)
    assert first.duration_ms == 1000.0
    assert json.loads(first.request_messages[0]) == {"role": "user", "content": "go"}
    assert second.duration_ms == 0.0 and json.loads(second.request_messages[0])["content"] is None


def test_harness_markers_and_web_fetch(spark, tmp_path):
    entries = [
        user("p1", 1, "[SUGGESTION MODE: guess]"),
        reply("a1", 2, [{"type": "text", "text": "maybe"}], "r1", "p1"),
        user("p2", 10, "go on", "a1"),
        reply("a2", 11, [{"type": "text", "text": ' {"title": "T"}'}], "r2", "p2"),
        user("p3", 20, "fetch it", "a2"),
        reply("a3", 21, [use("w1", "WebFetch", url="https://www.a.io/x", prompt="sum"),
                         use("w2", "Skill", skill="s")], "r3", "p3"),
    ]
    stages = chat_stages(spark, tmp_path, entries)
    got = tables.stored_tables(stages.graph)
    sem = got["semantics"].join(got["nodes"].select("id", "type", "name", "start_time_ns"), "id")
    rows = sem.orderBy("start_time_ns", "type", "name", "sequence_in_node").collect()
    assert [r.action for r in rows if r.type == "llm_request"] == [
        "predict next user prompt", "generate session title", "invoke fetch web page",
        "decide on skill use"]
    fetch = [(r.action, r.url, r.comment) for r in rows if r.name == "WebFetch"]
    assert fetch == [("fetch web page", "a.io", "sum"), ("process result with weak model", None, None)]


def test_native_files_beat_traces_and_logs_attach_by_directory(spark, tmp_path):
    spans, _ = traced_session()
    write(tmp_path / "a", "trace.json", spans)
    write(tmp_path / "a", "logs.json", [log("x", 1, 1)])
    write(tmp_path / "b", "logs.json", [log("x", 1, 1)])
    write(tmp_path / "c", "s.jsonl", lines(failed_edit("O1")))
    stages = build_stages(spark, [str(tmp_path)])
    got = {(r.path.rsplit("/", 2)[1], r.input_type): (r.harness_session, r.kind)
           for r in stages.sessions.collect()}
    assert got == {("a", "otel-trace"): ("O1", "native"), ("a", "otel-log"): ("O1", "native"),
                   ("c", "native"): ("O1", "native")}
    assert {r.user_id for r in stages.canonical.filter("type = 'interaction'").collect()} == {
        "pseudo_user_id"}


def test_spans_without_required_attributes(spark, tmp_path):
    bad = span(9, 1, 100, 200, "llm_request", model="big", input_tokens=1)
    odd = span(10, None, 300, 400, "something_else", session__id="O1")
    spans, _ = traced_session()
    spans["batches"][0]["scopeSpans"][0]["spans"] += [bad, odd]
    write(tmp_path, "trace.json", spans)
    stages = build_stages(spark, [str(tmp_path)])
    rejected = {r.id: sorted(r.missing) for r in stages.rejects.collect()}
    assert rejected == {"s0000000000000009": ["tokens_out"],
                        "s000000000000000a": ["prompt", "sequence", "user_id"]}
    with pytest.raises(Exception, match="missing required attributes"):
        build_stages(spark, [str(tmp_path)], strict=True)


def test_span_checks(spark, tmp_path):
    good = span(1, None, 1, 2, "interaction")
    spans = [good, good, {**span(2, 1, 5, 4, "tool"), "name": ""}, {**span(3, 99, 1, 2, "tool"), "traceId": "AA=="},
             {**span(4, 1, 1, 2, "tool"), "startTimeUnixNano": "12x"}, {**span(5, 1, 1, 2, "tool"), "spanId": "%%"}]
    write(tmp_path, "trace.json", trace(*spans))
    docs = files.read_documents(spark, [str(tmp_path)], "*.json")
    found = {(r.span_id, r.rule) for r in otel.violations(otel.flat_spans(docs)).collect()}
    assert found == {(b64(1), "duplicate_span_id"), (b64(2), "ends_before_start"), (b64(2), "empty_name"),
                     (b64(3), "trace_id_size"), (b64(3), "unknown_parent"), (b64(4), "start_not_digits"),
                     ("%%", "span_id_size")}


def test_large_files_keep_their_line_order(spark, tmp_path):
    write(tmp_path, "a.jsonl", "\n".join(f"line {i}" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.read_lines(spark, [str(tmp_path)], "*.jsonl")
        assert rows.rdd.getNumPartitions() > 4
        got = [r.value for r in rows.orderBy("path", "block", "line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i}" for i in range(20_000)]


def test_repo_directories(spark, tmp_path):
    names = ["-w-dev-app", "-w-dev-app--claude-worktrees-a-1", "-w-dev-app-.claude-worktrees-b",
             "-w-dev-other", "-w-x-dup", "-w-y-dup"]
    for name in names:
        write(tmp_path / name, "s.jsonl", "{}\n")
    dirs = files.directories_under(spark, str(tmp_path))
    found = [r.directory for r in files.resolve_repo(dirs, "app").collect()]
    assert found == sorted(names[:3])
    only = files.resolve_repo(dirs, "/w/dev/app", include_worktrees=False).collect()
    assert [r.directory for r in only] == ["-w-dev-app"]
    for query, message_ in (("dup", "ambiguous"), ("none", "no logs")):
        with pytest.raises(ValueError, match=message_):
            files.resolve_repo(dirs, query)
    assert files.source_dirs(spark, str(tmp_path)) == [str(tmp_path)]
    assert len(files.source_dirs(spark, "app", str(tmp_path))) == 3


def test_results_do_not_depend_on_partitioning(spark, tmp_path):
    write(tmp_path, "a.jsonl", lines(failed_edit()))
    spans, logs = traced_session()
    write(tmp_path, "trace.json", spans)
    write(tmp_path, "logs.json", logs)
    seen = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        made = tables.stored_tables(build_stages(spark, [str(tmp_path)]).graph)
        seen.append({n: sorted(map(str, df.collect())) for n, df in made.items()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
