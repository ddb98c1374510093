"""Lanes, deltas and causal edges on hand-made nodes. Times are in ms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.plans import analyses, graph
from spanloom.plans.columns import CANONICAL, canonical
from spanloom.plans.digest import digest, message_keys

MS = 1_000_000


def nodes(spark, rows):
    schema = ", ".join(f"{n} {t}" for n, t in CANONICAL.items())
    made = []
    for row in rows:
        full = {"session_id": "session-s", "harness_session": "s", "origin": "s", "parent": "root",
                **row}
        full["start_time_ns"], full["end_time_ns"] = row["start"] * MS, row["end"] * MS
        full["duration_ms"] = float(row["end"] - row["start"])
        made.append(tuple(full.get(c) for c in CANONICAL))
    return canonical(spark.createDataFrame(made, schema))


def root(start=90, end=500):
    return dict(id="root", type="interaction", parent=None, start=start, end=end, prompt="go",
                user_id="u", sequence=0)


def llm(id, start, end, emits=(), consumes=(), source=None, messages=None, **more):
    response = [json.dumps({"type": "tool_use", "id": t, "name": "T", "input": {}}) for t in emits]
    if messages is None:
        blocks = [{"type": "tool_result", "tool_use_id": t, "content": "ok"} for t in consumes]
        messages = [{"role": "user", "content": blocks or f"text of {id}"}]
    return dict(id=id, type="llm_request", start=start, end=end, source=source, model="big",
                request_messages=[json.dumps(m, separators=(",", ":")) for m in messages], response_messages=response, **more)


def tool(id, start, end, use=None, name="T", **more):
    return dict(id=id, type="tool", start=start, end=end, tool_use_id=use, name=name, **more)


def hook(id, start, end, name, **more):
    return dict(id=id, type="hook", start=start, end=end, name=name, **more)


def edges(spark, rows):
    built = graph.build_graph(nodes(spark, rows))
    return {(r.from_id, r.to_id): r.gap_ms for r in built.causal_edges.collect()}


def members(spark, rows):
    built = graph.build_graph(nodes(spark, rows))
    got = {}
    for r in built.threads.orderBy("thread_id", "position").collect():
        got.setdefault(r.thread_id, []).append(r.node_id)
    return got


def parallel(a="tu_a", b="tu_b"):
    return [root(), llm("i1", 100, 200, ["tu_a", "tu_b"]), tool("ta", 150, 250, a),
            tool("tb", 210, 260, b), llm("i2", 300, 400, consumes=["tu_a", "tu_b"])]


def test_parallel_tools_fan_out_and_in(spark):
    assert edges(spark, parallel()) == {
        ("i1", "ta"): -50.0, ("i1", "tb"): 10.0, ("ta", "i2"): 50.0, ("tb", "i2"): 40.0,
    }


def test_without_call_ids_steps_form_a_chain(spark):
    assert set(edges(spark, parallel(None, None))) == {("i1", "ta"), ("ta", "tb"), ("tb", "i2")}


def test_other_lanes_do_not_consume_results(spark):
    rows = [root(end=9999), llm("main", 100, 200, ["x"], source="repl_main_thread"),
            tool("tx", 210, 250, "x"), llm("bg", 9000, 9100, consumes=["x"], source="away_summary")]
    assert edges(spark, rows) == {("main", "tx"): 10.0}
    assert members(spark, rows) == {"thread_repl_main_thread": ["main", "tx"],
                                    "thread_away_summary": ["bg"]}


def test_sub_spans_follow_their_tool_in_parallel(spark):
    rows = [root(), llm("i", 100, 200, ["x"]), tool("tx", 210, 260, "x"),
            dict(id="wait", type="tool.blocked_on_user", start=211, end=212, parent="tx"),
            dict(id="run", type="tool.execution", start=212, end=260, parent="tx"),
            llm("deep", 220, 230, parent="run"), llm("deep2", 231, 240, parent="run")]
    got = edges(spark, rows)
    assert got == {("i", "tx"): 10.0, ("tx", "wait"): 1.0, ("tx", "run"): 2.0, ("run", "deep"): 8.0,
                   ("deep", "deep2"): 1.0}


def test_hooks_are_woven_around_their_tool(spark):
    rows = [root(), llm("i1", 100, 200, ["x"]), hook("pre", 201, 202, "PreToolUse:T"),
            tool("tx", 203, 250, "x"), hook("post", 251, 252, "PostToolUse:T"),
            llm("i2", 300, 400, consumes=["x"])]
    assert edges(spark, rows) == {("i1", "pre"): 1.0, ("pre", "tx"): 1.0, ("tx", "post"): 1.0,
                                  ("post", "i2"): 48.0}


def test_a_gap_of_zero_is_null(spark):
    assert edges(spark, [root(), llm("i1", 100, 200), llm("i2", 200, 300)]) == {("i1", "i2"): None}


def test_prompt_hooks_join_only_the_main_lane(spark):
    prompt = hook("h", 95, 96, "UserPromptSubmit")
    assert members(spark, [root(), llm("i", 100, 200), prompt]) == {"thread_unknown": ["i"]}
    rows = [root(), llm("i", 100, 200, source="repl_main_thread"), llm("j", 90, 300, source="a b-c"),
            prompt]
    assert members(spark, rows) == {"thread_repl_main_thread": ["h", "i"], "thread_a_b_c": ["j"]}


def test_lane_tiers(spark):
    rows = [root(0, 9000), llm("a", 100, 1000, source="a"), llm("b", 200, 300, source="b"),
            tool("early", 50, 60), tool("inner", 250, 260), tool("outer", 500, 510),
            tool("late", 2000, 2010)]
    # early: the first lane; inner: the latest started; outer: still running; late: latest ended.
    assert members(spark, rows) == {"thread_a": ["early", "a", "outer", "late"],
                                    "thread_b": ["b", "inner"]}


def message(text, mark=None):
    block = {"type": "text", "text": text}
    return {"role": "user", "content": [{**block, "cache_control": mark} if mark else block]}


@pytest.mark.parametrize(
    "raw, bare",
    [
        ('{"a":1,"cache_control":{"t":"x","u":[1]},"b":2}', '{"a":1,"b":2}'),
        ('{"cache_control":null,"b":{"cache_control":"y"}}', '{"b":{}}'),
        ('[{"cache_control":{}}]', "[{}]"),
        ('{"a":"\\"cache_control\\":1","b":"cache_control","n":1.50}', None),
    ],
)
def test_message_identity_ignores_cache_control(spark, raw, bare):
    df = spark.createDataFrame([(raw, bare or raw)], "raw string, bare string")
    keys = df.select(message_keys(F.array("raw")), message_keys(F.array("bare"))).first()
    assert keys[0] == keys[1]


def test_deltas_keep_new_messages_only(spark):
    one, two, three = message("1"), message("2"), message("3")
    rows = [root(), llm("a", 100, 110, messages=[one, one]),
            llm("b", 120, 130, messages=[message("1", {"type": "ephemeral"}), two]),
            llm("c", 140, 150, messages=[one, two, three], source="other"),
            llm("d", 160, 170, messages=[three])]
    built = graph.build_graph(nodes(spark, rows))
    got = {r.id: [json.loads(m) for m in r.request] for r in built.deltas.collect()}
    assert got == {"a": [one, one], "b": [two], "c": [one, two, three], "d": [three]}


def test_requests_that_extend_earlier_ones_cost_their_new_messages(spark):
    """Cumulative requests with a branch, a shorter request and repeated messages, against sets of what was sent."""
    rng = random.Random(3)
    rows, sent, want = [root()], [], {}
    history, seen = [], {"main": set(), "other": set()}
    for i in range(40):
        source = "other" if i % 9 == 8 else None
        if i % 7 == 6:
            history = history[: rng.randrange(len(history) + 1)]
        history = [*history, *[message(str(rng.randrange(25))) for _ in range(rng.randrange(3))]]
        rows.append(llm(f"n{i:02}", 100 + 10 * i, 105 + 10 * i, messages=history, source=source))
        lane = "other" if source else "main"
        want[f"n{i:02}"] = [m for m in history if json.dumps(m) not in seen[lane]]
        seen[lane] |= {json.dumps(m) for m in history}
        sent.append(len(history))
    built = graph.build_graph(nodes(spark, rows))
    assert {r.id: [json.loads(m) for m in r.request] for r in built.deltas.collect()} == want


def test_digests_refer_to_tool_blocks(spark):
    odd = ["no json", '{"content":"text"}', '{"content":[1,"x",{"type":"tool_result"},{"type":"tool\\u005fresult","tool_use_id":"a","is_error":true}]}']
    row = {**llm("a", 100, 110), "request_messages": odd, "response_messages": ["{", '{"type":"tool_use","id":"b"}', '{"type":"tool_use"}']}
    got = digest(nodes(spark, [root(), row])).first()
    assert [tuple(r) for r in got.results] == [(2, 3, "a", True)] and [tuple(r) for r in got.calls] == [(0, 1, "b", False)]
    assert len(got["keys"]) == 3 and all(len(k) == 32 for k in got["keys"])


def test_owner_is_the_root_of_the_chain(spark):
    rows = [root(), tool("t", 100, 300), dict(id="x", type="tool.execution", start=110, end=290, parent="t"),
            llm("deep", 120, 130, parent="x"), tool("lost", 1, 2, parent="nowhere"),
            tool("self", 1, 2, parent="self")]
    got = graph.with_owner(graph.unique_nodes(nodes(spark, rows)))
    assert {r.id: r.interaction_id for r in got.collect()} == {
        "root": "root", "t": "root", "x": "root", "deep": "root", "lost": "lost", "self": "self"}


def test_first_copy_of_an_id_wins(spark):
    rows = [root(), {**root(), "origin": "a", "prompt": "first"}, {**root(), "origin": "z"}]
    got = graph.unique_nodes(nodes(spark, rows)).collect()
    assert [(r.id, r.prompt) for r in got] == [("root", "first")]


def test_hot_groups_give_the_same_graph(spark, hot):
    rows = parallel() + [tool(f"z{i:02}", 260 + i, 500) for i in range(20)]
    got = edges(spark, rows)
    chain = ["tb"] + [f"z{i:02}" for i in range(20)]
    assert got[("i1", "ta")] == -50.0 and got[("ta", "i2")] == 50.0
    assert all((a, b) in got for a, b in zip(chain[1:], chain[2:]))


def test_viewer_analyses(spark):
    rows = parallel() + [dict(id="run", type="tool.execution", start=215, end=255, parent="tb"),
                         {**llm("weak", 220, 230, parent="run"), "model": "x-Haiku-1"}]
    built = graph.build_graph(nodes(spark, rows))
    t = {"nodes": graph.with_seq(built.nodes), "threads": built.threads,
         "causal_edges": built.causal_edges, "sessions": graph.sessions(built.nodes)}
    level, = analyses.parallel_levels(t).collect()
    assert (level.fork_id, level.join_id, level.branches, level.critical_id) == ("i1", "i2", 2, "ta")
    hidden, = analyses.hidden_subcalls(t).collect()
    assert (hidden.tool_id, hidden.subcall_id) == ("tb", "weak")
    longest, = analyses.main_thread_longest(t).collect()
    assert longest.id == "i1" and longest.share_of_run == pytest.approx(100 / 410)
    heads = analyses.prompt_edges(t).collect()
    assert [(r.from_id, r.to_id) for r in heads] == [("root", "i1")]
    way = analyses.ancestor_paths(t, t["nodes"].filter("id = 'weak'")).orderBy("level").collect()
    assert [r.step_id for r in way] == ["weak", "run", "tb", "root", "session-s", "agent-u"]
    assert analyses.edge_gaps(t).filter(F.col("gap_ms").isNull()).count() == 0
