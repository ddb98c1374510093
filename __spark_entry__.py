"""

Queries run the library over the driver's tables through ``spanloom.plans.adapters``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries  # noqa: E402
from spanloom.functions import bodies, intent, labels, outcome, paths, text  # noqa: E402
from spanloom.operators.climb import nearest_stop, reach  # noqa: E402
from spanloom.operators.nesting import inside  # noqa: E402
from spanloom.operators.ordered import after, before, position, scan  # noqa: E402
from spanloom.operators.stab import best_covering, latest_ended  # noqa: E402
from spanloom.plans import adapters as ad  # noqa: E402
from spanloom.plans import analyses as an  # noqa: E402
from spanloom.plans import chat, graph, otel, outcomes, semantics, tables, workbench  # noqa: E402
from spanloom.plans.digest import digest  # noqa: E402
from spanloom.runtime import prepare, settle  # noqa: E402
from spanloom.sources import chatlog, files, records  # noqa: E402
from spanloom.sources import otel as otel_source  # noqa: E402

# The training-data operators are optional; without their folder the rest works alone.
try:
    import corpus_pipeline
    from spanloom.llm import queries as training
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "spanloom.llm"):
        raise
    corpus_pipeline = training = None

Query = Callable[[SparkSession, str], DataFrame]


def _long(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so both engines return the same types."""
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name)
            if f.dataType.simpleString() in ("int", "smallint", "tinyint")
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})



# ---- Over events -----------------------------------------------------------------------------


def _nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, bool]:
    """Event nodes as a plan, for queries that read them once."""
    cold = ad.is_cold(spark, sf)
    return ad.event_nodes(spark, sf, cold), cold


def _stored_nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, bool]:
    """Event nodes written once, for queries that read them several times."""
    nodes, cold = _nodes(spark, sf)
    return settle(nodes), cold


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return ad.event_tables(*_stored_nodes(spark, sf))


def _members(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, bool]:
    nodes, cold = _stored_nodes(spark, sf)
    return settle(graph.lane_members(nodes, cold)), nodes, cold


def _layers(spark: SparkSession, sf: str):
    members, nodes, cold = _members(spark, sf)
    digests = settle(digest(nodes))
    return members, nodes, cold, settle(graph.delta_positions(members, digests, cold)), digests


def _edges(spark: SparkSession, sf: str):
    members, nodes, cold, fresh, digests = _layers(spark, sf)
    return members, nodes, cold, settle(graph.causal_edges(members, nodes, digests, fresh, cold))


def _graph_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    members, nodes, cold, edges = _edges(spark, sf)
    return {
        "nodes": graph.with_seq(nodes, cold),
        "threads": graph.threads(members),
        "causal_edges": edges,
        "sessions": graph.sessions(nodes),
    }


def session_rollup(spark, sf):
    nodes, _ = _nodes(spark, sf)
    sums = ["cost_usd", "tokens_in", "tokens_out"]
    return _rounded(an.session_rollup({"nodes": nodes}), *sums)


def interaction_metrics(spark, sf):
    sums = ["tokens_in", "tokens_out", "cost_usd"]
    return _rounded(_tables(spark, sf)["interaction_metrics"], *sums)


def interaction_rollup(spark, sf):
    return _rounded(
        an.interaction_rollup(_tables(spark, sf)), "tokens_in", "tokens_out", "cost_usd"
    )


def shape_counts(spark, sf):
    return an.shape_counts(_tables(spark, sf))


def load_summary(spark, sf):
    return an.load_summary({"nodes": _nodes(spark, sf)[0]})


def typed_views(spark, sf):
    """The three typed views."""
    nodes = tables.nodes_table(*_stored_nodes(spark, sf))
    seen = tables.typed_views(nodes)
    parts = [
        seen[name].select(F.lit(name).alias("relation"), "id", "session_id", "seq", "duration_ms")
        for name in ("llm_requests", "tools", "interactions")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def interaction_windows(spark, sf):
    cold = ad.is_cold(spark, sf)
    prompts = ad.event_rows(spark, sf).filter("event_type = 'signup'")
    ranked = scan(
        prompts, ["user_id"], ["s", "event_id"], [position("sequence"), after("next_s", F.col("s"))],
        cold,
    )
    return ranked.select("user_id", "event_id", "sequence", "s", "next_s")


def node_seq(spark, sf):
    nodes, cold = _nodes(spark, sf)
    return graph.with_seq(nodes, cold).select(
        "interaction_id", "id", "seq"
    )


def narrowest_span(spark, sf):
    cold = ad.is_cold(spark, sf)
    rows = ad.event_rows(spark, sf)
    points = rows.filter("event_type in ('error', 'click')").select("user_id", "id", "s")
    spans = rows.filter("event_type in ('view', 'purchase')").select(
        "user_id", F.col("id").alias("span_id"), F.col("s").alias("b"), "e"
    )
    return best_covering(
        points, spans, ["user_id"], "id", "s", "b", "e",
        [F.col("e") - F.col("b"), F.col("b"), F.col("span_id")], F.col("span_id"), "span_id", cold,
    ).select("id", "span_id")


def last_ended_before(spark, sf):
    cold = ad.is_cold(spark, sf)
    rows = ad.event_rows(spark, sf)
    points = rows.filter("event_type in ('error', 'click')").select("user_id", "id", "s")
    spans = rows.filter("event_type in ('view', 'purchase')").select(
        "user_id", F.col("id").alias("span_id"), "e"
    )
    return latest_ended(
        points, spans, ["user_id"], "id", "s", "e", [F.col("span_id")], F.col("span_id"),
        "span_id", cold,
    ).select("id", "span_id")


def _event_logs(spark, sf):
    return otel.ordered_logs(ad.event_logs(spark, sf))


def positional_zip(spark, sf):
    logs = settle(_event_logs(spark, sf))
    return otel.zipped_bodies(logs, ad.is_cold(spark, sf))


def hook_pairs(spark, sf):
    logs = settle(_event_logs(spark, sf))
    return otel.hook_runs(logs, ad.is_cold(spark, sf)).select(
        "harness_session", "hook_name", "start_ns", "end_ns"
    )


def _flat_spans(spark, sf) -> DataFrame:
    """Spans of the trace documents, parsed once."""
    return settle(otel_source.flat_spans(ad.trace_documents(spark, sf)))


def _typed_spans(spark, sf) -> DataFrame:
    spans = _flat_spans(spark, sf)
    routed = spans.join(otel_source.trace_sessions(spans).select("path", "harness_session"), "path")
    return otel.span_columns(routed)


def otel_spans(spark, sf):
    """Spans flattened from trace documents, with typed attributes."""
    return _typed_spans(spark, sf).select(
        "harness_session", "id", "parent", "start_ns", "end_ns", "span_type", "model", "tokens_in",
        "tokens_out", "request_id", "tool_name", "prompt", "user_id", "sequence",
        text.leading_float(F.col("own_cost")).alias("cost_usd"),
    )


def otel_rejects(spark, sf):
    """Spans that lack an attribute their type requires."""
    kind = F.when(F.col("span_type").isin(otel.NODE_TYPES), F.col("span_type"))
    return (
        _typed_spans(spark, sf)
        .withColumn("type", F.coalesce(kind, F.lit("interaction")))
        .withColumn("missing", otel.missing_attributes(F.col("type")))
        .filter(F.size("missing") > 0)
        .select("harness_session", "id", "type", F.array_join("missing", ",").alias("missing"))
    )


def span_violations(spark, sf):
    spans = _flat_spans(spark, sf)
    # All spans of a session count as one document here, so parents can be looked up in it.
    return otel_source.violations(spans.withColumn("path", F.col("dir")))


def log_attribution(spark, sf):
    """Log events to spans in three tiers."""
    spans, logs = settle(_typed_spans(spark, sf)), settle(_event_logs(spark, sf))
    return otel.attribute_logs(spans, logs, ad.is_cold(spark, sf)).select(
        "harness_session", F.regexp_extract("log_id", "([0-9]+)$", 1).cast("bigint").alias("pos"),
        "span_id",
    )


def llm_enrichment(spark, sf):
    """What attributed log events add to each span."""
    spans, logs = settle(_typed_spans(spark, sf)), settle(_event_logs(spark, sf))
    links = settle(otel.attribute_logs(spans, logs, ad.is_cold(spark, sf)))
    attributed = logs.drop("span_id").join(links, ["harness_session", "log_id"])
    return otel.llm_enrichment(attributed).select(
        "harness_session", "id", F.col("api.cost_usd").alias("cost_usd"), "log_request",
        "log_response",
    )


def hook_hints(spark, sf):
    """The span each hook of a session without a root is put below."""
    hooks, spans = ad.hook_rows(spark, sf)
    found = otel.hook_parent_hints(settle(hooks), settle(spans), ad.is_cold(spark, sf))
    return found.filter("hint is not null")


def log_records(spark, sf):
    """Events of log arrays that are read in pieces, each with the event before it."""
    found = records.records(ad.event_pieces(spark, sf), otel_source.EVENT_LEVEL)
    events = settle(otel_source.record_logs(found)).select(
        "path", "pos", F.col("event_sequence").cast("bigint").alias("event_id"), "event_name", "body"
    )
    return scan(events, ["path"], ["pos"], [before("previous", F.col("event_id"))], ad.is_cold(spark, sf)).drop("pos")


def thread_assignment(spark, sf):
    members, _, _ = _members(spark, sf)
    return members.filter("type <> 'llm_request'").select("owner", "id", "lane")


def threads(spark, sf):
    members, _, _ = _members(spark, sf)
    return graph.threads(members)


def first_seen_delta(spark, sf):
    members, nodes, _ = _members(spark, sf)
    return graph.delta_messages(members, nodes).withColumnRenamed("at", "message_index")


def message_deltas(spark, sf):
    """The deltas table."""
    members, nodes, _, fresh, _ = _layers(spark, sf)
    return tables.deltas_table(graph.deltas(members, nodes, fresh))


def causal_edges(spark, sf):
    return _edges(spark, sf)[3]


def edge_gaps(spark, sf):
    return an.edge_gaps(_graph_tables(spark, sf))


def prompt_edges(spark, sf):
    """Some prompts are made blank; no edge starts there."""
    members, nodes, _ = _members(spark, sf)
    blank = F.substr("id", F.lit(2)).cast("bigint") % 7 == 0
    asked = nodes.withColumn("prompt", F.when(blank, F.lit(" \n")).otherwise(F.col("prompt")))
    return an.prompt_edges({"threads": graph.threads(members), "nodes": asked})


def main_thread_longest(spark, sf):
    members, nodes, cold = _members(spark, sf)
    return an.main_thread_longest({"nodes": nodes, "threads": graph.threads(members)})


def parallel_levels(spark, sf):
    return an.parallel_levels(_graph_tables(spark, sf))


def hidden_subcalls(spark, sf):
    nodes, _ = _stored_nodes(spark, sf)
    return an.hidden_subcalls({"nodes": nodes})


def tools_with_causes(spark, sf):
    return an.tools_with_causes(_graph_tables(spark, sf), only_inferences=True)


def causal_reach(spark, sf):
    """Everything upstream of the last step of each interaction."""
    members, nodes, cold, fresh, digests = _layers(spark, sf)
    edges = graph.owned_edges(members, nodes, digests, fresh, cold)
    last = nodes.groupBy(F.col("interaction_id").alias("owner")).agg(
        F.max_by("id", F.struct("start_time_ns", "id")).alias("seed")
    )
    up = edges.select("owner", F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return reach(up, last, "owner", cold)


def root_closure(spark, sf):
    """Owner of every node by climbing its parents."""
    nodes, _ = _stored_nodes(spark, sf)
    return graph.with_owner(nodes.drop("interaction_id")).select("id", "interaction_id")


def subtree(spark, sf):
    """Every node with everything it contains."""
    nodes, _ = _stored_nodes(spark, sf)
    return inside(an.nesting(nodes), "id").select(F.col("above").alias("root"), "id", F.col("levels").alias("depth"))


def ancestor_path(spark, sf):
    nodes, _ = _stored_nodes(spark, sf)
    return an.ancestor_paths({"nodes": nodes, "sessions": graph.sessions(nodes)})


def nearest_tool(spark, sf):
    """Closest tool above each node, by pointer doubling."""
    nodes, _ = _stored_nodes(spark, sf)
    found = nearest_stop(nodes, "id", "parent", F.col("type") == "tool", out="tool_id")
    return found.filter("found").select("id", "tool_id")


def containment(spark, sf):
    return graph.containment(_nodes(spark, sf)[0])


def session_dimension(spark, sf):
    return graph.sessions(_nodes(spark, sf)[0]).drop("title")


def agent_dimension(spark, sf):
    return graph.agents(_nodes(spark, sf)[0])


def dedupe_nodes(spark, sf):
    """One row per id where every node also arrives in a later copy."""
    nodes = _nodes(spark, sf)[0].drop("interaction_id")
    copies = nodes.withColumn("origin", F.concat(F.lit("zz"), "origin")).withColumn(
        "tokens_out", F.lit(-1.0)
    )
    return graph.unique_nodes(copies.unionByName(nodes)).select("id", "session_id", "tokens_out")


def tool_outcomes(spark, sf):
    """Outcome of each call by the last result sent back in its session."""
    nodes, _ = _stored_nodes(spark, sf)
    return (
        outcomes.attach_outcomes(nodes.drop("interaction_id"))
        .filter("type = 'tool'")
        .select("id", "is_error", "error_kind", "output_size", "error_message")
    )


def tool_semantics(spark, sf):
    return _tables(spark, sf)["semantics"]


def inference_semantics(spark, sf):
    members, nodes, _, fresh, _ = _layers(spark, sf)
    seeds = semantics.inference_entries(nodes, graph.deltas(members, nodes, fresh))
    return semantics.ground(semantics.label_entries(seeds), graph.session_facts(nodes))


def node_context(spark, sf):
    return an.node_context(_tables(spark, sf))


def resolve_node(spark, sf):
    """Every node with its delta and entries, as sizes."""
    members, nodes, cold, fresh, _ = _layers(spark, sf)
    relations = {
        "nodes": graph.with_seq(nodes, cold).select("id", "type", "seq"),
        "deltas": tables.deltas_table(graph.deltas(members, nodes, fresh)),
        "semantics": ad.event_semantics(nodes),
    }
    return workbench.resolved(relations).select(
        "id", "type", "seq", "request_messages_delta",
        F.when(F.col("entries").isNotNull(), F.size("entries")).alias("entry_count"),
        F.col("entries")[0]["action"].alias("first_action"),
    )


def redundant_calls(spark, sf):
    return _rounded(an.redundant_calls({"nodes": _nodes(spark, sf)[0]}), "approx_wasted_ms")


def redundant_call_members(spark, sf):
    return an.redundant_call_members({"nodes": _stored_nodes(spark, sf)[0]})


def longest_steps(spark, sf):
    return an.longest_steps({"nodes": _nodes(spark, sf)[0]})


def misleading_files(spark, sf):
    return an.misleading_files(_tables(spark, sf))


def failed_edit_members(spark, sf):
    return an.failed_edit_members(_tables(spark, sf))


def error_breakdown(spark, sf):
    return an.error_breakdown(_tables(spark, sf))


def verify_loop_excluded(spark, sf):
    return an.operational_errors(_tables(spark, sf))


def recovery_window(spark, sf):
    nodes, cold = _nodes(spark, sf)
    rows = an.recovery_windows({"nodes": graph.with_seq(nodes, cold)}, cold=cold)
    return _rounded(rows, "tokens_between")


def recovery_same_file(spark, sf):
    nodes, cold = _stored_nodes(spark, sf)
    rows = an.recovery_windows(ad.event_tables(nodes, cold), same_file=True, cold=cold)
    return _rounded(rows, "tokens_between")


def preventable_cost(spark, sf):
    nodes, cold = _nodes(spark, sf)
    ranked = an.preventable_cost({"nodes": graph.with_seq(nodes, cold)}, cold=cold)
    return _rounded(ranked, "recovery_tokens")


def failure_facts(spark, sf):
    return an.failure_facts({"nodes": _nodes(spark, sf)[0]})


def json_escape_hatch(spark, sf):
    nodes = tables.nodes_table(*_nodes(spark, sf))
    return an.unpromoted_field({"nodes": nodes})


# ---- Over conversations, documents, pages and keys -----------------------------------------------


def _chat_nodes(spark, sf) -> DataFrame:
    return chat.chat_nodes(settle(chatlog.entries(ad.conversation_lines(spark, sf))))


def chat_log_nodes(spark, sf):
    """Nodes of the conversations written as native session logs."""
    return _chat_nodes(spark, sf).select(
        "type", "session_id", "start_time_ns", "end_time_ns", "tokens_in", "tokens_out", "sequence",
        "prompt", "cwd", "stop_reason", F.size("response_messages").alias("reply_blocks"),
    )


def chat_requests(spark, sf):
    """What each inference of the conversations was asked."""
    return _chat_nodes(spark, sf).filter("type = 'llm_request'").select(
        "session_id", "end_time_ns",
        F.get_json_object(F.col("request_messages")[0], "$.content").alias("asked"),
    )


def chat_tool_nodes(spark, sf):
    """Nodes of native logs with tool calls, chunked replies, turn ends and files to leave out."""
    lines = ad.tool_chat_lines(spark, sf)
    nodes = chat.chat_nodes(settle(chatlog.entries(lines)))
    return nodes.select(
        "type", "session_id", "start_time_ns", "end_time_ns", "tokens_in", "stop_reason", "name", "tool_input",
        F.size("response_messages").alias("reply_blocks"),
        F.get_json_object(F.col("request_messages")[0], "$.content[0].tool_use_id").alias("fed"),
    )


def intent_counts(spark, sf):
    talk = ad.read_spread(spark, sf, "conversations").filter("role = 'user'")
    nodes = intent.with_intent(talk, "text", "intent_category").withColumn(
        "type", F.lit("interaction")
    )
    return an.intent_counts({"nodes": nodes})


def document_intents(spark, sf):
    docs = ad.read_spread(spark, sf, "documents")
    return intent.with_intent(docs, "text", "intent_category").select("doc_id", "intent_category")


def document_error_kinds(spark, sf):
    docs = outcome.with_error_kind(ad.read_spread(spark, sf, "documents"), "text", "error_kind")
    return outcome.with_error_message(docs, "text", "error_message").select(
        "doc_id", "error_kind", "error_message",
        text.utf16_length(F.col("text")).alias("output_size"),
    )


def decoded_bodies(spark, sf):
    """Request bodies wrapped around whole documents, some cut short, read back."""
    docs = ad.read_spread(spark, sf, "documents").select("doc_id", "text")
    body = F.to_json(
        F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
                 .alias("messages"))
    )
    cut = F.concat(F.substr(body, F.lit(1), F.length(body) - 4), F.lit("[TRUNCATED 9 bytes]"))
    raw = docs.withColumn("body", F.when(F.col("doc_id") % 3 == 0, cut).otherwise(body))
    decoded = raw.withColumn("decoded", bodies.decoded(F.col("body")))
    return decoded.select(
        "doc_id",
        F.get_json_object(bodies.request_messages(F.col("decoded"))[0], "$.content").alias("text"),
    )


def shell_action(spark, sf):
    rows = labels.with_shell_action(ad.command_rows(spark, sf), "command", "action")
    return rows.select("o_orderkey", "action")


def tool_labels(spark, sf):
    """Entries of calls of every listed tool, with their commands."""
    calls = ad.tool_call_rows(spark, sf)
    entries = semantics.label_entries(semantics.tool_entries(calls))
    # One row per call on this side.
    valid = F.when(F.expr("try_parse_json(tool_input) is not null"), F.col("tool_input"))
    commands = calls.select("id", labels.bash_command(valid).alias("bash_command"))
    return entries.join(commands, "id").select(
        F.col("id").cast("bigint").alias("o_orderkey"), "sequence_in_node", "action", "raw_path", "url", "comment", "bash_command"
    )


def path_type(spark, sf):
    rows = labels.with_path_type(ad.path_rows(spark, sf), "path", "path_type")
    return rows.select("l_orderkey", "l_linenumber", "path_type")


def repo_path(spark, sf):
    rows = paths.with_repo_path(ad.path_rows(spark, sf), "path", "cwd", "repo_path")
    return rows.select(
        "l_orderkey", "l_linenumber", "repo_path",
        paths.package(F.col("repo_path")).alias("package"),
    )


def url_host(spark, sf):
    return ad.read(spark, sf, "pages").select(
        "page_id", paths.url_host(F.col("url")).alias("host")
    )


def classify_files(spark, sf):
    return ad.file_rows(spark, sf).select(
        "o_orderkey", files.input_type(F.col("name")).alias("input_type")
    )


def repo_families(spark, sf):
    return files.repo_families(ad.directory_rows(spark, sf))


def session_routing(spark, sf):
    """Trace, log and chat files to sessions."""
    spans = _flat_spans(spark, sf)
    traces = otel_source.trace_sessions(spans)
    logs = ad.event_logs(spark, sf).select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "pos",
        F.when(F.col("harness_session").cast("bigint") % 2 == 0, F.col("harness_session")).alias(
            "session_id"
        ),
    )
    chats = ad.read(spark, sf, "conversations").select(
        F.concat(F.lit("/logs/c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"),
        F.col("conv_id").cast("string").alias("harness_session"),
    ).distinct()
    routed = otel_source.session_inputs(chats, traces, otel_source.log_sessions(logs, traces))
    return routed.groupBy("harness_session", "kind", "input_type").agg(
        F.count("*").alias("inputs")
    )


QUERIES: list[Query] = [
    session_rollup, interaction_metrics, interaction_rollup, shape_counts, load_summary,
    typed_views, interaction_windows, node_seq, narrowest_span, last_ended_before, positional_zip,
    hook_pairs, otel_spans, otel_rejects, span_violations, log_attribution, llm_enrichment,
    hook_hints, log_records,
    thread_assignment, threads, first_seen_delta, message_deltas, causal_edges, edge_gaps,
    prompt_edges, main_thread_longest, parallel_levels, hidden_subcalls, tools_with_causes,
    causal_reach, root_closure, subtree, ancestor_path, nearest_tool, containment,
    session_dimension, agent_dimension, dedupe_nodes, tool_outcomes, tool_semantics,
    inference_semantics, node_context, resolve_node, redundant_calls, redundant_call_members,
    longest_steps, misleading_files, failed_edit_members, error_breakdown, verify_loop_excluded,
    recovery_window, recovery_same_file, preventable_cost, failure_facts, json_escape_hatch,
    chat_log_nodes, chat_requests, chat_tool_nodes, intent_counts, document_intents, document_error_kinds,
    decoded_bodies, shell_action, tool_labels, path_type, repo_path, url_host, classify_files, repo_families,
    session_routing,
]


def _query(make: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(make(prepare(spark), sf_dir))

    run.__name__ = make.__name__
    run.__doc__ = make.__doc__
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Metrics per interaction at the smallest scale."""
    return queries()["interaction_metrics"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    made = {make.__name__: _query(make) for make in QUERIES}
    if training:
        made |= training.queries() | {"pipeline": corpus_pipeline.run}
    return made


def oracle_sql() -> dict[str, str]:
    made = dict(oracle_queries.SQL)
    if training:
        made |= training.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            made["pipeline"] = corpus_pipeline.ORACLE_SQL
    return made
