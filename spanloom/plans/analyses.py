"""Ready-made analyses over the tables. Each takes a dict of tables and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import labels
from spanloom.operators.nesting import first_inside, inside, nested_intervals
from spanloom.operators.ordered import running_sum, scan, upcoming
from spanloom.plans.columns import MAIN_THREAD, SORT_RANK
from spanloom.plans.graph import gap_ms
from spanloom.runtime import settle

Tables = dict[str, DataFrame]

# Tools that change files, and labels of commands whose failure is a finding.
EDIT_TOOLS = ["Edit", "Write", "MultiEdit", "NotebookEdit"]
VERIFY_LABELS = [labels.action_label(a) for a in ("test", "verify", "lint", "typecheck", "search")]
WEAK_MODEL = "(?i)haiku"


# ---- Rollups ---------------------------------------------------------------------------------


def session_rollup(t: Tables) -> DataFrame:
    """Cost, tokens and calls per session."""
    return (
        t["nodes"]
        .groupBy("session_id")
        .agg(
            F.sum("cost_usd").alias("cost_usd"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
            F.count_if(F.col("type") == "llm_request").alias("llm_calls"),
            F.count_if(F.col("type") == "tool").alias("tool_calls"),
        )
        .orderBy(F.col("cost_usd").desc(), "session_id")
    )


def interaction_rollup(t: Tables) -> DataFrame:
    """Interaction metrics, longest first."""
    return (
        t["interaction_metrics"]
        .select(
            "interaction_id", "shape", "tool_count", "llm_count", "tokens_in", "tokens_out",
            "cost_usd", "duration_ms", "distinct_files", "error_count",
        )
        .orderBy(F.col("duration_ms").desc(), "interaction_id")
    )


def shape_counts(t: Tables) -> DataFrame:
    return t["interaction_metrics"].groupBy("shape").agg(F.count("*").alias("interactions"))


def intent_counts(t: Tables) -> DataFrame:
    return (
        t["nodes"]
        .filter("type = 'interaction'")
        .groupBy("intent_category")
        .agg(F.count("*").alias("interactions"))
    )


# ---- Waste -----------------------------------------------------------------------------------

CALL = ["interaction_id", "name", "tool_input"]


def redundant_calls(t: Tables) -> DataFrame:
    """Calls repeated with the same input in one interaction, and the time that took."""
    return (
        t["nodes"]
        .filter("type = 'tool'")
        .groupBy(*CALL)
        .agg(
            F.count("*").alias("occurrences"),
            (F.sum("duration_ms") - F.max("duration_ms")).alias("approx_wasted_ms"),
        )
        .filter("occurrences >= 2")
    )


def redundant_call_members(t: Tables) -> DataFrame:
    """The calls behind ``redundant_calls``, one row each instead of an unbounded list."""
    tools = t["nodes"].filter("type = 'tool'").select(*CALL, "id")
    groups = redundant_calls(t).select(*CALL)
    same = [
        tools["interaction_id"].eqNullSafe(groups["interaction_id"]),
        tools["name"].eqNullSafe(groups["name"]),
        tools["tool_input"].eqNullSafe(groups["tool_input"]),
    ]
    return tools.join(groups, same, "left_semi")


def longest_steps(t: Tables) -> DataFrame:
    """Longest node of each interaction; the smallest id of equal ones.

    An aggregate, not a window: a huge interaction is reduced before it is shuffled.
    """
    return (
        t["nodes"]
        .filter("duration_ms is not null")
        .groupBy("interaction_id")
        .agg(
            F.min_by(
                F.struct("id", "type", "name", "duration_ms"),
                F.struct(-F.col("duration_ms"), F.col("id")),
            ).alias("s")
        )
        .select("interaction_id", "s.*")
    )


def _first_entries(t: Tables) -> DataFrame:
    return t["semantics"].filter("sequence_in_node = 0").drop("sequence_in_node", "comment")


def failed_edit_members(t: Tables) -> DataFrame:
    failed = t["nodes"].filter(
        (F.col("type") == "tool") & F.col("is_error") & F.col("name").isin(EDIT_TOOLS)
    )
    return failed.select("id").join(_first_entries(t), "id").select("repo_path", "id")


def misleading_files(t: Tables) -> DataFrame:
    """Failed edits per file."""
    return (
        failed_edit_members(t)
        .groupBy("repo_path")
        .agg(F.count("*").alias("failed_edits"))
        .orderBy(F.col("failed_edits").desc(), F.col("repo_path"))
    )


def unpromoted_field(t: Tables, field: str = "stop_reason") -> DataFrame:
    """A field of the node JSON."""
    return t["nodes"].filter("type = 'llm_request'").select(
        "id", F.get_json_object("data", f"$.{field}").alias(field)
    )


def tools_with_causes(t: Tables, only_inferences: bool = False) -> DataFrame:
    """Tools with what triggered them; optionally only where that is an inference."""
    tools = t["nodes"].filter("type = 'tool'").select(
        F.col("id").alias("to_id"), "name", "duration_ms"
    )
    edges = t["causal_edges"].select("from_id", "to_id")
    if only_inferences:
        senders = t["nodes"].filter("type = 'llm_request'").select(F.col("id").alias("from_id"))
        edges = edges.join(senders, "from_id", "left_semi")
    return tools.join(edges, "to_id").select(
        F.col("from_id").alias("inference_id"), F.col("to_id").alias("tool_id"), "name",
        "duration_ms",
    )


def _failures(t: Tables) -> DataFrame:
    failed = t["nodes"].filter("type = 'tool' and is_error")
    return failed.select("id", "name", "error_kind").join(_first_entries(t), "id", "left")


def error_breakdown(t: Tables) -> DataFrame:
    """Failed calls by kind of error and action."""
    return _failures(t).groupBy("error_kind", "action").agg(F.count("*").alias("errors"))


def without_verify_loop(failures: DataFrame) -> DataFrame:
    """Leave out red tests, checks and empty searches of the shell: they are findings."""
    finding = (
        (F.col("name") == "Bash")
        & (F.col("error_kind") == "nonzero_exit")
        & F.col("action").isin(VERIFY_LABELS)
    )
    return failures.filter(~F.coalesce(finding, F.lit(False)))


def operational_errors(t: Tables) -> DataFrame:
    return (
        without_verify_loop(_failures(t))
        .groupBy("error_kind", "action")
        .agg(F.count("*").alias("errors"))
    )


RECOVERY = ["failed_id", "error_kind", "recovered_id", "steps", "tokens_between"]


def _recoveries(t: Tables, by: list[str], cold: bool | None) -> DataFrame:
    spent = scan(
        t["nodes"].select(
            "id", "type", "interaction_id", "seq", "name", "is_error", "error_kind", "tokens_out",
            "start_time_ns", "end_time_ns",
        ),
        ["interaction_id"],
        ["seq"],
        [running_sum("spent", F.when(F.col("type") == "llm_request", F.col("tokens_out")))],
        cold,
    ).filter("type = 'tool' and name is not null")
    if "repo_path" in by:
        paths = _first_entries(t).filter("repo_path is not null").select("id", "repo_path")
        spent = spent.join(paths, "id")
    good = F.when(~F.col("is_error"), F.struct("id", "seq", "start_time_ns", "spent"))
    ranked = scan(spent, by, ["seq"], [upcoming("next", good)], cold)
    return ranked.filter("is_error").select(
        *by,
        F.col("id").alias("failed_id"),
        "error_kind",
        F.col("next.id").alias("recovered_id"),
        (F.col("next.seq") - F.col("seq")).alias("steps"),
        (F.col("next.spent") - F.col("spent")).alias("tokens_between"),
        (F.col("next.start_time_ns") - F.col("end_time_ns")).alias("ns_between"),
    )


def recovery_windows(t: Tables, same_file: bool = False, cold: bool | None = None) -> DataFrame:
    """Each failed call with the next good call of the same tool and the cost in between.

    Tokens in between come from a running sum, so no range join is needed.
    """
    by = ["interaction_id", "name", *(["repo_path"] if same_file else [])]
    return _recoveries(t, by, cold).select(
        *by, *RECOVERY, (F.col("ns_between") / 1e6).alias("ms_between")
    )


def preventable_cost(t: Tables, cold: bool | None = None) -> DataFrame:
    """Errors ranked by frequency times recovery cost.

    Time is summed in whole nanoseconds, so the result does not depend on the order of the rows.
    """
    windows = _recoveries(t, ["interaction_id", "name"], cold)
    costs = windows.groupBy("name", "error_kind").agg(
        F.count("*").alias("errors"),
        F.count("recovered_id").alias("recovered"),
        F.sum(F.coalesce("tokens_between", F.lit(0.0))).alias("recovery_tokens"),
        (F.sum(F.coalesce("ns_between", F.lit(0))) / 1e6).alias("recovery_ms"),
    )
    return costs.orderBy(F.col("recovery_tokens").desc(), "name", "error_kind")


# ---- Lanes, branches, ancestors ------------------------------------------------------------------


def _lane_heads(t: Tables) -> DataFrame:
    """First member of each lane."""
    firsts = t["threads"].filter("position = 0").select(
        "interaction_id", "source", F.col("node_id").alias("id")
    )
    return firsts.join(t["nodes"].select("id", "type", "start_time_ns"), "id")


def main_lanes(t: Tables) -> DataFrame:
    """The main lane of each interaction: the one so named, else the first."""
    order = F.struct(
        (F.col("source") != MAIN_THREAD).alias("other"), "start_time_ns",
        F.expr(SORT_RANK).alias("rank"), "source",
    )
    return (
        _lane_heads(t)
        .groupBy("interaction_id")
        .agg(F.min_by("source", order).alias("source"))
    )


def _main_members(t: Tables) -> DataFrame:
    return (
        t["threads"]
        .join(main_lanes(t), ["interaction_id", "source"], "left_semi")
        .select("interaction_id", F.col("node_id").alias("id"), "position")
        .join(t["nodes"].select("id", "type", "duration_ms", "start_time_ns", "end_time_ns"), "id")
    )


def main_thread_longest(t: Tables) -> DataFrame:
    """Longest main-lane step of each interaction and its share of the wall-clock time."""
    top = (
        _main_members(t)
        .filter("duration_ms > 0")
        .groupBy("interaction_id")
        .agg(
            F.min_by(F.struct("id", "duration_ms"), F.struct(-F.col("duration_ms"), "position"))
            .alias("s")
        )
    )
    total = t["nodes"].filter("type = 'interaction'").select(
        F.col("id").alias("interaction_id"), F.col("duration_ms").alias("total")
    )
    share = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("s.duration_ms") / F.col("total")))
    return top.join(total, "interaction_id").select(
        "interaction_id", "s.id", "s.duration_ms", share.alias("share_of_run")
    )


def nesting(nodes: DataFrame, cold: bool | None = None) -> DataFrame:
    """``(id, root, depth, enter, leave)``: who contains whom, siblings in time order."""
    ranked = nodes.select("interaction_id", "id", "parent", "start_time_ns", F.expr(SORT_RANK).alias("rank"))
    return settle(nested_intervals(ranked, "id", "parent", ["start_time_ns", "rank"], cold, scope="interaction_id"))


def hidden_subcalls(t: Tables) -> DataFrame:
    """First weak-model inference inside each tool, depth first."""
    nodes = t["nodes"]
    weak = nodes.filter(F.col("type") == "llm_request").filter(F.col("model").rlike(WEAK_MODEL))
    found = first_inside(nesting(nodes), "id", nodes.filter("type = 'tool'"), weak)
    return (
        found.join(nodes.select("id", "model", "duration_ms"), "id")
        .select(F.col("above").alias("tool_id"), F.col("id").alias("subcall_id"), "model", "duration_ms")
    )


def parallel_levels(t: Tables) -> DataFrame:
    """Forks of the main lane into two or more tools that meet again in one step."""
    members = _main_members(t)
    edges = t["causal_edges"].select("from_id", "to_id").distinct()
    branch = members.filter("type = 'tool'").select(
        "interaction_id", F.col("id").alias("branch_id"), "duration_ms"
    )
    lane = members.select(F.col("id").alias("end_id"))
    into = edges.select(F.col("from_id").alias("fork_id"), F.col("to_id").alias("branch_id"))
    out = edges.select(F.col("from_id").alias("branch_id"), F.col("to_id").alias("join_id"))
    return (
        branch.join(into, "branch_id")
        .join(out, "branch_id")
        .join(lane.withColumnRenamed("end_id", "fork_id"), "fork_id", "left_semi")
        .join(lane.withColumnRenamed("end_id", "join_id"), "join_id", "left_semi")
        .groupBy("interaction_id", "fork_id", "join_id")
        .agg(
            F.count("*").alias("branches"),
            F.min_by("branch_id", F.struct(-F.col("duration_ms"), "branch_id")).alias(
                "critical_id"
            ),
            F.max("duration_ms").alias("critical_ms"),
        )
        .filter("branches >= 2")
    )


def ancestor_paths(t: Tables, seeds: DataFrame | None = None) -> DataFrame:
    """The way from the agent down to each node: ``(id, level, kind, step_id)``; level 0 is the node.

    ``seeds`` is a frame of ``id``; all nodes by default.
    """
    nodes = t["nodes"]
    wanted = nodes.select("id") if seeds is None else seeds.select("id")
    own = wanted.join(nodes.select("id", "session_id"), "id")
    nested = nesting(nodes)
    pairs = inside(nested, "id") if seeds is None else inside(nested, "id").join(wanted, "id", "left_semi")
    above = pairs.select("id", F.col("levels").cast("int").alias("level"), F.lit("node").alias("kind"), F.col("above").alias("step_id"))
    itself = wanted.select(
        "id", F.lit(0).alias("level"), F.lit("node").alias("kind"), F.col("id").alias("step_id")
    )
    height = nested.select("id", F.col("depth").cast("int").alias("top"))
    ends = (
        own.join(height, "id", "left")
        .join(t["sessions"].select(F.col("id").alias("session_id"), "agent_id"), "session_id",
              "left")
        .select(
            "id",
            F.inline(
                F.array(
                    F.struct(
                        (F.coalesce("top", F.lit(0)) + 1).alias("level"),
                        F.lit("session").alias("kind"),
                        F.col("session_id").alias("step_id"),
                    ),
                    F.struct(
                        (F.coalesce("top", F.lit(0)) + 2).alias("level"),
                        F.lit("agent").alias("kind"),
                        F.col("agent_id").alias("step_id"),
                    ),
                )
            ),
        )
    )
    return itself.unionByName(above).unionByName(ends)


def node_context(t: Tables) -> DataFrame:
    """First package, file and URL among the entries of each node."""

    def first(col):
        return F.min_by(col, F.when(F.col(col).isNotNull(), F.col("sequence_in_node"))).alias(col)

    return (
        t["semantics"]
        .groupBy("id")
        .agg(first("package"), first("repo_path"), first("url"))
        .filter("package is not null or repo_path is not null or url is not null")
    )


def edge_gaps(t: Tables) -> DataFrame:
    """Edges with their gap, measured end to start where the edge has none."""
    ends = t["nodes"].select("id", "start_time_ns", "end_time_ns")
    return (
        t["causal_edges"]
        .join(ends.select(F.col("id").alias("from_id"), F.col("end_time_ns").alias("from_end"),
                          F.col("start_time_ns").alias("from_start")), "from_id")
        .join(ends.select(F.col("id").alias("to_id"), F.col("start_time_ns").alias("to_start")),
              "to_id")
        .select(
            "from_id",
            "to_id",
            F.coalesce(
                "gap_ms",
                gap_ms(F.lit(False), F.col("from_start"),
                       F.nullif("from_end", F.lit(0)), F.nullif("to_start", F.lit(0))),
            ).alias("gap_ms"),
        )
    )


def prompt_edges(t: Tables) -> DataFrame:
    """From each prompt that is not blank to the first member of every lane it started."""
    asked = t["nodes"].filter("type = 'interaction'").filter(F.col("prompt").rlike(r"(?U)[^\s\uFEFF]"))
    heads = t["threads"].filter("position = 0").select(
        F.col("interaction_id").alias("from_id"), F.col("node_id").alias("to_id"), "source"
    )
    return heads.join(asked.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("from_id", "to_id", "source")


def failure_facts(t: Tables) -> DataFrame:
    return t["nodes"].filter("type = 'tool' and is_error").select(
        "id", F.col("error_kind").alias("kind"), F.nullif("error_message", F.lit("")).alias("message")
    )


def load_summary(t: Tables) -> DataFrame:
    """Sessions, interactions and nodes of the loaded data."""
    return t["nodes"].agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count_if(F.col("type") == "interaction").alias("interactions"),
        F.count("*").alias("nodes"),
    )
