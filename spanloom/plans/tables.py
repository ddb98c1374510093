"""The relational surface: table specs, table rows, views, and storage as Parquet."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import intent, labels, messages
from spanloom.plans import graph as g
from spanloom.plans import semantics as sem


@dataclass(frozen=True)
class Table:
    """A relation: its columns in order as (name, type, doc)."""

    name: str
    doc: str
    columns: tuple[tuple[str, str, str], ...]
    is_view: bool = False

    @property
    def column_names(self) -> list[str]:
        return [c[0] for c in self.columns]

    @property
    def schema(self) -> T.StructType:
        kinds = {
            "string": T.StringType(), "json": T.StringType(), "double": T.DoubleType(),
            "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(),
        }
        return T.StructType(
            [T.StructField(n, kinds[t], True, {"comment": d}) for n, t, d in self.columns]
        )

    def shape(self, df: DataFrame) -> DataFrame:
        """Project ``df`` to exactly these columns and types; unknown columns fail."""
        return df.select(
            *[
                F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata)
                for f in self.schema
            ]
        )

    def pick(self, names: list[str]) -> tuple[tuple[str, str, str], ...]:
        by_name = {c[0]: c for c in self.columns}
        return tuple(by_name[n] for n in names)


NODES = Table(
    "nodes",
    "One row per step of an execution. Columns of other node types are null; `data` keeps the rest.",
    (
        ("id", "string", "Node id, shared by every table."),
        ("type", "string", "interaction, llm_request, tool, tool.execution, tool.blocked_on_user or hook."),
        ("parent", "string", "Containing node (nodes.id)."),
        ("session_id", "string", "Owning session (sessions.id)."),
        ("interaction_id", "string", "Owning interaction (nodes.id)."),
        ("start_time_ns", "bigint", "Start in nanoseconds since the epoch."),
        ("end_time_ns", "bigint", "End in nanoseconds since the epoch."),
        ("seq", "int", "Dense 0-based order in the interaction, by start then id."),
        ("duration_ms", "double", "Wall-clock time in ms."),
        ("model", "string", "llm_request: model id."),
        ("source", "string", "llm_request: loop that sent it."),
        ("stop_reason", "string", "llm_request: why the model stopped."),
        ("tokens_in", "double", "llm_request: uncached input tokens."),
        ("tokens_out", "double", "llm_request: output tokens."),
        ("cache_read_tokens", "double", "llm_request: tokens read from the prompt cache, 0 if none."),
        ("cache_write_tokens", "double", "llm_request: tokens written to the prompt cache, 0 if none."),
        ("cost_usd", "double", "llm_request: cost stated by the trace; null when it states none."),
        ("name", "string", "tool, hook: its name."),
        ("tool_use_id", "string", "tool: call id that links emitter, call and result."),
        ("tool_input", "string", "tool: input as JSON text."),
        ("bash_command", "string", "tool: non-empty `command` of the input."),
        ("is_error", "boolean", "tool: did the result report an error; null without a result."),
        ("error_kind", "string", "tool: class of the failure; null unless it failed."),
        ("output_size", "int", "tool: length of the result text; null without a result."),
        ("error_message", "string", "tool: start of the error text; null unless it failed."),
        ("sequence", "int", "interaction: 0-based turn in the session."),
        ("prompt", "string", "interaction: what the user asked."),
        ("intent_category", "string", "interaction: kind of request, never null there."),
        ("data", "json", "The whole node as JSON."),
    ),
)
DELTAS = Table(
    "deltas",
    "Messages new to an llm_request within its lane.",
    (
        ("id", "string", "The llm_request (nodes.id)."),
        ("request_messages_delta", "json", "Request messages not sent earlier in the lane."),
        ("response_messages_delta", "json", "The whole response."),
    ),
)
SEMANTICS = Table(
    "semantics",
    "What a tool or llm_request did, one row per act.",
    (
        ("id", "string", "The node (nodes.id)."),
        ("sequence_in_node", "int", "Dense 0-based order of the act in its node."),
        ("action", "string", "Label of the act without its specific input."),
        ("repo_path", "string", "Repo-relative path acted on, the same in every worktree."),
        ("package", "string", "Workspace package of the path."),
        ("url", "string", "Host acted on."),
        ("comment", "string", "The agent's own note."),
    ),
)
CONTAINMENT = Table(
    "containment",
    "Which node ran inside which.",
    (
        ("parent_id", "string", "Container (nodes.id)."),
        ("child_id", "string", "Contained node (nodes.id)."),
    ),
)
CAUSAL_EDGES = Table(
    "causal_edges",
    "Which step triggered which.",
    (
        ("from_id", "string", "Cause (nodes.id)."),
        ("to_id", "string", "Effect (nodes.id)."),
        ("gap_ms", "double", "Signed gap from cause to effect in ms; null when 0."),
    ),
)
THREADS = Table(
    "threads",
    "Lanes of an interaction and their members.",
    (
        ("thread_id", "string", "Lane id, unique in its interaction."),
        ("interaction_id", "string", "Owning interaction (nodes.id)."),
        ("source", "string", "Loop behind the lane."),
        ("node_id", "string", "Member (nodes.id)."),
        ("position", "int", "0-based order in the lane."),
    ),
)
AGENTS = Table(
    "agents",
    "Agents.",
    (("id", "string", "Agent id."), ("user_id", "string", "User behind the agent.")),
)
SESSIONS = Table(
    "sessions",
    "Sessions.",
    (
        ("id", "string", "Session id as used by nodes.session_id."),
        ("agent_id", "string", "Agent (agents.id)."),
        ("user_id", "string", "User behind the session."),
        ("session_id", "string", "Session id given by the harness."),
        ("title", "string", "Title, if any."),
        ("cwd", "string", "Working directory; null for traces."),
        ("branch", "string", "Git branch; null for traces."),
    ),
)
LLM_REQUESTS = Table(
    "llm_requests",
    "View: the llm_request nodes.",
    NODES.pick([
        "id", "parent", "session_id", "interaction_id", "seq", "start_time_ns", "end_time_ns",
        "duration_ms", "model", "source", "stop_reason", "tokens_in", "tokens_out",
        "cache_read_tokens", "cache_write_tokens", "cost_usd",
    ]),
    True,
)
TOOLS = Table(
    "tools",
    "View: the tool nodes.",
    NODES.pick([
        "id", "parent", "session_id", "interaction_id", "seq", "start_time_ns", "end_time_ns",
        "duration_ms", "name", "tool_use_id", "tool_input", "bash_command", "is_error",
        "error_kind", "output_size", "error_message",
    ]),
    True,
)
INTERACTIONS = Table(
    "interactions",
    "View: the interaction nodes.",
    NODES.pick([
        "id", "session_id", "seq", "start_time_ns", "end_time_ns", "duration_ms", "sequence",
        "prompt", "intent_category",
    ]),
    True,
)
INTERACTION_METRICS = Table(
    "interaction_metrics",
    "View: one row per interaction with sums over its nodes.",
    (
        ("interaction_id", "string", "The interaction (nodes.id)."),
        ("session_id", "string", "Its session (sessions.id)."),
        ("sequence", "int", "Its turn in the session."),
        ("prompt_len", "int", "Characters of the prompt."),
        ("tool_count", "int", "Tool nodes."),
        ("llm_count", "int", "llm_request nodes."),
        ("tokens_in", "double", "Sum over its llm_requests."),
        ("tokens_out", "double", "Sum over its llm_requests."),
        ("cache_read_tokens", "double", "Sum over its llm_requests."),
        ("cache_write_tokens", "double", "Sum over its llm_requests."),
        ("cost_usd", "double", "Sum of stated costs; null when none is stated."),
        ("duration_ms", "double", "Its own wall-clock time."),
        ("shape", "string", "agentic when it called a tool, else direct."),
        ("distinct_files", "int", "Different repo paths its tools touched."),
        ("error_count", "int", "Failed tools."),
    ),
    True,
)

STORED = [NODES, DELTAS, SEMANTICS, CONTAINMENT, CAUSAL_EDGES, THREADS, AGENTS, SESSIONS]
VIEWS = [INTERACTION_METRICS, LLM_REQUESTS, TOOLS, INTERACTIONS]
TABLES = {t.name: t for t in STORED + VIEWS}


# ---- Rows ------------------------------------------------------------------------------------

DATA_FIELDS = [
    "id", "type", "parent", "session_id", "interaction_id", "start_time_ns", "end_time_ns",
    "duration_ms", "model", "source", "stop_reason", "tokens_in", "tokens_out",
    "cache_read_tokens", "cache_write_tokens", "cost_usd", "name", "tool_use_id", "tool_input",
    "is_error", "error_kind", "output_size", "error_message", "sequence", "prompt", "user_id",
    "cwd", "branch",
]


def node_data():
    """The node as JSON: non-null fields, times as digit strings, messages as JSON arrays."""
    fields = [
        F.col(f).cast("string").alias(f) if f.endswith("_ns") else F.col(f) for f in DATA_FIELDS
    ]
    base = F.to_json(F.struct(*fields))
    parts = [F.substr(base, F.lit(1), F.length(base) - 1)]
    for name in ("request_messages", "response_messages"):
        body = messages.json_array(F.col(name))
        parts.append(F.when(body.isNotNull(), F.concat(F.lit(f',"{name}":'), body)).otherwise(""))
    return F.concat(*parts, F.lit("}"))


def nodes_table(nodes: DataFrame, cold: bool | None = None) -> DataFrame:
    """Rows of ``nodes`` from canonical nodes with owners."""
    is_tool = F.col("type") == "tool"
    checked = F.when(F.expr("try_parse_json(tool_input) is not null"), F.col("tool_input"))
    labelled = intent.with_intent(g.with_seq(nodes, cold), "prompt", "intent")
    full = labelled.withColumns(
        {
            "bash_command": F.when(is_tool, labels.bash_command(checked)),
            "intent_category": F.when(F.col("type") == "interaction", F.col("intent")),
            "data": node_data(),
        }
    )
    return NODES.shape(full)


def deltas_table(deltas: DataFrame) -> DataFrame:
    return DELTAS.shape(
        deltas.select(
            "id",
            messages.json_array(F.col("request")).alias("request_messages_delta"),
            messages.json_array(F.col("response")).alias("response_messages_delta"),
        )
    )


def interaction_metrics(nodes: DataFrame, semantics: DataFrame) -> DataFrame:
    """Per-interaction rollup: nodes are summed before they meet their interaction."""
    is_tool = F.col("type") == "tool"
    is_llm = F.col("type") == "llm_request"
    # Only the first entry of a node counts, so the join never multiplies nodes.
    files = (
        nodes.filter(is_tool)
        .select("id", "interaction_id")
        .join(
            semantics.filter("sequence_in_node = 0 and repo_path is not null").select(
                "id", "repo_path"
            ),
            "id",
        )
        .groupBy("interaction_id")
        .agg(F.count_distinct("repo_path").alias("distinct_files"))
    )
    sums = ["tokens_in", "tokens_out", "cache_read_tokens", "cache_write_tokens", "cost_usd"]
    owned = nodes.groupBy("interaction_id").agg(
        F.count_if(is_tool).alias("tool_count"),
        F.count_if(is_llm).alias("llm_count"),
        *[F.sum(F.when(is_llm, F.col(c))).alias(c) for c in sums],
        F.count_if(is_tool & F.col("is_error")).alias("error_count"),
    )
    turns = nodes.filter("type = 'interaction'").select(
        F.col("id").alias("interaction_id"),
        "session_id",
        "sequence",
        F.length("prompt").alias("prompt_len"),
        "duration_ms",
    )
    shape = F.when(F.col("tool_count") > 0, "agentic").otherwise("direct")
    return INTERACTION_METRICS.shape(
        turns.join(owned, "interaction_id")
        .join(files, "interaction_id", "left")
        .withColumn("distinct_files", F.coalesce("distinct_files", F.lit(0)))
        .withColumn("shape", shape)
    )


def typed_views(nodes: DataFrame) -> dict[str, DataFrame]:
    """The columns of one node type each."""
    typed = {"llm_requests": "llm_request", "tools": "tool", "interactions": "interaction"}
    return {
        name: nodes.filter(F.col("type") == kind).select(*TABLES[name].column_names)
        for name, kind in typed.items()
    }


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The views over stored tables, computed when read."""
    nodes = tables["nodes"]
    metrics = interaction_metrics(nodes, tables["semantics"])
    return {"interaction_metrics": metrics, **typed_views(nodes)}


def stored_tables(graph: g.Graph) -> dict[str, DataFrame]:
    """The eight tables of a graph."""
    session_rows = g.sessions(graph.nodes)
    return {
        "nodes": nodes_table(graph.nodes, graph.cold),
        "deltas": deltas_table(graph.deltas),
        "semantics": SEMANTICS.shape(sem.semantics(graph.nodes, graph.deltas, session_rows)),
        "containment": CONTAINMENT.shape(g.containment(graph.nodes)),
        "causal_edges": CAUSAL_EDGES.shape(graph.causal_edges),
        "threads": THREADS.shape(graph.threads),
        "agents": AGENTS.shape(g.agents(graph.nodes)),
        "sessions": SESSIONS.shape(session_rows),
    }


# ---- Storage ---------------------------------------------------------------------------------


#: Empty files in this folder name the snapshots that are whole, as ``<number>-<folder>``; the last one counts.
COMMITS = "_commits"
#: Snapshots that stay: the current one, and those before it that readers may still use.
KEPT = 2


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and how to name paths in it."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole snapshots below ``path``, the current one last."""
    fs, make = _hadoop(spark, path)
    folder = make(f"{path.rstrip('/')}/{COMMITS}")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet directory per stored table, and of ``rejects`` if there are any.

    They go to a new folder below ``path``. Creating one empty file makes it the current snapshot, so there
    is a whole one at any time, and a write that fails leaves the earlier one as it is. Of writers at the
    same time each commits its own folder; the last name is the current one. Older snapshots than the
    last ``KEPT`` are removed. Folders of failed writes stay.
    """
    base, version = path.rstrip("/"), uuid.uuid4().hex
    for name in [*(t.name for t in STORED), *(["rejects"] if "rejects" in tables else [])]:
        tables[name].write.mode("error").parquet(f"{base}/{version}/{name}")
    spark = tables[STORED[0].name].sparkSession
    fs, make = _hadoop(spark, base)
    earlier = snapshots(spark, base)
    number = int(earlier[-1].split("-")[0]) + 1 if earlier else 1
    fs.create(make(f"{base}/{COMMITS}/{number:012d}-{version}"), False).close()
    for name in snapshots(spark, base)[:-KEPT]:
        fs.delete(make(f"{base}/{COMMITS}/{name}"), False)
        fs.delete(make(f"{base}/{name.split('-')[1]}"), True)


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current snapshot."""
    base = path.rstrip("/")
    whole = snapshots(spark, base)
    if not whole:
        raise FileNotFoundError(f"no snapshot below {base}")
    folder = f"{base}/{whole[-1].split('-')[1]}"
    made = {t.name: spark.read.schema(t.schema).parquet(f"{folder}/{t.name}") for t in STORED}
    fs, make = _hadoop(spark, folder)
    extras = [name for name in ("rejects",) if fs.exists(make(f"{folder}/{name}"))]
    return made | {name: spark.read.parquet(f"{folder}/{name}") for name in extras}


def register(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Make tables and views visible to SQL."""
    everything = {**tables, **views(tables)}
    for name, df in everything.items():
        df.createOrReplaceTempView(name)
    return everything


def describe(spark: SparkSession) -> DataFrame:
    """``(table, is_view, table_doc, position, column, type, doc)`` of the whole surface."""
    rows = [
        (t.name, t.is_view, t.doc, i, n, kind, doc)
        for t in TABLES.values()
        for i, (n, kind, doc) in enumerate(t.columns)
    ]
    return spark.createDataFrame(
        rows,
        "`table` string, is_view boolean, table_doc string, position int, `column` string,"
        " type string, doc string",
    )
