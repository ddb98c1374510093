"""From canonical nodes to owners, lanes, message deltas and causal edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.climb import nearest_stop
from spanloom.operators.ordered import before, has_hot_group, latest, position, scan
from spanloom.operators.stab import nearest_interval
from spanloom.plans.columns import MAIN_THREAD, PSEUDO_USER, SORT_RANK
from spanloom.plans.digest import digest, fingerprint
from spanloom.runtime import settle

# ---- One row per id, owners, dimensions ------------------------------------------------------


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id; the first by source file, session and start stays.

    A partial aggregate keeps one row per id and task before the shuffle, so many copies of one
    node cost no more than one.
    """
    clean = nodes.withColumn("parent", F.when(F.col("parent") != F.col("id"), F.col("parent")))
    rank = F.struct("origin", "session_id", "start_time_ns", F.xxhash64(*clean.columns))
    first = clean.groupBy("id").agg(F.min_by(F.struct(*clean.columns), rank).alias("n"))
    return first.select("n.*")


def with_owner(nodes: DataFrame) -> DataFrame:
    """Add ``interaction_id``, the root of the parent chain."""
    roots = nearest_stop(nodes, "id", "parent", F.lit(False), out="root").drop("found")
    return (
        nodes.join(roots, "id", "left")
        .withColumn("interaction_id", F.coalesce("root", "id"))
        .drop("root")
    )


def _arrival() -> Column:
    return F.struct("origin", "session_id", "start_time_ns", "id")


def agents(nodes: DataFrame) -> DataFrame:
    """The single agent, named by the first interaction's user."""
    first = nodes.filter("type = 'interaction'").agg(F.min_by("user_id", _arrival()).alias("u"))
    user = F.coalesce("u", F.lit(PSEUDO_USER))
    return first.select(F.concat(F.lit("agent-"), user).alias("id"), user.alias("user_id"))


def session_facts(nodes: DataFrame) -> DataFrame:
    """What the first interaction of each harness session tells about it."""
    described = F.struct(F.col("session_id").alias("id"), "user_id", "cwd", "branch")
    return (
        nodes.filter("type = 'interaction'")
        .groupBy("harness_session")
        .agg(F.min_by(described, _arrival()).alias("s"))
        .select("s.*", F.col("harness_session").alias("session_id"))
    )


def sessions(nodes: DataFrame) -> DataFrame:
    """One row per harness session, described by its first interaction."""
    agent = agents(nodes).select(F.col("id").alias("agent_id"), F.lit(1).alias("one"))
    return (
        session_facts(nodes)
        .withColumn("one", F.lit(1))
        .join(F.broadcast(agent), "one")  # one row
        .select(
            "id",
            "agent_id",
            "user_id",
            "session_id",
            F.lit(None).cast("string").alias("title"),
            "cwd",
            "branch",
        )
    )


def with_seq(nodes: DataFrame, cold: bool | None = None) -> DataFrame:
    """Dense 0-based order of the nodes of an interaction."""
    ranked = scan(nodes, ["interaction_id"], ["start_time_ns", "id"], [position("seq")], cold)
    return ranked.withColumn("seq", F.col("seq").cast("int"))


def containment(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent is not null").select(
        F.col("parent").alias("parent_id"), F.col("id").alias("child_id")
    )


# ---- Lanes -----------------------------------------------------------------------------------

STEP = ["id", "type", "name", "tool_use_id", "start_time_ns", "end_time_ns"]


def _steps(nodes: DataFrame) -> DataFrame:
    return nodes.select(*STEP, "parent", "source").withColumn("rank", F.expr(SORT_RANK))


def lane_members(nodes: DataFrame, cold: bool | None = None) -> DataFrame:
    """Direct children of interactions by lane: ``(owner, lane, position, ...step)``.

    Inferences seed a lane per source; tools and hooks join the lane of the inference they ran
    under or after.
    """
    owners = nodes.filter("type = 'interaction'").select(F.col("id").alias("parent"))
    direct = (
        _steps(nodes)
        .filter("type in ('llm_request', 'tool', 'hook') and parent is not null")
        .join(owners, "parent", "left_semi")
        .withColumnRenamed("parent", "owner")
    )
    seeds = direct.filter("type = 'llm_request'").withColumn(
        "lane", F.coalesce("source", F.lit("unknown"))
    )
    others = direct.filter("type <> 'llm_request'")
    opens_prompt = F.expr("type = 'hook' and name <=> 'UserPromptSubmit'")
    main = seeds.filter(F.col("lane") == MAIN_THREAD).select("owner", "lane").distinct()
    on_main = others.filter(opens_prompt).join(main, "owner")
    placed = nearest_interval(
        others.filter(~opens_prompt),
        seeds,
        ["owner"],
        "id",
        "start_time_ns",
        "start_time_ns",
        "end_time_ns",
        "id",
        F.col("lane"),
        "lane",
        cold,
    )
    rest = others.join(placed, ["owner", "id"])
    keep = ["owner", "lane", *STEP, "rank"]
    members = seeds.select(*keep).unionByName(on_main.select(*keep)).unionByName(rest.select(*keep))
    return scan(
        members, ["owner", "lane"], ["start_time_ns", "rank", "id"], [position("position")], cold
    )


def threads(members: DataFrame) -> DataFrame:
    lane_id = F.concat(F.lit("thread_"), F.regexp_replace("lane", r"\W+", "_"))
    return members.select(
        lane_id.alias("thread_id"),
        F.col("owner").alias("interaction_id"),
        F.col("lane").alias("source"),
        F.col("id").alias("node_id"),
        F.col("position").cast("int").alias("position"),
    )


def lane_order(members: DataFrame) -> DataFrame:
    """Lanes of an interaction sort by their first member."""
    return members.groupBy("owner", "lane").agg(
        F.min(F.struct("start_time_ns", "rank", "lane")).alias("lane_order")
    )


# ---- Message deltas --------------------------------------------------------------------------


def delta_positions(members: DataFrame, digests: DataFrame, cold: bool | None = None) -> DataFrame:
    """Which messages each inference of a lane sends first: ``(id, at)``; no text is moved.

    A request that begins with the whole request before it (told by the fingerprint of its keys) sends on only
    what comes after, so a conversation costs rows with its length, not with its square. Any other
    message that was sent before is found among the keys that are left.
    """
    sent = (
        members.filter("type = 'llm_request'")
        .select("owner", "lane", "position", "id")
        .join(digests.filter("keys is not null").select("id", "keys"), "id")
        .withColumns({"n": F.size("keys"), "whole": fingerprint(F.col("keys"))})
    )
    lined = scan(sent, ["owner", "lane"], ["position"], [before("earlier", F.struct("n", "whole"))], cold)
    known = F.coalesce("earlier.n", F.lit(0))
    extends = (known <= F.col("n")) & (fingerprint(F.slice("keys", F.lit(1), known)) == F.col("earlier.whole"))
    skipped = F.when(F.coalesce(extends, F.lit(False)), known).otherwise(0)
    left = lined.withColumn("skipped", skipped).select(
        "owner", "lane", "position", "id",
        F.posexplode(F.slice("keys", F.col("skipped") + 1, F.col("n"))).alias("after", "key"), "skipped",
    )
    # Many copies of one message end in one row per task before the shuffle.
    own = left.groupBy("owner", "lane", "key").agg(F.min_by(F.struct("position", "id"), F.struct("position", "id")).alias("f"))
    first = own.select(F.col("f.id").alias("id"), "key")
    return left.join(first, ["id", "key"]).select("id", (F.col("skipped") + F.col("after")).alias("at"))


def delta_messages(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Messages first sent by each inference of a lane: ``(id, at, message)``."""
    found = delta_positions(members, settle(digest(nodes)))
    kept = found.groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("kept"))
    return (
        nodes.filter("request_messages is not null").select("id", "request_messages").join(kept, "id")
        .select("id", "request_messages", F.explode("kept").alias("at"))
        .select("id", "at", F.get("request_messages", F.col("at")).alias("message"))
    )


def deltas(members: DataFrame, nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """New request messages and the full response of every inference in a lane.

    ``fresh`` has the positions of the new messages; texts are picked from the bodies in one join.
    """
    bodies = nodes.filter(
        "type = 'llm_request' and (request_messages is not null or response_messages is not null)"
    ).select("id", "request_messages", "response_messages")
    kept = fresh.groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("kept"))
    wanted = members.filter("type = 'llm_request'").select("id").join(kept, "id", "left")
    picked = F.transform(F.coalesce("kept", F.array().cast("array<int>")), lambda at: F.get("request_messages", at))
    return bodies.join(wanted, "id").select(
        "id", F.when(F.col("request_messages").isNotNull(), picked).alias("request"), F.col("response_messages").alias("response")
    )


# ---- Causal edges ----------------------------------------------------------------------------


def _end(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in
                      ("id", "start_time_ns", "end_time_ns", "type", "name")])


def participants(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lane members and everything contained in them, with their sibling group and head."""
    tops = members.join(lane_order(members), ["owner", "lane"])
    keep = ["owner", "lane", "lane_order", "position", *STEP, "rank", "group", "head"]
    nothing = F.lit(None).cast(members.select(_end().alias("x")).schema["x"].dataType)
    top_rows = tops.withColumn("group", F.col("owner")).withColumn("head", nothing).select(*keep)

    inner = _steps(nodes).filter("parent is not null").join(
        members.select("id"), "id", "left_anti"
    )
    links = members.select(
        "id", F.lit(None).cast("string").alias("parent"), F.lit(True).alias("top")
    ).unionByName(inner.select("id", "parent", F.lit(False).alias("top")))
    under = nearest_stop(links, "id", "parent", F.col("top"), out="top").filter("found")
    lanes = tops.select(F.col("id").alias("top"), "owner", "lane", "lane_order", "position")
    heads = _steps(nodes).select(F.col("id").alias("parent"), _end().alias("head"))
    nested = (
        under.drop("found")
        .join(lanes, "top")
        .join(inner, "id")
        .join(heads, "parent")
        .withColumnRenamed("parent", "group")
        .select(*keep)
    )
    return top_rows.unionByName(nested)


def post_hooks(members: DataFrame, cold: bool | None = None) -> DataFrame:
    """``(tool_id, hook)``: the hook that follows each tool, the last one if several do."""
    prefix = "PostToolUse:"
    is_hook = F.expr(f"type = 'hook' and name like '{prefix}_%'")
    ran = members.filter((F.col("type") == "tool") | is_hook).withColumn(
        "tool_name",
        F.when(F.col("type") == "tool", F.coalesce("name", F.lit(""))).otherwise(
            F.expr(f"substr(name, {len(prefix) + 1})")
        ),
    )
    paired = scan(
        ran,
        ["owner", "lane", "tool_name"],
        ["position"],
        [latest("tool_id", F.when(F.col("type") == "tool", F.col("id")))],
        cold,
    ).filter("type = 'hook' and tool_id is not null")
    return paired.groupBy("tool_id").agg(F.max_by(_end(), "position").alias("hook"))


def causal_edges(
    members: DataFrame, nodes: DataFrame, digests: DataFrame, fresh: DataFrame, cold: bool | None = None
) -> DataFrame:
    """What triggered each step: ``(from_id, to_id, gap_ms)``."""
    return owned_edges(members, nodes, digests, fresh, cold).drop("owner")


def owned_edges(
    members: DataFrame, nodes: DataFrame, digests: DataFrame, fresh: DataFrame, cold: bool | None = None
) -> DataFrame:
    """``causal_edges`` with the interaction that both ends lie in, as ``owner``.

    ``fresh`` has the positions of new messages and ``digests`` the tool blocks of all messages.
    """
    taking_part = scan(
        participants(members, nodes),
        ["owner", "lane", "group"],
        ["start_time_ns", "rank", "id"],
        [before("sibling", _end())],
        cold,
    )
    is_top = F.col("head").isNull()
    steps = settle(
        taking_part.withColumn(
            "prev",
            F.when(is_top, F.col("sibling"))
            .when(F.col("head.type") == "tool", F.col("head"))
            .otherwise(F.coalesce("sibling", "head")),
        ).drop("sibling", "head")
    )
    placed = members.filter("type = 'llm_request'").select(
        "owner", "lane", "position", *STEP
    )

    emitted = (
        placed.join(lane_order(members), ["owner", "lane"])
        .join(digests.select("id", F.explode("calls.use_id").alias("used")), "id")
        .groupBy("owner", F.col("used").alias("tool_use_id"))
        .agg(F.max_by(_end(), F.struct("lane_order", "position")).alias("emitter"))
    )
    tools = steps.filter("type = 'tool'")
    named = tools.filter("tool_use_id is not null")
    tool_of = named.groupBy("owner", "tool_use_id").agg(
        F.max_by(
            F.struct("lane", _end().alias("tool")),
            F.struct("lane_order", "position", "start_time_ns", "id"),
        ).alias("t")
    )
    consumed = (
        digests.select("id", F.explode("results").alias("r"))
        .select("id", F.col("r.at").alias("at"), F.col("r.use_id").alias("tool_use_id"))
        .join(fresh, ["id", "at"])
        .drop("at")
        .join(placed.drop("tool_use_id"), "id")
    )
    fan_in = (
        consumed.join(tool_of, ["owner", "tool_use_id"])
        .filter("lane = t.lane")
        .select("owner", "id", "start_time_ns", "t.tool", F.col("t.tool.id").alias("tool_id"))
        .join(post_hooks(members, cold), "tool_id", "left")
        .select("owner", "id", "start_time_ns", F.coalesce("hook", "tool").alias("cause"))
    )
    fed = fan_in.select("id").distinct()

    wrapped = F.expr(
        "prev is not null and prev.type = 'hook' and name is not null"
        " and prev.name = concat('PreToolUse:', name) and name <> ''"
    )
    cause = F.when(wrapped, F.col("prev")).otherwise(F.coalesce("emitter", "prev"))
    to = ["owner", "id", "start_time_ns", "group"]
    nobody = F.lit(None).cast(steps.schema["prev"].dataType)
    edges = (
        named.join(emitted, ["owner", "tool_use_id"], "left").select(*to, cause.alias("cause"))
        .unionByName(
            tools.filter("tool_use_id is null").withColumn("emitter", nobody)
            .select(*to, cause.alias("cause"))
        )
        .unionByName(
            steps.filter("type = 'llm_request'").join(fed, "id", "left_anti")
            .select(*to, F.col("prev").alias("cause"))
        )
        .unionByName(
            steps.filter("type not in ('tool', 'llm_request')")
            .select(*to, F.col("prev").alias("cause"))
        )
        .unionByName(fan_in.withColumn("group", F.col("owner")).select(*to, "cause"))
        .filter("cause is not null")
    )
    return edges.select(
        "owner",
        F.col("cause.id").alias("from_id"),
        F.col("id").alias("to_id"),
        gap_ms(
            F.col("group") == F.col("cause.id"),
            F.col("cause.start_time_ns"),
            F.col("cause.end_time_ns"),
            F.col("start_time_ns"),
        ).alias("gap_ms"),
    )


def gap_ms(nested: Column, from_start: Column, from_end: Column, to_start: Column) -> Column:
    """Signed gap in ms; within its container a step is measured from the container's start."""
    gap = (to_start - F.when(nested, from_start).otherwise(from_end)) / 1e6
    return F.nullif(gap, F.lit(0.0))


# ---- All of it -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Graph:
    """Canonical nodes with owners, and the layers derived from them."""

    nodes: DataFrame
    members: DataFrame
    deltas: DataFrame
    causal_edges: DataFrame
    cold: bool

    @property
    def threads(self) -> DataFrame:
        return threads(self.members)


def build_graph(canonical_nodes: DataFrame) -> Graph:
    """Lanes, deltas and edges over stored nodes."""
    nodes = settle(with_owner(settle(unique_nodes(canonical_nodes))))
    cold = not has_hot_group(nodes, ["interaction_id"])
    members = settle(lane_members(nodes, cold))
    digests = settle(digest(nodes))
    fresh = settle(delta_positions(members, digests, cold))
    delta_rows = settle(deltas(members, nodes, fresh))
    edges = causal_edges(members, nodes, digests, fresh, cold)
    return Graph(nodes, members, delta_rows, edges, cold)
