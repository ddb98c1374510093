"""Walks over parent pointers and edges: pointer doubling and graph contraction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spanloom.operators.scoped import apart, per_scope, reached_of
from spanloom.runtime import settle, settle_counting

MAX_HOPS = 4
#: Another contraction pays while it takes out this share of the edges.
WORTH_CONTRACTING = 1 / 8


def nearest_stop(
    links: DataFrame,
    node: str,
    parent: str,
    is_stop: Column,
    scope: Sequence[str] = (),
    out: str = "stop",
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Closest proper ancestor satisfying ``is_stop``, else the last node of the chain.

    Pointer doubling: each round an unfinished pointer jumps to its target's pointer, so a chain
    of depth d takes log2(d) joins. Returns ``(scope..., node, out, found, sums...)`` for nodes whose
    parent exists; ``found`` tells whether ``out`` satisfies ``is_stop``, and each of ``sums`` is added up
    over the chain from the node to just below ``out``. A parent missing from ``links`` ends the chain.
    Each round joins and stores unfinished rows alone. Nodes whose chain runs into a cycle without
    meeting a stop have no end and no row: after as many rounds as the number of nodes has binary
    digits, they are what is left.
    """
    scope, sums = list(scope), sums or {}
    base = links.select(
        *scope, F.col(node).alias("n"), F.col(parent).alias("p"), is_stop.alias("hit"),
        *[c.alias(name) for name, c in sums.items()],
    )
    targets = base.select(*scope, F.col("n").alias("p"), F.col("hit").alias("p_hit"))
    # Rows whose parent exists and is another node; the rest end their chain.
    step = base.filter("p is not null and p <> n").join(targets, [*scope, "p"])
    has_parent = step.select(*scope, F.col("n").alias("p"), F.lit(True).alias("p_goes_on"))
    first = step.join(has_parent, [*scope, "p"], "left").select(
        *scope,
        "n",
        F.col("p").alias("to"),
        F.col("p_hit").alias("found"),
        (F.col("p_hit") | F.col("p_goes_on").isNull()).alias("done"),
        *sums,
    )
    state, left = settle_counting(first, ~F.col("done"))
    finished, pending = [state.filter("done")], state.filter("not done")
    reached, nodes = 1, None
    while left:
        nodes = base.count() if nodes is None else nodes
        if reached > nodes:
            break
        reached *= 2
        jump = reduce(DataFrame.unionByName, finished, pending).select(
            *scope,
            F.col("n").alias("to"),
            F.col("to").alias("far"),
            F.col("found").alias("far_found"),
            F.col("done").alias("far_done"),
            *[F.col(name).alias(f"far_{name}") for name in sums],
        )
        moved = pending.join(jump, [*scope, "to"]).select(
            *scope,
            "n",
            F.col("far").alias("to"),
            F.col("far_found").alias("found"),
            F.col("far_done").alias("done"),
            *[(F.col(name) + F.col(f"far_{name}")).alias(name) for name in sums],
        )
        state, left = settle_counting(moved, ~F.col("done"))
        finished.append(state.filter("done"))
        pending = state.filter("not done")
    return reduce(DataFrame.unionByName, finished).select(
        *scope, F.col("n").alias(node), F.col("to").alias(out), "found", *sums
    )


# ---- Reach ---------------------------------------------------------------------------------------


def _links(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, int]:
    """Nodes with one way in and one way out that are no seeds, as ``(n, prev, next)``, and their number."""
    ways = edges.select(F.col("src").alias("n"), F.col("dst").alias("next"), F.lit(None).cast(edges.schema["src"].dataType).alias("prev"))
    ways = ways.unionByName(
        edges.select(F.col("dst").alias("n"), F.lit(None).cast(edges.schema["dst"].dataType).alias("next"), F.col("src").alias("prev"))
    )
    ends = ways.groupBy("n").agg(
        F.count("next").alias("outs"), F.count("prev").alias("ins"), F.max("next").alias("next"), F.max("prev").alias("prev")
    )
    inner = ends.filter("outs = 1 and ins = 1").select("n", "prev", "next")
    inner = inner.join(seeds.select(F.col("seed").alias("n")).distinct(), "n", "left_anti")
    return settle_counting(inner, F.lit(True))


def _contracted(edges: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of ``links`` as one edge each: the edges that remain, and ``(src, node)`` for the nodes taken out.

    ``src`` is where the run of a node starts; whoever gets there gets to the node. Runs without a start are
    circles that nothing leads into and go altogether.
    """
    heads = nearest_stop(links, "n", "prev", F.lit(False), out="head", sums={"hops": F.lit(1).cast("bigint")})
    first = links.join(links.select(F.col("n").alias("prev")), "prev", "left_anti").select("n", F.col("n").alias("head"), F.lit(0).cast("bigint").alias("hops"))
    placed = settle(heads.select("n", "head", "hops").unionByName(first).join(links, "n"))
    runs = settle(placed.groupBy("head").agg(F.min_by("prev", "hops").alias("src"), F.max_by("next", "hops").alias("dst")))
    taken = placed.join(runs.select("head", "src"), "head").select("src", F.col("n").alias("node"))
    own = links.select(F.col("n").alias("src"))
    whole = edges.join(own, "src", "left_anti").join(own.withColumnRenamed("src", "dst"), "dst", "left_anti")
    return settle(whole.select("src", "dst").unionByName(runs.select("src", "dst")).distinct()), taken


def reach(edges: DataFrame, seeds: DataFrame, scope: str | None = None, cold: bool | None = None) -> DataFrame:
    """All nodes reachable from each seed, as distinct ``(seed, node)``.

    ``edges`` is ``(src, dst)`` and ``seeds`` is ``(seed)``; the seed itself is returned only when
    a path leads back to it. Edges with a null end are ignored. ``scope`` is a column of both that an edge's ends
    and a seed share: scopes that fit one task are searched there (``cold=True``: all do).

    Runs of nodes with one way in and one way out become one edge by pointer doubling, again and again
    while that takes out many (the branches of a fork that meet again are one edge after the first time);
    the small graph is searched, and the nodes that were taken out are put back by where their run starts.
    So a run of any length costs rounds with its logarithm; the search takes rounds with the longest
    path of the small graph.
    """
    if scope is not None:
        kind = edges.schema["src"].dataType
        asked = seeds.filter("seed is not null").select(scope, F.col("seed").alias("src"), F.lit(None).cast(kind).alias("dst"))
        rows = edges.filter("src is not null and dst is not null").select(scope, "src", "dst").unionByName(asked)
        fitting, rest = apart(rows, scope, cold)
        lined = fitting.repartition(scope).sortWithinPartitions(scope)
        met = per_scope(lined, reached_of, StructType([StructField("seed", kind), StructField("node", kind)]))
        if rest is None:
            return met
        return met.unionByName(reach(rest.filter("dst is not null"), rest.filter("dst is null").select(F.col("src").alias("seed")))).distinct()
    found = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    edges, n_edges = settle_counting(found, F.col("src") != F.col("dst"))
    seeds = seeds.select("seed").distinct()
    # A way from a node back to itself tells something only of seeds.
    loops, small, inside = [edges.filter("src = dst")], edges.filter("src <> dst"), None
    while n_edges:
        links, n_links = _links(small, seeds)
        if n_links < WORTH_CONTRACTING * n_edges:
            break
        small, taken = _contracted(small, links)
        n_edges -= n_links
        if inside is not None:  # nodes of a run that starts at a node now taken out itself
            lifted = taken.select(F.col("src").alias("above"), F.col("node").alias("src"))
            inside = inside.join(lifted, "src", "left").select(F.coalesce("above", "src").alias("src"), "node").unionByName(taken)
        else:
            inside = taken
        inside = settle(inside)
        loops.append(small.filter("src = dst"))
        small = small.filter("src <> dst")
    met = _searched(small, seeds)
    if inside is not None:
        starts = met.unionByName(seeds.select("seed", F.col("seed").alias("node"))).distinct()
        within = starts.withColumnRenamed("node", "src").join(inside, "src").select("seed", "node")
        met = met.unionByName(within)
    back = reduce(DataFrame.unionByName, loops).select(F.col("src").alias("seed")).join(seeds, "seed", "left_semi")
    return met.unionByName(back.select("seed", F.col("seed").alias("node"))).distinct()


def _searched(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(seed, node)`` by breadth-first rounds that follow ever more edges each, up to MAX_HOPS; each round is stored."""

    def step(front: DataFrame) -> DataFrame:
        nexts = front.withColumnRenamed("node", "src").join(edges, "src")
        return nexts.select("seed", F.col("dst").alias("node")).distinct()

    front, left = settle_counting(step(seeds.select("seed", F.col("seed").alias("node"))), F.lit(True))
    parts, hops = [front], 1
    while left:
        hops = min(2 * hops, MAX_HOPS)
        layers = [step(front)]
        for _ in range(hops - 1):
            layers.append(step(layers[-1]))
        met = reduce(DataFrame.unionByName, layers).distinct()
        visited = reduce(DataFrame.unionByName, parts)
        front, left = settle_counting(met.join(visited, ["seed", "node"], "left_anti"), F.lit(True))
        parts.append(front)
    return reduce(DataFrame.unionByName, parts)
