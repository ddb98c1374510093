"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch

#: Nodes that one task holds at a time while it contracts its own links.
NODES_HELD = 500_000


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links from each node to the smallest one it reaches over this task's links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars() -> pd.DataFrame:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        if len(parent) > NODES_HELD:
            yield stars()
    yield stars()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with a link (a, b); the component is its smallest node.

    First every task replaces its links by a forest. Then, in turn, each node hands its larger and
    its smaller neighbours over to its smallest neighbour, until all links point at the smallest
    node of their component. The rounds grow with the logarithm of the number of nodes; each is
    written out, so lineage stays short. A node's neighbours never meet in one row: the smallest is
    an aggregate, joined back to the links.
    """
    now = scratch.keep(links.filter("a != b").select("a", "b").mapInPandas(_forests, "a bigint, b bigint").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = scratch.keep(large.filter("a != b").distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("link")).select("link.*")
        after = scratch.keep(small.filter("a != b").distinct(), "small")
        scratch.drop(large)
        # Done once no node has two links upwards and no target has one of its own.
        moving = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        forked = after.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        done = moving.isEmpty() and forked.isEmpty()
        scratch.drop(now)
        now = after
        if done:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
