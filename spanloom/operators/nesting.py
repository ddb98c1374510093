"""Nested intervals of a forest: who contains whom as a range of numbers.

Nodes are numbered within their tree in depth-first order. A node's interval runs from its own number
(``enter``) to that of the last node below it (``leave``), so containment is a range predicate, depth-first
order is ``enter``, and no walk is needed once the numbers exist.

Subtree sizes and the sums of offsets along each path come from pointer doubling, so rounds grow with the
logarithm of the depth; siblings are summed up by an ordered scan, so a parent may have any number of
children.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanloom.operators.climb import nearest_stop
from spanloom.operators.ordered import running_sum, scan, upcoming
from spanloom.operators.scoped import apart, intervals_of, per_scope
from spanloom.runtime import settle, settle_counting

#: Numbers that one row lists at a time where intervals are listed node by node.
LISTED = 65_536


def subtree_sizes(kids: DataFrame) -> DataFrame:
    """``(n, size)`` of the nodes that have children, from ``(n, a)`` with a node and its parent.

    After round k a size holds the descendants less than 2 ** k below; pointers reach twice as far each round
    and vanish beyond the root. Sizes on circles, which no round ends, are of no use.
    """
    pointers, left = settle_counting(kids.select("n", "a"), F.lit(True))
    total, reached = left, 1
    sizes = None
    while left and reached <= 2 * total:
        reached *= 2
        own = F.lit(1).cast("bigint")
        weighed = pointers.withColumn("w", own) if sizes is None else pointers.join(sizes, "n", "left").withColumn("w", F.coalesce("size", own))
        gains = weighed.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("w"))
        if sizes is not None:
            gains = sizes.withColumnRenamed("size", "w").unionByName(gains.select("n", "w")).groupBy("n").agg(F.sum("w").alias("w"))
            sizes = settle(gains.select("n", F.col("w").alias("size")))
        else:
            sizes = settle(gains.select("n", (F.col("w") + 1).alias("size")))
        # Pointers of nodes right below a root have nowhere to go on to.
        far = pointers.select(F.col("n").alias("a"), F.col("a").alias("far"))
        pointers, left = settle_counting(pointers.join(far, "a").select("n", F.col("far").alias("a")), F.lit(True))
    return sizes if sizes is not None else kids.select("n", F.lit(1).cast("bigint").alias("size"))


def nested_intervals(
    links: DataFrame, node: str, parent: str, order: Sequence[str], cold: bool | None = None, scope: str | None = None
) -> DataFrame:
    """``(node, root, depth, enter, leave)``, numbered from 0 in each tree; a root has depth 0.

    Siblings come in the order of the columns ``order``, then of ``node``. A parent that is null, missing from ``links`` or
    the node itself makes a root. Nodes on a circle, or below one, have no root and no row. ``scope`` is a column that
    a node always shares with its parent: scopes that fit one task are then numbered there.
    """
    order = list(order)
    if scope is not None:
        fitting, rest = apart(links, scope, cold)
        kind = links.schema[node].dataType
        schema = StructType([StructField(node, kind), StructField("root", kind), *[StructField(c, LongType()) for c in ("depth", "enter", "leave")]])
        slim = fitting.select(F.col(scope).alias("scope"), F.col(node).alias("n"), F.col(parent).alias("p"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        sibling = [*[f"o{i}" for i in range(len(order))], "n"]
        numbered = _numbered(slim, sibling, schema)
        return numbered if rest is None else numbered.unionByName(nested_intervals(rest, node, parent, order, False))
    rows = links.select(F.col(node).alias("n"), F.nullif(F.col(parent), F.col(node)).alias("a"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = settle(rows)
    kids = settle(rows.filter("a is not null").join(rows.select(F.col("n").alias("a")), "a", "left_semi"))
    sizes = subtree_sizes(kids)
    sized = kids.join(sizes, "n", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("bigint")))
    lined = scan(sized, ["a"], [*[f"o{i}" for i in range(len(order))], "n"], [running_sum("upto", F.col("size"))], cold)
    placed = settle(lined.select("n", "a", "size", (F.col("upto") - F.col("size") + 1).alias("offset")))
    roots = rows.join(kids.select("n"), "n", "left_anti").join(sizes, "n", "left").select(
        "n", F.col("n").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("enter"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("size"),
    )
    # Roots have offset 0 and end every chain.
    ends = roots.select("n", F.lit(None).cast(kids.schema["a"].dataType).alias("a"), "size", F.lit(0).cast("bigint").alias("offset"))
    climbed = nearest_stop(
        placed.unionByName(ends), "n", "a", F.lit(False), out="root",
        sums={"enter": F.col("offset"), "depth": F.lit(1).cast("bigint"), "size": F.lit(0).cast("bigint")},
    )
    inner = climbed.drop("size").join(placed.select("n", "size"), "n").select("n", "root", "depth", "enter", "size")
    return roots.unionByName(inner).select(
        F.col("n").alias(node), "root", "depth", "enter", (F.col("enter") + F.col("size") - 1).alias("leave")
    )


def _numbered(rows: DataFrame, sibling: list[str], schema: StructType) -> DataFrame:
    """The intervals of scopes that fit one task."""
    lined = rows.repartition("scope").sortWithinPartitions("scope", *sibling).select("scope", "n", "p")
    return per_scope(lined, intervals_of, schema)


def inside(labels: DataFrame, node: str, outer: DataFrame | None = None) -> DataFrame:
    """Every pair of a node and a node it contains: ``(above, node, levels)``; one level is a child.

    ``labels`` are nested intervals; ``outer`` limits the containing nodes to its column ``node``. An interval is listed
    number by number, long ones in stretches of bounded length that are dealt out first, and the numbers
    meet their nodes in one join; nothing else is compared.
    """
    owners = labels.filter("leave > enter")
    if outer is not None:
        owners = owners.join(outer.select(node).distinct(), node, "left_semi")
    stretches = owners.select(
        F.col(node).alias("above"), "root", F.col("depth").alias("from_depth"), "leave",
        F.explode(F.sequence(F.col("enter") + 1, F.col("leave"), F.lit(LISTED).cast("bigint"))).alias("begin"),
    )
    stretches = stretches.repartition("above", "begin")
    numbers = stretches.select(
        "above", "root", "from_depth", F.explode(F.sequence("begin", F.least(F.col("begin") + (LISTED - 1), "leave"))).alias("enter")
    )
    return numbers.join(labels.select("root", "enter", node, "depth"), ["root", "enter"]).select(
        "above", node, (F.col("depth") - F.col("from_depth")).alias("levels")
    )


def first_inside(labels: DataFrame, node: str, owners: DataFrame, wanted: DataFrame, cold: bool | None = None) -> DataFrame:
    """``(above, node)``: of each owner the first wanted node it contains, in depth-first order.

    ``owners`` and ``wanted`` are frames with the column ``node``. Both are lined up by number within their trees and
    the next wanted node after an owner is looked up in one ordered scan; no pairs are made.
    """
    marks = reduce(DataFrame.unionByName, [
        owners.select(node).distinct().withColumns({"owns": F.lit(True), "wanted": F.lit(False)}),
        wanted.select(node).distinct().withColumns({"owns": F.lit(False), "wanted": F.lit(True)}),
    ]).groupBy(node).agg(F.max("owns").alias("owns"), F.max("wanted").alias("wanted"))
    lined = labels.join(marks, node)
    next_one = F.when(F.col("wanted"), F.struct(F.col(node).alias("node"), "enter"))
    found = scan(lined, ["root"], ["enter"], [upcoming("next", next_one)], cold)
    return found.filter("owns and next.enter <= leave").select(F.col(node).alias("above"), F.col("next.node").alias(node))
