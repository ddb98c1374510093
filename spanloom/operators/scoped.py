"""Graph steps on scopes that never touch each other, each scope worked off where its rows lie.

Nodes of one interaction have parents and edges within it alone. One shuffle brings a scope's rows together,
sorted, and a task walks scope after scope; no rounds are needed. Scopes above ``spanloom.hotGroupRows``, and rows
without a scope, are left to the distributed walks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanloom.operators.ordered import hot_limit


def apart(df: DataFrame, scope: str, cold: bool | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of scopes that fit one task, and the others, or None if there are none.

    ``cold=True`` states that every row has a scope and none exceeds the limit.
    """
    if cold:
        return df, None
    counts = df.groupBy(scope).count()
    large = counts.filter((F.col("count") > hot_limit(df.sparkSession)) & F.col(scope).isNotNull())
    largest, missing = counts.agg(F.max(F.when(F.col(scope).isNotNull(), F.col("count"))), F.max(F.when(F.col(scope).isNull(), F.col("count")))).first()
    hot = (largest or 0) > hot_limit(df.sparkSession)
    if not hot and not missing:
        return df, None
    large = large.select(scope)
    there = df.filter(F.col(scope).isNotNull())
    fitting = there.join(large, scope, "left_anti") if hot else there
    rest = df.filter(F.col(scope).isNull())
    return fitting, rest.unionByName(there.join(large, scope, "left_semi")) if hot else rest


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each run of equal first values, without that first column."""
    current, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys, begin = columns[0], 0
        for at in range(1, len(keys) + 1):
            if at < len(keys) and keys[at] == keys[begin]:
                continue
            piece = [c[begin:at] for c in columns[1:]]
            if held is not None and keys[begin] == current:
                for have, more in zip(held, piece, strict=True):
                    have += more
            else:
                if held is not None:
                    yield held
                current, held = keys[begin], piece
            begin = at
    if held is not None:
        yield held


def per_scope(lined: DataFrame, work: Callable[[list[list]], list[list]], schema: StructType) -> DataFrame:
    """``work`` on the columns of every scope in turn; it returns columns of ``schema``, given out in batches.

    ``lined`` is dealt out and sorted by its first column, the scope.
    """
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = [[] for _ in types]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(m, f.type) for m, f in zip(made, types, strict=True)], schema=types)

        for columns in groups(batches):
            for have, more in zip(made, work(columns), strict=True):
                have += more
            if len(made[0]) >= 10_000:
                yield out()
                made = [[] for _ in types]
        if made[0]:
            yield out()

    return lined.mapInArrow(run, schema)


def intervals_of(columns: list[list]) -> list[list]:
    """node, root, depth, enter, leave of one scope's nodes, from nodes in sibling order and their parents."""
    nodes, parents = columns
    at = {n: i for i, n in enumerate(nodes)}
    kids: list[list[int]] = [[] for _ in nodes]
    roots = []
    for i, parent in enumerate(parents):
        above = at.get(parent, i) if parent is not None else i
        (roots if above == i else kids[above]).append(i)
    out: list[list] = [[], [], [], [], []]
    for root in roots:
        seen, stack = [], [(root, 0, -1)]
        while stack:
            i, depth, above = stack.pop()  # ``above`` is the parent's number
            seen.append((i, depth, above))
            stack += [(k, depth + 1, len(seen) - 1) for k in reversed(kids[i])]
        leave = list(range(len(seen)))
        for number in range(len(seen) - 1, 0, -1):
            above = seen[number][2]
            leave[above] = max(leave[above], leave[number])
        out[0] += [nodes[i] for i, _, _ in seen]
        out[1] += [nodes[root]] * len(seen)
        out[2] += [depth for _, depth, _ in seen]
        out[3] += range(len(seen))
        out[4] += leave
    return out


def reached_of(columns: list[list]) -> list[list]:
    """seed, node of one scope, from edges (a, b) and seeds (a, null)."""
    after: dict = {}
    seeds = []
    for a, b in zip(*columns, strict=True):
        if b is None:
            seeds.append(a)
        else:
            after.setdefault(a, []).append(b)
    out: list[list] = [[], []]
    for seed in dict.fromkeys(seeds):
        met, front = set(), [seed]
        while front:
            for node in after.get(front.pop(), ()):
                if node not in met:
                    met.add(node)
                    front.append(node)
        out[0] += [seed] * len(met)
        out[1] += met
    return out
