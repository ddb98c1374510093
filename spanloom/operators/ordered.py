"""Ordered scans over groups of any size.

A window over ``partitionBy(group)`` puts a whole group into one task. Here a group larger than
``spanloom.hotGroupRows`` is cut into chunks along its own order: the window runs inside each
chunk, one small row per chunk carries the running state over, and a broadcast join brings that
state back. Groups below the limit take the plain window.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.runtime import settle

HOT_ROWS_CONF = "spanloom.hotGroupRows"
HOT_ROWS = 1_000_000
MAX_CHUNKS = 20_000  # bounds the carried state and the split points held by the driver
SAMPLES_PER_CHUNK = 16
EDGE_BLOCK = 128


@dataclass(frozen=True)
class Out:
    """One output column of a scan."""

    kind: str
    name: str
    col: Column | None = None


def position(name: str) -> Out:
    """0-based position in the group."""
    return Out("position", name)


def before(name: str, col: Column) -> Out:
    """Value of the row just before."""
    return Out("before", name, col)


def after(name: str, col: Column) -> Out:
    """Value of the row just after."""
    return Out("after", name, col)


def latest(name: str, col: Column) -> Out:
    """Last non-null value up to and including the row."""
    return Out("latest", name, col)


def upcoming(name: str, col: Column) -> Out:
    """First non-null value strictly after the row."""
    return Out("upcoming", name, col)


def running_sum(name: str, col: Column) -> Out:
    """Sum up to and including the row; null counts as 0."""
    return Out("running_sum", name, col)


def running_min(name: str, col: Column) -> Out:
    """Smallest non-null value up to and including the row."""
    return Out("running_min", name, col)


def hot_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def has_hot_group(df: DataFrame, by: Sequence[str]) -> bool:
    """True when some group exceeds the limit. One map-side-combined count."""
    top = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return (top or 0) > hot_limit(df.sparkSession)


def split_points(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """Split points of the hot groups as ``(by..., __edges)``, or None when no group is hot.

    Which points are picked only balances the chunks; any choice gives the same results. At most
    MAX_CHUNKS points exist, because the limit grows with the row count.
    """
    counts = df.groupBy(*by).count()
    total, top = counts.agg(F.sum("count"), F.max("count")).first()
    limit = max(hot_limit(df.sparkSession), (total or 0) // MAX_CHUNKS)
    if (top or 0) <= limit:
        return None
    hot = counts.filter(F.col("count") > limit).drop("count")
    point = F.struct(*order)
    every = max(1, limit // SAMPLES_PER_CHUNK)
    per_chunk = min(SAMPLES_PER_CHUNK, limit)
    sampled = (
        df.join(F.broadcast(hot), list(by), "left_semi")
        .filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
        .select(*by, point.alias("p"))
    )
    ranked = sampled.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("p")))
    picked = ranked.filter(F.col("r") % per_chunk == 0).drop("r").collect()
    if not picked:
        return None

    by_group = defaultdict(list)
    for row in picked:
        by_group[tuple(row[b] for b in by)].append(row["p"])
    key_fields = [df.schema[b] for b in by]
    edge = T.ArrayType(T.ArrayType(sampled.schema["p"].dataType))
    schema = T.StructType([*key_fields, T.StructField("__edges", edge)])
    rows = []
    for key, points in by_group.items():
        points = sorted(points)
        blocks = [points[i : i + EDGE_BLOCK] for i in range(0, len(points), EDGE_BLOCK)]
        rows.append((*key, blocks))
    return df.sparkSession.createDataFrame(rows, schema)


def _chunk_of(order: Sequence[str]) -> Column:
    here = F.struct(*order)
    edges = F.col("__edges")
    block = F.size(F.filter(edges, lambda b: b[0] <= here))
    inner = F.size(F.filter(F.get(edges, block - 1), lambda e: e <= here))
    return F.when(edges.isNull() | (block == 0), F.lit(0)).otherwise(
        (block - 1) * EDGE_BLOCK + inner
    )


def with_chunks(df: DataFrame, by: Sequence[str], order: Sequence[str], edges: DataFrame):
    marked = df.join(F.broadcast(edges), list(by), "left")
    return (
        marked.withColumn("__chunk", _chunk_of(order))
        .withColumn("__hot", F.col("__edges").isNotNull())
        .drop("__edges")
    )


def _local(outs: Sequence[Out], parts: Sequence[str], order: Sequence[str]) -> dict[str, Column]:
    """Window expressions inside one partition of the scan."""
    asc = Window.partitionBy(*parts).orderBy(*order)
    desc = Window.partitionBy(*parts).orderBy(*[F.col(o).desc() for o in order])
    upto = asc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = desc.rowsBetween(Window.unboundedPreceding, -1)
    made = {}
    for i, out in enumerate(outs):
        value = F.col(f"__v{i}")
        made[out.name] = {
            "position": lambda: F.row_number().over(asc).cast("long") - 1,
            "before": lambda: F.lag(value).over(asc),
            "after": lambda: F.lead(value).over(asc),
            "latest": lambda: F.last(value, ignorenulls=True).over(upto),
            "upcoming": lambda: F.last(value, ignorenulls=True).over(beyond),
            "running_sum": lambda: F.sum(F.coalesce(value, F.lit(0))).over(upto),
            "running_min": lambda: F.min(value).over(upto),
        }[out.kind]()
    return made


def _carry(hot_rows: DataFrame, outs: Sequence[Out], by: Sequence[str], order: Sequence[str]):
    """One row per chunk of a hot group with the state that enters it."""
    point = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, out in enumerate(outs):
        value = F.col(f"__v{i}")
        filled = F.when(value.isNotNull(), point)
        summary = {
            "position": lambda: F.count(F.lit(1)),
            "before": lambda: F.max_by(F.struct(value.alias("v")), point),
            "after": lambda: F.min_by(F.struct(value.alias("v")), point),
            "latest": lambda: F.max_by(value, filled),
            "upcoming": lambda: F.min_by(value, filled),
            "running_sum": lambda: F.sum(F.coalesce(value, F.lit(0))),
            "running_min": lambda: F.min(value),
        }[out.kind]()
        aggs.append(summary.alias(f"__s{i}"))
    chunks = hot_rows.groupBy(*by, "__chunk").agg(*aggs)

    asc = Window.partitionBy(*by).orderBy("__chunk")
    desc = Window.partitionBy(*by).orderBy(F.col("__chunk").desc())
    earlier = asc.rowsBetween(Window.unboundedPreceding, -1)
    later = desc.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for i, out in enumerate(outs):
        summary = F.col(f"__s{i}")
        entering = {
            "position": lambda: F.sum(summary).over(earlier),
            "before": lambda: F.lag(summary).over(asc),
            "after": lambda: F.lead(summary).over(asc),
            "latest": lambda: F.last(summary, ignorenulls=True).over(earlier),
            "upcoming": lambda: F.last(summary, ignorenulls=True).over(later),
            "running_sum": lambda: F.sum(summary).over(earlier),
            "running_min": lambda: F.min(summary).over(earlier),
        }[out.kind]()
        carried.append(entering.alias(f"__c{i}"))
    return chunks.select(*by, "__chunk", "__rows", *carried)


def _merge(out: Out, i: int) -> Column:
    local, carried = F.col(out.name), F.col(f"__c{i}")
    if out.kind == "position":
        return local + F.coalesce(carried, F.lit(0))
    if out.kind == "before":
        return F.when(F.col("__here") == 0, carried["v"]).otherwise(local)
    if out.kind == "after":
        return F.when(F.col("__here") == F.col("__rows") - 1, carried["v"]).otherwise(local)
    if out.kind in ("latest", "upcoming"):
        return F.coalesce(local, carried)
    if out.kind == "running_sum":
        return local + F.coalesce(carried, F.lit(0))
    return F.least(local, carried)


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    outs: Sequence[Out],
    cold: bool | None = None,
) -> DataFrame:
    """Add ordered-scan columns per group.

    ``order`` must be a total order of non-null columns. ``cold=True`` states that no group
    exceeds the limit, as when a coarser key was already checked; ``cold=False`` settles ``df``
    first so the check and the scan read the same stored rows.
    """
    if cold is False:
        df = settle(df)
    keep = df.columns
    valued = df.withColumns({f"__v{i}": o.col for i, o in enumerate(outs) if o.col is not None})
    edges = None if cold else split_points(df, by, order)
    names = [o.name for o in outs]
    if edges is None:
        return valued.withColumns(_local(outs, by, order)).select(*keep, *names)

    chunked = with_chunks(valued, by, order, edges)
    parts = [*by, "__chunk"]
    carry = _carry(chunked.filter("__hot"), outs, by, order)
    here = {"__here": F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1}
    scanned = chunked.withColumns({**_local(outs, parts, order), **here})
    joined = scanned.join(F.broadcast(carry), parts, "left")
    return joined.withColumns({o.name: _merge(o, i) for i, o in enumerate(outs)}).select(
        *keep, *names
    )
