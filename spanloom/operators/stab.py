"""Interval joins without pairing every point with every interval of its group.

Points are numbered in time order per group. An interval then covers a run of point numbers,
which is the union of at most 2*log2(length) aligned blocks (block ``n`` of level ``l`` holds the
numbers ``n*2^l`` to ``(n+1)*2^l - 1``). Only the best interval of each block is kept, so the
joined side has one row per block, and a point looks up one block per level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ordered import running_min, running_sum, scan, upcoming


def _blocks() -> Column:
    """Aligned blocks that tile the point numbers [__lo, __hi)."""
    return F.expr(
        """
        filter(flatten(transform(
            sequence(0, cast(ceil(log2(__hi - __lo)) as int) + 1),
            l -> transform(
                array(named_struct(
                    'a', shiftright(__lo + shiftleft(1L, l) - 1, l),
                    'b', shiftright(__hi, l))),
                x -> array(
                    if(x.a < x.b and x.a % 2 = 1, named_struct('level', l, 'node', x.a), null),
                    if(x.a < x.b and x.b % 2 = 1, named_struct('level', l, 'node', x.b - 1), null)
                ))[0])), x -> x is not null)
        """
    )


def best_covering(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    point_id: str,
    at: str,
    start: str,
    end: str,
    prefer: Sequence[Column],
    take: Column,
    out: str,
    cold: bool | None = None,
) -> DataFrame:
    """``(by..., point_id, out)`` for each point inside some interval of its group.

    Of the intervals with ``start <= at <= end`` the one with the smallest ``prefer`` wins and
    ``take`` is returned from it. ``prefer`` must be a total order. Points are unique by
    ``point_id``.
    """
    by = list(by)
    marks = (
        intervals.filter(F.col(start) <= F.col(end))
        .withColumn("__best", F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)],
                                       take.alias("take")))
        .select(*by, "__best", F.inline(F.array(
            F.struct(F.col(start).alias("__at"), F.lit(0).alias("__kind")),
            F.struct(F.col(end).alias("__at"), F.lit(2).alias("__kind")),
        )))
        .withColumn("__id", F.lit(None).cast(points.schema[point_id].dataType))
    )
    spots = points.select(
        *by,
        F.lit(None).cast(marks.schema["__best"].dataType).alias("__best"),
        F.col(at).alias("__at"),
        F.lit(1).alias("__kind"),
        F.col(point_id).alias("__id"),
    )
    lined = marks.unionByName(spots).withColumn(
        "__tie", F.coalesce(F.col("__id").cast("string"), F.col("__best").cast("string"))
    )
    numbered = scan(
        lined,
        by,
        ["__at", "__kind", "__tie"],
        [running_sum("__seen", F.when(F.col("__kind") == 1, F.lit(1).cast("long")))],
        cold,
    )
    spans = (
        numbered.filter("__kind <> 1")
        .groupBy(*by, "__best")
        .agg(F.min("__seen").alias("__lo"), F.max("__seen").alias("__hi"))
        .filter("__lo < __hi")
    )
    blocks = (
        spans.select(*by, "__best", F.inline(_blocks()))
        .groupBy(*by, "level", "node")
        .agg(F.min("__best").alias("__best"))
    )
    depth = blocks.groupBy(*by).agg(F.max("level").alias("__top"))
    lookups = (
        numbered.filter("__kind = 1")
        .select(*by, F.col("__id").alias(point_id), (F.col("__seen") - 1).alias("__n"))
        .join(depth, by)
        .select(*by, point_id, "__n", F.explode(F.expr("sequence(0, __top)")).alias("level"))
        .withColumn("node", F.expr("shiftright(__n, level)"))
    )
    return (
        lookups.join(blocks, [*by, "level", "node"])
        .groupBy(*by, point_id)
        .agg(F.min("__best").alias("__best"))
        .select(*by, point_id, F.col("__best.take").alias(out))
    )


def nearest_interval(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    point_id: str,
    at: str,
    start: str,
    end: str,
    interval_id: str,
    take: Column,
    out: str,
    cold: bool | None = None,
) -> DataFrame:
    """The interval each point belongs to, in three tiers, as ``(by..., point_id, out)``.

    1. a covering interval with the latest start; 2. the interval with the latest end before the
    point; 3. the earliest interval of the group. Ties go to the earliest start, then the smallest
    id. One scan settles every point except those whose latest-started interval has ended while an
    earlier one still runs; only these take the block join. Groups without an interval yield
    nothing.
    """
    by = list(by)
    opened = intervals.select(
        *by,
        F.col(start).alias("__at"),
        F.lit(0).alias("__kind"),
        F.col(interval_id).alias("__id"),
        F.struct(
            F.col(start).alias("s"), F.col(end).alias("e"), F.col(interval_id).alias("id"),
            take.alias("take"),
        ).alias("__span"),
    )
    asked = points.select(
        *by,
        F.col(at).alias("__at"),
        F.lit(1).alias("__kind"),
        F.col(point_id).alias("__id"),
        F.lit(None).cast(opened.schema["__span"].dataType).alias("__span"),
    )
    span = F.col("__span")
    started = F.struct((-span["s"]).alias("k"), span["id"].alias("id"), span.alias("span"))
    ended = F.struct(
        (-span["e"]).alias("k"), span["s"].alias("s"), span["id"].alias("id"), span.alias("span")
    )
    given = span.isNotNull()
    ranked = scan(
        opened.unionByName(asked),
        by,
        ["__at", "__kind", "__id"],
        [
            running_min("__started", F.when(given, started)),
            running_min("__ended", F.when(given, ended)),
            upcoming("__next", span),
        ],
        cold,
    ).filter("__kind = 1")

    running = F.col("__started.span.e") >= F.col("__at")
    over = F.col("__ended.span.e") < F.col("__at")
    tagged = ranked.select(
        *by,
        F.col("__id").alias(point_id),
        F.col("__at").alias(at),
        F.when(F.col("__started").isNull(), F.col("__next.take"))
        .when(running, F.col("__started.span.take"))
        .when(over, F.col("__ended.span.take"))
        .alias(out),
        (F.col("__started").isNotNull() & ~running & ~over).alias("__open"),
    )
    settled = tagged.filter(F.col(out).isNotNull() & ~F.col("__open")).select(*by, point_id, out)
    undecided = tagged.filter("__open").select(*by, point_id, at)
    covered = best_covering(
        undecided,
        intervals.join(undecided.select(*by).distinct(), by, "left_semi"),
        by,
        point_id,
        at,
        start,
        end,
        [-F.col(start), F.col(interval_id)],
        take,
        out,
        cold,
    )
    return settled.unionByName(covered)


def latest_ended(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    point_id: str,
    at: str,
    end: str,
    tie: Sequence[Column],
    take: Column,
    out: str,
    cold: bool | None = None,
) -> DataFrame:
    """Backward as-of join: of the intervals with ``end <= at`` the latest end, ties by ``tie``."""
    by = list(by)
    ends = intervals.select(
        *by,
        F.col(end).alias("__at"),
        F.lit(0).alias("__kind"),
        F.lit(None).cast(points.schema[point_id].dataType).alias("__id"),
        F.struct((-F.col(end)).alias("k"), *[t.alias(f"t{i}") for i, t in enumerate(tie)],
                 take.alias("take")).alias("__end"),
    )
    asked = points.select(
        *by,
        F.col(at).alias("__at"),
        F.lit(1).alias("__kind"),
        F.col(point_id).alias("__id"),
        F.lit(None).cast(ends.schema["__end"].dataType).alias("__end"),
    )
    lined = ends.unionByName(asked).withColumn(
        "__tie", F.coalesce(F.col("__id").cast("string"), F.col("__end").cast("string"))
    )
    return (
        scan(
            lined, by, ["__at", "__kind", "__tie"], [running_min("__best", F.col("__end"))], cold
        )
        .filter("__kind = 1 and __best is not null")
        .select(*by, F.col("__id").alias(point_id), F.col("__best.take").alias(out))
    )
