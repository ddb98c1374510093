"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on many fixed random directions. On one direction two vectors of cosine
``least`` or more lie close together, whatever else they are; the spread of that distance is known, so
windows can be laid out for a wanted recall.

* Bringing together: per table, the projections on a few directions are each cut into windows of equal width
  at random offsets. Vectors in the same windows of a table meet there; vectors alone in theirs drop out.
  A larger input needs more cuts per table to keep groups small, and gets as many more tables as keep the
  wanted recall (``layout``).
* Counting: of the vectors that meet, each pair's collisions in query-centred windows are counted on
  ``counted`` further directions. Pairs below a count that 99.99 % of true pairs reach are left.
* Verifying: the cosine of the rest is taken in double precision.

Equal vectors are one class with a weight. A group that is too large for one task is dealt to pairs of
blocks. A task gives back per-vector link counts and a forest of its links, never its pairs; a pair
that meets in several tables is counted in the first one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from spanloom.llm.common import Scratch, block_pairs, sorted_groups
from spanloom.llm.components import components

#: Rows of a group that meet in one task.
BLOCK = 256
#: Width of a cut and of a centred window, in standard deviations of a true pair's distance.
CUT_WIDTH, WINDOW = 7.6, 1.96


@functools.lru_cache(64)
def directions(dim: int, tables: int, cuts: int, counted: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit directions for cutting and for counting, and the offsets of the cuts."""
    rng = np.random.default_rng([seed, dim])
    both = rng.standard_normal((dim, tables * cuts + counted))
    both /= np.linalg.norm(both, axis=0)
    return both[:, : tables * cuts], both[:, tables * cuts :], rng.random(tables * cuts)


def pair_spread(least: float, dim: int) -> float:
    """Standard deviation, on one direction, of the distance of two unit vectors of cosine ``least``."""
    return math.sqrt((2 - 2 * least) / dim)


def agreement(dim: int) -> float:
    """Probability that a pair of the wanted cosine lies in the same window of one direction."""
    # Mean size of one component of a random unit vector, in standard deviations of it.
    mean = math.exp(math.lgamma(dim / 2) - math.lgamma((dim + 1) / 2)) * math.sqrt(dim / math.pi)
    return 1 - mean / CUT_WIDTH


def layout(vectors: int, dim: int, recall: float, least_tables: int) -> tuple[int, int]:
    """(tables, cuts per table) so that a pair of the wanted cosine meets in some table with ``recall``."""
    # More windows per table the more vectors there are, so that groups stay small.
    cuts = max(6, round(math.log2(max(1, vectors) / 50)))
    return max(least_tables, math.ceil(math.log(1 - recall) / math.log1p(-(agreement(dim) ** cuts)))), cuts


def least_count(counted: int, recall: float = 0.9999) -> int:
    """The most collisions that all but 1 - ``recall`` of true pairs reach on ``counted`` directions."""
    hit, below = math.erf(WINDOW / math.sqrt(2)), 0.0
    for count in range(counted + 1):
        below += math.comb(counted, count) * hit**count * (1 - hit) ** (counted - count)
        if below > 1 - recall:
            return count
    return counted


def _units(vectors: pd.Series) -> np.ndarray:
    raw = np.stack(vectors.to_list()).astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _window_keys(least: float, tables: int, cuts: int, counted: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.random.default_rng(seed).integers(1, 2**63, size=cuts, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for dim, part in batch.groupby(batch["vector"].map(len)):
                cut, _, offsets = directions(dim, tables, cuts, counted, seed)
                cells = np.floor(_units(part["vector"]) @ cut / (CUT_WIDTH * pair_spread(least, dim)) + offsets)
                cells = cells.astype(np.int64).astype(np.uint64).reshape(len(part), tables, cuts)
                keys = (cells * weights).sum(axis=2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)
                yield part.assign(keys=list((keys >> np.uint64(32)).astype(np.uint32).view(np.int32)))

    return run


def _group_links(least: float, tables: int, cuts: int, counted: int, seed: int):
    enough = least_count(counted)

    def of_dim(group: pd.DataFrame, table: int, crossing: bool):
        units = _units(group["vector"])
        dim = units.shape[1]
        along = (units @ directions(dim, tables, cuts, counted, seed)[1]).astype(np.float32)
        width = np.float32(WINDOW * pair_spread(least, dim))
        sides = group["side"].to_numpy()
        left = np.flatnonzero(sides == 0) if crossing else np.arange(len(group))
        right = np.flatnonzero(sides == 1) if crossing else left
        hits = np.zeros((len(left), len(right)), dtype=np.uint8)
        for k in range(counted):
            hits += np.abs(along[left, k][:, None] - along[right, k][None, :]) <= width
        a, b = np.nonzero(hits >= enough)
        a, b = left[a], right[b]
        if not crossing:
            a, b = a[a < b], b[a < b]
        close = np.einsum("ij,ij->i", units[a], units[b]) >= least
        a, b = a[close], b[close]
        if table and len(a):
            keys = np.stack(group["keys"].to_list())[:, :table]
            first = ~(keys[a] == keys[b]).any(axis=1)
            a, b = a[first], b[first]
        if not len(a):
            return None
        weight, rep = group["weight"].to_numpy(), group["rep"].to_numpy()
        links = np.bincount(a, weight[b], len(group)) + np.bincount(b, weight[a], len(group))
        label, forest = np.arange(len(group)), []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if label[i] != label[j]:
                forest.append((rep[i], rep[j], 0))
                label[label == label[j]] = label[i]
        some = np.flatnonzero(links)
        counts = pd.DataFrame({"a": rep[some], "b": rep[some], "n": links[some].astype(np.int64)})
        return pd.concat([counts, pd.DataFrame(forest, columns=["a", "b", "n"])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in sorted_groups(batches, ["table", "key", "bi", "bj"]):
            if len(group) < 2:
                continue
            table, crossing = int(group["table"].iloc[0]), bool(group["bi"].iloc[0] != group["bj"].iloc[0])
            dims = group["vector"].map(len)
            parts = [group] if dims.nunique() == 1 else [g for _, g in group.groupby(dims)]
            out += [found for g in parts if (found := of_dim(g, table, crossing)) is not None]
            if len(out) > 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95,
    tables: int = 16, counted: int = 32, seed: int = 11, recall: float = 0.998,
) -> DataFrame:
    """Per row: id, n_links, component_id (smallest id reachable, itself included), kept.

    Two vectors of cosine ``least`` meet with probability ``recall`` at least, whatever the number of vectors,
    and closer ones more often; ``tables`` is the fewest tables taken for that.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, and
    neither do vectors of different dimensions. Rows that are equal in id and vector count once as a link
    but each have a row. A row without an id has no links, a null component, and is kept.
    """
    scratch = Scratch(vectors.sparkSession)
    vector = F.col(vector_col)
    usable = (
        F.col(id_col).isNotNull() & vector.isNotNull() & F.exists(vector, lambda x: x != 0)
        & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    )
    hashes = (F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2"))
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(usable, F.lit(False)).alias("usable"), *hashes,
        vector.alias("vector"),
    )
    classes = rows.filter("usable").dropDuplicates(["id", "h1", "h2"]).groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector")
    )
    classes = scratch.keep(classes, "classes")
    size = classes.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("dim")).first()
    tables, cuts = layout(size["n"], size["dim"] or 1, recall, tables)
    made = classes.select("rep", "weight", "vector", "h1", "h2").mapInPandas(
        _window_keys(least, tables, cuts, counted, seed), classes.select("rep", "weight", "vector", "h1", "h2").schema.add("keys", ArrayType(IntegerType()))
    )
    keyed = scratch.keep(made, "keyed")
    met = keyed.select("rep", "h1", "h2", F.posexplode("keys").alias("table", "key"))
    sizes = met.groupBy("table", "key").agg(F.count("*").alias("size")).filter("size > 1")
    listed = met.join(sizes, ["table", "key"]).join(keyed.select("h1", "h2", "weight", "vector", "keys"), ["h1", "h2"])
    listed = listed.withColumn("keys", F.slice("keys", 1, F.col("table")))  # of the tables before
    order = ["table", "key", "bi", "bj"]
    dealt = block_pairs(listed, F.col("size"), F.xxhash64("h1", "h2"), BLOCK).select(*order, "side", "rep", "weight", "vector", "keys")
    found = dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(
        _group_links(least, tables, cuts, counted, seed), "a bigint, b bigint, n bigint"
    )
    found = scratch.keep(found, "found")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.filter("n = 0"), scratch).withColumnRenamed("node", "rep")
    told = classes.select("h1", "h2", "rep", "weight").join(counts, "rep", "left").join(labels, "rep", "left").select(
        "h1", "h2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component")
    ).withColumn("usable", F.lit(True))
    placed = rows.drop("vector").join(told, ["h1", "h2", "usable"], "left")
    component = F.coalesce("component", "id")
    return placed.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
