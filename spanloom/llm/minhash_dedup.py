"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each document's word shingles are hashed once. It keeps the size of the set, a hash of the whole
   set and its ``SKETCH`` smallest values. Documents of equal sets form a class; only classes go on.
2. Each class enters the inverted lists of its ``POSTED`` smallest values. Two sets of similarity s miss
   each other there with probability (1 - s) ** POSTED: 1e-7 at 0.8. A list is worked off in one
   task, a long one in pairs of blocks: sketches overlap, and the overlap within the range both
   sketches cover estimates the similarity of the sets. Pairs estimated at ``LOOSE`` or more (six
   standard deviations below 0.8) are kept as a spanning forest per list, so no list emits its
   pairs. The components of these links are the families.
3. The texts of families of two classes or more meet in one task per family, or pairs of blocks of
   one. There larger sketches, of ``CLOSE_SKETCH`` values, sort out pairs estimated below ``CLOSE``, and
   the rest is confirmed on full sets. Confirmed links go out as a forest; their components are the
   result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, block_pairs, likely_members, maybe_member, sorted_groups
from spanloom.llm.components import components

SKETCH, POSTED, LOOSE = 64, 10, 0.5
CLOSE_SKETCH, CLOSE = 128, 0.62
#: Classes of a list, or documents of a family, that meet in one task.
LIST_BLOCK, FAMILY_BLOCK = 512, 256
#: Entries of a worker's memory of word hashes; it starts anew beyond that.
WORDS_KEPT = 200_000

_SPACE = "id bigint, h1 bigint, h2 bigint, n_shingles bigint, sketch array<bigint>"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > WORDS_KEPT:
        _words.clear()
    codes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    rows = len(words) - size + 1
    total = np.full(rows, size, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + _mixed(codes[k : k + rows], 0xFF51AFD7ED558CCD)
    return np.unique(_mixed(total, 0xD6E8FEB86659FD93))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: id, a 128-bit hash of its shingle set, the set's size and its smallest hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, text in zip(batch["id"], batch["text"], strict=True):
                found = shingle_hashes(text, width)
                h1, h2 = (int(_mixed(found, by).sum(dtype=np.uint64).astype(np.int64)) for by in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25))
                rows.append((id_, h1, h2, len(found), (found[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "h1", "h2", "n_shingles", "sketch"])
        _words.clear()  # later tasks of this worker may need the memory for other things

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    return slim.mapInPandas(run, _SPACE)


class _Group:
    """Sketches of one group, to compare one item with the others at a time."""

    def __init__(self, values: list[np.ndarray], full: np.ndarray, k: int):
        """``values``: ascending and not empty; ``full``: whether a sketch is the whole set."""
        self.sizes = np.array([len(v) for v in values])
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate(values)
        known, self.codes = np.unique(flat, return_inverse=True)
        self.seen = np.zeros(len(known), dtype=bool)
        width = int(self.sizes.max())
        self.table = np.full((len(values), width), len(known), dtype=np.int64)
        self.table[np.arange(width) < self.sizes[:, None]] = self.codes
        self.reach = np.where(full, len(known), self.codes[self.starts + self.sizes - 1])

    def estimates(self, i: int, others: np.ndarray) -> np.ndarray:
        """Similarity of item i to ``others``, from the values within the range both cover."""
        own = self.codes[self.starts[i] : self.starts[i] + self.sizes[i]]
        table = self.table[others]
        self.seen[own] = True
        common = np.append(self.seen, False)[table].sum(axis=1)
        self.seen[own] = False
        reach = np.minimum(self.reach[i], self.reach[others])
        mine = np.searchsorted(own, reach, side="right")
        theirs = ((table <= reach[:, None]) & (table < len(self.seen))).sum(axis=1)
        return common / np.maximum(mine + theirs - common, 1)


def _forest(n: int, sides: np.ndarray, crossing: bool, linked) -> list[tuple[int, int]]:
    """Spanning links of a group: ``linked(i, others)`` tells which others item i links with.

    Items that are already joined are not compared again. In a pair of different blocks only items
    of different sides are compared.
    """
    label, found = np.arange(n), []
    for i in range(n):
        if crossing and sides[i]:
            continue
        ahead = np.flatnonzero(sides == 1) if crossing else np.arange(i + 1, n)
        others = ahead[label[ahead] != label[i]]
        if not len(others):
            continue
        for j in others[linked(i, others)].tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def _links(group: pd.DataFrame, pairs: list[tuple[int, int]]) -> pd.DataFrame:
    ids = group["rep"].to_numpy()
    return pd.DataFrame([(ids[i], ids[j]) for i, j in pairs], columns=["a", "b"], dtype="int64")


def _list_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for group in sorted_groups(batches, ["value", "bi", "bj"]):
        if len(group) < 2:
            continue
        full = (group["n_shingles"] <= SKETCH).to_numpy()
        space = _Group(list(group["sketch"]), full, SKETCH)
        crossing = bool(group["bi"].iloc[0] != group["bj"].iloc[0])
        pairs = _forest(len(group), group["side"].to_numpy(), crossing, lambda i, o, s=space: s.estimates(i, o) >= LOOSE)
        if pairs:
            out.append(_links(group, pairs))
        if len(out) >= 1000:
            yield pd.concat(out)
            out = []
    if out:
        yield pd.concat(out)


def _family_links(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(batches, ["family", "bi", "bj"]):
            sets = [shingle_hashes(t, width) for t in group["text"]]
            there = [i for i, s in enumerate(sets) if len(s)]
            group, sets = group.iloc[there], [sets[i] for i in there]
            if len(sets) < 2:
                continue
            full = np.array([len(s) <= CLOSE_SKETCH for s in sets])
            space = _Group([s[:CLOSE_SKETCH] for s in sets], full, CLOSE_SKETCH)

            def linked(i, others, sets=sets, space=space):
                near = space.estimates(i, others) >= CLOSE
                for k in np.flatnonzero(near):
                    a, b = sets[i], sets[others[k]]
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    near[k] = 100 * common >= percent * (len(a) + len(b) - common)
                return near

            crossing = bool(group["bi"].iloc[0] != group["bj"].iloc[0])
            pairs = _forest(len(sets), group["side"].to_numpy(), crossing, linked)
            if pairs:
                yield _links(group, pairs)

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Sets whose intersection is at least ``percent`` % of their union are linked, for ``percent`` of 80
    or more. A document without words has an empty set and no links. Rows that share an id are one
    document, and each of them has a row; rows without an id take part in nothing: their component is
    null, they are kept and have null n_shingles.
    """
    if percent < 80:
        raise ValueError("the sketches are laid out for similarities of 0.8 or more")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    each = scratch.keep(sketches(docs, id_col, text_col, width), "sketches")
    classes = scratch.keep(
        each.filter("n_shingles > 0").groupBy("h1", "h2").agg(
            F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
        ), "classes",
    )
    posts = classes.select("rep", F.explode(F.slice("sketch", 1, POSTED)).alias("value")).distinct()
    lists = posts.groupBy("value").agg(F.count("*").alias("size")).filter("size > 1")
    posts = scratch.keep(posts.join(lists, "value"), "posts")
    listed = posts.join(classes.select("rep", "n_shingles", "sketch"), "rep")
    dealt = block_pairs(listed, F.col("size"), F.col("rep"), LIST_BLOCK)
    order = ["value", "bi", "bj"]
    loose = dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(_list_links, "a bigint, b bigint")
    families = scratch.keep(components(loose, scratch), "families")
    sizes = families.groupBy("component").agg(F.count("*").alias("size"))
    members = families.join(sizes, "component").select(F.col("component").alias("family"), F.col("node").alias("rep"), "size")
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).alias("text"))
    texts = likely_members(texts, members, "rep")
    once = texts.join(members, "rep").groupBy("rep", "family", "size", F.xxhash64("text")).agg(F.first("text").alias("text"))
    dealt = block_pairs(once, F.col("size"), F.col("rep"), FAMILY_BLOCK).select("family", "bi", "bj", "side", "rep", "text")
    order = ["family", "bi", "bj"]
    sure = dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(_family_links(width, percent), "a bigint, b bigint")
    found = scratch.keep(components(sure, scratch), "components")
    # A copy of a class belongs to the component of its class; a document that shares its id with
    # another class has one label all the same, as components are told by the smallest id.
    labels = classes.select("h1", "h2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    placed = each.drop("sketch").join(labels, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("component", "id"))
    named = placed.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
    without = docs.filter(F.col(id_col).isNull()).select(
        F.col(id_col).cast("bigint").alias(id_col), F.lit(None).cast("bigint").alias("n_shingles"),
        F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"),
    )
    return named.unionByName(without)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; all columns stay.

    Of rows that share an id one stays, unless that id goes; rows without an id all stay. Only rows that may have to go are
    shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    judged = scratch.keep(near_duplicates(docs, id_col, text_col, width, percent).select(F.col(id_col).alias("id"), "kept"), "judged")
    gone = judged.filter("NOT kept").select("id").distinct()
    again = judged.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), row.alias("row"))
    rows = rows.withColumn("maybe", maybe_member(gone.unionByName(again), "id") & F.col("id").isNotNull())
    checked = rows.filter("maybe").join(gone, "id", "left_anti")
    once = checked.groupBy("id").agg(F.first("row").alias("row"))
    left = rows.filter("NOT maybe").select("row").unionByName(once.select("row"))
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
