"""Hard negatives: rows of other labels that score nearly as high with an anchor as its positives do.

Scores are whole numbers, inner products of vectors scaled and rounded down. All rows meet all anchors in
cells: rows are dealt to parts, anchors to blocks of bounded size, and a cell is one block and one part.
A cell's anchors come first in its sorted stream; its rows pass by in batches and are not kept. The first pass
keeps per cell and anchor the first positives, of which the first of all cells are taken. The second
knows every anchor's positives and keeps, per cell and positive, the first negatives of its window.

What cells keep is packed into keys (anchor, descending score, positives before negatives, id). The keys are
shuffled by anchor and sorted within partitions; one pass over each partition opens a window at a
positive, lets each open window take the negatives that follow, and closes it once it is full or the scores
sink below it. No anchor's rows are ever held together.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, shuffle_partitions

#: Anchors of a block, and rows of a part; a part is smaller where there are fewer rows than tasks.
BLOCK_ANCHORS, PART_ROWS = 16_384, 262_144
#: Anchors compared with a batch at a time.
CHUNK = 256
LONG = np.iinfo(np.int64)
SIGN = np.uint64(1 << 63)

_KEY = np.dtype([("anchor", ">u8"), ("anchor_row", ">u8"), ("fall", ">u8"), ("kind", "u1"), ("id", ">u8"), ("row", ">u8")])
_PACKED = ">QQQBQQ"
#: Keys are dealt by this many bytes, those of the anchor.
_ANCHOR_BYTES = 16
POSITIVE, NEGATIVE = 0, 1
_FOUND = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


# ---- Keys --------------------------------------------------------------------------------------


def pack_keys(anchor: np.ndarray, anchor_row: np.ndarray, score: np.ndarray, kind: int, id_: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys whose bytes sort by anchor, falling score, kind and id."""

    def rising(x: np.ndarray) -> np.ndarray:
        return x.astype(np.int64).view(np.uint64) ^ SIGN

    keys = np.empty(len(score), dtype=_KEY)
    keys["anchor"], keys["anchor_row"], keys["fall"] = rising(anchor), rising(anchor_row), ~rising(score)
    keys["kind"], keys["id"], keys["row"] = kind, rising(id_), rising(row)
    return keys


def unpack_key(key: bytes) -> tuple[int, int, int, int, int]:
    """anchor, anchor_row, score, kind, id."""
    anchor, anchor_row, fall, kind, id_, _ = struct.unpack(_PACKED, key)
    return anchor - 2**63, anchor_row - 2**63, 2**63 - 1 - fall, kind, id_ - 2**63


def _batch(keys: np.ndarray) -> pa.RecordBatch:
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
    return pa.RecordBatch.from_arrays([fixed.cast(pa.binary())], ["key"])


def open_windows(keys: Iterator[bytes], low: int, high: int, negatives: int) -> Iterator[tuple]:
    """The result rows of sorted keys; holds the open windows of one anchor."""
    current, windows = None, []
    for key in keys:
        anchor, anchor_row, score, kind, id_ = unpack_key(key)
        if current != (anchor, anchor_row):
            current, windows = (anchor, anchor_row), []
        if kind == POSITIVE:
            windows.append([id_, score, 0])
            continue
        windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]
        for window in windows:
            if 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], id_, window[1], score


# ---- Scores ------------------------------------------------------------------------------------


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers; exact, and held at the ends of 64 bits beyond those."""
    if not left.shape[1]:
        return np.zeros((len(left), len(right)))
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < 2.0**53:
        return left @ right.T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(left) @ whole(right).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def _matrices(vectors: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, values[begins[rows][:, None] + np.arange(size)]))
    return out


class First:
    """The first ``n`` entries of every slot, by falling score, then by id and row."""

    def __init__(self, slots: int, n: int):
        self.n = n
        self.slot, self.score, self.id, self.row = (np.zeros(0, dtype=np.int64) for _ in range(4))
        #: A lower score cannot be among the first of its slot.
        self.least = np.full(slots, LONG.min)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score.astype(np.int64)])
        id_, row = np.concatenate([self.id, id_]), np.concatenate([self.row, row])
        order = np.lexsort((row, id_, ~score, slot))
        slot = slot[order]
        begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.r_[begins, len(slot)]))
        kept = rank < self.n
        order = order[kept]
        self.slot, self.score, self.id, self.row = slot[kept], score[order], id_[order], row[order]
        full = rank[kept] == self.n - 1
        self.least[self.slot[full]] = self.score[full]


class Cell:
    """The anchors of one block, and what the rows that passed by left with them."""

    def __init__(self, anchors: pa.Table, n: int, windowed: bool):
        get = lambda c: anchors.column(c).to_numpy()
        self.row, self.id, self.label = get("row"), get("id"), get("label")
        self.groups = {m.shape[1]: (at, m) for at, m in _matrices(anchors.column("vec").combine_chunks())}
        self.windowed = windowed
        self.widest = 1
        if windowed:
            lows, highs = anchors.column("lows").to_pylist(), anchors.column("highs").to_pylist()
            self.widest = max(map(len, lows), default=0)
            pad = lambda x, fill: np.array([[*v, *[fill] * (self.widest - len(v))] for v in x], dtype=np.int64)
            # A window that an anchor does not have takes no score.
            self.low, self.high = pad(lows, LONG.max), pad(highs, LONG.min)
        self.first = First(len(self.row) * self.widest, n)

    def pass_by(self, batch: pa.RecordBatch) -> None:
        row, id_, label = (batch.column(c).to_numpy() for c in ("row", "id", "label"))
        for at, right in _matrices(batch.column("vec")):
            places, left = self.groups.get(right.shape[1], (np.zeros(0, dtype=np.int64), None))
            for i in range(0, len(places), CHUNK):
                here = places[i : i + CHUNK]
                score = scores(left[i : i + CHUNK], right)
                same = self.label[here][:, None] == label[at][None, :]
                for k in range(self.widest):
                    slots = here * self.widest + k
                    fit = score >= self.first.least[slots][:, None]
                    if self.windowed:
                        fit &= ~same & (score <= self.high[here, k][:, None]) & (score >= self.low[here, k][:, None])
                    else:
                        fit &= same & (self.id[here][:, None] != id_[at][None, :])
                    a, b = np.nonzero(fit)
                    self.first.add(slots[a], score[a, b], id_[at][b], row[at][b])

    def kept(self) -> np.ndarray:
        """Keys of what is kept, each row once per anchor."""
        f = self.first
        anchor = f.slot // self.widest
        keys = pack_keys(self.id[anchor], self.row[anchor], f.score, NEGATIVE if self.windowed else POSITIVE, f.id, f.row)
        return np.unique(keys)


def _cells(batches: Iterator[pa.RecordBatch], n: int, windowed: bool) -> Iterator[pa.RecordBatch]:
    """Walks batches sorted by (block, part, anchors first)."""
    at, anchors, cell = None, [], None

    def ended() -> Iterator[pa.RecordBatch]:
        if cell is not None and len(keys := cell.kept()):
            for i in range(0, len(keys), 100_000):
                yield _batch(keys[i : i + 100_000])

    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "kind")])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            block, part, kind = marks[:, begin]
            piece = batch.slice(begin, end - begin)
            if at != (block, part):
                yield from ended()
                at, anchors, cell = (block, part), [], None
            if kind == 0:
                anchors.append(piece)
            elif anchors:
                if cell is None:
                    cell = Cell(pa.Table.from_batches(anchors), n, windowed)
                cell.pass_by(piece)
    yield from ended()


# ---- The operator ------------------------------------------------------------------------------


def _compared(rows: DataFrame, anchors: DataFrame, parts: int, blocks: int, n: int, windowed: bool) -> DataFrame:
    """Keys of the entries that ``Cell`` keeps, of all anchors (with their block) against all rows."""
    columns = ["block", "part", "kind", "row", "id", "label", "vec"]
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    one = anchors.withColumn("kind", F.lit(0)).select("*", every)
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")
    other = rows.select("*", part, F.lit(1).alias("kind")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if windowed:
        columns += ["lows", "highs"]
        other = other.withColumns({c: F.lit(None).cast("array<bigint>") for c in ("lows", "highs")})
    dealt = one.select(*columns).unionByName(other.select(*columns))
    dealt = dealt.repartitionById(parts * blocks, F.col("block") * parts + F.col("part")).sortWithinPartitions("block", "part", "kind")
    return dealt.mapInArrow(lambda batches: _cells(batches, n, windowed), "key binary")


def usable(vectors: DataFrame, anchors: Column, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, anchor, vec) of the rows that take part, their vectors as whole numbers in double precision."""
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"),
    ).filter("id is not null and label is not null and x is not null")
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    scaled = rows.withColumn("x", F.transform("x", lambda v: v * float(scale)))
    # Doubles of 2 ** 53 and more are whole numbers already, and too large for floor().
    whole = F.transform("x", lambda v: F.when(F.abs(v) < float(2**53), F.floor(v).cast("double")).otherwise(v))
    return scaled.select("id", "label", "anchor", whole.alias("vec"))


def _unpacked(keys: DataFrame) -> DataFrame:
    """(anchor_row, score, id, row) of keys."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=_KEY)
            whole = lambda x: pa.array((x.astype(np.uint64) ^ SIGN).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [whole(k["anchor_row"]), whole(~k["fall"].astype(np.uint64)), whole(k["id"]), whole(k["row"]), batch.column("key")],
                ["anchor_row", "score", "id", "row", "key"],
            )

    return keys.mapInArrow(read, "anchor_row bigint, score bigint, id bigint, row bigint, key binary")


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the columns of ``vectors``. A row's score is the inner product with the
    anchor of ``floor(scale * x)``, ``scale`` a power of two; higher scores come first, ties by smaller id. An
    anchor's positives are its first ``positives`` rows of the same label and another id. For each of them
    come the first ``negatives`` rows of another label with ``low`` to ``high`` percent of its score.

    Rows whose id, label or vector is null, or that hold a null or non-finite component, take no part.
    Vectors of different lengths are not compared. Repeated rows count one by one: as anchors each
    gives its rows, as partners each takes a place. Labels are whole numbers. Scores beyond 64 bits are
    held at their ends. An anchor without positives, or a positive without negatives, gives no rows.
    Other columns are not read. No rows give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = usable(vectors, anchors, id_col, vec_col, label_col, scale)
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    count, chosen = rows.agg(F.count("*"), F.count_if("anchor")).first()
    if not chosen:
        return spark.createDataFrame([], _FOUND)
    parts = max(shuffle_partitions(spark), -(-count // PART_ROWS))
    blocks = -(-chosen // BLOCK_ANCHORS)
    others = rows.drop("anchor")
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    asked = rows.filter("anchor").drop("anchor").select("*", block)

    near = _unpacked(_compared(others, asked, parts, blocks, positives, False))
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    near = scratch.keep(near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives), "positives")

    # Scores are compared in whole numbers; those of few percent of 64 bits cannot overflow a decimal.
    wide = F.col("score").cast("decimal(20,0)")
    bound = near.select("anchor_row", "rank", F.ceil(wide * low / 100).cast("bigint").alias("low"), F.floor(wide * high / 100).cast("bigint").alias("high"))
    windows = bound.groupBy(F.col("anchor_row").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("windows")  # ``positives`` at most
    ).select("row", F.col("windows.low").alias("lows"), F.col("windows.high").alias("highs"))
    far = _compared(others, asked.join(windows, "row"), parts, blocks, negatives, True)

    keys = scratch.keep(far.unionByName(near.select("key")), "keys")
    dealt = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(
        parts * blocks, lambda key: zlib.crc32(key[:_ANCHOR_BYTES])
    )
    mined = dealt.mapPartitions(lambda pairs: open_windows((k for k, _ in pairs), low, high, negatives))
    return spark.createDataFrame(mined, _FOUND, verifySchema=False)
