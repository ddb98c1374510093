"""Records of JSON documents that are too large for one task.

A document is read as the texts between closing braces, which Spark's reader splits at any byte range.
Each task joins them into pieces of a few million characters. A piece alone does not tell whether it
begins inside a string, nor how deep. But the quotes that are not escaped alternate, so their running sum
over the pieces of a document tells whether a piece begins inside a string; the braces outside strings
then sum up to its depth. With both known, every piece is cut into records by itself, and only the ends of
records that pieces share are put together again.

The sums run over one small row per piece (``operators/ordered.py``), texts are joined by place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.ordered import latest, running_sum, scan
from spanloom.runtime import settle
from spanloom.sources.files import file_columns

#: Pieces are at least this long, unless their split ends.
PIECE_CHARS = 4_000_000
#: Documents above this size are read in pieces (``spanloom.wholeDocumentBytes``).
WHOLE_BYTES_CONF, WHOLE_BYTES = "spanloom.wholeDocumentBytes", 32 << 20

#: A string, closed or up to the end, or a brace.
_TOKEN = re.compile(r'"[^"\\]*+(?:\\(?:.|\Z)[^"\\]*+)*+("|\Z)|[{}\[\]]', re.S)
_REST_OF_STRING = re.compile(r'[^"\\]*+(?:\\(?:.|\Z)[^"\\]*+)*+("|\Z)', re.S)
_PLACE = ["path", "block", "piece"]


def whole_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(WHOLE_BYTES_CONF, str(WHOLE_BYTES)))


def read_pieces(spark: SparkSession, dirs: Sequence[str], glob: str, above: int = -1) -> DataFrame:
    """Texts of the files above a size as ``(path, block, piece, text)``; pieces of a file in order."""
    read = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("lineSep", "}")
        .text(list(dirs))
        .filter(F.col("_metadata.file_size") > above)
    )
    start = F.col("_metadata.file_block_start")
    last = start + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    path = file_columns(F.col("_metadata.file_path"))["path"]
    parts = read.select(path.alias("path"), start.alias("block"), last.alias("last"), "value")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number, kept, size = None, 0, [], 0

        def piece(whole: bool) -> pd.DataFrame:
            # Only the end of a file may lack the brace that ended the text.
            text = "}".join(kept) + ("" if whole else "}")
            return pd.DataFrame({"path": [at[0]], "block": [at[1]], "piece": [number], "text": [text]})

        for batch in batches:
            for path, block, end, value in zip(batch["path"], batch["block"], batch["last"], batch["value"], strict=True):
                if at is not None and (path, block) != at[:2]:
                    yield piece(at[2])
                    number, kept, size = 0, [], 0
                elif size >= PIECE_CHARS:
                    yield piece(False)
                    number, kept, size = number + 1, [], 0
                at = (path, block, end)
                kept.append(value)
                size += len(value) + 1
        if kept:
            yield piece(at[2])

    return parts.mapInPandas(gather, "path string, block bigint, piece bigint, text string")


def _braces(text: str, inside: bool) -> int:
    """Opened less closed braces outside strings."""
    start = _REST_OF_STRING.match(text).end() if inside else 0
    opened = closed = 0
    for token in _TOKEN.finditer(text, start):
        sign = token[0]
        if sign in "{[":
            opened += 1
        elif sign in "}]":
            closed += 1
    return opened - closed


def _quotes(text: str) -> int:
    """Quotes that are not escaped; outside strings nothing is."""
    return text.count('"') - sum(1 for _ in re.finditer(r'(?<!\\)(?:\\\\)*+\\"', text))


def cut(text: str, inside: bool, depth: int, level: int) -> list[tuple[int | None, int, bool]]:
    """Elements of a piece as (start, or null if begun before, end, whether it ends here).

    An element is an object or array that opens at depth ``level``; whole arrays are left out. The piece
    begins inside a string or not, and at ``depth``.
    """
    found: list[tuple[int | None, int, bool]] = []
    begun: int | None = None
    held = depth > level
    at = _REST_OF_STRING.match(text).end() if inside else 0
    for token in _TOKEN.finditer(text, at):
        sign = token[0]
        if sign in "{[":
            if depth == level:
                begun, held = token.start(), True
            depth += 1
        elif sign in "}]":
            depth -= 1
            if held and depth == level:
                if begun is None or text[begun] == "{":
                    found.append((begun, token.end(), True))
                held = False
    if held:
        found.append((begun, len(text), False))
    return found


def records(pieces: DataFrame, level: int) -> DataFrame:
    """Every object that opens at depth ``level`` as ``(path, offset, record)``, ``offset`` in characters.

    ``pieces`` is ``(path, block, piece, text)``, in order of ``(block, piece)`` and not cut behind a
    backslash. An object that its document leaves open is no record; text without any has none. A null
    text is empty. Depth 0 is outside the document, 1 inside its outermost array or object.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("text")
            batch["length"] = [len(t) for t in texts]
            batch["quotes"] = [_quotes(t) for t in texts]
            batch["out"] = [_braces(t, False) for t in texts]
            batch["inner"] = [_braces(t, True) for t in texts]
            yield batch

    pieces = settle(pieces.filter("path IS NOT NULL").select(*_PLACE, F.coalesce("text", F.lit("")).alias("text")))
    place = "path string, block bigint, piece bigint"
    sizes = settle(pieces.mapInPandas(measure, f"{place}, length bigint, quotes bigint, out bigint, inner bigint"))
    order = ["block", "piece"]
    strings = scan(sizes, ["path"], order, [running_sum("q", F.col("quotes")), running_sum("o", F.col("length"))])
    inside = (F.col("q") - F.col("quotes")) % 2 == 1
    strings = strings.withColumn("inside", inside).withColumn("braces", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("out")))
    states = scan(strings, ["path"], order, [running_sum("d", F.col("braces"))]).select(
        *_PLACE, "inside", (F.col("d") - F.col("braces")).alias("depth"), (F.col("o") - F.col("length")).alias("origin")
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, within, depth, origin in zip(*(batch[c] for c in ("path", "text", "inside", "depth", "origin")), strict=True):
                for start, end, ends in cut(text, bool(within), int(depth), level):
                    rows.append((path, origin + (start or 0), start is not None, ends, text[start or 0 : end]))
            yield pd.DataFrame(rows, columns=["path", "offset", "begins", "ends", "record"])

    parts = settle(
        pieces.join(states, _PLACE).select("path", "text", "inside", "depth", "origin")
        .mapInPandas(split, "path string, offset bigint, begins boolean, ends boolean, record string")
    )
    shared = ~(F.col("begins") & F.col("ends"))
    owner = latest("owner", F.when(F.col("begins"), F.col("offset")))
    owners = scan(parts.filter(shared).select("path", "offset", "begins"), ["path"], ["offset"], [owner])
    texts = F.array_join(F.sort_array(F.collect_list(F.struct("offset", "record")))["record"], "")
    joined = (
        parts.filter(shared).join(owners.select("path", "offset", "owner"), ["path", "offset"])
        .filter("owner IS NOT NULL").groupBy("path", "owner").agg(texts.alias("record"), F.bool_or("ends").alias("whole"))
    )
    return parts.filter(~shared).select("path", "offset", "record").unionByName(
        joined.filter("whole AND startswith(record, '{')").select("path", F.col("owner").alias("offset"), "record")
    )

