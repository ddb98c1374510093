"""Lines that many documents share: range-partitioned hashes, streamed runs, keep bitmaps.

Every line becomes (128-bit hash of its key, document, position). The rows are range-partitioned and
sorted by all of these, so equal keys lie in one run; a run may reach over several partitions, and a
key that a third of all documents hold is cut at document borders like any other range. Each task
streams its runs and reports the lines to drop. Only the runs at the two ends of a partition can go
on in a neighbour, and only those below the threshold are decided afterwards, from fewer than
``2 * min_docs`` rows per partition.

The result is one compressed bitmap per document that loses lines; no text is shuffled for it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BLANKS, Scratch, ascii_lower

#: Stands for a missing document id.
NO_ID = -(2**63)

_RUNS = "h1 bigint, h2 bigint, doc bigint, text_hash bigint, pos int, sure boolean"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def document_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row of hashes for each line whose key has at least ``min_chars`` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    )
    keyed = rows.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
        "doc", "text_hash", "pos",
    )


def _stream_runs(min_docs: int):
    """Rows of runs held by ``min_docs`` documents or more; the undecided ends are marked unsure.

    A row at position -1 tells that the run at an end of this partition is decided.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first_run, decided, held = None, False, []  # of the run that is open
        last_key, last_doc, docs_seen = None, None, 0

        def frame(cols: list[np.ndarray], sure) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(("h1", "h2", "doc", "text_hash", "pos"), cols, strict=True)) | {"sure": sure})

        def marker(key) -> pd.DataFrame:
            one = [np.array([v]) for v in (*key, NO_ID, 0)] + [np.array([-1], dtype=np.int32)]
            return frame(one, True)

        def close(at_end: bool) -> Iterator[pd.DataFrame]:
            """Ends the open run; its held rows go out only if a neighbour may complete it."""
            if last_key is None:
                return
            if decided:
                if at_end or last_key == first_run:
                    yield marker(last_key)
            elif at_end or last_key == first_run:
                for part in held:
                    yield frame(part, False)

        for batch in batches:
            if not len(batch):
                continue
            cols = [batch[c].to_numpy() for c in ("h1", "h2", "doc", "text_hash", "pos")]
            h1, h2, doc = cols[:3]
            new_run = np.ones(len(h1), dtype=bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_run[0] = last_key != (h1[0], h2[0])
            new_doc = new_run.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            new_doc[0] |= last_doc != doc[0]
            starts = np.flatnonzero(new_run)
            edges = np.unique(np.concatenate(([0], starts, [len(h1)])))
            counts = np.add.reduceat(new_doc.astype(np.int64), edges[:-1])
            inner = np.zeros(len(h1), dtype=bool)  # rows of complete inner runs that are dropped
            for k in range(len(edges) - 1):
                a, b = edges[k], edges[k + 1]
                whole = k > 0 and k < len(edges) - 2
                if whole and counts[k] < min_docs:
                    continue
                if whole:
                    inner[a:b] = True
                    continue
                if new_run[a]:
                    yield from close(at_end=False)
                    last_key, docs_seen, decided, held = (h1[a], h2[a]), 0, False, []
                    first_run = first_run or last_key
                docs_seen += int(counts[k])
                part = [c[a:b] for c in cols]
                if not decided and docs_seen >= min_docs:
                    decided = True
                    for earlier in held:
                        yield frame(earlier, True)
                    held = []
                if decided:
                    yield frame(part, True)
                else:
                    held.append(part)
            if inner.any():
                yield frame([c[inner] for c in cols], True)
            last_doc = doc[-1]
        yield from close(at_end=True)

    return stream


def shared_lines(lines: DataFrame, min_docs: int, scratch: Scratch) -> DataFrame:
    """(doc, text_hash, pos) of the lines whose key at least ``min_docs`` documents hold."""
    order = ["h1", "h2", "doc", "text_hash", "pos"]
    runs = scratch.keep(
        lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_stream_runs(min_docs), _RUNS),
        "runs",
    )
    ends = runs.filter("NOT sure OR pos = -1").groupBy("h1", "h2").agg(
        F.countDistinct(F.when(~F.col("sure"), F.col("doc"))).alias("docs"), F.max(F.col("pos") == -1).alias("done")
    ).filter((F.col("docs") >= min_docs) | F.col("done"))
    late = runs.filter("NOT sure").join(ends, ["h1", "h2"], "left_semi")
    columns = ["doc", "text_hash", "pos"]
    return runs.filter("sure AND pos >= 0").select(columns).unionByName(late.select(columns))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, text_hash, bitmap): zlib-compressed bits, set where a line goes, lowest bit first.

    The bits are gathered as 32-bit words, so that a document's rows meet as partial sums.
    """
    words = dropped.groupBy("doc", "text_hash", F.expr("pos div 32").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 32)")).alias("bits")
    )
    gathered = words.groupBy("doc", "text_hash").agg(
        F.collect_list(F.struct("word", "bits")).alias("words")
    ).select("doc", "text_hash", F.col("words.word").alias("word"), F.col("words.bits").alias("bits"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for word, bits in zip(batch["word"], batch["bits"], strict=True):
                out = np.zeros(max(word) + 1, dtype="<u4")
                out[np.asarray(word)] = np.asarray(bits, dtype=np.int64)
                packed.append(zlib.compress(out.tobytes()))
            yield pd.DataFrame({"doc": batch["doc"], "text_hash": batch["text_hash"], "bitmap": packed})

    return gathered.mapInPandas(pack, "doc bigint, text_hash bigint, bitmap binary")


def kept_lines(lines: list[str], bitmap: bytes | None) -> list[str]:
    """The lines whose bit is not set."""
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")
    gone = set(np.flatnonzero(bits).tolist())
    return [line for i, line in enumerate(lines) if i not in gone]


def line_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Which lines of which document go: keys of ``min_chars`` code points in ``min_docs`` documents.

    Documents are told apart by id; rows without an id count as one document. Rows that share an id
    but not the text have bitmaps of their own. A null or empty text is one empty line, whose key
    has no code points. Documents that lose nothing have no row.
    """
    scratch = Scratch(docs.sparkSession)
    return drop_bitmaps(shared_lines(document_lines(docs, id_col, text_col, min_chars), min_docs, scratch))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` (id, text, and nothing named like the keys) with ``bitmap``, null where no line goes."""
    keyed = docs.withColumns({
        "doc": F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)),
        "text_hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    })
    return keyed.join(bitmaps, ["doc", "text_hash"], "left")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """``docs`` with shared lines taken out of the text; all columns and rows stay.

    A null text stays null. Other columns travel in one struct, so their names cannot clash.
    """
    bitmaps = line_bitmaps(docs, id_col, text_col, min_docs, min_chars)
    carried = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = with_bitmaps(carried, bitmaps, "id", "text")

    @F.pandas_udf("string")
    def rest(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([
            t if t is None or b is None else "\n".join(kept_lines(t.split("\n"), b))
            for t, b in zip(text, bitmap, strict=True)
        ])

    cleaned = F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(rest("text", "bitmap"))
    return joined.withColumn("cleaned", cleaned).select(*[
        F.col("cleaned").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns
    ])


def line_digest(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Per row of ``docs``: id, n_lines before dropping, n_dropped, and SHA-256 of what stays."""
    bitmaps = line_bitmaps(docs, id_col, text_col, min_docs, min_chars)
    joined = with_bitmaps(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), bitmaps, "id", "text")
    schema = f"{id_col} bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, text, bitmap in zip(batch["id"], batch["text"], batch["bitmap"], strict=True):
                lines = (text or "").split("\n")
                kept = kept_lines(lines, bitmap)
                sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
                rows.append((None if pd.isna(id_) else int(id_), len(lines), len(lines) - len(kept), sha))
            yield pd.DataFrame({
                name: pd.Series(list(col), dtype=kind)
                for name, kind, col in zip((id_col, "n_lines", "n_dropped", "kept_sha256"), ("Int64", "int64", "int64", "object"), zip(*rows, strict=True), strict=True)
            }) if rows else pd.DataFrame({id_col: pd.Series(dtype="Int64"), "n_lines": pd.Series(dtype="int64"), "n_dropped": pd.Series(dtype="int64"), "kept_sha256": pd.Series(dtype="object")})

    return joined.select("id", "text", "bitmap").mapInPandas(digest, schema)
