"""WARC archives, indexed as they are written, and read back by coalesced byte ranges.

Each task writes archives of its own, one gzip member per record, and returns one index row per record:
file, offset, length, url, digest. The index is a table; reading starts from any selection of it. The
selected rows are grouped by file and sorted by offset, neighbouring records become one read, and each
record is cut out of it. A task that runs again writes files of new names, and only the index rows of
the attempt that counts are kept.

Archives lie below a folder that pyarrow can open (local or mounted paths, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch

#: A writer starts a new archive beyond this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Records nearer than this are read at once, up to this many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

_INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, digest string"
_RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
#: Stands for a missing id where pandas would turn ids into floating numbers.
NO_ID = -(2**63)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _urn(page_id: int) -> str:
    return "<urn:page:none>" if page_id == NO_ID else f"<urn:page:{page_id}>"


def _page_of(urn: str) -> int:
    named = urn.strip("<>").rpartition(":")[2]
    return NO_ID if named == "none" else int(named)


def record_bytes(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit holds the HTTP head alone, which still tells the payload's size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The fields (names lower-cased) and the block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    return fields, rest[: int(fields["content-length"])]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_originals(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): the largest id of an equal payload, null for that row itself."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumns({"sha": F.sha1("html"), "long": F.octet_length("html") >= min_bytes})
    largest = rows.filter("long").groupBy("sha").agg(F.max("page_id").alias("largest")).withColumn("long", F.lit(True))
    return rows.join(largest, ["sha", "long"], "left").select(
        F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.coalesce("largest", F.lit(NO_ID))).alias("refers_to"),
    ).withColumn("refers_to", F.when(F.col("refers_to") != NO_ID, F.col("refers_to")))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``with_originals`` below ``folder``; gives the index rows, once, as it runs."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = _open(folder)
        where.create_dir(root, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = where.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    digest = base32_sha1(payload)
                    target = None if refers_to is None else int(refers_to)
                    press = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = press.compress(record_bytes(int(page_id), url, payload, digest, target)) + press.flush()
                    out.write(member)
                    index.append((page_id, f"{folder}/{name}", at, len(member), url, digest))
                    at += len(member)
                yield pd.DataFrame(index, columns=["page_id", "file", "offset", "length", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    # As text, so that pandas keeps large ids exact where some are null.
    exact = rows.withColumn("refers_to", F.col("refers_to").cast("string"))
    return exact.mapInPandas(write, _INDEX)


def _spans(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Reads that cover the records: first and last record, begin and end."""
    first = 0
    for i in range(1, len(offsets) + 1):
        begin, end = offsets[first], offsets[i - 1] + lengths[i - 1]
        if i == len(offsets) or offsets[i] - end > GAP_BYTES or offsets[i] + lengths[i] - begin > READ_BYTES:
            yield first, i, begin, end
            first = i


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows. Digest and size are taken from a response's payload.

    A revisit has no payload of its own; it tells both of the payload it refers to.
    """

    def parsed(record: bytes, url) -> tuple:
        fields, block = parse_record(record)
        head, _, payload = block.partition(b"\r\n\r\n")
        page_id = _page_of(fields["warc-record-id"])
        if fields["warc-type"] == "response":
            return page_id, url, "response", None, len(payload), base32_sha1(payload), payload if with_payload else None
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        return page_id, url, "revisit", str(_page_of(fields["warc-refers-to"])), size, fields["warc-payload-digest"].removeprefix("sha1:"), None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = source = None
        for batch in batches:
            for file, part in batch.groupby("file", sort=False):
                if file != name:
                    if source is not None:
                        source.close()
                    where, path = _open(file)
                    name, source = file, where.open_input_file(path)
                offsets, lengths, urls = part["offset"].tolist(), part["length"].tolist(), part["url"].tolist()
                for first, last, begin, end in _spans(offsets, lengths):
                    data = memoryview(source.read_at(end - begin, begin))
                    rows = [
                        parsed(zlib.decompress(data[offsets[i] - begin : offsets[i] - begin + lengths[i]], 31), urls[i])
                        for i in range(first, last)
                    ]
                    yield pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        if source is not None:
            source.close()

    spread = index.select("file", "offset", "length", "url").repartition("file").sortWithinPartitions("file", "offset")
    records = spread.mapInPandas(read, _RECORD.replace("refers_to bigint", "refers_to string"))
    return records.withColumns({"page_id": F.nullif("page_id", F.lit(NO_ID)), "refers_to": F.col("refers_to").cast("bigint")})


def archive(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 0,
) -> DataFrame:
    """Writes every row as a record and gives the index, which is a stored table.

    Of rows of equal payloads of at least ``min_bytes`` bytes that with the largest id holds it, the
    others refer to that; shorter payloads are all held. A null html is an empty payload, a null url is
    left out of the record. Repeated rows of the largest id all hold the payload; a row without an id
    refers to the largest id, and holds the payload if no row of it has an id.
    """
    scratch = Scratch(pages.sparkSession)
    rows = with_originals(pages, id_col, url_col, html_col, min_bytes)
    return scratch.keep(write_archives(rows, folder or scratch.path("archives")), "index")
