"""WARC archives: written by tasks, indexed per record, read back by coalesced byte ranges.

Every record is a gzip member of its own. The index (a Parquet table in the shared folder) names file, offset and
length of each record that a finished task wrote; what a lost task left behind is in no index and never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.files import new_folder, small_batches, store_of
from siterank.sources.staging import stage

ARCHIVE_BYTES = 1 << 30  # a file is closed once it has this many bytes
GAP = 1 << 16  # ranges that lie this near are read in one request
SPAN = 8 << 20  # and a request takes no more than this, unless a single record is longer
TASK_BYTES = 128 << 20
DATE = "2000-01-01T00:00:00Z"

INDEX = "path string, offset long, length long, url string, digest string, page_id {id}, record_type string, refers_to {id}"
RECORD = "page_id {id}, url string, record_type string, refers_to {id}, payload_digest string, payload_bytes long, payload binary"


def record_types(pages: DataFrame, key: str = "page_id", body: str = "html", least: int = 0) -> DataFrame:
    """(page_id, payload, record_type, refers_to), with every other column of pages.

    Of rows with equal payloads of at least `least` bytes the one with the largest id is the response and the
    others revisit it; shorter payloads are all responses. A NULL body is an empty payload. Repeated rows that
    carry the largest id are all responses. A NULL id is a response only if no equal payload has an id.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.withColumn("__payload", payload).withColumns(
        {"__sha": F.sha1("__payload"), "__bytes": F.octet_length("__payload")}
    )
    kept = (
        pages.select(F.col(key).alias("__id"), payload.alias("__p"))
        .select("__id", F.sha1("__p").alias("__sha"), F.octet_length("__p").alias("__bytes"))
        .groupBy("__sha", "__bytes")
        .agg(F.max("__id").alias("__kept"))
    )
    first = (F.col("__bytes") < least) | F.col(key).eqNullSafe(F.col("__kept"))
    return rows.join(kept, ["__sha", "__bytes"]).select(
        *pages.columns, "__payload",
        F.when(first, "response").otherwise("revisit").alias("__type"),
        F.when(~first, F.col("__kept")).alias("__refers"),
    )


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(name: str | None) -> int | None:
    return None if name is None or name == "<urn:page:none>" else int(name[len("<urn:page:") : -1])


def _record(page, url, payload: bytes, kind: str, refers) -> tuple[bytes, str]:
    """One gzip member, and the digest of the payload. A revisit keeps the HTTP head with the payload's size."""
    digest = _digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_name(refers)}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush(), digest


def write_archives(records: DataFrame, key: str = "page_id", url: str = "url", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of record_types to archives in the shared folder and return their index, itself a table there."""
    small_batches(records.sparkSession)
    folder = new_folder(records.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        out, path, at = None, "", 0
        try:
            for batch in batches:
                found = {c: [] for c in ("path", "offset", "length", "digest")}
                for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "record_type", "refers_to"))):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        path, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{path}", compression=None)
                    member, digest = _record(*(v.as_py() for v in row))
                    out.write(member)
                    for c, v in zip(found, (f"{folder}/{path}", at, len(member), digest)):
                        found[c].append(v)
                    at += len(member)
                    if at >= archive_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["path"], pa.string()), pa.array(found["offset"], pa.int64()),
                     pa.array(found["length"], pa.int64()), batch.column("url"), pa.array(found["digest"], pa.string()),
                     batch.column("id"), batch.column("record_type"), batch.column("refers_to")],
                    names=["path", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to"],
                )
        finally:
            if out is not None:
                out.close()

    rows = records.select(
        F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col("__payload").alias("payload"),
        F.col("__type").alias("record_type"), F.col("__refers").cast("long").alias("refers_to"),
    )
    return stage(rows.mapInArrow(write, INDEX.format(id="long")), "warc-index")


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of `index` (any selection of them) point to, read from the archives.

    The ranges are dealt out sorted by file and offset; a task joins ranges that lie next to each other to one
    request. A response's digest is worked out anew and must be the one in its head; a revisit tells the size and
    digest in its own head. Without payloads that column is NULL.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = index.select("path", "offset", "length", "url").repartitionByRange(tasks, "path", "offset")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
        path, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length", "url"))))
            start = 0
            while start < len(rows):
                file, low, size, _ = rows[start]
                end, high = start + 1, low + size
                while (
                    end < len(rows) and rows[end][0] == file and rows[end][1] <= high + GAP
                    and rows[end][1] + rows[end][2] - low <= SPAN
                ):
                    high = max(high, rows[end][1] + rows[end][2])
                    end += 1
                if file != path:
                    store, inner = store_of(file)
                    path, source = file, store.open_input_file(inner)
                data = source.read_at(high - low, low)
                for _, offset, length, url in rows[start:end]:
                    yield url, data[offset - low : offset - low + length]
                start = end

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for url, member in members(batches):
            fields, block = _parse(member)
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and (len(payload), _digest(payload)) != (size, digest):
                raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not the one that was written")
            rows.append((
                _page(fields["WARC-Record-ID"]), url, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), digest, size,
                payload if payloads and fields["WARC-Type"] == "response" else None,
            ))
            held += len(payload) if payloads else 64
            if held > SPAN:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return ranges.sortWithinPartitions("path", "offset").mapInArrow(read, RECORD.format(id="long"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
