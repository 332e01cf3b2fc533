"""WARC (10): archives of single-record Zstandard frames under a dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame
per record, as described for `.warc.zst`. The dictionary is trained on the records of at most
`SAMPLE_RECORDS` pages of at most `SAMPLE_CHARS` characters, chosen by a hash of their id.

Of pages with equal payloads of at least `least_bytes` bytes the one with the smallest id is a
response and the others revisit it. Equality is that of SHA-256 and length; the digest in the archive is the customary
Base32 SHA-1. A revisit keeps the HTTP headers, so the length of its payload can be read back.

Defined results: a null payload counts as empty; a null url leaves its header out; null ids come last,
and rows that repeat the smallest id of a payload are all responses (so are all pages of a payload that
has null ids only). An empty table gives no archives. Archives are named by task and attempt; only those of attempts that
ended are listed.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import open_fs, sample_rows, text_batches

SAMPLE_RECORDS = 1000
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 1 << 30
LEVEL = 6
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; the id stands in the record's URN."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head.append(f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>")
    head.append(f"WARC-Date: {date}")
    if url is not None:
        shown = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
        head.append(f"WARC-Target-URI: {shown}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def label_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, payload binary) with `refers_to` (null for responses)."""
    keyed = pages.withColumns({"key": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    firsts = (
        keyed.where(F.col("bytes") >= least_bytes).groupBy("key", "bytes")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    )
    joined = keyed.join(firsts, ["key", "bytes"], "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(later, F.col("first")).alias("refers_to"))


def train_dictionary(rows: DataFrame, date: str) -> bytes:
    """A dictionary over whole records; empty if there are too few to train on."""
    sample = sample_rows(rows.where(F.octet_length("payload") <= SAMPLE_CHARS), "page_id", SAMPLE_RECORDS)
    records = [record(r["page_id"], r["url"], bytes(r["payload"]), None, False, date) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=LEVEL).as_bytes() if records else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> list[str]:
    """Write every page into archives at `path` (in the shared folder); returns their names."""
    spark = pages.sparkSession
    text_batches(spark)
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    words = train_dictionary(rows, date)
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(words)).compress
        out, folder = open_fs(path)
        task, file, size, names = TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "refers_to")]
            for page, url, payload, first in zip(*columns, strict=True):
                if file is None or size >= ARCHIVE_BYTES:
                    if file is not None:
                        file.close()
                    names.append(f"pages-{task:06d}-{len(names):04d}-{uuid.uuid4().hex}.warc.zst")
                    file = out.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                    file.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
                    size = 0
                frame = pack(record(page, url, payload, first, first is not None, date))
                file.write(frame)
                size += len(frame)
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return sorted(r["name"] for r in label_copies(rows, least_bytes).mapInArrow(write, "name string").collect())


def _until(source: BinaryIO, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError("an archive ends inside a record")
    return data


def records_of(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    magic, length = struct.unpack("<II", _until(file, 8))
    if magic != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary frame")
    words = _until(file, length)
    open_frames = zstandard.ZstdDecompressor(dict_data=_dictionary(words))
    source = io.BufferedReader(open_frames.stream_reader(file, read_across_frames=True), 1 << 20)
    while first := source.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError("a record starts with its version")
        head: dict[str, str] = {}
        while (line := source.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        block = _until(source, int(head["content-length"]))
        _until(source, 4)
        yield head, block


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str, names: list[str], block: int = 256) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits).

    Length and digest of a response are taken from its payload, those of a revisit from its headers.
    """
    kinds = {
        "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
        "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
    }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), kinds.values(), strict=True)], list(kinds)
            )

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, root = open_fs(path)
                found: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as file:
                    for head, content in records_of(file):
                        http, _, payload = content.partition(b"\r\n\r\n")
                        kind = head["warc-type"]
                        if kind == "response":
                            size, digest = len(payload), payload_digest(payload)
                            if head["warc-payload-digest"] != f"sha1:{digest}":
                                raise ValueError(f"{name}: a payload does not match its digest")
                        else:
                            size, digest = int(http.rpartition(b"Content-Length: ")[2]), head["warc-payload-digest"][5:]
                        found.append((
                            _page_of(head["warc-record-id"]), head.get("warc-target-uri"), kind,
                            _page_of(head.get("warc-refers-to")), size, digest, payload if kind == "response" else None,
                        ))
                        if len(found) == block:
                            yield rows(found)
                            found = []
                if found:
                    yield rows(found)

    listed = spark.createDataFrame([(n,) for n in names], "name string")
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    return listed.mapInArrow(read, schema)
