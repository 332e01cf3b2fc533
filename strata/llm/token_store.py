"""Token-id output (6): one Zstandard frame per document under a dictionary that all shards share.

A store is a folder of shards in ascending id order and `manifest.json`. A shard holds, in this
order, `TOKZ1`, the width of an id (2 or 4), the SHA-256 of the dictionary, the frames, the index and its
trailer. The index has, per document: the id, whether it is null, the frame's place, the count of token ids before it in
the shard and its own. `fetch` reads one document with the index and one frame.

Texts are encoded where they are read, and the arrays of ids are stored and then ranged; no text crosses the network. A
task goes on to another shard at `SHARD_BYTES` bytes or `SHARD_DOCS` documents, which bounds what it holds of the index.

The dictionary is trained on the id arrays of at most `SAMPLE_DOCS` documents of at most `SAMPLE_IDS`
ids, chosen by a hash of their id; it changes the size of the files, never what is read back.

Shards are named by task and attempt and only those of attempts that ended are listed, so tasks may
run again. Order: null ids first, then ascending; rows that repeat an id by a hash of the ids, then the ids, so that one id
may spread over shards. A null or empty text is the end id alone. An empty table gives a store without shards.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import cut, open_fs, sample_rows, text_batches
from strata.llm.tokens import DEFAULT_TOKENIZER, END_ID, encoder

SAMPLE_DOCS = 1000
SAMPLE_IDS = 5_000
SHARD_BYTES = 256 << 20
SHARD_DOCS = 1_000_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
MAGIC = b"TOKZ1"
INDEX = np.dtype([("doc", "<i8"), ("null", "u1"), ("place", "<u8"), ("before", "<u8"), ("count", "<u8")])
TRAILER = "<QQ5s"


def train_dictionary(encoded: DataFrame, width: int) -> bytes:
    """A dictionary over serialised id arrays; empty if there are too few samples to train on."""
    size = F.octet_length("ids")
    sample = sample_rows(encoded.where((size <= SAMPLE_IDS * width) & (size > width)), "doc_id", SAMPLE_DOCS)
    arrays = [bytes(r["ids"]) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays, level=LEVEL).as_bytes() if arrays else b""
    except zstandard.ZstdError:
        return b""


def encode_rows(rows: DataFrame, tokenizer: str, width: int) -> DataFrame:
    """doc_id and ids (with the end id, in `width` bytes each) of rows (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            found = [encode(t) + end for t in batch.column(1).to_pylist()]
            ids = found if width == 4 else [np.frombuffer(f, "<u4").astype("<u2").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(work, "doc_id bigint, ids binary")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_store(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    tokenizer: str = DEFAULT_TOKENIZER, shards: int | None = None,
) -> dict:
    """Encode all documents into a store at `path` (in the shared folder); returns the manifest.

    The manifest has a line per shard, one per task and `SHARD_BYTES`.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    width = 2 if encoder(tokenizer).size <= 1 << 16 else 4
    encoded = cut(encode_rows(rows, tokenizer, width), "encoded")
    words = train_dictionary(encoded, width)
    digest = hashlib.sha256(words).hexdigest()
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(words)
    total = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    count = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    ordered = encoded.repartitionByRange(count, F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), "ids"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(words)).compress
        task = TaskContext.get().partitionId()
        out, folder = open_fs(path)
        head = MAGIC + bytes([width]) + bytes.fromhex(digest)
        file, seq = None, -1

        def close() -> pa.RecordBatch:
            rows = [np.frombuffer(c, k) for c, k in zip(index, ("<i8", "u1", "<u8", "<u8", "<u8"), strict=True)]
            file.write(np.rec.fromarrays(rows, dtype=INDEX).tobytes() + struct.pack(TRAILER, place, len(index[0]), MAGIC))
            file.close()
            return pa.RecordBatch.from_pydict(
                {"task": pa.array([task], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "docs": [len(index[0])], "tokens": [before]}
            )

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file is not None and (place >= SHARD_BYTES or len(index[0]) >= SHARD_DOCS):
                    yield close()
                    file = None
                if file is None:
                    seq += 1
                    name = f"shard-{task:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
                    file = out.open_output_stream(f"{folder}/{name}")
                    file.write(head)
                    index, place, before = [array(k) for k in "qBQQQ"], len(head), 0
                frame = pack(ids)
                file.write(frame)
                for column, value in zip(index, (doc or 0, doc is None, place, before, len(ids) // width), strict=True):
                    column.append(value)
                place, before = place + len(frame), before + len(ids) // width
        if file is not None:
            yield close()

    done = ordered.mapInArrow(write, "task int, seq int, file string, docs bigint, tokens bigint").collect()
    listed, base = [], 0
    for r in sorted(done, key=lambda r: (r["task"], r["seq"])):
        listed.append({"file": r["file"], "docs": r["docs"], "tokens": r["tokens"], "base": base})
        base += r["tokens"]
    manifest = {"tokenizer": tokenizer.rsplit("/", 1)[-1], "end_id": END_ID, "width": width, "dictionary_sha256": digest, "tokens": base, "shards": listed}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(path: str) -> dict:
    fs, root = open_fs(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class Shard:
    """An open shard: its index and its frames."""

    def __init__(self, path: str, file: str):
        fs, root = open_fs(path)
        self.file = fs.open_input_file(f"{root}/{file}")
        head = self.file.read_at(len(MAGIC) + 33, 0)
        size = self.file.size()
        at, count, magic = struct.unpack(TRAILER, self.file.read_at(struct.calcsize(TRAILER), size - struct.calcsize(TRAILER)))
        if head[: len(MAGIC)] != MAGIC or magic != MAGIC:
            raise ValueError(f"{file} is no complete shard")
        self.width, self.end = head[len(MAGIC)], at
        with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
            words = f.read()
        if hashlib.sha256(words).digest() != head[len(MAGIC) + 1 :]:
            raise ValueError(f"{file} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(count * INDEX.itemsize, at), INDEX)
        self._open = zstandard.ZstdDecompressor(dict_data=_dictionary(words)).decompress

    def ids(self, lo: int, hi: int) -> Iterator[bytes]:
        """The ids (unsigned 32-bit, little-endian) of the documents lo to hi - 1, read in one go."""
        places = [*map(int, self.index["place"][lo:hi]), int(self.index["place"][hi]) if hi < len(self.index) else self.end]
        data = self.file.read_at(places[-1] - places[0], places[0])
        for a, b in zip(places, places[1:], strict=False):
            ids = self._open(data[a - places[0] : b - places[0]])
            yield ids if self.width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def fetch(path: str, shard: int, position: int) -> np.ndarray:
    """The ids of one document: the shard's index and one frame are read."""
    return np.frombuffer(next(Shard(path, read_manifest(path)["shards"][shard]["file"]).ids(position, position + 1)), "<u4")


def read_store(spark: SparkSession, path: str, block: int = 256) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens and ids."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    shards = [(s["file"], s["base"]) for s in read_manifest(path)["shards"]]
    listed = spark.createDataFrame(shards, "file string, base bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path, file)
                for lo in range(0, len(shard.index), block):
                    part = shard.index[lo : lo + block]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(part["doc"], pa.int64(), mask=part["null"].astype(bool)),
                        "start": pa.array(part["before"].astype("i8") + base),
                        "n_tokens": pa.array(part["count"].astype("i8")),
                        "ids": pa.array(list(shard.ids(lo, lo + len(part))), pa.binary()),
                    })

    return listed.mapInArrow(read, schema)
