"""Suffix-array dedup (4): passages that occur twice, by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else as well. Sorting all suffixes as far as that
needs buckets only: equal strings share a bucket, and a bucket with one member is finished. As in bucket-pointer refinement,
a suffix starts in the bucket of its first q bytes and is refined by the bucket of a later offset, whose refined value is
used at once: the bucket of 2m bytes is a function of the buckets of m bytes here and m bytes on (`Buckets`). A pointer is a
128-bit value of the content instead of a rank, so that suffixes of different documents can be looked up without each other.

Not every suffix is shuffled. Each window of `length` bytes selects one anchor: the position of its least q-gram by bucket. Equal
windows select anchors at the same place in them, so a repeated window has two anchors in one q-gram bucket:

1. Anchors are spread by q-gram bucket; those that stand alone are finished (most of the corpus).
2. The others are refined: all windows that an anchor could have lie in one stretch of text around it. If its bucket has
   two members, all the anchor's windows are repeated, whatever else the texts hold.
3. Anchors that are left (at the ends of passages) are refined in steps of `STEP` windows. The core of a step, the bytes that
   its windows share, decides who stays; the whole of it decides who is settled.
4. What is left is refined window by window.

Nodes that are settled stay as witnesses, one per bucket, for those that share their core and are not. Buckets are only counted, never
gathered, so a passage that a third of all documents share costs a count. All figures are for the input as it is; overlapping
and periodic repeats count, matches never cross documents.

Defined results: a null text is empty; texts shorter than `length` lose nothing; rows that repeat an id are documents of their own;
very long texts are worked on in blocks; empty tables give empty results. Documents are found
again by file and place in the stored table; a frame that is none is stored first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, delete_path, fresh, numbered, scratch_path, stored, text_batches

LENGTH = 200
STEP = 16
BLOCK = 1 << 19
NODE_BATCH = 50_000
_PLACE = np.uint64((1 << 20) - 1)
_MIX = tuple(
    tuple(np.uint64(c) for c in pair) for pair in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
)
_NODE = "core bigint, wh bigint, wl bigint, row bigint, a int, t int, lo int, hi int, own boolean"
_NODE_TYPES = {
    "core": pa.int64(), "wh": pa.int64(), "wl": pa.int64(), "row": pa.int64(), "a": pa.int32(), "t": pa.int32(),
    "lo": pa.int32(), "hi": pa.int32(), "own": pa.bool_(),
}


def _refine(here: np.ndarray, later: np.ndarray, keys: tuple[np.uint64, np.uint64]) -> np.ndarray:
    """The bucket of a string from the buckets of its start and of a later offset."""
    z = here * keys[0]
    z ^= z >> np.uint64(32)
    z += later
    z *= keys[1]
    z ^= z >> np.uint64(29)
    return z


class Buckets:
    """Buckets of all suffixes of `data` for 8, 16, 32, ... bytes up to `longest`, each refined from the one before."""

    def __init__(self, data: np.ndarray, longest: int, streams: int = 2):
        n = len(data)
        padded = np.concatenate([data, np.zeros(7, np.uint8)])
        first = np.ndarray(max(n - 7, 0), "<u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
        self.levels = {8: [first] * streams}
        size = 8
        while 2 * size <= longest and 2 * size <= n:
            k = n - 2 * size + 1
            self.levels[2 * size] = [_refine(b[:k], b[size : size + k], _MIX[i]) for i, b in enumerate(self.levels[size])]
            size *= 2

    def at(self, starts: np.ndarray, size: int, salt: np.ndarray | int = 0) -> list[np.ndarray]:
        """The buckets of `size` bytes from each of `starts`: two overlapping buckets of a power of two."""
        part = 1 << (size.bit_length() - 1)
        salted = np.uint64(size * 1000) + np.asarray(salt).astype(np.uint64)
        return [_refine(b[starts] ^ salted, b[starts + (size - part)], _MIX[i]) for i, b in enumerate(self.levels[part])]

    def of_all(self, size: int) -> np.ndarray:
        """The first stream's buckets of `size` bytes from every position that has them."""
        part = 1 << (size.bit_length() - 1)
        b = self.levels[part][0]
        k = len(b) - (size - part)
        return _refine(b[:k] ^ np.uint64(size * 1000), b[size - part :], _MIX[0])


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, from running minima of blocks in both directions."""
    n = len(v)
    blocks = np.concatenate([v, np.full(-n % w, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def anchors(pieces: list[tuple[int, int, bytes]], length: int) -> list[np.ndarray]:
    """core, row, a, lo, hi of the anchors of some pieces (row, offset in the document, bytes) of at least `length` bytes.

    An anchor at `a` is selected by the windows that start at lo to hi.
    """
    q = length // 4
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    grams = Buckets(data, q, streams=1).of_all(q)
    packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding_min(packed, length - q + 1) & _PLACE).astype(np.int64)
    sizes = np.array([len(p[2]) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    j = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    piece = np.repeat(np.arange(len(pieces)), windows)
    at = chosen[j]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])
    last = np.r_[new[1:], len(j)] - 1
    shift = np.array([p[1] for p in pieces])[piece[new]] - starts[piece[new]]
    rows = np.array([p[0] for p in pieces], np.int64)[piece[new]]
    return [grams[at[new]].view(np.int64), rows, at[new] + shift, j[new] + shift, j[last] + shift]


def _document_anchors(row: int, data: bytes, length: int) -> list[np.ndarray]:
    """The anchors of one long document; those that windows of two blocks select are put together."""
    parts = [anchors([(row, s, data[s : s + BLOCK + length - 1])], length) for s in range(0, len(data) - length + 1, BLOCK)]
    core, rows, a, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
    new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return [core[new], rows[new], a[new], lo[new], hi[np.r_[new[1:], len(a)] - 1]]


def find_anchors(rows: DataFrame, length: int) -> DataFrame:
    """core, row, a, lo, hi of every anchor of `rows` (row, text)."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(found, kinds, strict=True)], ["core", "row", "a", "lo", "hi"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                if len(data) < length:
                    continue
                if len(data) > BLOCK:
                    yield batch_of(_document_anchors(row, data, length))
                    continue
                if size + len(data) > BLOCK:
                    yield batch_of(anchors(held, length))
                    held, size = [], 0
                held.append((row, 0, data))
                size += len(data)
        if held:
            yield batch_of(anchors(held, length))

    return rows.mapInArrow(work, "core bigint, row bigint, a int, lo int, hi int")


def _blocks(data: np.ndarray, a: np.ndarray, length: int) -> Iterator[tuple[slice, int, np.ndarray]]:
    """Runs of anchors (ascending) with the bytes around them that any of their windows can have."""
    reach, i = length - length // 4 + STEP, 0
    while i < len(a):
        base = max(0, int(a[i]) - reach)
        end = int(np.searchsorted(a, base + BLOCK, side="left"))
        end = max(end, i + 1)
        yield slice(i, end), base, data[base : int(a[end - 1]) + length]
        i = end


def _nodes(level: int, data: bytes, row: int, state: list[np.ndarray], length: int) -> Iterator[dict]:
    """The nodes of one document's `state` (a, lo, hi, own) at a level: 1 anchors, 2 steps of windows, 3 windows."""
    a, lo, hi, own = state
    q, raw = length // 4, np.frombuffer(data, np.uint8)
    most = length - q  # a window starts at most so far before its anchor

    for part, base, view in _blocks(raw, a, length):
        buckets = Buckets(view, length + (most if level == 1 else STEP - 1 if level == 2 else 0))
        A, L, H, O = (x[part] for x in (a, lo, hi, own))
        if level == 3:
            n = H - L + 1
            start = np.repeat(L - (np.cumsum(n) - n), n) + np.arange(n.sum())
            wh, wl = buckets.at(start - base, length)
            yield {"core": wh, "wh": wh, "wl": wl, "whole": None, "a": np.repeat(A, n), "t": 0, "lo": start, "hi": start, "own": np.repeat(O, n)}
            continue
        # Step t holds the windows that start t * size to t * size + width bytes before their anchor.
        width = most if level == 1 else STEP - 1
        steps = np.arange(most // (width + 1) + 1) if level == 2 else np.zeros(1, np.int64)
        i, k = np.nonzero(((A - H)[:, None] <= steps * (width + 1) + width) & ((A - L)[:, None] >= steps * (width + 1)))
        am, t = A[i], steps[k]
        near = t * (width + 1)
        far = near + width
        core = buckets.at(am - near - base, length - width, t)[0] if level == 2 else buckets.at(am - base, q)[0]
        fits = (am - far >= 0) & (am - near + length <= len(raw))
        wh, wl = np.zeros((2, len(am)), np.uint64)
        if fits.any():
            wh[fits], wl[fits] = buckets.at(am[fits] - far[fits] - base, length + width, t[fits])
        yield {
            "core": core, "wh": wh, "wl": wl, "whole": fits, "a": am, "t": t,
            "lo": np.maximum(L[i], am - far), "hi": np.minimum(H[i], am - near), "own": O[i],
        }


def expand(texts: DataFrame, state: DataFrame, level: int, length: int) -> DataFrame:
    """The nodes of a level for `state` (row, a, lo, hi, own), from the stored texts of the candidates."""
    listed = state.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "lo", "hi", "own"))).alias("state"))
    joined = texts.join(listed, "row").select("row", "text", "state")

    def packed(held: list[dict]) -> pa.RecordBatch:
        arrays = []
        for name, kind in _NODE_TYPES.items():
            value = np.concatenate([n[name] for n in held])
            value = value.view(np.int64) if value.dtype == np.uint64 else value.astype(kind.to_pandas_dtype())
            absent = ~np.concatenate([n["whole"] for n in held]) if name in ("wh", "wl") and level < 3 else None
            arrays.append(pa.array(value, mask=absent))
        return pa.RecordBatch.from_arrays(arrays, list(_NODE_TYPES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, text, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                fields = state.values.flatten()
                columns = [f.to_numpy(zero_copy_only=False).astype(kind) for f, kind in zip(fields, (np.int64, np.int64, np.int64, bool), strict=True)]
                for node in _nodes(level, text.encode(), row, columns, length):
                    n = len(node["a"])
                    held.append(node | {"row": np.full(n, row), "t": np.broadcast_to(node["t"], n)})
                    size += n
                if size > NODE_BATCH:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return joined.mapInArrow(work, _NODE)


def settle(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (row, lo, hi) that a level settles, and the state of the next level with its witnesses."""
    shared = nodes.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    twins = nodes.where("wh IS NOT NULL").groupBy("wh", "wl").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "a", "t")).alias("first")).where("n > 1")
    judged = cut(
        nodes.join(shared, "core").join(twins.select("wh", "wl", "first"), ["wh", "wl"], "left"), "judged"
    )
    settled = F.col("first").isNotNull()
    spans = judged.where(settled & F.col("own")).select("row", "lo", "hi")
    open_cores = judged.where(~settled & F.col("own")).select("core").distinct()
    is_first = settled & (F.col("first") == F.struct("row", "a", "t"))
    state = judged.where(~settled | is_first).join(open_cores, "core", "left_semi")
    return spans, state.select("row", "a", "lo", "hi", (~settled & F.col("own")).alias("own"))


def repeated_windows(texts: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """row, lo, hi: runs of starts of windows that occur elsewhere too."""
    spans, state = settle(cut(expand(texts, first, 1, length), "level1"))
    more, state = settle(cut(expand(texts, cut(state, "state1"), 2, length), "level2"))
    windows = cut(expand(texts, cut(state, "state2"), 3, length).select("wh", "wl", "row", "lo", "hi", "own"), "level3")
    twice = windows.groupBy("wh", "wl").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("wh", "wl")
    last = windows.where("own").join(twice, ["wh", "wl"]).select("row", "lo", "hi")
    return spans.unionByName(more).unionByName(last)


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes from spans (lo inclusive, hi exclusive) in order of lo."""
    out: list[tuple[int, int]] = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Store `df` in buckets of `key`, so that joins on it leave these rows where they are."""
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"{label}_{uuid.uuid4().hex}", scratch_path(spark, label)
    df.write.bucketBy(count, key).option("path", path).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and the frame knows their buckets
    return stored


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Documents that lose bytes: row, spans (array of lo, hi; hi exclusive), kept (the remaining bytes)."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = stored(docs)
    place = fresh(docs, "__row")
    rows = numbered(docs, place).select(F.col(place).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = cut(find_anchors(rows, length), "anchors")
    shared = found.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    first = cut(found.join(shared, "core").select("row", "a", "lo", "hi", F.lit(True).alias("own")), "state0")
    texts = _bucketed(rows.join(first.select("row").distinct(), "row", "left_semi"), "row", "candidates")
    runs = cut(repeated_windows(texts, first, length), "runs")
    listed = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", (F.col("hi") + length).alias("hi")))).alias("runs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            spans, kept = [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.encode()
                merged = merge_spans(*(f.to_numpy() for f in runs.values.flatten()))
                ends = [0, *(x for span in merged for x in span), len(data)]
                spans.append([{"lo": a, "hi": b} for a, b in merged])
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], ["row", "spans", "kept"])

    return texts.join(listed, "row").select("row", "text", "runs").mapInArrow(work, "row bigint, spans array<struct<lo:int,hi:int>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: the id, n_bytes, n_removed, n_spans and kept_sha256. Texts are read in place, only the
    lines of documents that lose bytes are joined to them."""
    docs = stored(docs)
    place = fresh(docs, "__row")
    cuts = find_repeats(docs, id_col, text_col, length).select(
        "row", F.size("spans").cast("bigint").alias("cut_spans"), F.octet_length("kept").cast("bigint").alias("left"), F.sha2("kept", 256).alias("cut_sha")
    )
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = numbered(docs, place).select(
        F.col(place).alias("row"), F.col(id_col), F.octet_length(data).cast("bigint").alias("n_bytes"), F.sha2(data, 256).alias("sha")
    )
    return rows.join(cuts, "row", "left").select(
        id_col, "n_bytes", (F.col("n_bytes") - F.coalesce("left", "n_bytes")).alias("n_removed"),
        F.coalesce("cut_spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256"),
    )
