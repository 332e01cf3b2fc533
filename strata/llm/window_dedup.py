"""Substring dedup (13): windows of words, sieved by a count-min sketch and grouped exactly.

A window is `window` consecutive words of one document. Each word goes that is covered by a window whose words also start in a document with a
smaller id.

1. Every window has a key gram: the run of half its words with the least hash value of those in it. Equal windows have equal key grams, and
   neighbouring windows mostly share one, so a document of n words has about n / 13 distinct ones (window 50). One pass
   over the texts stores them.
2. Tasks count their documents' key grams in a count-min sketch of `ROWS` rows, the sketches are merged cell by cell. The count of a
   window's key gram is at least the number of documents that hold the window, so no repeated window is lost; a
   cell needs to know only none, one, or more. A row has four cells per key gram, up to `CELLS`; more key grams are dealt by hash into slices
   of `CELLS` / 4, and each slice has its own sketch, so sketches do not fill up as the input grows.
3. A second pass over the texts gives the windows whose key gram is estimated in two or more documents, by a 128-bit fingerprint. While
   there is one slice, tasks take its merged sketch with them (`CELLS` / 8 bytes a row at most, 64 MB in all); with more, a document's
   repeated key grams are joined to it by its row, which costs a shuffle of the texts.
4. These windows are ranged by (fingerprint, document id) and sorted, which puts the document that a window starts in first before its
   other rows; bounds lie inside a fingerprint that has many rows, so no key is hot. A task drops what it sees behind a smaller
   id; rows of the fingerprint that its range begins with are settled against the ends of the ranges before.
5. Windows to drop become runs per row, which are joined to the texts.

The fingerprint is a polynomial over word digests (BLAKE2b, keyed) modulo 2**64 with two odd bases; two different windows agree in all 128
bits with a chance below 2**-80 or so each. Everything else is exact, and the sketch changes work only, never results.

Defined results: words are runs without the six ASCII blanks, unchanged; a null text has none; a text of fewer words than a window keeps all;
a null id is not smaller than any id, and a row with a null id keeps all its words; rows that repeat an id are no smaller than one another; windows
that repeat inside one document only stay. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import batch_rows, cut, fresh, numbered, stored, text_batches

WINDOW = 50
ROWS = 2
CELLS = 1 << 28
#: Cells of a part of a sketch that tasks hand on, and rows of a batch of numbers.
_BLOCK = 1 << 22
_BATCH = 1 << 16
#: Words of a document that are hashed at once; bounds a worker's memory for very long texts.
CHUNK_WORDS = 1 << 18
#: Rows that one range of windows has on average.
RANGE_ROWS = 500_000
_MEMO = 500_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Words(dict):
    """Number of each word met lately; `digest` holds its two hash values by number."""

    def __init__(self) -> None:
        super().__init__()
        self.digest, self.new = np.empty((1 << 16, 2), np.uint64), []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.new.append(hashlib.blake2b(word, digest_size=16, key=b"window").digest())
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        """The hash values of words, two lines."""
        if len(self) > _MEMO:
            self.clear()
        known = len(self)
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            while len(self) > len(self.digest):
                self.digest = np.concatenate([self.digest, np.empty_like(self.digest)])
            self.digest[known : len(self)] = np.frombuffer(b"".join(self.new), np.uint64).reshape(-1, 2)
            self.new = []
        return np.ascontiguousarray(self.digest[number].T)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Hash values of all runs of a length, by differences of sums over powers of an odd base."""

    def __init__(self, base: int):
        self.up, self.down = _powers(base, CHUNK_WORDS + 1), _powers(pow(base, -1, 1 << 64), CHUNK_WORDS + 1)

    def runs(self, digest: np.ndarray, length: int) -> np.ndarray:
        n = len(digest)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(digest * self.up[:n], out=total[1:])
        return (total[length:] - total[:-length]) * self.down[: n - length + 1]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


class Block(NamedTuple):
    """Windows of some texts: the text's number, the window's first word in it, its key gram and place in `digest`, the hash values of all words."""

    text: np.ndarray
    at: np.ndarray
    grams: np.ndarray
    place: np.ndarray
    digest: np.ndarray


class Windows:
    """Fingerprints and key grams of the windows of texts, with a memo of word digests."""

    def __init__(self, window: int):
        self.window, self.key = window, max(1, window // 2)
        self.words, self.hashers = _Words(), [_Hasher(b) for b in _BASES]

    def _least(self, grams: np.ndarray) -> np.ndarray:
        """The least of each window's grams, by doubling."""
        span, wide, out = self.window - self.key + 1, 1, grams
        while 2 * wide <= span:
            out = np.minimum(out[:-wide], out[wide:])
            wide *= 2
        rest = span - wide
        return np.minimum(out[:-rest], out[rest:]) if rest else out

    def blocks(self, texts: list[str | None]) -> Iterator[Block]:
        """The windows of all texts, about `CHUNK_WORDS` words at a time; a longer text goes over several blocks."""
        parts: list[tuple[int, int, list[bytes]]] = []
        size = 0
        for number, text in enumerate(texts):
            words = text.encode().split() if text else []
            for start in range(0, len(words) - self.window + 1, CHUNK_WORDS - self.window + 1):
                part = words[start : start + CHUNK_WORDS]
                if size + len(part) > CHUNK_WORDS:
                    yield self._block(parts)
                    parts, size = [], 0
                parts.append((number, start, part))
                size += len(part)
        if parts:
            yield self._block(parts)

    def _block(self, parts: list[tuple[int, int, list[bytes]]]) -> Block:
        digest = self.words.of([w for _, _, words in parts for w in words])
        sizes = np.array([len(words) for _, _, words in parts])
        begins = np.cumsum(sizes) - sizes
        counts = sizes - self.window + 1
        # Windows that lie in one text.
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = np.repeat(begins, counts) + inside
        grams = self._least(_mixed(self.hashers[0].runs(digest[0], self.key)))[place]
        text = np.repeat([number for number, _, _ in parts], counts)
        at = np.repeat([start for _, start, _ in parts], counts) + inside
        return Block(text, at, grams, place, digest)

    def fingerprints(self, block: Block, some: np.ndarray) -> list[np.ndarray]:
        """The two fingerprints of some windows of a block."""
        return [h.runs(d, self.window)[block.place[some]] for h, d in zip(self.hashers, block.digest, strict=True)]


def key_grams(rows: DataFrame, window: int) -> DataFrame:
    """row, gram: the distinct key grams of each of `rows` (row, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window)
        for batch in batches:
            row = batch.column(0).to_numpy()
            for block in windows.blocks(batch.column(1).to_pylist()):
                new = np.append(True, (block.grams[1:] != block.grams[:-1]) | (block.text[1:] != block.text[:-1]))
                text, gram = block.text[new], block.grams[new]
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
                one = np.append(True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(row[text[one]]), pa.array(gram[one].view(np.int64))], ["row", "gram"])

    return rows.select("row", "text").mapInArrow(work, "row bigint, gram bigint")


def _cells(grams: np.ndarray, cells: int, slices: int) -> list[np.ndarray]:
    """The cell of each gram in each row of the sketch of its slice."""
    rest = grams.view(np.uint64) // np.uint64(slices)
    return [(_mixed(rest * np.uint64(2 * i + 1) + np.uint64(i)) & np.uint64(cells - 1)).astype(np.int64) for i in range(ROWS)]


def _mark(seen: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    """Count cells in two bitmaps."""
    cell, n = np.unique(at, return_counts=True)
    for cells, several in ((cell, False), (cell[n > 1], True)):
        if len(cells):
            byte, bit = cells >> 3, (128 >> (cells & 7)).astype(np.uint8)
            edge = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            byte, bits = byte[edge], np.bitwise_or.reduceat(bit, edge)
            twice[byte] |= bits if several else seen[byte] & bits
            seen[byte] |= bits


def sketch(grams: DataFrame, cells: int, slices: int) -> np.ndarray:
    """The merged sketch of the grams of one slice: one bit per cell, set where two or more documents fall into it."""
    block = min(_BLOCK, cells) // 8
    schema = "block bigint, seen binary, twice binary"
    pack, unpack = (lambda a: zstandard.compress(a.tobytes(), 1)), (lambda b: np.frombuffer(zstandard.decompress(b), np.uint8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros((2, ROWS, cells // 8), np.uint8)
        for batch in batches:
            for line, at in enumerate(_cells(batch.column(0).to_numpy(), cells, slices)):
                _mark(seen[line], twice[line], at)
        seen, twice = seen.reshape(-1, block), twice.reshape(-1, block)
        for at in np.flatnonzero(seen.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pack(seen[at])], pa.binary()), pa.array([pack(twice[at])], pa.binary())], ["block", "seen", "twice"])

    def merge(table: pa.Table) -> pa.Table:
        seen, twice = np.zeros((2, block), np.uint8)
        for one, two in zip(table.column("seen").to_pylist(), table.column("twice").to_pylist(), strict=True):
            one = unpack(one)
            twice |= unpack(two) | (seen & one)
            seen |= one
        return pa.table({"block": table.column("block")[:1], "seen": pa.array([pack(seen)], pa.binary()), "twice": pa.array([pack(twice)], pa.binary())})

    parts = grams.select("gram").mapInArrow(count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(8)))
    whole = parts.groupBy("block", "salt").applyInArrow(merge, schema).groupBy("block").applyInArrow(merge, schema)
    bits = np.zeros((ROWS * (cells // 8) // block, block), np.uint8)
    with batch_rows(grams.sparkSession, _BATCH):
        for row in whole.select("block", "twice").toLocalIterator():  # ROWS * cells / 8 bytes at most, whatever the input
            bits[row["block"]] = unpack(row["twice"])
    return bits.reshape(ROWS, -1)


def repeated(grams: np.ndarray, bits: np.ndarray, slices: int = 1) -> np.ndarray:
    """Which grams the sketch estimates in two or more documents."""
    out = np.ones(len(grams), bool)
    for line, at in zip(bits, _cells(grams, bits.shape[1] * 8, slices), strict=True):
        out &= (line[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def repeated_grams(grams: DataFrame, cells: int, slices: int) -> DataFrame:
    """row, grams (binary): the key grams of each row that are estimated repeated, sorted; slice by slice."""
    spark = grams.sparkSession
    # A slice's folder is read alone; its grams are dealt over tasks by row.
    dealt = cut(grams.withColumn("slice", F.pmod("gram", F.lit(slices)).cast("int")).repartitionByRange("slice", "row"), "slices")
    kept = None
    for i in range(slices):
        mine = dealt.where(F.col("slice") == i)
        bits = spark.sparkContext.broadcast(sketch(mine, cells, slices))

        def sieve(batches: Iterator[pa.RecordBatch], bits=bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(repeated(batch.column(1).to_numpy(), bits.value, slices)))

        with batch_rows(spark, _BATCH):
            part = cut(mine.select("row", "gram").mapInArrow(sieve, "row bigint, gram bigint"), "repeated")
        kept = part if kept is None else kept.unionByName(part)
        bits.unpersist()
    return kept.groupBy("row").agg(F.sort_array(F.collect_list("gram")).alias("grams"))  # bounded by the document


def _pairs(text: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """(text, gram) as values that can be compared and sorted."""
    out = np.empty(len(text), [("text", np.int64), ("gram", np.int64)])
    out["text"], out["gram"] = text, gram
    return out


def candidates(rows: DataFrame, window: int, bits: np.ndarray | None) -> DataFrame:
    """hi, lo (the fingerprint), doc_id, row, at of the windows whose key gram is estimated repeated.

    `rows` has doc_id, row, text and, without `bits`, the row's repeated grams.
    """
    context: SparkContext = rows.sparkSession.sparkContext
    sent = None if bits is None else context.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window)
        for batch in batches:
            doc, row = (batch.column(i).to_numpy() for i in (0, 1))
            known = None
            if sent is None:
                lists = batch.column(3)
                known = _pairs(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy())
            for block in windows.blocks(batch.column(2).to_pylist()):
                if sent is not None:
                    keep = repeated(block.grams, sent.value)
                else:
                    # A text holds a repeated gram under its own row only.
                    new = np.append(True, (block.grams[1:] != block.grams[:-1]) | (block.text[1:] != block.text[:-1]))
                    some = np.isin(_pairs(block.text[new], block.grams[new].view(np.int64)), known)
                    keep = np.repeat(some, np.diff(np.append(np.flatnonzero(new), len(new))))
                at = np.flatnonzero(keep)
                if len(at):
                    prints = [pa.array(f.view(np.int64)) for f in windows.fingerprints(block, at)]
                    text = block.text[at]
                    yield pa.RecordBatch.from_arrays([*prints, pa.array(doc[text]), pa.array(row[text]), pa.array(block.at[at])], ["hi", "lo", "doc_id", "row", "at"])

    columns = ["doc_id", "row", "text"] + (["grams"] if sent is None else [])
    return rows.select(*columns).mapInArrow(work, "hi bigint, lo bigint, doc_id bigint, row bigint, at bigint")


def later_windows(found: DataFrame) -> DataFrame:
    """row, at of the windows of a stored table of candidates that also start in a document with a smaller id."""
    parts = max(1, -(-found.count() // RANGE_ROWS))
    ranged = found.repartitionByRange(parts, "hi", "lo", "doc_id").sortWithinPartitions("hi", "lo", "doc_id")
    schema = "hi bigint, lo bigint, doc_id bigint, row bigint, at bigint, kind int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: to drop. 1: the first id of the fingerprint that the range begins with, not settled yet. 2: the last fingerprint and its first id."""
        first, last, least = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, doc = (batch.column(i).to_numpy() for i in range(3))
            if first is None:
                first = (hi[0], lo[0])
            new = np.empty(len(hi), bool)
            new[0] = (hi[0], lo[0]) != last
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(hi)), -1))
            smallest = np.where(begin >= 0, doc[np.maximum(begin, 0)], least)
            drop = doc > smallest
            unsettled = ~drop & (hi == first[0]) & (lo == first[1])
            last, least = (hi[-1], lo[-1]), smallest[-1]
            for kind, keep in enumerate((drop, unsettled)):
                if keep.any():
                    part = batch.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, kind, np.int32))], [*batch.schema.names, "kind"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in (*last, least, 0, 0)] + [pa.array([2], pa.int32())], ["hi", "lo", "doc_id", "row", "at", "kind"])

    with batch_rows(found.sparkSession, _BATCH):
        judged = cut(ranged.mapInArrow(work, schema), "judged")
    # One row per range at most; and of the open rows only those of one id per range.
    ends = judged.where("kind = 2").groupBy("hi", "lo").agg(F.min("doc_id").alias("smallest"))
    late = judged.where("kind = 1").join(ends, ["hi", "lo"]).where("smallest < doc_id")
    return judged.where("kind = 0").select("row", "at").unionByName(late.select("row", "at"))


def spans(later: DataFrame, window: int) -> DataFrame:
    """row, spans: runs of words (lo, hi; hi exclusive) that windows cover, in order; runs may touch."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + window)]))
                last = np.concatenate([first[1:], [len(row)]]) - 1
                yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(at[first]), pa.array(at[last] + window)], ["row", "lo", "hi"])

    # Ranges by place as well, so that a document with many repeated windows is not one task's.
    ordered = later.repartitionByRange("row", "at").sortWithinPartitions("row", "at")
    found = ordered.mapInArrow(runs, "row bigint, lo bigint, hi bigint")
    return found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def find_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cells: int = CELLS) -> DataFrame:
    """row (`common.numbered`), spans of the documents of a stored table that lose words, as a stored table."""
    place = fresh(docs, "__row")
    rows = numbered(docs, place).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(place).alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL")
    grams = cut(key_grams(rows, window), "grams")
    n = grams.count()
    slices = max(1, -(-n // (cells // 4)))
    if slices == 1:
        found = candidates(rows, window, sketch(grams, min(cells, max(1 << 10, 1 << (4 * n).bit_length())), 1))
    else:
        found = candidates(rows.join(repeated_grams(grams, cells, slices), "row"), window, None)
    later = later_windows(cut(found, "windows"))
    with batch_rows(docs.sparkSession, _BATCH):
        return cut(spans(later, window), "spans")


def remove_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cells: int = CELLS) -> DataFrame:
    """One row per document: row, doc_id, n_words, n_removed and kept (the words that stay, joined by one space)."""
    text_batches(docs.sparkSession)
    docs = stored(docs)
    lost = find_windows(docs, id_col, text_col, window, cells)
    place = fresh(docs, "__row")
    rows = numbered(docs, place).select(F.col(place).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, removed = [], [], []
            for text, cuts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.encode().split() if text else []
                left, upto = [], 0
                for span in cuts or ():
                    left += words[upto : span["lo"]] if span["lo"] > upto else []
                    upto = max(upto, span["hi"])
                left += words[upto:]
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            arrays = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], ["row", "doc_id", "n_words", "n_removed", "kept"])

    # A merge join at any number of spans, so that the plan does not change with the size.
    joined = rows.join(lost.hint("merge"), "row", "left").select("row", "doc_id", "text", "spans")
    return joined.mapInArrow(work, "row bigint, doc_id bigint, n_words bigint, n_removed bigint, kept string")
