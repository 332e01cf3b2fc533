"""Best-fit packing (7): the plan is made over counts of lengths, and documents join it by rank.

1. Tasks encode documents and cut those that are longer than a sequence. A piece's record holds its
   length and its rank among the pieces of that length in its task; records are stored once.
2. The counts per length (at most `size` numbers) go to the driver, which runs best-fit decreasing over
   counts: a run of sequences with equal room left is one entry, so the plan's size depends on the
   sequence length and not on the number of documents.
3. The tasks' counts per length are added up in order of the tasks, which turns ranks in a task into ranks in the
   table without ordering a length in one place; a piece takes the slot with its length and rank.

Defined results: a null or empty text is the end id alone; a text longer than a sequence is cut
into full pieces, the first piece takes the remainder; rows that repeat an id are packed each on
its own; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import cut, text_batches
from strata.llm.tokens import DEFAULT_TOKENIZER, END_ID, encoder

SEQUENCE = 1024
#: One slot run of a plan: pieces of `length` with ranks from `rank` on take `count` sequences from `sequence` on, all at `offset`.
SLOT = np.dtype([("length", "i8"), ("rank", "i8"), ("count", "i8"), ("sequence", "i8"), ("offset", "i8")])


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Best-fit decreasing over counts per length; the slot runs in order of (length, rank).

    A sequence that has taken a piece and still has room for another of that length is the tightest
    fit for the next one, so a sequence takes all it can before the next of the run is touched.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, count)
    rooms: list[int] = []  # the rooms that have runs, ascending
    slots: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in runs:
                rooms.insert(bisect_left(rooms, room), room)
                runs[room] = []
            runs[room].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = size, opened
                count = -(-left // (size // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            taken = [(full, each)] if full else []
            if full < count and left - full * each:
                taken.append((1, left - full * each))
            for n, pieces in taken:
                for k in range(pieces):
                    slots.append((length, rank, n, first, size - room + k * length))
                    rank += n
                left -= n * pieces
                give(room - pieces * length, first, n)
                first, count = first + n, count - n
            give(room, first, count)
    return np.sort(np.array(slots, SLOT), order=["length", "rank"])


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, and its task and rank among the task's pieces of that length."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer).encode, TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = min((n - start) % size or size, n - start)
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    out.append((doc, piece, start, length, crc, task, seen[length]))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names) if out else empty

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names)
    return rows.mapInArrow(cut_up, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, task_rank bigint")


def assign(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """`pieces` (a stored table) with sequence_id and offset."""
    per_task = cut(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(counts, size)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint")).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("task_rank")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.searchsorted(plan["length"], np.arange(size + 2))
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            slot = np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine, (lo, hi) = length == n, firsts[n : n + 2]
                slot[mine] = lo + np.searchsorted(plan["rank"][lo:hi], rank[mine], side="right") - 1
            run = plan[slot]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run["sequence"] + rank - run["rank"]), pa.array(run["offset"])],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """One row per piece of every document with its place in a sequence of at most `size` tokens."""
    return assign(cut(pieces_of(docs, id_col, text_col, tokenizer, size), "pieces"), size)
