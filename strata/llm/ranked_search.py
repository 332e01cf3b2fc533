"""Ranked lexical search (12), reversed: the documents stream through an index over the items' terms.

1. The items' terms form an inverted index: term to (item, times). It is built for a share of the items at a time, `MOST_POSTINGS`
   postings at most, so what tasks are sent has a bound; more items take more passes. An item with more terms than
   that is a share of its own.
2. One pass over the texts gives, for every document with a term, its length and the counts of the terms of the index (no others); the
   table is stored. Sums over it are the number of documents, of terms, and each term's documents.
3. The stored counts stream through the index: a batch of documents adds each term's part to the scores of the items that ask for it. A task
   keeps a heap of the best `top` documents per item; what cannot enter a heap is sieved out by its worst entry for whole batches.
4. The heaps, `top` rows per item and task at most, are merged by item and salt, then by item.

All scores are 64-bit integers, so they do not hang on the order of the sums. Defined results: a null or empty text has no term, is no
document of the collection and no item's text; an item without terms, or whose terms no document holds, has no row; items that repeat an
id are searched each on its own (their rows repeat); documents that repeat an id are documents of their own; a null
document id comes after every other one. Empty tables give no rows. Only the columns named are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import cut, text_batches
from strata.llm.terms import terms

TOP = 20
#: Postings (term, item) of the index that is sent to tasks: about 100 bytes each with their terms.
MOST_POSTINGS = 500_000
#: Scores that a task adds up at once.
_CELLS = 1 << 21
_SALTS = 32
_LAST = 2**63 - 1


class Index:
    """Postings of some items: the term's number by its bytes, and per term the items that ask for it and how often."""

    def __init__(self, items: list[list[bytes]]):
        counts = [Counter(found) for found in items]
        self.vocabulary = {term: i for i, term in enumerate(sorted(set().union(*counts) if counts else ()))}
        pairs = sorted((self.vocabulary[term], item, times) for item, found in enumerate(counts) for term, times in found.items())
        columns = np.array(pairs, np.int64).reshape(-1, 3)
        self.items, self.times = columns[:, 1], columns[:, 2]
        self.ends = np.searchsorted(columns[:, 0], np.arange(len(self.vocabulary) + 1))
        self.n_items = len(items)


def item_shares(items: DataFrame, id_col: str, text_col: str, most: int = MOST_POSTINGS) -> Iterator[DataFrame]:
    """The items (item, text) in shares of about `most` distinct terms, each item in one share."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(set(terms(t))) for t in batch.column(1).to_pylist()], pa.int64())], [*batch.schema.names, "n"])

    kind = rows.schema["item"].dataType.simpleString()
    sized = cut(rows.mapInArrow(sizes, f"item {kind}, text string, n bigint").where("n > 0").withColumn("spot", F.xxhash64("item", "text")), "items")
    total = sized.agg(F.sum("n")).first()[0] or 0
    # Shares by hash hold `most` on average and are cut again where they hold more, so no list over all items is needed.
    shares = -(-total // most)
    for share in range(shares):
        mine = sized.where(F.pmod("spot", F.lit(shares)) == share)
        upto = F.sum("n").over(Window.orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)) if shares > 1 else F.lit(0)
        parts = mine.withColumn("part", F.floor(F.coalesce(upto, F.lit(0)) / most).cast("int"))
        last = parts.agg(F.max("part")).first()[0]
        for part in range(0 if last is None else last + 1):
            yield parts.where(F.col("part") == part).select("item", "text")


def term_counts(docs: DataFrame, index, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the document), found and times (the index's terms in it and how often, unsigned integers) of documents with a term."""
    text_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.value.vocabulary.get
        for batch in batches:
            sizes, found, times = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                sizes.append(len(words))
                at = [i for i in map(number, words) if i is not None]
                some, n = np.unique(np.array(at, np.uint32), return_counts=True)
                found.append(some.tobytes())
                times.append(n.astype(np.uint32).tobytes())
            keep = pa.array([n > 0 for n in sizes], pa.bool_())
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays([a.filter(keep) for a in arrays], ["doc_id", "n", "found", "times"])

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(work, "doc_id bigint, n bigint, found binary, times binary")


def document_frequency(counts: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the index is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    summed = counts.select("found").mapInArrow(work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # one row per term of the index at most
        out[row["term"]] = row["n"]
    return out


class _Heaps:
    """The best `top` (score, document) of every item, as heaps with the worst entry first."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, int, bool]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # scores that a full heap does not take any more lie below

    def take(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """scores: documents x items."""
        for d, i in np.argwhere(scores >= np.maximum(self.least, 1)):
            heap, entry = self.heaps[i], (int(scores[d, i]), -int(docs[d]), not null[d])
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(item, -doc if known else None, score) for item, heap in enumerate(self.heaps) for score, doc, known in heap]


def best_per_task(counts: DataFrame, index, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """place (the item's place in the index), doc_id and score of the best documents of each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = index.value
        heaps = _Heaps(asked.n_items, top)
        step = max(1, _CELLS // max(1, asked.n_items))
        for batch in batches:
            docs = batch.column(0)
            null = docs.is_null().to_numpy(zero_copy_only=False)
            ids = docs.fill_null(_LAST).to_numpy()
            m = np.array([75 + 25 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            found, times = (batch.column(i).to_pylist() for i in (2, 3))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                sizes = np.array([len(f) // 4 for f in found[part]], np.int64)
                term = np.frombuffer(b"".join(found[part]), np.uint32).astype(np.int64)
                tf = np.frombuffer(b"".join(times[part]), np.uint32).astype(np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[part][doc]))
                scores = np.zeros((len(sizes), asked.n_items), np.int64)
                # Postings a bounded number at a time: a document may hold many terms that many items ask for.
                width = asked.ends[term + 1] - asked.ends[term]
                upto = np.cumsum(width)
                lo = 0
                while lo < len(term):
                    hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _CELLS, side="right")))
                    many = width[lo:hi]
                    offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                    posting = np.repeat(asked.ends[term[lo:hi]], many) + offset
                    np.add.at(scores, (np.repeat(doc[lo:hi], many), asked.items[posting]), np.repeat(value[lo:hi], many) * asked.times[posting])
                    lo = hi
                heaps.take(scores, ids[part], null[part])
        columns = list(zip(*heaps.rows(), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "doc_id", "score"])

    return counts.mapInArrow(work, "place bigint, doc_id bigint, score bigint")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    top: int = TOP, most_postings: int = MOST_POSTINGS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's `top` best documents with a score above 0."""
    spark = docs.sparkSession
    context: SparkContext = spark.sparkContext
    out = None
    for share in item_shares(items, item_col, item_text_col, most_postings):
        rows = share.orderBy("item", "text").collect()  # bounded by `most_postings` terms or one item
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"place bigint, item_id {share.schema['item'].dataType.simpleString()}")
        index = context.broadcast(Index([terms(r["text"]) for r in rows]))
        counts = cut(term_counts(docs, index, id_col, text_col), "counts")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        frequency = document_frequency(counts, len(index.value.vocabulary))
        weight = np.array([math.floor(1000 * math.log(float(2 * n_docs + 2) / float(2 * df + 1))) for df in frequency.tolist()], np.int64)
        heaps = best_per_task(counts, index, weight, n_docs, n_terms, top).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
        best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for group in (["place", "salt"], ["place"]):
            heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*best))).where(F.col("rank") <= top)
        ranked = cut(heaps.join(names, "place").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        kind = items.schema[item_col].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out
