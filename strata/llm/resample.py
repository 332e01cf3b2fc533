"""Target-distribution importance resampling (11): array-scored weights, ranks by a distributed radix sort.

1. A document's features are its runs of `1` to `max_run` consecutive words; each falls into one of `buckets` buckets by the crc32 of
   its bytes. One pass over the texts stores the buckets of every document as an array (two bytes a feature up to 65 536 buckets);
   all that follows reads those arrays.
2. Tasks count their features per bucket in an array, Spark sums the arrays. The gain of a bucket compares its share in the target
   with its share in the documents; a document's weight is the sum of the gains that its array points at. Only the gains, one
   number per bucket, are on the driver and sent to tasks.
3. Scores (weight plus Gumbel noise from a hash of the id) are ranked by a least-significant-digit radix sort over the composite key
   (score falling, null ids last, id rising). Rows have dense positions; `BLOCK_ROWS` neighbouring positions form a block. A
   pass counts (digit, block), turns the counts into global offsets by prefix sums (over digits, then over the blocks of a digit), and
   each block sorts itself stably by the digit and gives each row its destination, which is its position in the next pass. Digits
   in which no two rows differ are left out. After the last pass a row's position is its rank less one.

A block has `BLOCK_ROWS` rows however often a key repeats, so no key is hot; what is joined to a block are its own counts. Every
pass is stored, so a lost executor costs one pass.

Defined results: words are runs of digits, letters a-z and characters beyond ASCII after lower-casing A-Z only; a null or empty text has no
feature, weight 0 and is not drawn; a null id is hashed as `null` and comes after every other id; rows that repeat an id are documents
of their own, and where their scores are equal a hash of their places in the table decides. An empty table of documents gives no rows, an empty target gives gains against
nothing. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import cut, fresh, numbered, stored, text_batches
from strata.llm.terms import terms

BUCKETS = 10_000
MAX_RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Neighbouring positions that one group of the sort takes, and the bits of a digit at most.
BLOCK_ROWS = 8192
DIGIT_BITS = 11
_MEMO = 500_000
_MOST = 2**63 - 1


class _Buckets(dict):
    """The bucket of each word met lately."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def feature_buckets(text: str | None, memo: _Buckets, max_run: int = MAX_RUN) -> tuple[int, list[int]]:
    """Number of words of a text and the buckets of its features."""
    words = terms(text)
    found = list(map(memo.__getitem__, words))
    for run in range(2, max_run + 1):
        found += [zlib.crc32(b" ".join(words[i : i + run])) % memo.buckets for i in range(len(words) - run + 1)]
    return len(words), found


def features(docs: DataFrame, keys: list[Column], text_col: str, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """The key columns with n_words, n_features and found: the buckets of the features as unsigned integers of two (or four) bytes."""
    text_batches(docs.sparkSession)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets(buckets)
        for batch in batches:
            n, sizes, found = [], [], []
            for text in batch.column(0).to_pylist():
                count, at = feature_buckets(text, memo, max_run)
                n.append(count)
                sizes.append(len(at))
                found.append(np.array(at, kind).tobytes())
            arrays = [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[1:], "n_words", "n_features", "found"])

    read = docs.select(F.col(text_col).cast("string"), *keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[1:])
    return read.mapInArrow(work, f"{schema}{', ' if keys else ''}n_words bigint, n_features bigint, found binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a table fall into each bucket."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in batch.column(0):
                total += np.bincount(np.frombuffer(at.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = found.where("n_features > 0").select("found").mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.collect():  # one row per bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over its share in the source, one feature added to each bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array(
        [math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets)))) for s, t in pairs], np.int64
    )


def noise(id_col: Column, seed: str) -> Column:
    """Thousandths of a Gumbel number from the first eight hex digits of sha256(`seed:id`)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """`found` with weight in place of the buckets."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(at.as_buffer(), kind)].sum()) for at in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(weight, pa.int64())], [*batch.schema.names[1:], "weight"])

    rest = [c for c in found.columns if c != "found"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*rest).schema.fields)
    return found.select("found", *rest).mapInArrow(work, f"{schema}, weight bigint")


def _digits(name: str, bits: int) -> list[Column]:
    """A key's `bits` low bits as digits of about equal width, least significant first."""
    passes = -(-bits // DIGIT_BITS)
    edges = [bits * i // passes for i in range(passes + 1)] if passes else []
    return [
        F.shiftrightunsigned(F.col(name), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).cast("int")
        for lo, hi in zip(edges, edges[1:], strict=False)
    ]


def radix_ranks(rows: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A stored table `rows` with `rank` (1, 2, 3...) in the order of the bigint `keys`, the first counting most; equal keys in any order.

    `rows` needs a bigint `row` that differs between rows; negative keys come before others.
    """
    signed = {k: F.col(k).bitwiseXOR(F.lit(-_MOST - 1)) for k in keys}  # order as unsigned numbers
    bits = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.bit_or(k).bitwiseXOR(F.bit_and(k)).alias(k) for k in keys],
    ).first()
    if not bits["n"]:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    widths = {k: (bits[k] & (2**64 - 1)).bit_length() for k in keys}
    digits = [(k, i) for k in reversed(keys) for i in range(len(_digits(k, widths[k])))]
    # The first positions come from a hash of the row, so blocks are even whatever the keys; only the order of equal keys hangs on them.
    blocks = -(-bits["n"] // block_rows)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("pos", F.col("row"))
    own_columns = list(range(len(rows.columns)))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    for key, i in digits or [(keys[0], None)]:
        digit = F.lit(0) if i is None else _digits("__key", widths[key])[i]
        keyed = placed.withColumn("__key", signed[key]).withColumn("digit", digit).drop("__key")
        offsets = _offsets(keyed.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")))

        def work(block: pa.Table, starts: pa.Table) -> pa.Table:
            digit, pos = block.column("digit").to_numpy(), block.column("pos").to_numpy()
            order = np.lexsort((pos, digit))
            by = np.argsort(starts.column("digit").to_numpy())
            own, counts = np.unique(digit, return_counts=True)
            start = starts.column("start").to_numpy()[by]
            dest = np.empty(len(digit), np.int64)
            dest[order] = np.arange(len(digit)) + np.repeat(start - (np.cumsum(counts) - counts), counts)
            return block.select(own_columns).append_column("pos", pa.array(dest)) if len(own) else block.slice(0, 0)

        moved = keyed.groupBy("block").cogroup(offsets.groupBy("block")).applyInArrow(work, f"{types}, pos bigint")
        placed = cut(moved, "radix").withColumn("block", F.expr(f"pos DIV {block_rows}"))
    return placed.withColumn("rank", F.col("pos") + 1).drop("pos", "block")


def _offsets(counts: DataFrame) -> DataFrame:
    """block, digit, start: where the rows of a digit in a block go, from counts (block, digit, n)."""
    counts = cut(counts, "counts")
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # one row per digit, 2048 at most
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    first = totals.select("digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("block", "digit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("inside"))
    return inside.join(first, "digit").select("block", "digit", (F.col("first") + F.col("inside")).alias("start"))


def scores(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: str = SEED,
) -> DataFrame:
    """One stored row per document: row (`common.numbered`), doc_id, n_words, n_features, weight, score."""
    docs = stored(docs)
    row = fresh(docs, "__row")
    keys = [F.col(row).alias("row"), F.col(id_col).cast("bigint").alias("doc_id")]
    found = cut(features(numbered(docs, row), keys, text_col, buckets, max_run), "features")
    wanted = bucket_counts(features(target, [], target_col, buckets, max_run), buckets)
    gain = gains(bucket_counts(found, buckets), wanted)
    return cut(weighted(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, max_run: int = MAX_RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """One row per document: row, doc_id, n_words, n_features, weight, score and rank, null for those that are not drawn.

    `percent` of the documents with at least `least_words` words are drawn, rounded down, by highest score, ties to the smaller id.
    """
    scored = scores(docs, target, id_col, text_col, target_col, buckets, max_run, seed)
    enough = F.col("n_words") >= least_words
    found = scored.where(enough).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")).first()
    rows = scored.where(enough).select(
        "*", (F.lit(found["top"]).cast("bigint") - F.col("score")).alias("falling"), F.col("doc_id").isNull().cast("bigint").alias("none"),
        F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("rising"),
    )
    ranked = radix_ranks(rows, ["falling", "none", "rising"]).drop("falling", "none", "rising")
    quota = percent * found["n"] // 100
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint")))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents themselves, with all their columns."""
    docs = stored(docs)
    row = fresh(docs, "__row")
    chosen = resample(docs, target, id_col, text_col, **options).where("rank IS NOT NULL").select(F.col("row").alias(row))
    return numbered(docs, row).join(chosen, row, "left_semi").drop(row)
