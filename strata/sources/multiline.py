"""Delimited text whose quoted fields hold line ends, read by as many tasks as a file has splits.

Whether a line end stands inside quotes hangs on all quotes before it, but only on whether their number is odd. So one pass over the
lines, split by split, says for each line what it is if the split begins outside quotes and what it is if it begins inside: the
parity of the quotes before it in the split, and the line its record starts at in either case. The splits of a file are few; a prefix sum over their
parities fixes how each begins, and which record goes on from the split before. After that a line that is a whole record is one
without any shuffle, and only the lines of records of several lines are brought together.

The pass is stored, so what follows does not hang on how a later scan would be split. Quotes that do not stand at the ends of a field, and
lone carriage returns, are left to the reader that takes a file in one task: `read_records` gives None then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.session import cut, is_empty

_KEYS = ["file", "split"]


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte), line (from 0 in the split), value, odd (its quotes), inside (parity before it), and the line that its
    record starts at if the split begins outside (`from0`) or inside quotes (`from1`); -1 where that lies before the split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    meta = lines.metadataColumn("_metadata")
    rows = lines.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), "value")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, parity, starts = None, 0, 0, [-1, -1]
        for batch in batches:
            if not batch.num_rows:
                continue
            file, split = batch.column(0), batch.column(1).to_numpy()
            other = np.flatnonzero(split[1:] != split[:-1]) + 1
            other = {*other.tolist(), *(np.flatnonzero(pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()}
            edges = [0, *sorted(other), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if (part.column(0)[0].as_py(), int(split[lo])) != now:
                    now, line, parity, starts = (part.column(0)[0].as_py(), int(split[lo])), 0, 0, [-1, -1]
                odd = pc.count_substring(part.column(2), '"').to_numpy().astype(np.int64) & 1
                upto = np.cumsum(odd) + parity
                inside = (upto - odd) & 1
                number = np.arange(line, line + len(odd))
                found = []
                for state in (0, 1):
                    at = np.maximum.accumulate(np.where(inside == state, number, starts[state]))
                    found.append(pa.array(at))
                    starts[state] = int(at[-1])
                line, parity = line + len(odd), int(upto[-1]) & 1
                arrays = [*part.columns[:2], pa.array(number), part.column(2), pa.array(odd), pa.array(inside), *found]
                yield pa.RecordBatch.from_arrays(arrays, ["file", "split", "line", "value", "odd", "inside", "from0", "from1"])

    return rows.mapInArrow(work, "file string, split bigint, line bigint, value string, odd bigint, inside bigint, from0 bigint, from1 bigint")


def split_states(lines: DataFrame) -> DataFrame:
    """Per split: begins (0 outside quotes, 1 inside), the record that goes on from before (`over_split`, `over_line`), the place of
    its file's header, and whether that ends with a carriage return (`crlf`)."""
    filled = F.rtrim(F.regexp_replace("value", "\r$", "")) != ""
    ends = lines.groupBy(*_KEYS).agg(
        F.sum("odd").alias("odd"), F.max("from0").alias("last0"), F.max("from1").alias("last1"), F.min(F.when(filled, F.struct("line", F.col("value").endswith("\r").alias("crlf")))).alias("first"),
    )
    by_file = Window.partitionBy("file")
    before = by_file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begun = ends.withColumn("begins", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    last = F.when(F.col("begins") == 0, F.col("last0")).otherwise(F.col("last1"))
    begun = begun.withColumn("opened", F.when(last >= 0, F.struct("split", last.alias("line"))))
    over = F.last("opened", ignorenulls=True).over(before)
    header = F.min(F.when(F.col("first").isNotNull(), F.struct("split", F.col("first.line").alias("line"), F.col("first.crlf").alias("crlf")))).over(by_file)
    return begun.withColumns({"over": over, "header": header}).select(
        *_KEYS, "begins", F.col("over.split").alias("over_split"), F.col("over.line").alias("over_line"),
        F.col("header.split").alias("header_split"), F.col("header.line").alias("header_line"), F.col("header.crlf").alias("crlf"),
    )


def records(lines: DataFrame) -> DataFrame:
    """file, is_header and text of the records of a stored table of `split_lines`; empty lines are none."""
    states = cut(split_states(lines), "splits")
    placed = lines.join(states, _KEYS)
    start = F.when(F.col("begins") == 0, F.col("from0")).otherwise(F.col("from1"))
    placed = placed.select(
        "file", "split", "line", "value", "header_split", "header_line", "crlf",
        F.when(start < 0, F.col("over_split")).otherwise(F.col("split")).alias("from_split"),
        F.when(start < 0, F.col("over_line")).otherwise(start).alias("from_line"),
        ((F.col("begins") + F.col("inside")) % 2 == 0).alias("begun"), (F.col("odd") == 0).alias("even"),
    )
    alone = placed.where("begun AND even")
    several = placed.where("NOT (begun AND even)").groupBy("file", "from_split", "from_line", "header_split", "header_line", "crlf").agg(
        F.sort_array(F.collect_list(F.struct("split", "line", "value"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    is_header = ((F.col("from_split") == F.col("header_split")) & (F.col("from_line") == F.col("header_line"))).alias("is_header")
    both = alone.select("file", is_header, "crlf", "value").unionByName(several.select("file", is_header, "crlf", text.alias("value")))
    # As the reader of one task has it: where lines end with CR LF, so do those inside fields, and both become LF.
    value = F.when(F.col("crlf"), F.replace("value", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("value"))
    record = F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value)
    return both.select("file", "is_header", record.alias("text")).where("text <> ''")


def is_plain(text: Column, sep: str) -> Column:
    """Whether the quotes of a record enclose whole fields and no carriage return stands outside of them."""
    parts = F.split(F.replace(text, F.lit('""'), F.lit("")), '"', -1)
    outside = F.filter(parts, lambda _, i: i % 2 == 0)
    n = F.size(outside)

    def fits(part: Column, i: Column) -> Column:
        opened = (i == n - 1) | part.endswith(sep) | ((i == 0) & (part == ""))
        closed = (i == 0) | part.startswith(sep) | ((i == n - 1) & (part == ""))
        return opened & closed & ~part.contains("\r")

    misfits = F.filter(outside, lambda part, i: ~fits(part, i))
    return (F.size(parts) % 2 == 1) & (F.size(misfits) == 0)


def read_records(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame, str] | None:
    """The records of delimited files with a header, without it (column text), and the header of the first file."""
    found = records(cut(split_lines(spark, path), "lines"))
    odd = found.where((F.col("text").contains('"') | F.col("text").contains("\r")) & ~is_plain(F.col("text"), sep))
    if not is_empty(odd):
        return None
    header = found.where("is_header").orderBy("file").select("text").first()
    return None if header is None else (found.where("NOT is_header").select("text"), header["text"])
