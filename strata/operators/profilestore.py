"""Column profiles that follow new data: sketches per file in a stored table, merged on reading.

Each file of a Parquet folder is scanned once, when it is first seen; what is kept of it is a row per column with counts, the smallest and largest text, a
HyperLogLog sketch of the values, a KLL sketch of numbers and the heavy hitters. A profile merges the rows of the files that the folder has now, so
files that went are no longer counted, and a file that was written anew under its old name is scanned again.

Examples are the values that a sketch of 1000 tracked values finds most often.

Bounds: distinct values within 3 % (HyperLogLog of 2**14 registers, standard error 0.7 %), quantiles within 1.5 % of the rows in rank
(KLL, k = 400), at 99 % confidence and more. Rows, non-nulls, texts and flags are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.values import value_text
from strata.operators.profile import EMAIL, PHONE
from strata.session import path_exists

REGISTERS = 14
KLL_K = 400
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.015
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
EXAMPLES, TRACKED = 5, 1000
#: Characters of a value that its example shows; longer values are told apart whole by the distinct count.
EXAMPLE_CHARS = 60
STORE_SCHEMA = (
    "file string, changed timestamp, bytes bigint, column_name string, n_rows bigint, n_present bigint, min_text string, max_text string, "
    "pii boolean, hll binary, kll binary, top struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"
)


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, changed and bytes of the files of a Parquet folder that hold rows; no column is read."""
    df = spark.read.parquet(folder)
    meta = df.metadataColumn("_metadata")
    return df.select(meta["file_path"].alias("file"), meta["file_modification_time"].alias("changed"), meta["file_size"].alias("bytes")).distinct()


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _sketches(df: DataFrame, name: str) -> list[Column]:
    dtype = df.schema[name].dataType
    text = value_text(F.col(f"`{name}`"), dtype)
    pii = text.rlike(EMAIL) | (text.rlike(PHONE) & ~text.rlike(r"^[0-9.+-]+$"))
    number = F.col(f"`{name}`").cast("double") if _is_number(dtype) else F.lit(None).cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return [
        F.count(F.lit(1)).alias("n_rows"), F.count(text).alias("n_present"), F.min(text).alias("min_text"), F.max(text).alias("max_text"),
        F.coalesce(F.bool_or(pii), F.lit(False)).alias("pii"), F.hll_sketch_agg(text, REGISTERS).alias("hll"), F.kll_sketch_agg_double(finite, KLL_K).alias("kll"),
        F.call_function("approx_top_k_accumulate", F.substring(text, 1, EXAMPLE_CHARS), F.lit(TRACKED)).alias("top"),
    ]


def sketch_files(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row of `STORE_SCHEMA` per file and column of a Parquet scan, in one pass."""
    names = columns or df.columns
    meta = df.metadataColumn("_metadata")
    keyed = df.select(
        meta["file_path"].alias("_file"), meta["file_modification_time"].alias("_changed"), meta["file_size"].alias("_bytes"), *[F.col(f"`{c}`") for c in names]
    )
    # A row per file: all columns' sketches beside each other, then one row per column.
    wide = keyed.groupBy("_file", "_changed", "_bytes").agg(*[F.struct(*_sketches(keyed, c)).alias(f"s{i}") for i, c in enumerate(names)])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("s")) for i, c in enumerate(names)])
    return wide.select(
        F.col("_file").alias("file"), F.col("_changed").alias("changed"), F.col("_bytes").cast("bigint").alias("bytes"), F.explode(entries).alias("e")
    ).select("file", "changed", "bytes", "e.column_name", "e.s.*")


def refresh(spark: SparkSession, folder: str, store: str, columns: list[str] | None = None) -> list[str]:
    """Scan the files of a folder that the store does not know yet and add their sketches; the paths of those files.

    The list has one path per new file, which the scan's own plan holds as well.
    """
    files = folder_files(spark, folder)
    if path_exists(spark, store):
        known = spark.read.schema(STORE_SCHEMA).parquet(store).select("file", "changed", "bytes").distinct()
        files = files.join(known, ["file", "changed", "bytes"], "left_anti")
    new = sorted(r["file"] for r in files.select("file").collect())
    if new:
        sketch_files(spark.read.parquet(*new), columns).write.mode("append").parquet(store)
    return new


def profile(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """Per column of the folder as it is now: counts, distinct values (estimate), smallest and largest text, pii,
    quantiles of numbers, and the most frequent values as examples.

    A file whose scan was written twice, as after a lost driver, counts once.
    """
    held = spark.read.schema(STORE_SCHEMA).parquet(store).join(folder_files(spark, folder), ["file", "changed", "bytes"], "left_semi")
    once = held.groupBy("file", "column_name").agg(F.max_by(F.struct("n_rows", "n_present", "min_text", "max_text", "pii", "hll", "kll", "top"), "changed").alias("s"))
    merged = once.select("column_name", "s.*").groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_present").alias("n_present"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"),
        F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"), F.bool_or("pii").alias("pii"), F.kll_merge_agg_double("kll").alias("kll"),
        F.call_function("approx_top_k_estimate", F.call_function("approx_top_k_combine", F.col("top")), F.lit(EXAMPLES + 1)).alias("top"),
    )
    numbers = F.kll_sketch_get_n_double("kll") > 0
    return merged.select(
        "column_name", "n_rows", "n_present", "n_distinct", "min_text", "max_text", "pii",
        F.when(numbers, F.array(*[F.kll_sketch_get_quantile_double("kll", F.lit(q)) for q in QUANTILES])).alias("quantiles"),
        F.slice(F.filter(F.transform("top", lambda t: t["item"]), lambda i: i.isNotNull()), 1, EXAMPLES).alias("examples"),
    )

