"""Import of CSV and Parquet files, and reading of query-text folders."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import StrataError, Workbench, error_text, is_empty
from strata.sources import multiline

REPORT_SCHEMA = "file string, target string, status string, rows bigint, message string"
# Separators tried on .txt files, and suffixes of query texts.
SEPARATORS = (",", "\t", ";", "|")
QUERY_SUFFIXES = ("sql", "postgres")


@dataclass(frozen=True)
class Imported:
    target: str
    view: str
    status: str
    rows: int


def base_name(path: str, name: str | None = None) -> str:
    """Table name for a file: the given name or the file's stem, made safe."""
    stem = (name or "").strip() or PurePosixPath(path).stem
    return re.sub("[^a-zA-Z0-9_]", "_", stem)


def pick_separator(spark: SparkSession, path: str) -> str:
    """Separator by suffix; a .txt file goes by the most frequent one in its first line."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".tsv":
        return "\t"
    if suffix != ".txt":
        return ","
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(SEPARATORS, key=line.count)


def widen(schema: T.StructType) -> T.StructType:
    """Whole numbers read from text are BIGINT, as the importer's users know them."""
    whole = (T.ByteType, T.ShortType, T.IntegerType)
    fields = [
        T.StructField(f.name, T.LongType() if isinstance(f.dataType, whole) else f.dataType, True)
        for f in schema.fields
    ]
    return T.StructType(fields)


def has_line_ends_in_fields(spark: SparkSession, path: str) -> bool:
    """Whether some quoted field goes over several lines: then a line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not is_empty(spark.read.text(path).where(quotes % 2 == 1))


def _of_records(reader: DataFrameReader, texts: DataFrame) -> DataFrame:
    """What the reader makes of a column of records."""
    strings = getattr(texts._jdf, "as")(texts.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(strings), texts.sparkSession)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text with a header. Types come from a full pass unless `schema` is given.

    A schema read off a sample could turn later values into nulls, so none is sampled. Files are
    split among tasks, also where fields hold line ends (`multiline`). Only files with quotes that do
    not enclose whole fields are then one task's each.
    """
    sep, several = pick_separator(spark, path), has_line_ends_in_fields(spark, path)

    def reader(header: bool, infer: bool) -> DataFrameReader:
        options = {"header": header, "sep": sep, "escape": '"', "multiLine": several, "inferSchema": infer}
        return spark.read.options(**options, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")

    found = multiline.read_records(spark, path, sep) if several else None
    if found is None:
        if schema is None:
            schema = widen(reader(True, True).csv(path).schema)
        return reader(True, False).schema(schema).csv(path)
    texts, header = found
    if schema is None:
        names = _of_records(reader(True, False), spark.createDataFrame([(header,)], "text string")).columns
        types = widen(_of_records(reader(False, True), texts).schema).fields
        schema = T.StructType([T.StructField(n, types[i].dataType if i < len(types) else T.StringType(), True) for i, n in enumerate(names)])
    return _of_records(reader(False, False).schema(schema), texts)


def read_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".csv", ".tsv", ".txt"):
        return read_delimited(spark, path, schema)
    raise StrataError(f"cannot import '{suffix}' files")


def import_file(
    wb: Workbench,
    path: str,
    name: str | None = None,
    overwrite: bool = True,
    schema: T.StructType | str | None = None,
) -> Imported:
    """Copy a file into ``imports.<name>`` and show it as ``bronze.raw__file__<name>``."""
    base = base_name(path, name)
    target, view = f"imports.{base}", f"bronze.raw__file__{base}"
    if not overwrite and wb.exists(target):
        return Imported(target, view, "kept", wb.table(target).count())
    rows = wb.replace_table(target, read_file(wb.spark, path, schema))
    wb.replace_view(view, f"SELECT * FROM {target}")
    return Imported(target, view, "imported", rows)


def import_files(wb: Workbench, paths: list[str], overwrite: bool = True, threads: int = 4) -> DataFrame:
    """Import several files; a failing one is reported and does not stop the others."""

    def one(path: str) -> tuple:
        try:
            done = import_file(wb, path, overwrite=overwrite)
            return (path, done.target, done.status, done.rows, None)
        except Exception as exc:
            return (path, f"imports.{base_name(path)}", "failed", None, error_text(exc))

    with ThreadPoolExecutor(max_workers=threads) as pool:
        report = list(pool.map(one, paths))
    return wb.spark.createDataFrame(report, REPORT_SCHEMA)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Query texts below `folder`, each with its companion note of the same base path.

    Columns: path, base, sql, updated, note_path, note (null when there is no note).
    """

    def texts(glob: str) -> DataFrame:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob)
            .load(folder)
            .select(
                "path",
                F.regexp_replace("path", r"\.[^./]+$", "").alias("base"),
                F.decode("content", "UTF-8").alias("text"),
                F.col("modificationTime").alias("updated"),
            )
        )

    queries = texts("*.{" + ",".join(QUERY_SUFFIXES) + "}").withColumnRenamed("text", "sql")
    notes = texts("*.md").select("base", F.col("path").alias("note_path"), F.col("text").alias("note"))
    return queries.join(notes, "base", "left").select("path", "base", "sql", "updated", "note_path", "note")
