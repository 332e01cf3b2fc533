"""What the operators of this subpackage share: words, stored intermediates, files in the shared folder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strata.session import StrataError, cut, delete_path, scratch_path, write_counted

__all__ = [
    "BLANKS", "WORD", "WORD_PATTERN", "batch_rows", "counted", "cut", "delete_path", "fresh", "numbered", "open_fs", "sample_rows", "scratch_path", "shared_path", "stored", "table",
    "text_batches",
]

#: The six ASCII blanks that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

#: Rows of one Arrow batch that carries whole texts; bounds a Python worker's memory by rows x text.
TEXT_BATCH = 500
#: Files of a folder whose rows are numbered by a broadcast list of paths (about 4 MB at 200 bytes each).
MOST_FILES = 20_000
_numbers: dict[tuple[str, str], tuple[int, list[tuple[str, int]]]] = {}
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches carry at most `TEXT_BATCH` rows; a smaller setting of the session stays."""
    now = int(spark.conf.get(_BATCH_KEY, "10000"))
    if now <= 0 or now > TEXT_BATCH:
        spark.conf.set(_BATCH_KEY, str(TEXT_BATCH))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of `rows` rows for what is run inside, where rows are short; the session's setting comes back."""
    before = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_KEY) if before is None else spark.conf.set(_BATCH_KEY, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(df: DataFrame, label: str, condition: Column | None = None) -> tuple[DataFrame, int]:
    """`cut`, and the number of rows (that meet `condition`), counted while they are written."""
    path = scratch_path(df.sparkSession, label)
    rows = write_counted(df, path, condition)
    return df.sparkSession.read.schema(df.schema).parquet(path), rows


def _relation(docs: DataFrame):
    """The Parquet relation of one folder that `docs` scans with projections and filters only, else None."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return None
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return None
    return relation if relation.location().rootPaths().size() == 1 else None


def is_stored(docs: DataFrame) -> bool:
    """Whether `docs` gives rows of one Parquet folder of at most `MOST_FILES` files, each row at most once."""
    return _relation(docs) is not None and len(docs.inputFiles()) <= MOST_FILES


def stored(docs: DataFrame) -> DataFrame:
    """`docs` itself if its rows can be numbered, else a stored copy; of a folder of too many files one of fewer files."""
    if is_stored(docs):
        return docs
    return cut(docs if _relation(docs) is None else docs.coalesce(MOST_FILES // 2), "docs")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with a number behind it where `df` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def _file_numbers(docs: DataFrame) -> list[tuple[str, int]]:
    """Path and number of each file that holds rows of the folder of `docs`; listed once per folder and list of files."""
    spark = docs.sparkSession
    root = _relation(docs).location().rootPaths().head().toString()
    key = (spark.sparkContext.applicationId, root)
    files = hash(tuple(sorted(docs.inputFiles())))
    if _numbers.get(key, (None,))[0] != files:
        folder = spark.read.parquet(root)
        paths = folder.select(folder.metadataColumn("_metadata")["file_path"]).distinct().collect()
        _numbers[key] = (files, [(path, i) for i, path in enumerate(sorted(r[0] for r in paths))])
    return _numbers[key][1]


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a bigint that names each stored row: the number of its file, by path, and its place in the file.

    It is the same in every scan, while `monotonically_increasing_id` follows the splits, and those the number of cores. The
    list of files has at most `MOST_FILES` rows and is broadcast. Columns of any name may be there, but none called `name`.
    """
    if not is_stored(docs):
        raise StrataError("rows can be numbered in a stored Parquet table only")
    if fresh(docs, name) != name:
        raise StrataError(f"the rows have a column {name!r} already")
    path, number, place = (fresh(docs, n) for n in ("__file", "__number", "__place"))
    meta = docs.metadataColumn("_metadata")
    files = docs.sparkSession.createDataFrame(_file_numbers(docs), "path string, number bigint")
    files = files.select(F.col("path").alias(path + "_of"), F.col("number").alias(number))
    rows = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(place))
    rows = rows.join(F.broadcast(files), F.col(path) == F.col(path + "_of"), "left")
    found = F.coalesce(number, F.raise_error(F.lit("a file came into the folder of the table meanwhile")).cast("bigint"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], (F.shiftleft(found, 33) + F.col(place)).alias(name))


def sample_rows(rows: DataFrame, id_col: str, most: int) -> list[Row]:
    """At most `most` rows, chosen by a hash of their id, on the driver.

    The hash lets about twice as many rows through, at any size of the input; the limit then stops at `most`, and only
    rows that are taken travel.
    """
    total = rows.count()
    share = min(1.0, 2 * most / total) if total else 0.0
    chosen = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    return rows.where(chosen).limit(most).collect()


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI in the shared folder, and the path inside it.

    Tasks use it to write and read archive files that no Spark format covers. A path without a scheme is local;
    `shared_path` gives those of the shared folder the scheme that Spark itself would use.
    """
    if "://" not in path and not path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder, qualified by Hadoop's default file system, so that tasks write where Spark does."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, label))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
