"""Session helpers: the shared work folder, durable cuts of a plan, and the layer databases."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

INPUT_LAYERS = ("imports", "data_cache")
PIPELINE_LAYERS = ("bronze", "silver", "gold")
SYSTEM_LAYER = "ops"
LAYERS = INPUT_LAYERS + PIPELINE_LAYERS
RESERVED_SCHEMAS = LAYERS + (SYSTEM_LAYER,)

RUN_LOG = f"{SYSTEM_LAYER}.run_log"
RUN_LOG_SCHEMA = (
    "run_id string, notebook string, cell_id string, layer string, output_name string, "
    "started_at timestamp, rows bigint, elapsed_ms bigint, status string, error string"
)

#: Spark's switch for removing the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch_roots: set[str] = set()
_mounts: dict[tuple[str, str], str] = {}
_versions: dict[tuple[str, str], list[str]] = {}


def literal(text: str) -> str:
    """A text as a SQL literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


class StrataError(ValueError):
    """A request the toolkit refuses, with the reason."""


def work_root(spark: SparkSession) -> str:
    """The shared folder for cuts and layer tables.

    A cluster names it in ``spark.checkpoint.dir``; without it the folder lies in the warehouse,
    which every executor has to reach anyway.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/strata-work"


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's cuts; the file system removes it when the application ends."""
    root = f"{work_root(spark)}/strata-scratch/{spark.sparkContext.applicationId}"
    if root not in _scratch_roots:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        _scratch_roots.add(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the cuts of this application; frames that read them end with it."""
    delete_path(spark, scratch_root(spark))


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Ends the lineage like a reliable checkpoint, survives lost executors, and the copy is
    columnar, so later readers still prune columns and push filters.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_in_turn(parts: Iterable[DataFrame], label: str = "cut") -> DataFrame:
    """Write frames of the same columns to the shared folder, one after the other, and read them back as one.

    A frame's shuffle files go as soon as it is written, so the disk holds those of one frame at a time beside what is
    written, which is packed tighter than a plain `cut`.
    """
    parts = list(parts)
    spark = parts[0].sparkSession
    path = scratch_path(spark, label)
    freed = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if freed is None else spark.conf.set(_FREE_SHUFFLES, freed)
    return spark.read.schema(parts[0].schema).parquet(path)


def write_counted(df: DataFrame, path: str, condition: Column | None = None, options: dict[str, str] | None = None) -> int:
    """Write `df` as parquet and give the number of rows (that meet `condition`), taken on the way."""
    seen = Observation()
    met = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    df.observe(seen, met.alias("rows")).write.options(**(options or {})).parquet(path)
    return int(seen.get["rows"])


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove one folder this toolkit wrote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


@dataclass
class Workbench:
    """A session with the layer databases and the tables kept in them.

    `root` is the folder of the layers. Name a lasting one to keep layers in a lasting catalog;
    without it they live in the shared work folder, apart from those of other applications.
    """

    spark: SparkSession
    root: str = ""

    def __post_init__(self) -> None:
        if not self.root:
            self.root = f"{work_root(self.spark)}/strata-layers/{self.spark.sparkContext.applicationId}"

    def init_layers(self) -> "Workbench":
        """Create the layer databases and the run log; existing ones are kept."""
        for layer in RESERVED_SCHEMAS:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer} LOCATION {literal(f'{self.root}/{layer}')}")
        if not self.exists(RUN_LOG):
            empty = self.spark.createDataFrame([], RUN_LOG_SCHEMA)
            empty.write.mode("overwrite").saveAsTable(RUN_LOG)
        return self

    def exists(self, fqn: str) -> bool:
        return self.spark.catalog.tableExists(fqn)

    def table(self, fqn: str) -> DataFrame:
        return self.spark.table(fqn)

    def kind(self, fqn: str) -> str | None:
        """'VIEW', 'BASE TABLE', or None when there is no such object."""
        if not self.exists(fqn):
            return None
        schema, name = fqn.split(".")
        found = self.spark.catalog.getTable(f"{schema}.{name}")
        return "VIEW" if found.tableType == "VIEW" else "BASE TABLE"

    def drop(self, fqn: str) -> None:
        kind = self.kind(fqn)
        _mounts.pop((self.spark.sparkContext.applicationId, fqn), None)
        if kind is not None:
            self.spark.sql(f"DROP {'VIEW' if kind == 'VIEW' else 'TABLE'} IF EXISTS {fqn}")

    def replace_table(
        self, fqn: str, df: DataFrame, keep_empty: bool = True, options: dict[str, str] | None = None
    ) -> int:
        """Replace a table by `df`, which may read the table itself; returns the row count.

        The rows go to a new folder first and the name is switched over afterwards, so a failed
        write leaves the old table as it was; a table of the same columns is switched without a gap. The version before the new one stays on disk for
        readers that hold it; older ones are removed. `options` go to the Parquet writer. With
        `keep_empty=False` an empty result leaves everything untouched.
        """
        path = f"{self.root}/{fqn.replace('.', '/')}/{uuid.uuid4().hex}"
        rows = write_counted(df, path, options=options)
        if rows == 0 and not keep_empty:
            delete_path(self.spark, path)
            return 0
        if self.kind(fqn) == "BASE TABLE" and self.table(fqn).schema == df.schema:
            # One catalog operation: a reader sees the old rows or the new ones.
            self.spark.sql(f"ALTER TABLE {fqn} SET LOCATION {literal(path)}")
            self.spark.catalog.refreshTable(fqn)
        else:
            self.drop(fqn)
            self.spark.catalog.createTable(fqn, path=path, source="parquet", schema=df.schema)
        history = _versions.setdefault((self.spark.sparkContext.applicationId, path.rsplit("/", 1)[0]), [])
        history.append(path)
        while len(history) > 2:
            delete_path(self.spark, history.pop(0))
        return rows

    def replace_view(self, fqn: str, sql: str) -> None:
        """Replace a view; a table of the same name is dropped first."""
        if self.kind(fqn) == "BASE TABLE":
            self.drop(fqn)
        self.spark.sql(f"CREATE OR REPLACE VIEW {fqn} AS {sql}")

    def mount(self, fqn: str, path: str) -> None:
        """Give parquet files that live elsewhere a table name; dropping it leaves the files."""
        key = (self.spark.sparkContext.applicationId, fqn)
        if _mounts.get(key) != path or not self.exists(fqn):
            self.drop(fqn)
            self.spark.catalog.createTable(fqn, path=path, source="parquet")
            _mounts[key] = path


def open_workbench(spark: SparkSession, root: str = "") -> Workbench:
    return Workbench(spark, root).init_layers()


def error_text(exc: Exception) -> str:
    """First line of an error, as shown in status rows."""
    text = str(exc) if not isinstance(exc, PySparkException) else (exc.getMessage() or str(exc))
    return text.strip().splitlines()[0] if text.strip() else type(exc).__name__
