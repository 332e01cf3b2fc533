"""Dropping and resetting layer objects, with their traces in the lineage tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.lineage import mark_deleted
from strata.session import PIPELINE_LAYERS, StrataError, Workbench

# Companion bronze views of the input layers.
COMPANIONS = {"imports": "bronze.raw__file__", "data_cache": "bronze.raw__"}


def drop_object(
    wb: Workbench, fqn: str, lineage: DataFrame | None = None, by: str = "user", at: datetime | None = None
) -> DataFrame | None:
    """Drop a table or view with its companion view; returns the lineage with it marked deleted."""
    schema, name = fqn.split(".")
    if schema in COMPANIONS:
        wb.drop(f"{COMPANIONS[schema]}{name}")
    wb.drop(fqn)
    if lineage is None or schema not in PIPELINE_LAYERS:
        return lineage
    return mark_deleted(lineage, by, at or datetime.now(), fqn=fqn)


def reset_layer(
    wb: Workbench, layer: str, lineage: DataFrame | None = None, at: datetime | None = None
) -> DataFrame | None:
    """Drop and recreate one pipeline layer; returns the lineage with the layer marked deleted."""
    if layer not in PIPELINE_LAYERS:
        raise StrataError(f"layer '{layer}' cannot be reset")
    wb.spark.sql(f"DROP DATABASE IF EXISTS {layer} CASCADE")
    wb.spark.sql(f"CREATE DATABASE {layer} LOCATION '{wb.root}/{layer}'")
    return None if lineage is None else mark_deleted(lineage, "system", at or datetime.now(), layer=layer)


def reset_outputs(
    wb: Workbench, lineage: DataFrame, notebook_id: str, at: datetime | None = None
) -> tuple[list[str], DataFrame]:
    """Drop what the cells of one notebook created; returns the names and the marked lineage.

    The names go through the driver because each one is a catalog command; a notebook has as
    many outputs as it has cells.
    """
    outputs = (
        lineage.where((F.col("pipeline_id") == notebook_id) & F.col("cell_id").isNotNull())
        .where(F.col("schema_name").isin(*PIPELINE_LAYERS))
        .select("fqn")
        .distinct()
    )
    names = sorted(r[0] for r in outputs.collect())
    for fqn in names:
        wb.drop(fqn)
    dead = outputs.withColumn("_dead", F.lit(True))
    when = F.lit(at or datetime.now()).cast(lineage.schema["deleted_at"].dataType)
    marked = lineage.join(dead, "fqn", "left").select(
        *[
            F.when(F.col("_dead"), value).otherwise(F.col(c)).alias(c) if value is not None else F.col(c)
            for c, value in (
                (c, {"status": F.lit("deleted"), "deleted_at": when, "deleted_by": F.lit("system")}.get(c))
                for c in lineage.columns
            )
        ]
    )
    return names, marked
