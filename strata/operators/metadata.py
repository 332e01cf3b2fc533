"""Joins and groupings over catalog rows of many databases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.values import normalize_type_name
from strata.operators.spread import HOT_ROWS, hot_keys, slices, spread_join, top_per_key
from strata.session import LAYERS, cut, cut_in_turn

SYSTEM_SCHEMAS = ("information_schema", "pg_catalog")


def constraint_join(
    constraints: DataFrame, key_usage: DataFrame, referential: DataFrame
) -> DataFrame:
    """Primary and foreign key columns, the latter with the column they refer to.

    Target columns are matched by position within the referenced constraint. Where the list of
    references names the table (an addition some catalogs have), equal names of different tables are told apart.
    """
    tc = constraints.where(F.col("constraint_type").isin("PRIMARY KEY", "FOREIGN KEY"))
    # A constraint's name is unique within its table only.
    kcu = key_usage.select("table_schema", "table_name", "constraint_name", "column_name", "ordinal_position")
    target = key_usage.select(
        F.col("constraint_name").alias("unique_constraint_name"),
        F.col("constraint_schema").alias("unique_constraint_schema"),
        "ordinal_position",
        F.col("table_schema").alias("foreign_schema"),
        F.col("table_name").alias("foreign_table"),
        F.col("column_name").alias("foreign_column"),
    )
    name = ["constraint_name", "constraint_schema"] + [c for c in ("table_name",) if c in referential.columns]
    rc = referential.select(*name, "unique_constraint_name", "unique_constraint_schema").distinct()
    # References meet constraints before these are many columns; names that differ most come first, as rows are sorted by them.
    place = ["constraint_name", "table_name", "table_schema"]
    on = ["unique_constraint_name", "unique_constraint_schema", "ordinal_position"]
    shown = ~F.col("table_schema").isin(*SYSTEM_SCHEMAS)
    kept = ["table_schema", "table_name", "column_name", "constraint_name", "constraint_type", *on]
    sources = constraints, key_usage, referential
    # Large catalogs are joined slice by slice, so that the disk does not hold the shuffle files of all.
    own = cut_in_turn(
        [
            tc.where(part).join(rc.where(part), name, "left").join(kcu.where(part), place).where(shown).select(*kept)
            for part in slices("constraint_name", *sources)
        ],
        "keys",
    )
    result = ["table_schema", "table_name", "column_name", "constraint_name", "constraint_type", "foreign_schema", "foreign_table", "foreign_column"]
    # A central table's key is referred to by a large share of all rows, and primary keys refer to nothing: they stay where they are.
    refers = F.col("unique_constraint_name").isNotNull()
    hot = cut(hot_keys(own.where(refers), on), "hot")
    parts = [
        spread_join(own.where(refers & part), target.where(part), on, "left", HOT_ROWS, hot).select(*result)
        for part in slices("unique_constraint_name", *sources)
    ]
    found = parts[0] if len(parts) == 1 else cut_in_turn(parts, "found")
    nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in result[5:]]
    return found.unionByName(own.where(~refers).select(*result[:5], *nothing))


def constraint_marks(columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """The same rows as `constraint_join` from a catalog that marks key columns.

    `columns`: table_schema, table_name, column_name, column_key (``PRI`` for primary keys).
    `foreign_keys`, one row per column: table_schema, table_name, column_name, constraint_name,
    referenced_table_schema, referenced_table_name, referenced_column_name; rows that refer to nothing are no foreign keys.
    """
    place = ["table_schema", "table_name", "column_name"]
    none = F.lit(None).cast("string")
    primary = columns.where(F.upper("column_key") == "PRI").select(
        *place, F.lit("PRIMARY").alias("constraint_name"), F.lit("PRIMARY KEY").alias("constraint_type"),
        none.alias("foreign_schema"), none.alias("foreign_table"), none.alias("foreign_column"),
    )
    foreign = foreign_keys.where(F.col("referenced_table_name").isNotNull()).select(
        *place, "constraint_name", F.lit("FOREIGN KEY").alias("constraint_type"),
        F.coalesce("referenced_table_schema", "table_schema").alias("foreign_schema"),
        F.col("referenced_table_name").alias("foreign_table"), F.col("referenced_column_name").alias("foreign_column"),
    )
    return primary.unionByName(foreign).where(~F.col("table_schema").isin(*SYSTEM_SCHEMAS))


def column_kind_join(columns: DataFrame, table_types: DataFrame) -> DataFrame:
    """Columns with short type names and the kind of their table (BASE TABLE when unlisted)."""
    return columns.join(table_types, ["table_schema", "table_name"], "left").select(
        *[c for c in columns.columns if c != "data_type"],
        normalize_type_name("data_type").alias("data_type"),
        F.coalesce("table_type", F.lit("BASE TABLE")).alias("table_type"),
    )


def index_columns(rows: DataFrame) -> DataFrame:
    """Indexes with their columns in order. Rows: schema, table, index, seq, column, non_unique."""
    listed = F.array_sort(F.collect_list(F.struct("seq_in_index", "column_name")))
    return rows.groupBy("table_schema", "table_name", "index_name").agg(
        F.array_join(F.transform(listed, lambda x: x["column_name"]), ",").alias("columns"),
        (F.max("non_unique") == 0).alias("is_unique"),
    )


def tables_and_views(columns_with_kind: DataFrame) -> DataFrame:
    """One listing of the tables and the views that have columns."""
    named = columns_with_kind.select("table_schema", "table_name", "table_type").distinct()
    tables = named.where(F.col("table_type") != "VIEW").withColumn("is_view", F.lit(False))
    views = named.where(F.col("table_type") == "VIEW").withColumn("is_view", F.lit(True))
    return tables.unionByName(views).drop("table_type")


def schema_object_counts(objects: DataFrame) -> DataFrame:
    """Tables and views per schema."""
    return objects.groupBy("table_schema").agg(F.count(F.lit(1)).alias("n_objects"))


def visible_schemas(
    schemata: DataFrame, primary_catalog: str, show_system: bool = False, local: bool = True
) -> DataFrame:
    """Schemas to show, with display names and a place in the order.

    `schemata`: catalog_name, schema_name. System schemas are hidden, attached catalogs show as
    ``catalog`` or ``catalog.schema``; the local database always shows its five layers first.
    """
    catalog, schema = F.col("catalog_name"), F.col("schema_name")
    own = catalog.isin(primary_catalog, "memory")
    shown = schemata.where(~schema.isin(*SYSTEM_SCHEMAS) & (catalog != "data_cache"))
    if not show_system:
        shown = shown.where(schema != "ops")
    if local:
        shown = shown.where(~(own & (schema == "main")))
    name = F.when(own, schema).when(schema == "main", catalog).otherwise(F.concat_ws(".", catalog, schema))
    shown = shown.select(name.alias("name")).distinct()
    if not local:
        return shown.withColumn("place", F.lit(len(LAYERS)))
    # The five layers are rows whether or not the listing has them.
    layers = schemata.sparkSession.createDataFrame([(n, i) for i, n in enumerate(LAYERS)], "name string, place int")
    return shown.join(layers, "name", "full").select(
        "name", F.coalesce("place", F.lit(len(LAYERS))).alias("place")
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Per connection the snapshot with the most schemas; the first loaded one wins a tie."""
    return dedupe_latest(snapshots, ["connection_id"], [F.col("n_schemas").desc(), F.col("load_order")])


def dedupe_latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by `order` (give a total order)."""
    return top_per_key(df, keys, order, 1).drop("_rn")


def merge_keys_dedupe(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key; the last one by `order` replaces earlier ones."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("_r")
    return df.groupBy(*keys).agg(last).select(*keys, "_r.*").select(*df.columns)


def registry_upsert(registry: DataFrame, incoming: DataFrame, key: str, created: str, now) -> DataFrame:
    """Merge entries by key: new non-null fields win, the stored creation time stays.

    Every touched entry gets `now` as its update time.
    """
    fields = [c for c in registry.columns if c not in (key, created, "updated_at")]
    old = registry.select(key, F.struct(*[c for c in registry.columns if c != key]).alias("_old"))
    new = incoming.select(key, F.struct(*[c for c in incoming.columns if c != key]).alias("_new"))
    both = old.join(new, key, "full")
    has = set(incoming.columns)

    def pick(name: str):
        return F.coalesce(F.col("_new")[name], F.col("_old")[name]) if name in has else F.col("_old")[name]

    made = F.coalesce(F.col("_old")[created], F.col("_new")[created] if created in has else F.lit(None), now)
    updated = F.when(F.col("_new").isNotNull(), now).otherwise(F.col("_old")["updated_at"])
    values = {created: made, "updated_at": updated}
    return both.select(key, *[values.get(c, pick(c) if c in fields else None).alias(c) for c in registry.columns if c != key])
