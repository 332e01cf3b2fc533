"""Table and column lineage of cells, kept as node and edge tables.

Cells are rows of pipeline_id, cell_id, ordinal, cell_type, layer, output_name, materialize, sql.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import sqlparts
from strata.functions.text import edge_label
from strata.operators.spread import HOT_ROWS, deal, number_rows, sized_parts, spread_join
from strata.session import PIPELINE_LAYERS, cut, scratch_path, write_counted

CELL = ["pipeline_id", "cell_id"]


def lineage_cells(cells: DataFrame) -> DataFrame:
    """SQL cells with an output in a pipeline layer, with their comment-free text and sources."""
    layer = F.coalesce("layer", F.lit("bronze"))
    kept = cells.where(
        (F.col("cell_type") == "sql") & (F.coalesce("output_name", F.lit("")) != "") & layer.isin(*PIPELINE_LAYERS)
    )
    parsed = kept.select(
        *CELL,
        layer.alias("layer"),
        "output_name",
        "materialize",
        F.concat_ws(".", layer, "output_name").alias("fqn"),
        sqlparts.strip_comments(F.coalesce("sql", F.lit(""))).alias("clean"),
    )
    return parsed.withColumn("sources", sqlparts.sources(F.col("clean")))


def table_refs(texts: DataFrame, key: str, sql: str = "sql") -> DataFrame:
    """Tables each text refers to: `key`, ``table_ref``."""
    return texts.select(key, F.explode(sqlparts.table_refs(sql)).alias("table_ref"))


def lineage_table_edges(cells: DataFrame) -> DataFrame:
    """Source table -> output table, once per cell."""
    named = F.array_distinct(F.transform("sources", lambda s: s["fqn"]))
    return lineage_cells(cells).select(
        *CELL, F.explode(named).alias("source"), F.col("fqn").alias("target"), F.lit("sql_ref").alias("reason")
    )


def select_items(texts: DataFrame, key: str, sql: str = "sql") -> DataFrame:
    """Select items of each text: position, expression, alias, confidence, is_wildcard."""
    found = sqlparts.select_items(sqlparts.strip_comments(sql))
    return texts.select(key, F.explode(found).alias("i")).select(
        key, "i.position", "i.expression", "i.alias", "i.confidence", "i.is_wildcard"
    )


def lineage_column_edges(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Input column -> output column, with the transforming expression and a confidence.

    `columns` is the catalog (table_schema, table_name, column_name): an edge needs an output
    column that exists. A wildcard gives one edge per source table.
    """
    parsed = (
        lineage_cells(cells)
        .withColumn("aliases", sqlparts.alias_map(F.col("sources")))
        .withColumn("tables", F.array_distinct(F.transform("sources", lambda s: s["fqn"])))
        .withColumn("i", F.explode(sqlparts.select_items(F.col("clean"))))
    )
    refs = sqlparts.column_refs(F.col("i.expression"), F.col("aliases"), F.col("tables"))
    star_refs = F.transform("tables", lambda t: F.struct(t.alias("table"), F.lit("*").alias("column")))
    # Parsing is the costly part and what follows reads it more than once.
    found = cut(
        parsed.select(
            *CELL,
            F.explode(F.when(F.col("i.is_wildcard"), star_refs).otherwise(refs)).alias("r"),
            F.col("fqn").alias("target"),
            F.col("i.alias").alias("target_column"),
            F.col("i.expression").alias("transform"),
            F.col("i.confidence").alias("confidence"),
            F.col("i.is_wildcard").alias("star"),
        ),
        "refs",
    ).select(*CELL, F.col("r.table").alias("source"), F.col("r.column").alias("source_column"),
             "target", "target_column", "transform", "confidence", "star")
    edge = [c for c in found.columns if c != "star"]
    stars = found.where("star").select(
        *[F.lit("*").alias(c) if c == "transform" else F.col(c) for c in edge], F.lit("wildcard").alias("reason")
    )
    known = columns.select(
        F.concat_ws(".", "table_schema", "table_name").alias("target"), F.col("column_name").alias("target_column")
    )
    named = found.where("NOT star").select(*edge).join(known, ["target", "target_column"], "left_semi")
    edges = named.select(*edge, F.lit("select_expr").alias("reason"))
    return edges.unionByName(stars)


def lineage_table_nodes(cells: DataFrame) -> DataFrame:
    """Outputs with the cell that makes them, and the tables that are only read as sources."""
    parsed = lineage_cells(cells)
    outputs = parsed.groupBy("pipeline_id", "fqn").agg(
        F.max_by(F.struct("materialize", "cell_id"), "cell_id").alias("_c")
    ).select(
        "pipeline_id", "fqn",
        F.when(F.col("_c.materialize") == "view", "view").otherwise("table").alias("node_type"),
        F.col("_c.cell_id").alias("cell_id"),
    )
    read = lineage_table_edges(cells).select("pipeline_id", F.col("source").alias("fqn")).distinct()
    only_read = read.join(outputs, ["pipeline_id", "fqn"], "left_anti").select(
        "pipeline_id", "fqn", F.lit("source").alias("node_type"), F.lit(None).cast(outputs.schema["cell_id"].dataType).alias("cell_id")
    )
    return outputs.unionByName(only_read)


def lineage_column_nodes(cells: DataFrame, columns: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Columns of the outputs with their types, and source columns (type unknown) the edges name."""
    if edges is None:
        edges = lineage_column_edges(cells, columns)
    key = ["pipeline_id", "table_fqn", "column_name"]
    parts = max(sized_parts(columns), sized_parts(edges))
    outputs = deal(lineage_cells(cells).select("pipeline_id", F.col("fqn").alias("table_fqn")), parts, ["table_fqn"]).distinct()
    catalog = columns.select(
        F.concat_ws(".", "table_schema", "table_name").alias("table_fqn"), "column_name", "data_type"
    )
    own = deal(catalog, parts, ["table_fqn"]).join(outputs, "table_fqn").select("pipeline_id", "table_fqn", "column_name", "data_type")
    named = edges.where("reason = 'select_expr'").select(
        "pipeline_id", F.col("source").alias("table_fqn"), F.col("source_column").alias("column_name")
    )
    outside = deal(named, parts, key).distinct().join(deal(own, parts, key), key, "left_anti")
    return own.unionByName(outside.withColumn("data_type", F.lit("unknown")))


def lineage_valid_edges(
    edges: DataFrame, nodes: DataFrame, columns: DataFrame, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Column edges that can be drawn: both ends are columns of nodes, with a short label.

    `nodes`: pipeline_id, fqn. `columns`: pipeline_id, table_fqn, column_name. A wildcard counts
    as a column of any node.
    """
    key = ["pipeline_id", "table_fqn", "column_name"]
    ids = nodes.select("pipeline_id", F.col("fqn").alias("table_fqn")).distinct()
    stars = ids.withColumn("column_name", F.lit("*"))
    # The edges only look whether an end is there, so it may be listed twice.
    ends = columns.select(*key).join(ids, ["pipeline_id", "table_fqn"], "left_semi").unionByName(stars)

    def end(side: str) -> DataFrame:
        return ends.select("pipeline_id", F.col("table_fqn").alias(side), F.col("column_name").alias(f"{side}_column"))

    # Many edges may start from one column.
    kept = spread_join(edges, end("source"), ["pipeline_id", "source", "source_column"], "left_semi", min_rows)
    kept = kept.join(end("target"), ["pipeline_id", "target", "target_column"], "left_semi")
    full = F.when((F.col("transform") != "*") & (F.col("transform") != F.col("source_column")), F.col("transform"))
    return kept.select(*edges.columns, edge_label(full).alias("label"))


def mark_deleted(
    tables: DataFrame, by: str, at: datetime | Column, fqn: str | None = None, layer: str | None = None
) -> DataFrame:
    """Set status, time and author on one table or a whole layer, in all pipelines."""
    hit = F.col("fqn") == fqn if fqn is not None else F.col("schema_name") == layer
    time = at if isinstance(at, Column) else F.lit(at)
    new = {
        "status": F.lit("deleted"),
        "deleted_at": time.cast(tables.schema["deleted_at"].dataType),
        "deleted_by": F.lit(by),
    }
    return tables.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tables.columns]
    )


def reconcile_lineage(tables: DataFrame, catalog: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """Bring table nodes in line with the catalog (table_schema, table_name).

    A managed table that exists is present and loses its deletion marks; one that does not is
    missing, unless it is already marked deleted.
    """
    there = catalog.select(F.concat_ws(".", "table_schema", "table_name").alias("fqn")).distinct()
    joined = spread_join(tables, there.withColumn("_there", F.lit(True)), ["fqn"], "left", min_rows)
    managed = F.col("schema_name").isin(*PIPELINE_LAYERS)
    found = managed & F.col("_there").isNotNull()
    lost = managed & F.col("_there").isNull() & ~F.col("status").eqNullSafe("deleted")
    new = {
        "status": F.when(found, "present").when(lost, "missing").otherwise(F.col("status")),
        "deleted_at": F.when(~found, F.col("deleted_at")),
        "deleted_by": F.when(~found, F.col("deleted_by")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in tables.columns])


#: Rows of a round that are sent to every task that reads edges, up to some 50 MB; with more, edges and rows are joined by a shuffle.
MOST_SENT = 500_000


def _sent(rows: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(rows) if n <= most else rows


def _stored_count(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """`rows` as a stored table, and how many there are."""
    path = scratch_path(rows.sparkSession, label)
    n = write_counted(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), n


def upstream_trace(
    edges: DataFrame, table: str, column: str, hops: int = 4, most_sent: int = MOST_SENT
) -> tuple[DataFrame, DataFrame]:
    """Columns and edges that feed one column, breadth first; safe on cycles.

    Returns (columns with their distance, edges). A round starts from the columns found last and takes `hops` steps; only what is new is
    written, to a sub-folder of its own, so what was seen stays one scan and no lineage builds up. Up to `most_sent` columns of a step are sent
    to the scans of the edges and of what was seen, which are then not shuffled; only larger steps shuffle them. Several hops compare with what
    was seen less often.
    """
    spark = edges.sparkSession
    ends, key = ["source", "source_column", "target", "target_column"], ["target", "target_column"]
    folder = scratch_path(spark, "trace")
    slim = cut(edges.select(*ends).distinct(), "trace")
    seen = lambda: spark.read.schema("target string, target_column string, distance int").parquet(folder)
    start = spark.sql("SELECT :t AS target, :c AS target_column, 0 AS distance", {"t": table, "c": column})
    start.write.parquet(f"{folder}/round=0")
    last = total = 1
    # Ends by itself: a round that finds nothing new is the last, and columns are finite.
    for done in count(0, hops):
        level, n, found, rows = seen().where(F.col("distance") == done).select(*key), last, [], 0
        for step in range(1, hops + 1):
            fed = slim.join(_sent(level, n, most_sent), key, "left_semi")
            level, n = _stored_count(fed.select(F.col("source").alias("target"), F.col("source_column").alias("target_column")).distinct(), "reached")
            if n == 0:
                break
            found.append(level.withColumn("distance", F.lit(done + step)))
            rows += n
        if not found:
            break
        nearest = reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min("distance").alias("distance"))
        # What was seen may be long: it is cut to what was reached before the two are set off.
        met = seen().select(*key).join(_sent(nearest.select(*key), rows, most_sent), key, "left_semi")
        path = f"{folder}/round={done + hops}"
        total += write_counted(nearest.join(_sent(met, rows, most_sent), key, "left_anti"), path)
        last = spark.read.schema("distance int").parquet(path).where(F.col("distance") == done + hops).count()
        if last == 0:
            break
    columns = seen().select(F.col("target").alias("table_fqn"), F.col("target_column").alias("column_name"), "distance")
    # Every edge into a column that was reached has been followed.
    return columns, slim.join(_sent(seen().select(*key), total, most_sent), key, "left_semi").select(*ends)


#: Start columns whose reach one row holds, as bits of a bigint.
_WORD = 64


def upstream_traces(edges: DataFrame, starts: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """What feeds each of many columns: start_table, start_column, table_fqn, column_name, distance; safe on cycles.

    `starts`: table_fqn, column_name. Columns are numbered; a row of a round holds, for a column and 64 starts, the bits of the starts that reached
    it just then. A round joins the edges once for all starts, ors the bits per column before they travel, and keeps what was not seen. Rounds of up
    to `most_sent` rows are sent to the scans of the edges and of what was seen, which are then not shuffled. There
    are as many rounds as the longest of the shortest ways, and rows for columns times starts / 64.
    """
    spark = edges.sparkSession
    pairs = edges.select("source", "source_column", "target", "target_column").distinct()
    wanted = starts.select(F.col("table_fqn").alias("t"), F.col("column_name").alias("c")).distinct()
    ends = pairs.select(F.col("source").alias("t"), F.col("source_column").alias("c")).unionByName(pairs.select(F.col("target").alias("t"), F.col("target_column").alias("c")))
    nodes = cut(number_rows(ends.unionByName(wanted).distinct(), [F.col("t"), F.col("c")], "node"), "nodes")
    named = lambda table, column, name: nodes.select(F.col("t").alias(table), F.col("c").alias(column), F.col("node").alias(name))
    slim = cut(
        pairs.join(named("source", "source_column", "src"), ["source", "source_column"]).join(named("target", "target_column", "node"), ["target", "target_column"]).select("src", "node"),
        "edges",
    )
    begun = cut(number_rows(wanted.join(nodes, ["t", "c"]), [F.col("node")], "start").withColumn("start", F.col("start") - 1), "starts")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("start") % _WORD).cast("int"))
    folder = scratch_path(spark, "traces")
    schema = "node bigint, word bigint, bits bigint, distance int"
    first = begun.groupBy("node", F.expr(f"start DIV {_WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))
    new = write_counted(first, f"{folder}/distance=0")
    seen = lambda: spark.read.schema(schema).parquet(folder)
    # Ends by itself: each round adds a bit at least, and bits are finite.
    for distance in count(1):
        level = spark.read.schema("node bigint, word bigint, bits bigint").parquet(f"{folder}/distance={distance - 1}")
        fed = slim.join(_sent(level, new, most_sent), "node")
        reached, n = _stored_count(fed.groupBy(F.col("src").alias("node"), "word").agg(F.bit_or("bits").alias("bits")), "reached")
        # What was seen may be long: it is cut to the nodes that were reached before bits are gathered.
        met = seen().join(_sent(reached.select("node", "word"), n, most_sent), ["node", "word"], "left_semi")
        held = met.groupBy("node", "word").agg(F.bit_or("bits").alias("_held"))
        fresh = reached.join(_sent(held, n, most_sent), ["node", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_held", F.lit(0).cast("bigint")))))
        new = write_counted(fresh.where("bits <> 0").select("node", "word", "bits"), f"{folder}/distance={distance}")
        if new == 0:
            break
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    long = seen().select("node", "distance", "word", F.explode(set_bits).alias("i")).select("node", "distance", (F.col("word") * _WORD + F.col("i")).alias("start"))
    by_start = begun.select("start", F.col("t").alias("start_table"), F.col("c").alias("start_column"))
    return long.join(by_start, "start").join(named("table_fqn", "column_name", "node"), "node").select(
        "start_table", "start_column", "table_fqn", "column_name", "distance"
    )
