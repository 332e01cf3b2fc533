import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strata.operators import corpus, history, lineage, metadata, relations, spread
from strata.streaming import index_stream
from strata.session import cut, scratch_path

EDGES = "source string, source_column string, target string, target_column string"
CELLS = "pipeline_id string, cell_id string, ordinal int, cell_type string, layer string, output_name string, materialize string, sql string"


def upstream(edges, start):
    distance, used, frontier, depth = {start: 0}, set(), {start}, 0
    while frontier:
        depth += 1
        step = {e for e in edges if (e[2], e[3]) in frontier}
        used |= step
        frontier = {(e[0], e[1]) for e in step} - set(distance)
        distance.update({f: depth for f in frontier})
    return distance, used


@pytest.mark.parametrize("seed", range(2))
def test_trace_on_cyclic_graphs(spark, seed):
    rnd = random.Random(seed)
    node = lambda: (f"t{rnd.randrange(12)}", f"c{rnd.randrange(3)}")
    edges = [(*node(), *node()) for _ in range(60)]
    df = spark.createDataFrame(edges + edges[:5], EDGES)
    columns, used = lineage.upstream_trace(df, "t1", "c1")
    want, want_used = upstream(set(edges), ("t1", "c1"))
    assert {(r[0], r[1]): r[2] for r in columns.collect()} == want
    assert sorted(tuple(r) for r in used.collect()) == sorted(want_used)


def test_trace_of_a_column_without_sources(spark):
    columns, used = lineage.upstream_trace(spark.createDataFrame([("a", "x", "b", "y")], EDGES), "q", "z")
    assert [tuple(r) for r in columns.collect()] == [("q", "z", 0)] and used.count() == 0


def test_lineage_of_cells(spark, rows):
    cells = spark.createDataFrame(
        [
            ("p", "c1", 1, "sql", "silver", "out", "table", "SELECT c.id, upper(c.name) AS nm, missing FROM bronze.customers c JOIN silver.orders ON 1=1"),
            ("p", "c2", 2, "sql", "gold", "final", "view", "SELECT * FROM silver.out"),
            ("p", "c3", 3, "markdown", "gold", "no", "table", "FROM bronze.x"),
            ("p", "c4", 4, "sql", "imports", "no", "table", "SELECT a FROM bronze.x"),
            ("p", "c5", 5, "sql", None, "dflt", None, None),
        ],
        CELLS,
    )
    catalog = spark.createDataFrame(
        [("silver", "out", "id", "int"), ("silver", "out", "nm", "string"), ("gold", "final", "id", "int")],
        "table_schema string, table_name string, column_name string, data_type string",
    )
    assert rows(lineage.lineage_table_edges(cells), "source", "target") == [
        ("bronze.customers", "silver.out"), ("silver.orders", "silver.out"), ("silver.out", "gold.final")]
    edges = lineage.lineage_column_edges(cells, catalog)
    assert rows(edges, "source", "source_column", "target", "target_column", "confidence", "reason") == [
        ("bronze.customers", "id", "silver.out", "id", 0.9, "select_expr"),
        ("bronze.customers", "name", "silver.out", "nm", 0.8, "select_expr"),
        ("silver.out", "*", "gold.final", "*", 0.4, "wildcard")]
    assert rows(lineage.lineage_table_nodes(cells), "fqn", "node_type") == [
        ("bronze.customers", "source"), ("bronze.dflt", "table"), ("gold.final", "view"), ("silver.orders", "source"), ("silver.out", "table")]
    nodes, columns = lineage.lineage_table_nodes(cells), lineage.lineage_column_nodes(cells, catalog, edges)
    assert ("bronze.customers", "id", "unknown") in rows(columns, "table_fqn", "column_name", "data_type")
    valid = lineage.lineage_valid_edges(edges, nodes, columns)
    assert rows(valid, "source_column", "label") == [("*", None), ("id", "c.id"), ("name", "upper(c.name)")]


def test_ends_of_edges_are_looked_up_without_being_made_distinct(spark, rows):
    edges = spark.createDataFrame(
        [("p", "c", "b.a", "id", "s.o", "id", "id", 0.9, "select_expr"), ("p", "c", "b.a", "no", "s.o", "id", "x.no", 0.9, "select_expr"), ("q", "c", "b.a", "*", "s.o", "*", "*", 0.4, "wildcard")],
        "pipeline_id string, cell_id string, source string, source_column string, target string, target_column string, transform string, confidence double, reason string",
    )
    nodes = spark.createDataFrame([(p, t) for p in "pq" for t in ("b.a", "s.o", "s.o")], "pipeline_id string, fqn string")
    columns = spark.createDataFrame([("p", "b.a", "id"), ("p", "b.a", "id"), ("p", "s.o", "id"), ("p", "x.y", "no")], "pipeline_id string, table_fqn string, column_name string")
    valid = lineage.lineage_valid_edges(edges, nodes, columns)
    assert rows(valid, "pipeline_id", "source_column", "label") == [("p", "id", None), ("q", "*", None)]
    # The nodes are made distinct, twice for each of two sides; ends are not.
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 4


def test_inferred_relationships(spark, rows):
    cols = spark.createDataFrame(
        [
            ("b", "Customers", "ID", 1), ("b", "Customers", "customers_id", 2), ("b", "orders", "customer_ID", 1), ("b", "orders", "box_id", 2),
            ("s", "boxes", "x", 1), ("s", "boxes", "box_id", 2), ("s", "order", "id", 1), ("s", "notes", "order_id", 1),
            ("s", "notes", "nothing_id", 2), ("s", "order", "order_id", 2),
        ],
        "table_schema string, table_name string, column_name string, ordinal int",
    )
    got = rows(relations.inferred_relationships(cols))
    # Orders has no key of its own, and neither `order` nor `boxes` refers to itself.
    assert got == [
        ("b.orders", "box_id", "s.boxes", "box_id"), ("b.orders", "customer_ID", "b.Customers", "ID"),
        ("s.notes", "order_id", "s.order", "id")]
    assert got == rows(relations.inferred_relationships(cols, min_rows=1))
    fks = spark.createDataFrame([("s", "notes", "nothing_id")], "table_schema string, table_name string, column_name string")
    assert len(rows(relations.inferred_relationships(cols, fks))) == 2


def test_key_flags_fall_back_without_declared_keys(spark):
    cols = spark.createDataFrame([("s", "T", "tid"), ("s", "T", "a_id"), ("s", "u", "b_id"), ("s", "u", "c_id")], "table_schema string, table_name string, column_name string")
    fks = cols.where("column_name = 'b_id'")
    flags = {r.column_name: (r.likely_pk, r.likely_fk) for r in relations.key_flags(cols, fks).collect()}
    assert flags == {"tid": (True, False), "a_id": (False, True), "b_id": (False, True), "c_id": (False, False)}
    none = relations.key_flags(cols, fks.limit(0))
    assert {r.column_name for r in none.where("likely_fk").collect()} == {"a_id", "b_id", "c_id"}


def test_graph_signature(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "x", "b", "y"), ("b", "y", "c", "z")], EDGES)
    sign = lambda n, e: relations.graph_signature(n, e).first()
    first = sign(nodes, edges)
    assert first == sign(nodes.union(nodes).repartition(5), edges.orderBy("target", ascending=False))
    assert first != sign(nodes.where("id <> 'c'"), edges)
    assert sign(nodes.limit(0), edges.limit(0)).signature == "0-0-0-0"


def test_mark_and_reconcile(spark, rows):
    t = spark.createDataFrame(
        [("p", "gold.a", "gold", None, None, None), ("p", "gold.b", "gold", "deleted", "t", "u"), ("p", "silver.c", "silver", "deleted", "t", "u"), ("q", "imports.d", "imports", None, None, None)],
        "pipeline_id string, fqn string, schema_name string, status string, deleted_at string, deleted_by string",
    )
    there = spark.createDataFrame([("silver", "c")], "table_schema string, table_name string")
    assert rows(lineage.reconcile_lineage(t, there), "fqn", "status", "deleted_by") == [
        ("gold.a", "missing", None), ("gold.b", "deleted", "u"), ("imports.d", None, None), ("silver.c", "present", None)]


# -- metadata ------------------------------------------------------------------------------------


def test_visible_schemas_of_an_empty_database(spark):
    empty = spark.createDataFrame([], "catalog_name string, schema_name string")
    got = [r.name for r in metadata.visible_schemas(empty, "own").orderBy("place", "name").collect()]
    assert got == ["imports", "data_cache", "bronze", "silver", "gold"]
    other = spark.createDataFrame([("x", "main"), ("x", "s"), ("own", "main"), ("own", "ops")], empty.schema)
    assert sorted(r.name for r in metadata.visible_schemas(other, "own", local=False).collect()) == ["main", "x", "x.s"]


def test_registry_keeps_creation_time(spark):
    cols = "id string, name string, created_at string, updated_at string"
    old = spark.createDataFrame([("a", "A", "t0", "t1"), ("b", "B", "t0", "t1")], cols)
    new = spark.createDataFrame([("a", None), ("c", "C")], "id string, name string")
    got = {r.id: tuple(r)[1:] for r in metadata.registry_upsert(old, new, "id", "created_at", F.lit("now")).collect()}
    assert got == {"a": ("A", "t0", "now"), "b": ("B", "t0", "t1"), "c": ("C", "now", "now")}


def test_retention(spark):
    data = [(i, f"u{i % 2}", f"2024-01-{1 + i % 28:02d} 10:00:00") for i in range(120)]
    df = spark.createDataFrame(data, "id int, u string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    now = F.lit("2024-01-20 10:00:00").cast("timestamp_ntz")
    got = {r.id for r in history.retain(df, "ts", "id", now, keep=5, by=["u"]).collect()}
    newest = {u: sorted((d for d in data if d[1] == u), key=lambda d: (d[2], -d[0]), reverse=True)[:5] for u in ("u0", "u1")}
    want = {d[0] for d in data if d[2] > "2024-01-13 10:00:00"} | {d[0] for ds in newest.values() for d in ds}
    assert got == want
    far = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    assert history.retain(df, "ts", "id", far, keep=7).count() == 7


# -- corpus --------------------------------------------------------------------------------------

INDEX = "path string, title string, md_title string, tags array<string>, md_body string, search_text string, updated string, last_run string"


@pytest.fixture
def index(spark):
    return spark.createDataFrame(
        [
            ("q/sales.sql", None, "Sales", ["finance"], "monthly sales notes", "sales", "2024-01-01", None),
            ("q/a.sql", "sales report", None, None, None, "select", "2024-01-02", None),
            ("q/b.sql", None, "Old sales", ["Sales"], None, "x", "2024-01-03", None),
            ("sales/c.sql", None, None, ["presales"], None, "y", "2024-01-04", "2024-01-09"),
            ("z/d.sql", None, None, None, "about\n  SALES here", "z", "2024-01-05", None),
            ("z/e.sql", None, None, None, None, "select sales from t", "2024-01-06", None),
            ("z/sales_f.sql", None, None, None, None, "w", "2024-01-07", None),
            ("sales/g.sql", None, None, None, None, "w", "2024-01-08", None),
            ("z/h.sql", None, None, None, None, None, "2024-01-08", None),
        ],
        INDEX,
    )


def test_search_scores(index):
    got = {r.path: r.score for r in corpus.corpus_search(index, "Sales").collect()}
    assert got == {"q/sales.sql": 100, "q/a.sql": 80, "q/b.sql": 60, "sales/c.sql": 40, "z/d.sql": 30, "z/sales_f.sql": 25, "sales/g.sql": 20, "z/e.sql": 10}


def test_search_needs_every_token_and_gives_a_snippet(index):
    found = corpus.corpus_search(index, "sales about").collect()
    assert [(r.path, r.score, r.snippet) for r in found] == [("z/d.sql", 60, "about SALES here")]
    assert corpus.corpus_search(index, "   ").count() == 0
    assert corpus.corpus_search(index, "absent").count() == 0


def test_search_scopes(index):
    paths = lambda scope: {r.path for r in corpus.corpus_search(index, "sales", scope).collect()}
    assert paths("title") == {"q/sales.sql", "q/a.sql", "q/b.sql"}
    assert paths("tags") == {"q/b.sql", "sales/c.sql"}
    assert paths("notes") == {"q/sales.sql", "z/d.sql"}
    assert paths("sql") == {"q/sales.sql", "z/e.sql"}


def test_many_searches_equal_single_ones(index):
    queries = {"one": "sales", "two": "sales about", "none": "absent"}
    got = sorted(tuple(r) for r in corpus.corpus_search_many(index, queries).collect())
    want = sorted((k, r.path, r.score) for k, q in queries.items() for r in corpus.corpus_search(index, q).collect())
    assert got == want


def test_recent(index):
    assert [r.path for r in corpus.recent_entries(index, 2).collect()] == ["sales/c.sql", "sales/g.sql"]


def test_groups_of_equal_texts(spark, rows):
    hashed = spark.createDataFrame([(f"p{i}", "hot" if i % 3 else f"h{i}") for i in range(30)], "path string, sql_hash string")
    members = corpus.hash_members(hashed, min_rows=5)
    assert {r.n_others for r in members.where("sql_hash = 'hot'").collect()} == {19} and members.count() == 30
    assert corpus.similar_queries(hashed, "p1").count() == 19
    assert corpus.similar_queries(hashed, "p0").count() == 0


def test_query_context_is_cut_exactly(spark):
    texts = spark.createDataFrame([(1, "SELECT * FROM s.t JOIN s.u"), (2, "SELECT 1"), (3, "SELECT * FROM s.none")], "qid int, sql string")
    cols = [("s", n, f"c{i}", "int", i) for n in ("t", "u") for i in range(40)]
    columns = spark.createDataFrame(cols, "table_schema string, table_name string, column_name string, data_type string, ordinal int")
    refs = spark.createDataFrame([("s.t",), ("s.u",)], "table_ref string")
    words = spark.createDataFrame([("s.t", "table t"), ("s.t.c0", "first")], "key string, description string")
    described = corpus.describe_join(refs, columns, words, words)
    whole = corpus.query_context(texts, "qid", described).collect()
    assert [r.qid for r in whole] == [1]
    text = whole[0].context
    assert text.startswith('{"tables":[{"schema":"s","table":"t","description":"table t","columns":[{"name":"c0","type":"int","description":"first"},{"name":"c1","type":"int"}')
    for size in (50, 300, len(text) - 1):
        short = corpus.query_context(texts, "qid", described, size).first().context
        assert short == text[:size] + "\n...truncated..."
    assert corpus.query_context(texts, "qid", described, len(text)).first().context == text


def test_merge_and_stale(spark, rows):
    cols = "key string, description string, source string, stale boolean"
    old = spark.createDataFrame([("a", "A", "ai", True), ("m", "M", "manual", True), ("k", "K", "ai", False)], cols)
    new = spark.createDataFrame([("a", "A2", "ai", None), ("m", "M2", "ai", None), ("n", "N", "ai", None), ("k", "", "ai", None)], cols)
    assert rows(corpus.merge_descriptions(old, new)) == [("a", "A2", "ai", False), ("k", "K", "ai", False), ("m", "M", "manual", True), ("n", "N", "ai", False)]
    twice = spark.createDataFrame([("a", "late", "ai", None, 2), ("a", "sooner", "ai", None, 1)], cols + ", block_no int")
    assert ("a", "late", "ai", False) in rows(corpus.merge_descriptions(old, twice))
    sampled = spark.createDataFrame([("a", "A", "ai", True, "1"), ("m", "M", "manual", True, "2")], cols + ", sample_value string")
    fresh = spark.createDataFrame([("a", "A2", "ai", None, "9"), ("m", "M2", "ai", None, "8")], cols + ", sample_value string")
    assert rows(corpus.merge_descriptions(sampled, fresh), "key", "sample_value") == [("a", "9"), ("m", "2")]
    known = spark.createDataFrame([("a",)], "key string")
    assert rows(corpus.stale_descriptions(old, known), "key", "stale") == [("a", False), ("k", True), ("m", True)]


def test_description_blocks(spark, rows):
    texts = [
        (1, 'Here:\n```json\n{"table": {"key": "s.t", "description": "d"}\n}\n```\nand {broken\n}\n{"columns": [{"key": "s.t.c", "description": "e"}]\n}'),
        (2, '{"schemaDescription": "only"}'), (6, '{"schemaDescription": "all", "table": {"key": "s.u", "description": "w"}}'), (3, "[]"), (4, ""), (5, '[{"columns": [{"key": "a", "description": ""}, {"key": "b", "description": "x"}]}]'),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    got = rows(corpus.description_blocks(df, "id"), "id", "kind", "target")
    assert got == [(1, "column", "s.t.c"), (1, "table", "s.t"), (5, "column", "b"), (6, "schema", "s"), (6, "table", "s.u")]


def test_cleanup(spark, rows):
    index = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    files = spark.createDataFrame([("b",), ("c",)], "path string")
    assert rows(corpus.corpus_cleanup(index, files)) == [("b", 2), ("c", None)]


# -- streams -------------------------------------------------------------------------------------


def test_late_events_and_repeated_batches(spark):
    schema = "seq long, op string, key string, new_key string, title string"
    incoming, log, point = (scratch_path(spark, n) for n in ("in", "log", "point"))
    batch = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(incoming)
    base = spark.createDataFrame([("x", "old", None)], "key string, title string, seq long")

    def run():
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
        index_stream.stream_changes(feed, log, point).awaitTermination()
        return sorted((tuple(r) for r in index_stream.current_index(base, log, schema, ["title"]).collect()), key=repr)

    batch([(5, "upsert", "a", None, "five")])
    assert run() == [("a", "five", 5), ("x", "old", None)]
    batch([(3, "delete", "a", None, None), (6, "rename", "x", "y", "none")])
    assert run() == [("a", "five", 5), ("y", "old", 6)]
    assert run() == [("a", "five", 5), ("y", "old", 6)]
    # The first batch as stored base, the second from the log.
    stored = spark.createDataFrame([("x", "old", None), ("a", "five", 5)], base.schema)
    rest = index_stream.current_index(stored, log, schema, ["title"], after=0)
    assert sorted(tuple(r) for r in rest.collect()) == [("a", "five", 5), ("y", "old", 6)]


def test_a_folded_base_remembers_deleted_keys(spark):
    schema = "seq long, op string, key string, new_key string, title string"
    log, path = scratch_path(spark, "log"), scratch_path(spark, "base")
    base = spark.createDataFrame([("x", "old", None), ("y", "old", None)], "key string, title string, seq long")
    for i, row in enumerate([(9, "delete", "x", None, None), (4, "upsert", "x", None, "late"), (10, "rename", "x", "z", "own")]):
        spark.createDataFrame([row], schema).write.parquet(f"{log}/batch={i:012d}")
    folded = index_stream.fold_index(base, log, schema, ["title"], path, upto=0)
    index_stream.drop_batches(spark, log, 0)
    found = index_stream.current_index(folded, log, schema, ["title"], after=0)
    assert sorted(tuple(r) for r in found.collect()) == [("y", "old", None), ("z", "own", 10)]


def test_many_traces_equal_single_ones(spark):
    """Diamonds, cycles, a self-edge, starts without edges, and more starts than a word has bits."""

    rng = random.Random(8)
    edges = [(f"t{rng.randrange(30)}", f"c{rng.randrange(3)}", f"t{rng.randrange(30)}", f"c{rng.randrange(3)}") for _ in range(110)]
    edges += [("t1", "c1", "t1", "c1"), edges[0], ("a", "x", "b", "y"), ("b", "y", "a", "x")]
    df = spark.createDataFrame(edges, "source string, source_column string, target string, target_column string")
    into = {}
    for s, sc, t, tc in edges:
        into.setdefault((t, tc), set()).add((s, sc))
    starts = [(f"t{i}", f"c{j}") for i in range(30) for j in range(3)] + [("alone", "z"), ("a", "x")]
    want = []
    for start in starts:
        distance, level, seen = 0, {start}, {}
        while level:
            seen |= {n: distance for n in level}
            level, distance = {s for n in level for s in into.get(n, ())} - seen.keys(), distance + 1
        want += [(*start, *n, d) for n, d in seen.items()]
    got = lineage.upstream_traces(df, spark.createDataFrame(starts, "table_fqn string, column_name string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(starts) > 64
    assert lineage.upstream_traces(df, spark.createDataFrame([], "table_fqn string, column_name string")).count() == 0


@pytest.mark.parametrize("most_sent", [0, 3, 10**6])
def test_traces_are_the_same_whether_rounds_are_sent_or_shuffled(spark, most_sent):
    rnd = random.Random(8)
    edges = [(f"t{rnd.randrange(25)}", f"c{rnd.randrange(2)}", f"t{rnd.randrange(25)}", f"c{rnd.randrange(2)}") for _ in range(60)]
    edges += [(None, "c0", "t1", "c0"), (None, "c0", "t2", "c0"), (None, "c0", "t3", "c1")]
    into = {}
    for a, b, c, d in edges:
        into.setdefault((c, d), set()).add((a, b))

    def reach(start):
        at, level = {start: 0}, [start]
        while level:
            level = [s for n in level if n[0] is not None for s in into.get(n, ()) if s not in at and not at.update({s: at[n] + 1})]
        return at

    df = spark.createDataFrame(edges, EDGES)
    want = reach(("t1", "c0"))
    columns, used = lineage.upstream_trace(df, "t1", "c0", most_sent=most_sent)
    found = columns.collect()
    assert sorted(map(repr, (r for r in found if r.table_fqn))) == sorted(repr(Row(table_fqn=t, column_name=c, distance=d)) for (t, c), d in want.items() if t)
    assert {tuple(r)[:2] for r in found} == set(want)
    assert {tuple(r) for r in used.collect()} == {e for e in edges if (e[2], e[3]) in want}
    starts = [(f"t{i}", f"c{i % 2}") for i in range(12)]
    # Edges without a name at one end are not numbered.
    named = [e for e in edges if e[0] is not None]
    got = lineage.upstream_traces(spark.createDataFrame(named, EDGES), spark.createDataFrame(starts, "table_fqn string, column_name string"), most_sent)
    whole = {(*s, *n, d) for s in starts for n, d in reach(s).items() if n[0] is not None}
    assert {tuple(r) for r in got.select("start_table", "start_column", "table_fqn", "column_name", "distance").collect()} == whole


def test_rounds_of_a_trace_do_not_shuffle_the_edges(spark, monkeypatch):
    plans, write = [], lineage.write_counted
    monkeypatch.setattr(lineage, "write_counted", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.createDataFrame([(f"t{i + 1}", "c", f"t{i}", "c") for i in range(4)], EDGES)
        columns, used = lineage.upstream_trace(df, "t0", "c")
        assert columns.count() == 5 and used.count() == 4
        assert "SortMergeJoin" not in used._jdf.queryExecution().executedPlan().toString()
        found = lineage.upstream_traces(df, spark.createDataFrame([("t0", "c")], "table_fqn string, column_name string"))
        assert found.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) >= 12 and not [p for p in plans if "SortMergeJoin" in p]


def test_joins_of_column_nodes_get_partitions_by_their_input(spark, monkeypatch):
    """The tasks of a join grow with its tables, so that a task's share does not."""
    cells = cut(spark.createDataFrame([(f"p{i % 3}", f"c{i}", i, "sql", "gold", f"o{i}", "table", f"SELECT a.x AS y, a.z FROM silver.s{i % 5} a") for i in range(200)], CELLS), "cells")
    catalog = cut(spark.createDataFrame([("gold", f"o{i}", c, "int") for i in range(200) for c in ("y", "z", "w") if i % 7], "table_schema string, table_name string, column_name string, data_type string"), "catalog")
    edges = cut(lineage.lineage_column_edges(cells, catalog), "edges")
    plain = lineage.lineage_column_nodes(cells, catalog, edges)
    want = sorted(map(repr, plain.collect()))
    monkeypatch.setattr(spread, "PART_BYTES", 500)
    dealt = lineage.lineage_column_nodes(cells, catalog, edges)
    assert sorted(map(repr, dealt.collect())) == want and len(want) > 500
    parts = spread.sized_parts(catalog)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 4
