import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.plans import cells, lifecycle, script
from strata.plans.analyze import analyze
from strata.session import LAYERS, RUN_LOG, StrataError, clear_scratch, cut, work_root
from strata.sources import cache, catalog, files, remote


def test_layers_exist(wb):
    assert all(wb.spark.catalog.databaseExists(layer) for layer in (*LAYERS, "ops"))
    assert wb.exists(RUN_LOG)
    wb.init_layers()


def test_cluster_names_the_folder(spark):
    assert work_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_cut_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("s", F.array(F.col("id")))
    assert cut(df).dtypes == df.dtypes
    assert sorted(cut(df).collect()) == sorted(df.collect())


@pytest.mark.parametrize("sql", ["SELECT 1 AS x;", "VALUES (1)", "WITH t AS (SELECT 1 AS x) SELECT * FROM t -- end", "SELECT 1 AS x ; ; "])
def test_analyze(spark, sql):
    assert analyze(spark, sql).count() == 1


def test_analyze_show(wb):
    assert "bronze" in {r[0] for r in analyze(wb.spark, "SHOW DATABASES").collect()}


@pytest.mark.parametrize("sql", ["DROP TABLE silver.keep", "INSERT INTO silver.keep SELECT 2", "SELECT 1; SELECT 2", "CREATE TABLE silver.made (a int)"])
def test_a_cell_must_be_a_query(wb, sql):
    cells.transform(wb, "SELECT 1 AS x", "silver", "keep")
    with pytest.raises(StrataError, match="single query"):
        cells.transform(wb, sql, "silver", "out")
    assert wb.table("silver.keep").count() == 1
    assert not wb.exists("silver.made")


def test_words_in_literals_and_names_do_no_harm(wb):
    done = cells.transform(wb, "SELECT 'drop it' AS `update` /* DELETE */", "gold", "words")
    assert done.rows == 1 and done.preview.columns == ["update"]


@pytest.mark.parametrize(
    "layer, output, message",
    [("imports", "x", "reserved"), ("ops", "x", "reserved"), ("platinum", "x", "not allowed"), ("silver", None, "required"), ("silver", "Big", "snake_case"), ("silver", "a-b", "snake_case")],
)
def test_targets(wb, layer, output, message):
    with pytest.raises(StrataError, match=message):
        cells.transform(wb, "SELECT 1 AS x", layer, output)


def test_replace_keeps_views_and_changes_kind(wb):
    cells.transform(wb, "SELECT 1 AS x", "silver", "base")
    cells.transform(wb, "SELECT x + 1 AS y FROM silver.base", "gold", "seen", "view")
    cells.transform(wb, "SELECT x + 10 AS x FROM silver.base UNION ALL SELECT 5", "silver", "base")
    assert sorted(r.y for r in wb.table("gold.seen").collect()) == [6, 12]
    assert cells.transform(wb, "SELECT 3 AS z", "gold", "seen").kind == "BASE TABLE"
    assert cells.transform(wb, "SELECT 4 AS z", "gold", "seen", "view").kind == "VIEW"


def test_failed_write_leaves_the_table(wb):
    cells.transform(wb, "SELECT 1 AS x", "silver", "safe")
    with pytest.raises(Exception):
        cells.transform(wb, "SELECT raise_error('no') AS x FROM silver.safe", "silver", "safe")
    assert [r.x for r in wb.table("silver.safe").collect()] == [1]


def test_old_version_stays_readable_once(wb):
    cells.transform(wb, "SELECT 1 AS x", "silver", "versions")
    held = wb.table("silver.versions")
    cells.transform(wb, "SELECT 2 AS x", "silver", "versions")
    assert held.first().x == 1
    assert wb.table("silver.versions").first().x == 2


def test_run_cells_reports_each(wb):
    before = wb.table(RUN_LOG).count()
    log = cells.run_cells(wb, [
        cells.Cell("a", "SELECT 1 AS x", "bronze", "run_a"),
        cells.Cell("b", "SELECT nope FROM bronze.run_a", "silver", "run_b"),
        cells.Cell("c", "SELECT * FROM bronze.run_a", "gold", "run_c", mode="analyze"),
        cells.Cell("d", "   "), cells.Cell("e", "text", kind="markdown"),
    ], "nb")
    got = {r.cell_id: (r.status, r.rows, bool(r.error)) for r in log.collect()}
    assert got == {"a": ("success", 1, False), "b": ("error", None, True), "c": ("success", 1, False)}
    assert wb.table(RUN_LOG).count() == before + 3 and not wb.exists("gold.run_c")


def test_script(wb):
    run = script.run_script(wb, ["SELECT id FROM range(30)", "SELECT id FROM range(30) LIMIT 5;", "SELECT oops", "SELECT 1"], 20)
    got = [(r.idx, r.status, r.kind, r.row_count) for r in run.status.orderBy("idx").collect()]
    assert got == [(1, "success", "tabular", 20), (2, "success", "tabular", 5), (3, "error", None, None), (4, "skipped", None, None)]
    assert run.failed_at == 3 and run.last_result.count() == 5


@pytest.mark.parametrize(
    "sql, cap, rows, clamped, limit",
    [("SELECT id FROM range(50)", 10, 10, False, 10), ("SELECT id FROM range(50) LIMIT 20", 10, 10, True, 10),
     ("SELECT id FROM range(50) LIMIT 5 OFFSET 2", 10, 5, False, 5), ("SELECT id FROM range(50)", 0, 50, False, 0)],
)
def test_row_cap(wb, sql, cap, rows, clamped, limit):
    got = script.capped_query(wb, sql, cap)
    assert (got.rows.count(), got.clamped, got.effective_limit) == (rows, clamped, limit)


# -- sources -------------------------------------------------------------------------------------


def test_import_text_files(wb, tmp_path):
    (tmp_path / "my data.csv").write_text('id,name,day\n1,"a ""q"", b",2024-01-02\n2,,2024-01-03\n')
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2.5\n")
    (tmp_path / "semi.txt").write_text("a;b;c\n1;x,y;true\n")
    done = files.import_file(wb, str(tmp_path / "my data.csv"))
    assert (done.target, done.view, done.rows) == ("imports.my_data", "bronze.raw__file__my_data", 2)
    assert dict(wb.table(done.view).dtypes) == {"id": "bigint", "name": "string", "day": "date"}
    assert wb.table(done.view).where("id = 1").first().name == 'a "q", b'
    assert wb.table(files.import_file(wb, str(tmp_path / "t.tsv")).target).dtypes == [("a", "bigint"), ("b", "double")]
    row = wb.table(files.import_file(wb, str(tmp_path / "semi.txt")).target).first()
    assert tuple(row) == (1, "x,y", True)
    (tmp_path / "lines.csv").write_text('a,b\n1,"x\ny, ""z"""\n2,w\n')
    lines = wb.table(files.import_file(wb, str(tmp_path / "lines.csv")).target)
    assert [tuple(r) for r in lines.orderBy("a").collect()] == [(1, 'x\ny, "z"'), (2, "w")]
    kept = files.import_file(wb, str(tmp_path / "t.tsv"), name="my data", overwrite=False)
    assert (kept.status, kept.rows) == ("kept", 2)


def test_import_files_go_on_after_a_failure(wb, tmp_path):
    (tmp_path / "ok.csv").write_text("a\n1\n")
    (tmp_path / "bad.xlsx").write_text("")
    report = files.import_files(wb, [str(tmp_path / n) for n in ("bad.xlsx", "gone.csv", "ok.csv")])
    assert [(r.status, r.rows) for r in report.collect()] == [("failed", None), ("failed", None), ("imported", 1)]


def test_read_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("SELECT 1")
    (tmp_path / "a.md").write_text("note é")
    (tmp_path / "sub" / "b.postgres").write_text("SELECT 2")
    (tmp_path / "sub" / "c.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: (r.sql, r.note) for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.sql": ("SELECT 1", "note é"), "b.postgres": ("SELECT 2", None)}


def test_cache(wb):
    done = cache.cache_query(wb, "SELECT id FROM range(30);", "My DB", "Top Rows", max_rows=10)
    assert (done.target, done.view, done.rows) == ("data_cache.my_db__top_rows", "bronze.raw__my_db__top_rows", 10)
    assert cache.cache_query(wb, "SELECT id FROM range(30) LIMIT 20", "My DB", "own limit", max_rows=10).rows == 20
    assert done.capped and not cache.cache_query(wb, "SELECT id FROM range(10)", "My DB", "full", max_rows=10).capped
    assert cache.cache_query(wb, "SELECT id, 'limit 5' AS note FROM range(30)", "My DB", "note", max_rows=10).rows == 10
    assert cache.cache_query(wb, "SELECT a.id FROM (SELECT id FROM range(30) LIMIT 20) a JOIN range(2) b ON b.id < 2", "My DB", "sub", max_rows=10).rows == 10
    assert cache.cache_query(wb, "SELECT id FROM range(200000); -- all of them", "My DB", "whole").rows == 200_000
    empty = cache.cache_query(wb, "SELECT id FROM range(0)", "My DB", "empty")
    assert empty.rows == 0 and not wb.exists(empty.target)
    assert cache.cache_query(wb, "SELECT 1 AS id", "My DB", "Top Rows", overwrite=False).rows == 0
    assert wb.table(done.view).count() == 10
    assert cache.cache_rows(wb, [(1, None), (2, "x")], "a int, b string", "db").rows == 2
    with pytest.raises(StrataError, match="reserved"):
        cache.cache_table(wb, "bronze.raw__my_db__top_rows", "db")
    with pytest.raises(StrataError):
        cache.cache_table(wb, "BRONZE.raw__my_db__top_rows", "db")


def test_cached_table_is_sorted_by_its_keys(wb, tmp_path):
    wb.spark.range(100).select((99 - F.col("id")).alias("k")).write.parquet(str(tmp_path / "t"))
    wb.spark.sql(f"CREATE DATABASE IF NOT EXISTS elsewhere LOCATION '{tmp_path}/db'")
    wb.mount("elsewhere.shuffled", str(tmp_path / "t"))
    done = cache.cache_table(wb, "elsewhere.shuffled", "db", keys=["k"])
    stored = wb.table(done.target).select(F.input_file_name().alias("f"), "k").collect()
    assert len(stored) == 100
    for file in {r.f for r in stored}:
        own = [r.k for r in stored if r.f == file]
        assert own == sorted(own)


def test_remote_options():
    plain = remote.remote_options("jdbc:x", "public.users", user="me")
    assert plain == {"url": "jdbc:x", "dbtable": "public.users", "user": "me"}
    split = remote.remote_options("jdbc:x", "SELECT * FROM t ; ", remote.Split("id", 4, 1, 100))
    assert split["dbtable"] == "(SELECT * FROM t) remote_query"
    assert (split["partitionColumn"], split["numPartitions"], split["lowerBound"], split["upperBound"]) == ("id", "4", "1", "100")
    assert remote.bounds_query("t", "id") == "SELECT MIN(id) AS lo, MAX(id) AS hi FROM t"
    with pytest.raises(ValueError):
        remote.remote_options("jdbc:x", "t", remote.Split("id", 4))


# -- catalog and lifecycle -----------------------------------------------------------------------


def test_catalog(wb):
    wb.spark.range(1).createOrReplaceTempView("temporary_one")
    cells.transform(wb, "SELECT 1 AS a, 'x' AS b", "silver", "listed")
    cells.transform(wb, "SELECT * FROM silver.listed", "gold", "listed", "view")
    found = {(r.table_schema, r.table_name): r.table_type for r in catalog.catalog_tables(wb).collect()}
    assert found[("silver", "listed")] == "BASE TABLE" and found[("gold", "listed")] == "VIEW"
    assert not any(name == "temporary_one" for _, name in found)
    cols = catalog.catalog_columns(wb, ["silver.listed", "silver.absent"]).orderBy("ordinal").collect()
    assert [(r.column_name, r.data_type, r.ordinal) for r in cols] == [("a", "int", 1), ("b", "string", 2)]
    assert catalog.all_columns(wb, ("gold",)).where("table_name = 'listed'").count() == 2


NODES = "pipeline_id string, fqn string, schema_name string, status string, deleted_at timestamp, deleted_by string, cell_id string"


def test_drop_and_reset(wb, tmp_path):
    (tmp_path / "d.csv").write_text("a\n1\n")
    files.import_file(wb, str(tmp_path / "d.csv"), name="dropme")
    nodes = wb.spark.createDataFrame([("p", "gold.x", "gold", "present", None, None, "c"), ("p", "imports.dropme", "imports", None, None, None, None)], NODES)
    assert lifecycle.drop_object(wb, "imports.dropme", nodes) is nodes
    assert not wb.exists("imports.dropme") and not wb.exists("bronze.raw__file__dropme")
    cells.transform(wb, "SELECT 1 AS a", "gold", "x")
    at = dt.datetime(2024, 1, 1)
    marked = lifecycle.drop_object(wb, "gold.x", nodes, at=at)
    assert [(r.status, r.deleted_at, r.deleted_by) for r in marked.where("fqn = 'gold.x'").collect()] == [("deleted", at, "user")]
    cells.transform(wb, "SELECT 1 AS a", "gold", "x")
    again = lifecycle.reset_layer(wb, "gold", nodes)
    assert not wb.exists("gold.x") and again.where("deleted_by = 'system'").count() == 1
    with pytest.raises(StrataError):
        lifecycle.reset_layer(wb, "imports")
    cells.transform(wb, "SELECT 1 AS a", "gold", "x")


def test_clear_scratch(spark):
    df = cut(spark.range(5))
    clear_scratch(spark)
    with pytest.raises(Exception):
        df.withColumn("y", F.rand()).collect()
