import pytest
from pyspark.sql import functions as F

from strata.operators import evolve, grid
from strata.plans import script
from strata.session import StrataError

STEPS = "table_name string, step int, action string, name string, old_value string, new_value string"


def drafts(spark, old, new):
    schema = "table_name string, kind string, name string, definition string, nullable boolean, default_value string"
    return evolve.alter_plan(*(spark.createDataFrame([("t", *r) for r in rows], schema) for rows in (old, new)))


OLD = [("column", "id", "BIGINT", False, None), ("column", "a", "VARCHAR", True, None), ("column", "b", "INT", True, None), ("column", "gone", "INT", True, None)]
NEW = [
    ("column", "ID", "BIGINT", False, None), ("column", "a", "INT", True, None), ("column", "b", "INT", False, None), ("column", "c", "STRING", True, None),
    ("primary_key", None, "id", None, None), ("unique", "u", "a, b", None, None), ("check", "positive", "b > 0", None, None), ("foreign_key", "fk", "b", None, None),
]


@pytest.fixture
def table(wb):
    def make(rows):
        wb.replace_table("silver.planned", wb.spark.createDataFrame(rows, "id bigint, a string, b int, gone int"))
        return wb

    return make


def test_a_plan_applies_as_a_whole(spark, table, rows):
    wb = table([(1, "5", 1, 0), (2, "6", 2, 0), (3, None, 2, 0)])
    plan = drafts(spark, OLD, NEW)
    parent = spark.createDataFrame([(1,), (2,)], "b int")
    assert evolve.apply_plan(wb, "silver.planned", plan, {"C": "concat('n', a)"}, {"fk": parent}) == 3
    got = wb.table("silver.planned")
    assert got.dtypes == [("id", "bigint"), ("a", "int"), ("b", "int"), ("c", "string")]
    assert rows(got) == [(1, 5, 1, "n5"), (2, 6, 2, "n6"), (3, None, 2, None)]


def test_what_stands_against_a_plan_leaves_the_table_as_it_was(spark, table, rows):
    data = [(1, "x", 1, 0), (1, "6", 2, 0), (None, "6", 2, 0), (4, "7", None, 0), (5, "8", -3, 0)]
    wb = table(data)
    plan = drafts(spark, OLD, NEW)
    parent = spark.createDataFrame([(1,), (2,)], "b int")
    found = evolve.plan_rows(wb.table("silver.planned"), plan, None, {"fk": parent}).failures
    got = {(r.action, r.name): r.n_failed for r in found.collect()}
    assert got == {
        ("alter type", "a"): 1, ("set nullability", "b"): 1, ("add primary_key", None): 2, ("add unique", "u"): 1, ("add check", "positive"): 1, ("add foreign_key", "fk"): 1,
    }
    with pytest.raises(StrataError, match="alter type a: 1 rows; set nullability b: 1 rows"):
        evolve.apply_plan(wb, "silver.planned", plan, None, {"fk": parent})
    assert rows(wb.table("silver.planned")) == sorted(data, key=repr)


def test_plans_that_do_not_fit_the_table(spark, table):
    wb = table([(1, "5", 1, 0)])
    for action, name in (("drop column", "nothing"), ("add column", "A"), ("alter type", "nothing")):
        with pytest.raises(StrataError):
            evolve.plan_rows(wb.table("silver.planned"), spark.createDataFrame([("t", 1, action, name, None, "INT")], STEPS))
    with pytest.raises(StrataError, match="no changes"):
        evolve.apply_plan(wb, "silver.planned", spark.createDataFrame([], STEPS))


KEYS = [("a", "desc"), ("id", "asc")]


def pages(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") % 11 != 0, F.col("id") % 7).alias("a"), F.concat(F.lit("v"), "id").alias("v"))


@pytest.mark.parametrize("shallow", [grid.SHALLOW_ROWS, 0])
def test_pages_of_any_kind_agree(spark, monkeypatch, shallow):
    monkeypatch.setattr(grid, "SHALLOW_ROWS", shallow)
    df = pages(spark, 950)
    want = sorted(((r.id, r.a, r.v) for r in df.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    index = grid.page_index(df, KEYS, 6)
    for page in (1, 2, 7, 10, 11):
        expected = want[(page - 1) * 100 : page * 100]
        assert [tuple(r) for r in grid.grid_page(df, KEYS, page).collect()] == expected
        assert [tuple(r) for r in grid.indexed_page(index, page).collect()] == expected


def test_a_later_page_reads_one_part(spark):
    index = grid.page_index(pages(spark, 20_000), KEYS, 8)
    page = grid.indexed_page(index, 90)
    held = index.where(F.col("row_no").between(8901, 9000))
    files = held.select(held.metadataColumn("_metadata")["file_path"].alias("f")).distinct().count()
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert files <= 2 and "PushedFilters: [IsNotNull(row_no), GreaterThanOrEqual(row_no,8901), LessThanOrEqual(row_no,9000)]" in plan


def test_shallow_pages_are_a_top_k(spark):
    plan = grid.grid_page(pages(spark, 1000), KEYS, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_a_capped_result_says_so(wb):
    run = script.run_script(wb, ["SELECT id FROM range(30)", "SELECT id FROM range(20)", "SELECT id FROM range(30) LIMIT 20", "SELECT id FROM range(30) LIMIT 25"], 20)
    assert [(r.row_count, r.capped) for r in run.status.orderBy("idx").collect()] == [(20, True), (20, False), (20, False), (20, True)]
    free = script.run_script(wb, ["SELECT id FROM range(30)"], 0).status.first()
    assert (free.row_count, free.capped) == (30, False)
