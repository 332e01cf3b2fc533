import pytest
from pyspark.sql import functions as F

from strata.operators import evolve, integrity, profile
from strata.session import StrataError


@pytest.fixture
def users(spark):
    return spark.createDataFrame(
        [(1, "a@x.org", 10), (2, "b@x.org", 11), (2, None, None), (None, "c", 99)], "id long, email string, org_id long"
    )


@pytest.fixture
def orgs(spark):
    return spark.createDataFrame([(10, "x"), (11, "y")], "id long, name string")


def test_keys_and_nulls(users, rows):
    assert rows(integrity.check_not_null(users, ["Email"])) == [(2, None, None)]
    assert rows(integrity.check_primary_key(users, ["id"])) == [(2, 2, "duplicate"), (None, 1, "null")]
    assert rows(integrity.check_unique(users, ["id"])) == [(2, 2)]
    assert rows(integrity.check_primary_key(users, ["id", "email"])) == [(2, None, 1, "null"), (None, "c", 1, "null")]
    with pytest.raises(StrataError):
        integrity.check_primary_key(users, ["nope"])


def test_check_passes_null(users, rows):
    assert rows(integrity.check_expression(users, "char_length(email) > 3"), "email") == [("c",)]


def test_foreign_key(users, orgs, rows):
    for min_rows in (1, 10**9):
        assert rows(integrity.check_foreign_key(users, orgs, ["org_id"], ["id"], min_rows), "org_id") == [(99,)]
    with pytest.raises(StrataError, match="counts"):
        integrity.check_foreign_key(users, orgs, ["org_id"], ["id", "name"])
    with pytest.raises(StrataError):
        integrity.check_foreign_key(users, orgs, [], [])


def test_composite_foreign_key(spark, rows):
    parent = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    child = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (None, "z")], "p int, q string")
    assert rows(integrity.check_foreign_key(child, parent, ["p", "q"], ["x", "y"])) == [(1, "b")]


@pytest.mark.parametrize(
    "action, expected",
    [
        ("CASCADE", [(1,), (2,), (None,)]),
        ("restrict", [(2,)]),
        ("NO ACTION", [(2,)]),
        ("SET NULL", [(1, 10), (2, None), (2, None), (None, 99)]),
        ("SET DEFAULT", [(1, 10), (2, 0), (2, None), (None, 99)]),
    ],
)
def test_on_delete(users, orgs, rows, action, expected):
    out = integrity.fk_on_delete(users, orgs.where("id = 11"), ["org_id"], ["id"], action, {"org_id": 0})
    assert rows(out, *(["id", "org_id"] if len(expected[0]) == 2 else ["id"])) == expected


def test_unknown_action(users, orgs):
    with pytest.raises(StrataError, match="invalid"):
        integrity.fk_on_delete(users, orgs, ["org_id"], ["id"], "EXPLODE")


def test_on_update(spark, users, rows):
    moves = spark.createDataFrame([(10, 100), (98, 980)], "old_key long, new_key long")
    assert rows(integrity.fk_on_update(users, moves, "ORG_ID"), "org_id") == [(100,), (11,), (99,), (None,)]
    twice = moves.unionByName(moves)
    assert rows(integrity.fk_on_update(users, twice, "org_id"), "org_id") == [(100,), (11,), (99,), (None,)]
    assert rows(integrity.fk_on_update(users, moves, "org_id", action="set null"), "org_id") == [(11,), (99,), (None,), (None,)]
    assert rows(integrity.fk_on_update(users, moves, "org_id", action="SET DEFAULT", default={"org_id": 0}), "org_id") == [(0,), (11,), (99,), (None,)]
    assert rows(integrity.fk_on_update(users, moves, "org_id", action="RESTRICT"), "org_id") == [(10,)]
    same = spark.createDataFrame([(10, 10)], "old_key long, new_key long")
    assert rows(integrity.fk_on_update(users, same, "org_id", action="NO ACTION")) == []
    with pytest.raises(Exception, match="two new ones"):
        integrity.fk_on_update(users, spark.createDataFrame([(10, 1), (10, 2)], "old_key long, new_key long"), "org_id").collect()


def test_defaults(users):
    out = integrity.column_defaults(users, {"EMAIL": "'none'", "extra": "1 + 1"})
    assert out.columns == ["id", "email", "org_id", "extra"]
    assert {r.email for r in out.collect()} == {"a@x.org", "b@x.org", "c", "none"}


# -- profiles ------------------------------------------------------------------------------------


def test_profile(users):
    found = {r.column_name: r for r in profile.column_profile(users).collect()}
    assert (found["id"].n_rows, found["id"].n_present, found["id"].n_distinct, found["id"].candidate_key) == (4, 3, 2, False)
    assert found["email"].pii and not found["id"].pii
    rough = {r.column_name: r for r in profile.column_profile(users, exact=False).collect()}
    assert rough["email"].n_distinct == 3 and rough["id"].min_text == "1"


def test_phone_is_pii(spark):
    df = spark.createDataFrame([("+49 (30) 123-4567", "2024.01", "12345678")], "phone string, a string, b string")
    assert {r.column_name: r.pii for r in profile.column_profile(df).collect()} == {"phone": True, "a": False, "b": False}


def test_profile_of_nothing(spark):
    assert profile.column_profile(spark.createDataFrame([], "a int")).count() == 0


@pytest.mark.parametrize(
    "child, parent, expected",
    [
        ([1, 2], [1, 2], ("one-to-one", 1.0)), ([1, 1, 3], [1, 2], ("many-to-one", 0.666667)),
        ([1], [1, 1], ("one-to-many", 1.0)), ([1, 1], [1, 1], ("many-to-many", 1.0)), ([], [1], ("one-to-one", 0.0)),
    ],
)
def test_relationship(spark, child, parent, expected):
    c = spark.createDataFrame([(x,) for x in child] + [(None,)], "k int")
    p = spark.createDataFrame([(x,) for x in parent], "k int")
    assert tuple(profile.relationship_profile(c, p, "k", "k").first())[:2] == expected


def test_grain_prefers_fewest_columns(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "a int, b int, c int")
    found = profile.table_grain(df, [["a"], ["a", "b"], ["c"]]).collect()
    assert {r.key_columns: (r.is_unique, r.grain) for r in found} == {"a": (False, False), "a,b": (True, False), "c": (True, True)}
    assert not any(r.grain for r in profile.table_grain(df, [["a"]]).collect())


# -- schema changes ------------------------------------------------------------------------------

COLS = "table_schema string, table_name string, column_name string, data_type string, is_nullable string"


def test_schema_diff(spark, rows):
    old = spark.createDataFrame([("s", "t", "a", "int", "NO"), ("s", "t", "b", "int", "NO"), ("s", "gone", "x", "int", "YES")], COLS)
    new = spark.createDataFrame([("s", "t", "a", "bigint", "YES"), ("s", "t", "c", "int", "NO"), ("s", "new", "x", "int", "YES")], COLS)
    assert rows(evolve.schema_diff(old, new), "table_name", "column_name", "change", "detail") == [
        ("gone", "x", "removed", None), ("gone", None, "table removed", None), ("new", "x", "added", None),
        ("new", None, "table added", None), ("t", "a", "changed", "data_type,is_nullable"), ("t", "b", "removed", None),
        ("t", "c", "added", None),
    ]
    assert evolve.schema_diff(old, old).count() == 0


def test_normalized_order(spark):
    names = ["b", "A", "a_b", "a1", "c"]
    df = spark.createDataFrame([("s", "t", n, "int", "NO") for n in names], COLS)
    assert [r.column_name for r in evolve.normalized_order(df).collect()] == ["A", "a_b", "a1", "b", "c"]


DRAFT = "table_name string, kind string, name string, definition string, nullable boolean, default_value string"


def test_alter_plan(spark):
    old = spark.createDataFrame(
        [
            ("t", "column", "Id", "INT", False, None), ("t", "column", "old", "INT", True, None),
            ("t", "column", "same", "INT", None, " "), ("t", "primary_key", None, "id, same", None, None),
            ("t", "unique", None, "a", None, None), ("t", "check", None, "id > 0", None, None),
            ("t", "index", "ix", "a", None, None),
        ],
        DRAFT,
    )
    new = spark.createDataFrame(
        [
            ("t", "column", "ID", "BIGINT ", True, "0"), ("t", "column", "new", "INT", False, None),
            ("t", "column", "same", "INT", True, None), ("t", "primary_key", None, "SAME,Id", None, None),
            ("t", "check", "c", "id > 1", None, None), ("t", "column", "  ", "INT", True, None),
            ("t", "index", "ix", "b", None, None),
        ],
        DRAFT,
    )
    plan = evolve.require_changes(evolve.alter_plan(old, new)).orderBy("step").collect()
    assert [(r.action, r.name, r.old_value, r.new_value) for r in plan] == [
        ("drop column", "old", "INT", None), ("add column", "new", None, "INT"), ("alter type", "ID", "INT", "BIGINT"),
        ("set nullability", "ID", "false", "true"), ("set default", "ID", "", "0"), ("add check", "c", None, "id > 1"),
    ]
    with pytest.raises(StrataError, match="no changes"):
        evolve.require_changes(evolve.alter_plan(old.where("name IS NOT NULL"), old.where("name IS NOT NULL")))


def test_evolve_table(spark):
    df = spark.createDataFrame([(1, "5", "x"), (2, "no", "y")], "id int, n string, gone string")
    done = evolve.evolve_table(df, ["GONE"], {"added": ("int", "7")}, {"N": "int"})
    assert [tuple(r) for r in done.rows.orderBy("id").collect()] == [(1, 5, 7), (2, None, 7)]
    assert [tuple(r) for r in done.failures.collect()] == [("n", 1)]
    assert evolve.evolve_table(df).failures.count() == 0
