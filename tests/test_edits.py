import random

import pytest
from pyspark.sql import functions as F

from strata.operators import edits as ed
from strata.session import StrataError

EDIT = "edit_id string, id long, column string, old_value string, new_value string"


@pytest.fixture
def base(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (2, "b", None), (3, None, 3.0), (4, "d", 4.0), (4, "e", 4.0)], "id long, Name string, price double"
    )


@pytest.fixture
def run(spark, base, rows):
    def apply(data):
        edits = spark.createDataFrame(data, EDIT)
        after = rows(ed.apply_edits(base, edits, ["ID"], ["name", "PRICE"]))
        status = dict(ed.edit_status(base, edits, ["ID"], ["name", "PRICE"]).collect())
        return after, status

    return apply


def test_all_cells_of_an_edit_or_none(run):
    after, status = run([
        ("ok", 1, "name", "a", "A"), ("ok", 1, "price", "1", "10"),
        ("half", 4, "name", "d", "D"), ("half", 4, "price", "5", "50"),
    ])
    assert status == {"ok": "applied", "half": "conflict"}
    assert (1, "A", 10.0) in after and (4, "d", 4.0) in after


def test_nulls_compare_as_equal(run):
    after, status = run([("p", 2, "price", None, "2"), ("n", 3, "name", None, "c"), ("x", 1, "name", None, "z")])
    assert status == {"p": "applied", "n": "applied", "x": "conflict"}
    assert (2, "b", 2.0) in after and (3, "c", 3.0) in after and (1, "a", 1.0) in after


def test_row_with_a_doubled_key_changes_where_it_fits(run):
    after, status = run([("e", 4, "name", "e", "E")])
    assert status == {"e": "applied"}
    assert (4, "E", 4.0) in after and (4, "d", 4.0) in after


def test_errors_and_ignored_edits(run):
    after, status = run([
        ("null", None, "name", "a", "x"), ("gone", 99, "name", "a", "x"), ("same", 1, "name", "a", "a"),
        ("key", 1, "id", "1", "7"), ("other", 1, "unknown", "1", "7"), ("bad", 2, "price", None, "much"),
        ("twice1", 1, "name", "a", "x"), ("twice2", 1, "NAME", "a", "y"),
    ])
    assert status == {"null": "error", "gone": "conflict", "bad": "error", "twice1": "error", "twice2": "error"}
    assert (1, "a", 1.0) in after


def test_two_edits_on_different_cells_of_a_row(run):
    after, status = run([("a", 1, "name", "a", None), ("b", 1, "price", "1.0", "2")])
    assert status == {"a": "applied", "b": "applied"}
    assert (1, None, 2.0) in after


def test_summary(spark, base):
    status = spark.createDataFrame([("a", "applied"), ("b", "conflict"), ("c", "error")], "edit_id string, status string")
    assert tuple(ed.edit_summary(status).first()) == (1, 1, 1, False)
    assert tuple(ed.edit_summary(status.where("status = 'applied'")).first()) == (1, 0, 0, True)


def test_missing_key_column(spark, base):
    edits = spark.createDataFrame([("a", 1, "name", "a", "b")], EDIT)
    with pytest.raises(StrataError, match="missing"):
        ed.apply_edits(base, edits, ["nope"], ["name"])


def test_diff_gives_edits_that_apply(spark, base, rows):
    before = base.where("id < 4")
    after = before.withColumn("name", F.upper("name")).withColumn("price", F.coalesce("price", F.lit(0.5)))
    changes = ed.edit_diff(before, after, ["id"])
    edits = changes.withColumn("edit_id", F.col("id").cast("string"))
    assert rows(ed.apply_edits(before, edits, ["id"], ["name", "price"])) == rows(after.select("id", "name", "price"))
    assert ed.edit_diff(before, before, ["id"]).count() == 0


# -- change feed ---------------------------------------------------------------------------------

FEED = "seq long, op string, key string, new_key string, title string"


def replay(index, feed):
    state = dict(index)
    for seq, op, key, new_key, title in sorted(feed):
        if op == "upsert":
            state[key] = (title, seq)
        elif op == "delete":
            state.pop(key, None)
        elif key != new_key:
            found = state.pop(key, None)
            state[new_key] = (found[0] if found else title, seq)
    return sorted(((k, t, s) for k, (t, s) in state.items()), key=repr)


def apply(spark, index, feed):
    base = spark.createDataFrame([(k, t, s) for k, (t, s) in index.items()], "key string, title string, seq long")
    out = ed.apply_change_feed(base, spark.createDataFrame(feed, FEED).repartition(3), ["title"])
    return sorted(((r.key, r.title, r.seq) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_change_feed_equals_replay(spark, seed):
    rnd = random.Random(seed)
    keys = list("abcdef")
    feed = [
        (i, rnd.choice(["upsert", "upsert", "delete", "rename", "rename", "rename"]), rnd.choice(keys), rnd.choice(keys), f"t{i}")
        for i in range(200 if seed else 60)
    ]
    rnd.shuffle(feed)
    index = {k: (f"start {k}", None) for k in keys[:3]}
    assert apply(spark, index, feed) == replay(index, feed)


def test_long_chain_of_renames(spark):
    feed = [(0, "upsert", "k0", None, "origin")] + [(i, "rename", f"k{i - 1}", f"k{i}", "none") for i in range(1, 40)]
    assert apply(spark, {"x": ("kept", None)}, feed) == [("k39", "origin", 39), ("x", "kept", None)]


def test_feed_without_renames(spark):
    feed = [(3, "upsert", "a", None, "new"), (1, "upsert", "a", None, "late"), (2, "delete", "b", None, None)]
    assert apply(spark, {"a": ("old", None), "b": ("old", None)}, feed) == [("a", "new", 3)]


def test_order_numbers_in_nanoseconds(spark):
    start = 1_700_000_000_000_000_000
    feed = [(start + 3_600_000_000_000 * i, "upsert", "hot", None, f"t{i}") for i in range(300)]
    feed.append((start + 3_600_000_000_000 * 150 + 1, "rename", "hot", "moved", "none"))
    assert apply(spark, {"x": ("kept", None)}, feed) == [
        ("hot", "t299", start + 3_600_000_000_000 * 299), ("moved", "t150", start + 3_600_000_000_000 * 150 + 1), ("x", "kept", None)
    ]


def test_an_edit_of_two_rows_applies_as_a_whole(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    edits = spark.createDataFrame(
        [("half", 1, "name", "a", "A"), ("half", 2, "name", "stale", "B"), ("gone", 3, "name", "c", "C"), ("gone", 9, "name", "x", "X")],
        "edit_id string, id int, column string, old_value string, new_value string",
    )
    assert sorted(map(tuple, ed.apply_edits(base, edits, ["id"], ["name"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, ed.edit_status(base, edits, ["id"], ["name"]).collect())) == [("gone", "conflict"), ("half", "conflict")]
