import random

import pytest

from strata.operators import treediff
from strata.session import StrataError


def states(spark, n, seed=1):
    """Two states: most rows equal, some cells changed, rows inserted and deleted, null keys and null cells among them."""
    rng = random.Random(seed)
    old = {(i, f"k{i % 3}"): (i * 3, None if i % 7 == 0 else f"t{i}", i / 2) for i in range(n)}
    old[(None, "k")] = (1, "null key", 0.5)
    new = dict(old)
    for key in rng.sample(list(old), n // 50):
        a, b, c = new[key]
        new[key] = rng.choice([(a + 1, b, c), (a, None if b else "was null", c), (a, b, c), (a, b, c + 1)])
    for key in rng.sample(list(old), n // 100):
        new.pop(key)
    for i in range(n, n + n // 100):
        new[(i, None)] = (i, None, None)
    schema = "id bigint, k string, a bigint, b string, c double"
    return old, new, *(spark.createDataFrame([(*k, *v) for k, v in s.items()], schema).repartition(4) for s in (old, new))


def brute(old, new):
    def text(v):
        return None if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    out = []
    for key in old.keys() | new.keys():
        x, y = old.get(key), new.get(key)
        change = "inserted" if x is None else "deleted" if y is None else "updated"
        for i, name in enumerate("abc"):
            u, v = (text(s[i]) if s else None for s in (x, y))
            if change != "updated" or u != v:
                out.append((*key, change, name, u, v))
    return out


@pytest.mark.parametrize("most_sent", [treediff.MOST_SENT, 0])
def test_equals_brute_force(spark, most_sent):
    old, new, a, b = states(spark, 3000)
    got = [tuple(r) for r in treediff.state_diff(a, b, ["id", "k"], most_sent=most_sent).collect()]
    assert sorted(got, key=repr) == sorted(brute(old, new), key=repr) and {r[2] for r in got} == {"updated", "inserted", "deleted"}


def test_equal_ranges_are_not_read_by_cell(spark):
    """Few changes: few leaves differ, and only their rows pass to the join."""
    _, _, a, _ = states(spark, 5000)
    b = a.selectExpr("id", "k", "CASE WHEN id IN (7, 4000) THEN a + 1 ELSE a END AS a", "b", "c")
    levels = treediff.levels_for(5000)
    trees = [treediff.hash_tree(df, ["id", "k"], ["a", "b", "c"], levels) for df in (a, b)]
    leaves = treediff.differing_leaves(*trees)
    assert levels >= 2 and 1 <= leaves.count() <= 2
    passed = treediff.in_leaves(a, ("id", "k"), levels, leaves)
    assert passed.count() < 5000 * 2 * 4 / 16**levels + 200
    assert "Exchange hashpartitioning" not in passed._jdf.queryExecution().executedPlan().toString()
    got = treediff.state_diff(a, b, ["id", "k"], *trees).collect()
    assert sorted((r.id, r.change, r.column) for r in got) == [(7, "updated", "a"), (4000, "updated", "a")]


def test_levels_hold_the_sums_below(spark):
    _, _, a, _ = states(spark, 800)
    tree = treediff.hash_tree(a, ["id", "k"], ["a", "b", "c"], 2)
    rows = tree.nodes.collect()
    assert {r.level for r in rows} == {0, 1, 2} and len([r for r in rows if r.level == 0]) == 1
    for level in (0, 1):
        for r in (r for r in rows if r.level == level):
            below = [x for x in rows if x.level == level + 1 and x.node >> treediff.FANOUT_BITS == r.node]
            assert (r.n, r.low1, r.high2) == tuple(sum(x[c] for x in below) % 2**32 for c in ("n", "low1", "high2"))


def test_nulls_do_not_hide_a_change(spark):
    schema = "id int, a string, b string"
    one, two = (spark.createDataFrame([(1, *cells)], schema) for cells in ((None, "x"), ("x", None)))
    assert treediff.state_diff(one, two, ["id"]).count() == 2
    assert treediff.state_diff(one, one, ["id"]).count() == 0


def test_empty_states_and_other_trees(spark):
    schema = "id int, a string"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, "x")], schema)
    assert [tuple(r) for r in treediff.state_diff(none, one, ["id"]).collect()] == [(1, "inserted", "a", None, "x")]
    assert [tuple(r) for r in treediff.state_diff(one, none, ["id"]).collect()] == [(1, "deleted", "a", "x", None)]
    assert treediff.state_diff(none, none, ["id"]).count() == 0
    trees = [treediff.hash_tree(one, ["id"], ["a"], n) for n in (1, 2)]
    with pytest.raises(StrataError):
        treediff.differing_leaves(*trees)
    with pytest.raises(StrataError):
        treediff.state_diff(one.select("id"), one, ["id"])
