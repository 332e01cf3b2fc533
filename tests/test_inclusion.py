import itertools
import random
from collections import Counter

import pytest

from strata.operators import inclusion, profile


def tables(spark):
    rng = random.Random(2)
    parent = [(i, f"p{i % 20}", float(i)) for i in range(40)]
    child = [(i, rng.choice([None, *range(30)]), rng.choice(["p1", "p2", "x", None]), rng.choice([1.0, 2.5, float("nan"), None])) for i in range(300)]
    lone = [(f"z{i}", i % 2 == 0) for i in range(10)]
    schemas = {"parent": "id bigint, name string, price double", "child": "id int, ref int, tag string, cost double", "lone": "code string, flag boolean"}
    rows = {"parent": parent, "child": child, "lone": lone}
    return rows, schemas, {n: spark.createDataFrame(rows[n], s) for n, s in schemas.items()}


def brute(rows, schemas, least):
    held = {}
    for name, schema in schemas.items():
        for i, field in enumerate(schema.split(", ")):
            column, kind = field.split(" ")
            kind = {"bigint": "n", "int": "n", "double": "n", "string": "s", "boolean": "b"}[kind]
            held[f"{name}.{column}"] = (kind, Counter(r[i] for r in rows[name] if r[i] is not None and r[i] == r[i]))
    out = {}
    for (a, (ka, va)), (b, (kb, vb)) in itertools.permutations(held.items(), 2):
        shared = va.keys() & vb.keys()
        if ka == kb and shared and len(shared) >= least * len(va):
            many = tuple(max(v.values()) > 1 for v in (va, vb))
            kind = {(True, True): "many-to-many", (True, False): "many-to-one", (False, True): "one-to-many", (False, False): "one-to-one"}[many]
            out[a, b] = (kind, round(len(shared) / len(va), 6), len(va), len(shared), sum(va.values()), sum(va[x] for x in shared))
    return out


@pytest.mark.parametrize("least", [1.0, 0.5, 0.0])
def test_equals_brute_force(spark, least):
    rows, schemas, dfs = tables(spark)
    got = {(r.child, r.parent): tuple(r)[2:] for r in inclusion.inclusions(dfs, least_share=least).collect()}
    assert got == brute(rows, schemas, least) and got
    assert ("child.ref", "parent.id") in got


def test_agrees_with_the_profile_of_one_pair(spark):
    _, _, dfs = tables(spark)
    one = profile.relationship_profile(dfs["child"], dfs["parent"], "ref", "id").first()
    row = next(r for r in inclusion.inclusions(dfs).collect() if (r.child, r.parent) == ("child.ref", "parent.id"))
    assert (row.relationship, row.n_child, row.n_matched) == (one.relationship, one.n_child, one.n_matched)


def test_rows_paired_do_not_grow_with_the_data(spark):
    """Twice the rows, the same sets of columns."""
    sizes = []
    for n in (500, 5000):
        df = spark.createDataFrame([(i, i % 50, "x") for i in range(n)], "a int, b int, c string")
        sizes.append(inclusion.column_sets(inclusion.value_counts({"t": df})).count())
    assert sizes[0] == sizes[1] <= 3


def test_chosen_columns_and_empty_tables(spark):
    _, _, dfs = tables(spark)
    got = inclusion.inclusions(dfs, {"child": ["ref"], "parent": ["id"]}, 0.0).collect()
    assert {(r.child, r.parent) for r in got} == {("child.ref", "parent.id"), ("parent.id", "child.ref")}
    assert inclusion.inclusions({n: df.limit(0) for n, df in dfs.items()}).count() == 0
