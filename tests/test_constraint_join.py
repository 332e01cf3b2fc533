import pytest

from strata.operators import metadata, spread
from strata.session import cut

CONSTRAINTS = [
    ("db", "s", "a", "pk_a", "PRIMARY KEY"), ("db", "s", "b", "fk_b", "FOREIGN KEY"), ("db", "s", "b", "pk_b", "PRIMARY KEY"),
    ("db", "s", "c", "fk_b", "FOREIGN KEY"), ("db", "s", "b", "ck_b", "CHECK"), ("db", "pg_catalog", "x", "pk_x", "PRIMARY KEY"),
    (None, "s", "d", "fk_d", "FOREIGN KEY"), ("db", None, "e", "fk_e", "FOREIGN KEY"),
]
USAGE = [
    ("db", "s", "a", "pk_a", "id", 1), ("db", "s", "a", "pk_a", "tenant", 2), ("db", "s", "b", "fk_b", "a_id", 1), ("db", "s", "b", "fk_b", "a_tenant", 2),
    ("db", "s", "b", "pk_b", "id", 1), ("db", "s", "c", "fk_b", "a_id", 1), ("db", "s", "b", "ck_b", "id", 1), ("db", "pg_catalog", "x", "pk_x", "oid", 1),
    (None, "s", "d", "fk_d", "d_id", 1), ("db", None, "e", "fk_e", "e_id", 1),
]


@pytest.fixture
def tables(spark):
    return (
        spark.createDataFrame(CONSTRAINTS, "constraint_schema string, table_schema string, table_name string, constraint_name string, constraint_type string"),
        spark.createDataFrame(USAGE, "constraint_schema string, table_schema string, table_name string, constraint_name string, column_name string, ordinal_position int"),
        spark.createDataFrame([("db", "fk_b", "db", "pk_a"), ("db", "fk_b", "db", "pk_a"), ("db", "fk_e", None, "pk_a")], "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string"),
    )


def test_keys_that_refer_to_nothing_are_not_joined_with_targets(tables, rows, monkeypatch):
    sent, join = [], metadata.spread_join

    def spread_join(left, *more):
        sent.extend(r.unique_constraint_name for r in left.collect())
        return join(left, *more)

    monkeypatch.setattr(metadata, "spread_join", spread_join)
    found = metadata.constraint_join(*tables)
    assert rows(found) == sorted(
        [
            ("s", "a", "id", "pk_a", "PRIMARY KEY", None, None, None), ("s", "a", "tenant", "pk_a", "PRIMARY KEY", None, None, None),
            ("s", "b", "id", "pk_b", "PRIMARY KEY", None, None, None), ("s", "d", "d_id", "fk_d", "FOREIGN KEY", None, None, None),
            ("s", "b", "a_id", "fk_b", "FOREIGN KEY", "s", "a", "id"), ("s", "b", "a_tenant", "fk_b", "FOREIGN KEY", "s", "a", "tenant"),
            ("s", "c", "a_id", "fk_b", "FOREIGN KEY", "s", "a", "id"),
        ],
        key=repr,
    )
    assert sent == ["pk_a"] * 3


def test_large_catalogs_are_joined_slice_by_slice(spark, rows, monkeypatch):
    n = 300
    # A name twice in two tables, a reference to two keys, one to no key, a key with two columns, null names.
    constraints = [("db", "s", f"t{i}", f"pk_{i}", "PRIMARY KEY") for i in range(n)] + [("db", "s", f"t{i}", f"fk_{i // 2}", "FOREIGN KEY") for i in range(n)]
    usage = [("db", "s", f"t{i}", f"pk_{i}", f"id{p}", p) for i in range(n) for p in (1, 2)[: 1 + i % 2]]
    usage += [("db", "s", f"t{i}", f"fk_{i // 2}", f"to{p}", p) for i in range(n) for p in (1, 2)]
    constraints += [("db", "s", "x", None, "FOREIGN KEY"), ("db", "s", "y", "fk_y", "FOREIGN KEY")]
    usage += [("db", "s", "x", None, "c", 1), ("db", "s", "y", "fk_y", "c", 1)]
    refers = [("db", f"fk_{i}", "db", f"pk_{i * k}") for i in range(n // 2) for k in (1, 3)] * 2 + [("db", "fk_y", "db", None), ("db", None, "db", "pk_1")]
    columns = "constraint_schema string, table_schema string, table_name string, constraint_name string"
    tables = [
        cut(spark.createDataFrame(constraints, f"{columns}, constraint_type string")),
        cut(spark.createDataFrame(usage, f"{columns}, column_name string, ordinal_position int")),
        cut(spark.createDataFrame(refers, "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string")),
    ]
    whole = rows(metadata.constraint_join(*tables))
    written, in_turn = {}, metadata.cut_in_turn

    def cut_in_turn(parts, label):
        written[label] = [p.collect() for p in parts]
        return in_turn(parts, label)

    monkeypatch.setattr(spread, "SLICE_BYTES", 1)
    monkeypatch.setattr(metadata, "cut_in_turn", cut_in_turn)
    assert rows(metadata.constraint_join(*tables)) == whole
    # Each key column of a primary key and each of a foreign key per key that it refers to.
    assert len(whole) == n + n // 2 + 2 * 2 * (n - 2) + 2 * 2 + 1
    for label, parts in written.items():
        assert len(parts) == spread.MOST_SLICES and all(len(p) > len(whole) / 10 for p in parts), label
    names = [{r.constraint_name for r in p} for p in written["keys"]]
    assert sum(map(len, names)) == len(set().union(*names))
