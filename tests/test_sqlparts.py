import pytest
from pyspark.sql import functions as F

from strata.functions import sqlparts as sp


@pytest.fixture
def parts(one):
    def get(sql, fn):
        return one(lambda c: fn(sp.strip_comments(c)), sql)

    return get


def fqns(found):
    return [(s.fqn, s.alias) for s in found]


@pytest.mark.parametrize(
    "sql, refs",
    [
        ("SELECT * FROM a.b JOIN c.d.e ON 1=1", ["a.b", "d.e"]),
        ("select * from bare", []),
        ("INSERT INTO x . y SELECT 1; UPDATE z.w SET a=1; create TABLE q.r (a int)", ["x.y", "z.w", "q.r"]),
        ("-- from no.no\nSELECT 1 /* from no.no */ FROM a.b, c.d", ["a.b", "c.d"]),
        ("SELECT 1 FROM a.b x , c . d AS y, (SELECT 2 FROM e.f) WHERE count.x = 1", ["a.b", "c.d", "e.f"]),
        ("FROM a.b FROM a.b", ["a.b"]),
    ],
)
def test_table_refs(one, sql, refs):
    assert one(sp.table_refs, sql) == refs


def test_strip_comments_keeps_literals(one):
    assert one(sp.strip_comments, "a/*x*/b '--no /*no*/' --yes\nc") == "a b '--no /*no*/'  \nc"
    assert one(sp.strip_comments, "'a'/*x*/'b'") == "'a' 'b'"


def test_join_without_alias_is_seen(parts):
    found = parts("SELECT * FROM bronze.a JOIN bronze.b ON 1=1", sp.sources)
    assert fqns(found) == [("bronze.a", None), ("bronze.b", None)]


@pytest.mark.parametrize("word", ["FULL", "USING", "NATURAL", "WHERE", "LEFT"])
def test_words_after_a_table_are_no_alias(parts, word):
    assert fqns(parts(f"SELECT 1 FROM silver.t {word} JOIN gold.u x", sp.sources))[0] == ("silver.t", None)


def test_comma_list_is_read_to_the_end(parts):
    found = parts("SELECT 1 FROM bronze.a x, silver.b AS y , gold.c WHERE 1=1", sp.sources)
    assert fqns(found) == [("bronze.a", "x"), ("silver.b", "y"), ("gold.c", None)]


def test_only_layer_schemas_count(parts):
    sql = "SELECT * FROM imports.r JOIN public.users u JOIN data_cache.d d ON 'FROM gold.no' = x"
    assert fqns(parts(sql, sp.sources)) == [("imports.r", None), ("data_cache.d", "d")]


def items(parts, sql):
    found = parts(sql, sp.select_items)
    return None if found is None else [(i.expression, i.alias, i.confidence, i.is_wildcard) for i in found]


def test_select_items(parts):
    sql = """SELECT c.id, count(*), sum(a, (b)) AS total, name nm, 'x, FROM y' lit, t.*, *, 5, CASE
      WHEN 1 THEN 2 END AS k, a + b FROM bronze.c"""
    assert items(parts, sql) == [
        ("c.id", "id", 0.9, False),
        ("count(*)", "__unnamed_1", 0.8, False),
        ("sum(a, (b))", "total", 0.8, False),
        ("name", "nm", 0.6, False),
        ("'x, FROM y'", "lit", 0.5, False),
        ("t.*", "*", 0.4, True),
        ("*", "*", 0.4, True),
        ("5", "5", 0.6, False),
        ("CASE\n      WHEN 1 THEN 2 END", "k", 0.5, False),
        ("a + b", "__unnamed_9", 0.5, False),
    ]


def test_last_select_counts(parts):
    assert items(parts, "WITH t AS (SELECT a FROM x) SELECT b, c FROM t")[0][0] == "b"


@pytest.mark.parametrize("sql", ["SELECT 1", "UPDATE t SET a = 1", "SELECT 'open FROM x", "selected FROM x", "SELECT (a FROM x"])
def test_no_select_list(parts, sql):
    assert not items(parts, sql)


def test_from_inside_a_word_or_parens_does_not_end_the_list(parts):
    assert [i[1] for i in items(parts, "SELECT extract(day FROM ts) AS d, fromage, a_from FROM t")] == ["d", "fromage", "a_from"]


def refs(spark, expression, aliases, tables):
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    found = sp.column_refs(F.lit(expression), F.create_map(*pairs), F.array(*[F.lit(t) for t in tables]))
    return [(r.table, r.column) for r in spark.range(1).select(found.alias("r")).first()[0]]


def test_column_refs(spark):
    al = {"c": "bronze.c", "o": "silver.o"}
    both = ["bronze.c", "silver.o"]
    assert refs(spark, "c.id + o.amount", al, both) == [("bronze.c", "id"), ("silver.o", "amount")]
    assert refs(spark, "name", al, both) == []
    assert refs(spark, "name", al, ["bronze.c"]) == [("bronze.c", "name")]
    assert refs(spark, "coalesce(c.a, 'c.b', 12)", al, both) == [("bronze.c", "a")]
    assert refs(spark, "my_fn (c.a) || c.a", al, both) == [("bronze.c", "a")]
    assert refs(spark, "'quote' || my_fn(x)", al, ["bronze.c"]) == [("bronze.c", "x")]
    assert refs(spark, "gold.g.x + public.u.y + zz.q", al, both) == [("gold.g", "x")]


def test_alias_map_first_use_wins(spark):
    df = spark.createDataFrame([("SELECT 1 FROM bronze.a x JOIN silver.b x JOIN gold.b",)], "s string")
    found = df.select(sp.alias_map(sp.sources(F.col("s"))).alias("m")).first()[0]
    assert found == {"x": "bronze.a", "b": "gold.b"}


def test_a_trailing_word_is_an_alias_only_behind_a_closed_operand(parts):
    sql = "SELECT a LIKE b, x AND y, CASE WHEN 1 THEN 2 END c, f(x) d, 'l' e, a || g FROM t"
    assert [i[1] for i in items(parts, sql)] == ["__unnamed_0", "__unnamed_1", "c", "d", "e", "__unnamed_5"]


def test_long_texts(parts, one):
    tables = [f"silver.t{i}" for i in range(10_000)]
    sql = "SELECT " + ", ".join(f"f(c{i}, 1) AS a{i}" for i in range(10_000)) + " FROM " + ", ".join(f"{t} x{i}" for i, t in enumerate(tables))
    assert fqns(parts(sql, sp.sources)) == [(t, f"x{i}") for i, t in enumerate(tables)]
    assert one(sp.table_refs, sql) == tables
    assert [i[1] for i in items(parts, sql)] == [f"a{i}" for i in range(10_000)]
    assert fqns(parts("SELECT 1 FROM silver.t WHERE x IN (" + "(" * 5000 + "FROM gold.u " + ")" * 5000, sp.sources)) == [("silver.t", None), ("gold.u", None)]
