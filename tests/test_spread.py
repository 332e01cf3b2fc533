import random

import pytest
from pyspark.sql import functions as F

from strata.operators import spread
from strata.operators.spread import hot_keys, number_rows, sized_parts, spread_join, spread_scan, top_per_key
from strata.session import cut


@pytest.fixture
def skewed(spark):
    rnd = random.Random(5)
    keys = [rnd.choice([1, 1, 1, None, None, *range(20)]) for _ in range(3000)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long").repartition(7)
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 15)] + [(None, "null")], "k long, v string")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("min_rows", [1, 200, 10**9])
def test_spread_join_equals_join(skewed, rows, how, min_rows):
    left, right = skewed
    got = spread_join(left, right, ["k"], how, min_rows)
    want = left.join(right, ["k"], how)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(want.columns))


def test_spread_join_of_two_keys_and_double_matches(spark, rows):
    left = spark.range(200).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), "id")
    right = spark.createDataFrame([(0, 0, "x"), (0, 0, "y"), (1, 2, "z")], "a long, b long, v string")
    got = spread_join(left, right, ["a", "b"], "left", 10)
    assert rows(got, "id", "v") == rows(left.join(right, ["a", "b"], "left"), "id", "v")


def test_every_hot_key_gets_tasks_by_its_rows(skewed, spark):
    left, _ = skewed
    assert hot_keys(left, ["k"], 10**6).count() == 0
    counts = {r.k: r["count"] for r in left.dropna().groupBy("k").count().collect()}
    assert {r.k: r._salts for r in hot_keys(left, ["k"], 50).collect()} == {k: -(-n // 50) for k, n in counts.items() if n > 50}
    many = spark.range(0, 60_000, 1, 20).select((F.col("id") % 600).alias("k"))
    assert hot_keys(many, ["k"], 40).groupBy("_salts").count().collect() == [(3, 600)]


@pytest.mark.parametrize("groups", [1, 7])
def test_hot_keys_are_exact_with_few_groups(skewed, spark, monkeypatch, groups):
    monkeypatch.setattr(spread, "KEY_GROUPS", groups)
    left, _ = skewed
    counts = {r.k: r["count"] for r in left.dropna().groupBy("k").count().collect()}
    assert {r.k: r._salts for r in hot_keys(left, ["k"], 50).collect()} == {k: -(-n // 50) for k, n in counts.items() if n > 50}


def test_hot_rows_go_to_many_partitions(spark):
    left = spark.range(0, 20000, 1, 40).select(F.lit(1).alias("k"), "id")
    right = spark.createDataFrame([(1, "x")], "k int, v string")
    joined = spread_join(left, right.hint("shuffle_hash"), ["k"], "inner", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(p["count"] for p in parts) == 20000
    assert len(parts) == 4  # every shuffle partition of the test session


def test_number_rows(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice(["a", "b", None, "c"]), rnd.random()) for i in range(1000)]
    df = spark.createDataFrame(data, "id long, s string, x double").repartition(5)
    got = number_rows(df, [F.col("s").desc_nulls_last(), F.col("x"), F.col("id")], partitions=6)
    order = {r.id: r.row_no for r in got.collect()}
    want = sorted(data, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[2], r[0]))
    assert [r[0] for r in want] == sorted(order, key=order.get)
    assert sorted(order.values()) == list(range(1, 1001))


def test_number_rows_of_nothing(spark):
    assert number_rows(spark.range(0).toDF("id"), [F.col("id")]).count() == 0


@pytest.mark.parametrize("k", [3, 1500])
def test_top_per_key(spark, k):
    df = spark.range(0, 5000, 1, 8).select((F.col("id") % 3).alias("g"), "id")
    got = top_per_key(df, ["g"], [F.col("id").desc()], k).groupBy("g").agg(F.count("*"), F.min("_rn"), F.max("_rn"), F.min("id"))
    for g, n, lo, hi, least in got.collect():
        own = [i for i in range(5000) if i % 3 == g][::-1][:k]
        assert (n, lo, hi, least) == (len(own), 1, len(own), own[-1])


def test_spread_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    wide = spread_scan(df)
    assert wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert wide.count() == df.count()


def test_a_join_is_not_sized_by_the_product_of_its_sides(spark):
    """Spark estimates a join at the product of its sides: two tables of a few hundred kB would go over thousands of partitions."""
    sides = [cut(spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias(f"t{i}")), "side") for i in (0, 1)]
    joined = sides[0].join(sides[1], "id", "left")
    estimate = int(str(joined._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimate > 100 * (128 << 20)
    assert sized_parts(joined) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_spread_scan_has_tasks_by_what_is_stored(spark):
    stored = cut(spark.range(0, 200_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")), "scan")
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert spread_scan(stored, size // 40).rdd.getNumPartitions() >= 40
    assert spread_scan(stored, size).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert spread_scan(stored, size // 40).count() == 200_000
