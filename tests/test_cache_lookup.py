from pyspark.sql import functions as F

from strata.sources import cache


def scanned(df):
    """Rows, and how many files the scan read."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return rows, sum(int(leaves.apply(i).metrics().apply("numFiles").value()) for i in range(leaves.size()))


def stored(wb, df, name, **options):
    wb.spark.sql(f"CREATE DATABASE IF NOT EXISTS elsewhere LOCATION '{wb.root}/elsewhere'")
    wb.replace_table(f"elsewhere.{name}", df)
    return cache.cache_table(wb, f"elsewhere.{name}", "db", keys=["k"], **options)


def wide(spark):
    """A third of all rows has the key 7, some have none, the order is random."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    return rows.orderBy("v")


def test_a_lookup_opens_few_files(wb, spark):
    df = wide(spark)
    done = stored(wb, df, "wide", file_bytes=100_000)
    assert done.rows == 30_000
    assert sorted(wb.table(done.target).collect(), key=str) == sorted(df.collect(), key=str)
    files = wb.table(cache._files_of(done.target))
    n = files.count()
    assert n >= 8 and files.agg(F.sum("rows")).first()[0] == 30_000
    # The hot key goes over several files, none of which holds many more rows than another.
    assert files.where("lo <= 7 AND hi >= 7").count() >= 3
    assert files.agg(F.max("rows")).first()[0] < 3 * 30_000 / n
    rows, read = scanned(cache.lookup(wb, done.target, "k", spark.createDataFrame([(20_000,), (20_002,), (None,), (-5,)], "k bigint")))
    assert {r.k for r in rows} == {20_000, 20_002} and read <= 3
    hot, read = scanned(cache.lookup(wb, done.target, "k", spark.createDataFrame([(7,)], "k int")))
    assert len(hot) == df.where("k = 7").count() and read < n


def test_lookups_without_hits_many_keys_and_other_columns(wb, spark):
    done = stored(wb, wide(spark), "other", file_bytes=100_000)
    find = lambda key, df: cache.lookup(wb, done.target, key, df)
    assert find("k", spark.createDataFrame([(None,)], "k bigint")).count() == 0
    assert find("k", spark.createDataFrame([(10**9,)], "k bigint")).count() == 0
    many = spark.range(1, 9_000).withColumnRenamed("id", "k")
    assert find("k", many).count() == wide(spark).where("k BETWEEN 1 AND 8999").count()
    assert [r.k for r in find("v", wide(spark).where("k = 20").select("v")).collect()] == [20]


def test_a_table_stored_anew_is_not_looked_up_by_old_files(wb, spark):
    done = stored(wb, spark.range(100).withColumnRenamed("id", "k"), "anew")
    wb.replace_table(done.target, spark.range(100, 200).withColumnRenamed("id", "k"))
    assert [r.k for r in cache.lookup(wb, done.target, "k", spark.createDataFrame([(150,), (50,)], "k bigint")).collect()] == [150]
    empty = stored(wb, spark.range(0).withColumnRenamed("id", "k"), "nothing")
    assert empty.rows == 0
