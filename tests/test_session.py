import time

from pyspark.sql import functions as F

from strata import session


def _shuffle_files(spark):
    kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in kept.split("\n") if "/shuffle_" in f}


def test_frames_cut_in_turn_leave_no_shuffle_files(spark):
    switch = spark.conf.get(session._FREE_SHUFFLES)
    before, left = _shuffle_files(spark), []

    def parts():
        for i in range(3):
            yield spark.range(1000).where(F.col("id") % 3 == i).groupBy((F.col("id") % 300).alias("k")).count()

    found = session.cut_in_turn(parts(), "turns")
    for _ in range(100):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert sorted(r["k"] for r in found.collect()) == list(range(300))
    assert spark.conf.get(session._FREE_SHUFFLES) == switch


def test_the_switch_comes_back_after_a_failure(spark):
    spark.conf.set(session._FREE_SHUFFLES, "false")
    try:
        try:
            session.cut_in_turn([spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))])
        except Exception:
            pass
        assert spark.conf.get(session._FREE_SHUFFLES) == "false"
    finally:
        spark.conf.unset(session._FREE_SHUFFLES)
