import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.streaming import state_stream

FEED = "seq bigint, op string, key string, title string, score double"


def feed_rows(n, seed):
    rng = random.Random(seed)
    rows = [(i, "delete" if rng.random() < 0.2 else "upsert", f"k{rng.randrange(12) if rng.random() < 0.5 else 0}", f"t{i}" if i % 7 else None, i / 2) for i in range(n)]
    rng.shuffle(rows)
    return rows


def newest(base, rows):
    held = {k: (None, "upsert", k, t, s) for k, t, s in base}
    for r in rows:
        if r[2] not in held or held[r[2]][0] is None or r[0] > held[r[2]][0]:
            held[r[2]] = r
    return sorted((k, r[3], r[4], r[0]) for k, r in held.items() if r[1] != "delete")


def test_index_goes_on_after_a_restart_and_late_events_lose(spark, tmp_path):
    rows = feed_rows(120, 1)
    base = [("k0", "base", 1.0), ("other", "stays", 2.0)]
    started = spark.createDataFrame([(k, None, t, s) for k, t, s in base], "key string, seq bigint, title string, score double")
    incoming, point = str(tmp_path / "in"), str(tmp_path / "point")
    provider = spark.conf.get(state_stream._PROVIDER)
    for part in (rows[:50], rows[50:60], rows[60:]):
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(incoming)
        source = spark.readStream.schema(FEED).parquet(incoming)
        state_stream.follow_index(source, ["title", "score"], point, started).awaitTermination()
    got = state_stream.index_state(spark, point, ["title", "score"]).collect()
    assert sorted(tuple(r) for r in got) == newest(base, rows)
    assert spark.conf.get(state_stream._PROVIDER) == provider


def test_renames_are_refused(spark, tmp_path):
    spark.createDataFrame([(1, "rename", "a", "x", 0.0)], FEED).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(FEED).parquet(str(tmp_path / "in"))
    query = state_stream.follow_index(source, ["title"], str(tmp_path / "point"))
    with pytest.raises(Exception, match="upserts and deletes only"):
        query.awaitTermination()


def test_history_is_kept_by_rank_and_youth_and_stays_bounded(spark, tmp_path):
    """A key with many runs a day and one with few: timers drop what is old, also of keys without new runs."""
    day = datetime(2024, 3, 1)
    rows = [(i, "busy", day + timedelta(hours=i), f"r{i}") for i in range(24 * 30)] + [(10_000 + i, "rare", day + timedelta(days=i), "x") for i in range(30)]
    rows += [(20_000 + i, "gone", day + timedelta(hours=i), "y") for i in range(60)]
    incoming, point = str(tmp_path / "in"), str(tmp_path / "point")
    schema = "run_id bigint, kind string, ts timestamp_ntz, note string"
    sizes = []
    for lo, hi in ((0, 10), (10, 20), (20, 40)):
        part = [r for r in rows if day + timedelta(days=lo) <= r[2] < day + timedelta(days=hi)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(incoming)
        source = spark.readStream.schema(schema).parquet(incoming)
        state_stream.follow_history(source, "kind", "ts", "run_id", point, keep=5, days=3, delay="0 days").awaitTermination()
        held = state_stream.history_state(spark, point, "kind", "ts", "run_id")
        sizes.append({r.kind: r["count"] for r in held.groupBy("kind").count().collect()})
    end = max(r[2] for r in rows)
    want = []
    for kind in ("busy", "rare", "gone"):
        mine = sorted((r for r in rows if r[1] == kind), key=lambda r: r[2], reverse=True)
        want += [r for i, r in enumerate(mine) if i < 5 or r[2] > end - timedelta(days=3)]
    kept = state_stream.kept_history(spark, point, "kind", "ts", "run_id", F.lit(end).cast("timestamp_ntz"), keep=5, days=3)
    got = [(r.run_id, r.kind, r.ts, r.note) for r in kept.collect()]
    assert sorted(got) == sorted(want)
    assert max(s["busy"] for s in sizes) <= 24 * 3 + 1 and sizes[-1]["gone"] == 5 and sizes[-1]["rare"] == 5


def test_a_hot_key_of_the_history_is_spread_over_slices_of_time(spark, tmp_path):
    """No group of the state holds all runs of a key; runs told again, also in a later batch, are held once, as told last."""
    day = datetime(2024, 3, 1)
    schema = "run_id bigint, kind string, ts timestamp_ntz, note string"
    rows = [(i, "hot", day + timedelta(minutes=i), "first") for i in range(3 * 24 * 60)] + [(0, None, day, None)]
    again = [(*r[:3], "again") for r in rows[-50:-1]]
    incoming, point = str(tmp_path / "in"), str(tmp_path / "point")
    for part in (rows, again):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(incoming)
        source = spark.readStream.schema(schema).parquet(incoming)
        state_stream.follow_history(source, "kind", "ts", "run_id", point, keep=5, days=2).awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "kept").load(point)
    sizes = [r[0] for r in held.select(F.size("value.ts")).collect()]
    assert max(sizes) <= 6 * 60 and len(sizes) >= 12
    end = rows[-2][2]
    kept = state_stream.kept_history(spark, point, "kind", "ts", "run_id", F.lit(end).cast("timestamp_ntz"), keep=5, days=2)
    want = [r for r in rows[:-1] if r[2] > end - timedelta(days=2)]
    want = [(*r[:3], "again") if r in rows[-50:-1] else r for r in want] + rows[-1:]
    got = [(r.run_id, r.kind, r.ts, r.note) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_feed_of_many_keys_is_aggregated_without_a_python_call_per_key(spark, tmp_path):
    """Base entries win over events up to their seq; events without a seq are none; keys of the base alone stay."""
    base = spark.createDataFrame([("a", 5, "base"), ("b", None, "base"), ("c", None, "base"), ("d", 5, "base"), (None, None, "base")], "key string, seq bigint, title string")
    rows = [(5, "upsert", "a", "same seq"), (6, "delete", "d", "gone"), (1, "upsert", "b", "new"), (None, "upsert", "c", "no seq"), (None, "upsert", "e", "no seq")]
    incoming, point = str(tmp_path / "in"), str(tmp_path / "point")
    schema = "seq bigint, op string, key string, title string"
    for part, start in ((rows[:2], base), (rows[2:], None)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(incoming)
        query = state_stream.follow_index(spark.readStream.schema(schema).parquet(incoming), ["title"], point, start)
        query.awaitTermination()
        assert "Python" not in query._jsq.explainInternal(False)
    got = sorted((tuple(r) for r in state_stream.index_state(spark, point, ["title"]).collect()), key=repr)
    assert got == sorted([("a", "base", 5), ("b", "new", 1), ("c", "base", None), (None, "base", None)], key=repr)
