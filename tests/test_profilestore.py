import math
import random
from datetime import datetime

import pytest

from strata.operators import profilestore

SCHEMA = "id bigint, price double, name string, mail string, day timestamp_ntz"


def rows(lo, hi):
    rng = random.Random(lo)
    return [
        (i, rng.choice([rng.gauss(100, 20), None, float("nan"), float("inf")]) if i % 5 == 0 else rng.random() * 50, rng.choice(["a", "a", "b", f"n{i}", None]),
         f"u{i % 40}@x.org" if i % 2 else None, datetime(2024, 1, 1 + i % 28))
        for i in range(lo, hi)
    ]


def close(spark, found, held):
    """The profile against exact counts of the rows."""
    by = {r.column_name: r for r in found.collect()}
    for i, name in enumerate(("id", "price", "name", "mail", "day")):
        values = [r[i] for r in held if r[i] is not None]
        p = by[name]
        assert p.n_rows == len(held)
        if name in ("id", "name", "mail"):
            assert p.n_present == len(values) and abs(p.n_distinct - len(set(values))) <= profilestore.DISTINCT_ERROR * len(set(values)) + 1
            texts = sorted(map(str, values))
            assert (p.min_text, p.max_text) == (texts[0], texts[-1]) and p.pii == (name == "mail")
        if name in ("id", "price"):
            numbers = sorted(v for v in values if math.isfinite(v))
            for q, v in zip(profilestore.QUANTILES, p.quantiles, strict=True):
                rank = sum(x <= v for x in numbers) / len(numbers)
                assert abs(rank - q) <= profilestore.RANK_ERROR + 2 / len(numbers)
        else:
            assert p.quantiles is None
    assert by["name"].examples[0] == "a" and len(by["day"].examples) == profilestore.EXAMPLES
    return by


def test_profile_follows_new_files(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "store")
    first, second = rows(0, 4000), rows(4000, 7000)
    spark.createDataFrame(first, SCHEMA).repartition(3).write.parquet(folder)
    assert len(profilestore.refresh(spark, folder, store)) == 3
    close(spark, profilestore.profile(spark, folder, store), first)
    assert profilestore.refresh(spark, folder, store) == []
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert len(profilestore.refresh(spark, folder, store)) == 1
    close(spark, profilestore.profile(spark, folder, store), first + second)


def test_files_that_went_or_changed(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "store")
    spark.createDataFrame(rows(0, 1000), SCHEMA).coalesce(1).write.parquet(folder)
    profilestore.refresh(spark, folder, store)
    spark.createDataFrame(rows(1000, 3000), SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)
    assert len(profilestore.refresh(spark, folder, store)) == 1
    close(spark, profilestore.profile(spark, folder, store), rows(1000, 3000))


def test_a_scan_written_twice_counts_once(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "store")
    spark.createDataFrame(rows(0, 500), SCHEMA).coalesce(1).write.parquet(folder)
    for _ in range(2):
        profilestore.sketch_files(spark.read.parquet(folder)).write.mode("append").parquet(store)
    close(spark, profilestore.profile(spark, folder, store), rows(0, 500))


@pytest.mark.parametrize("columns", [["id"], ["name", "price"]])
def test_chosen_columns(spark, tmp_path, columns):
    folder, store = str(tmp_path / "data"), str(tmp_path / "store")
    spark.createDataFrame(rows(0, 100), SCHEMA).write.parquet(folder)
    profilestore.refresh(spark, folder, store, columns)
    assert {r.column_name for r in profilestore.profile(spark, folder, store).collect()} == set(columns)
