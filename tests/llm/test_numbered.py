from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from strata.llm import common, exact_dedup, mixing, near_dup
from strata.session import StrataError


@contextmanager
def splits(spark, n):
    """Scans are planned as on a cluster of `n` cores."""
    spark.conf.set("spark.sql.files.minPartitionNum", n)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_do_not_follow_the_splits(spark, stored):
    docs = stored([(i, f"t{i} " * 50, "en", "a") for i in range(300)], parts=7)
    found = []
    for n in (1, 3, 16):
        with splits(spark, n):
            found.append({r.doc_id: r.place for r in common.numbered(docs, "place").collect()})
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) == 300
    assert common.numbered(docs.where("doc_id % 3 = 0").select("doc_id"), "place").columns == ["doc_id", "place"]
    assert {r.doc_id: r.place for r in common.numbered(docs.where("doc_id % 3 = 0").select("doc_id"), "place").collect()}.keys() == set(range(0, 300, 3))


def test_other_frames_are_refused_or_stored(spark, stored):
    docs = stored([(i, "t", "en", "a") for i in range(5)])
    for other in (docs.union(docs), docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), docs.join(docs.select("doc_id"), "doc_id"), spark.range(3)):
        assert not common.is_stored(other)
        with pytest.raises(StrataError):
            common.numbered(other, "place")
        assert common.is_stored(common.stored(other)) and common.stored(other).count() == other.count()


@pytest.mark.parametrize("stage", ["exact", "near", "mix"])
def test_stages_survive_another_number_of_cores(spark, stored, stage):
    """The stage numbers its rows under one split and finds them again under another one."""
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(40 + i % 5)), "en", "ab"[i % 3 == 0]) for i in range(120)]
    rows = [(i, rows[i // 2 * 2][1] if i % 4 < 2 else t, lang, source) for i, t, lang, source in rows]
    docs = stored(rows, parts=7)
    run = {"exact": exact_dedup.drop_copies, "near": near_dup.drop_near_copies, "mix": mixing.take}[stage]
    with splits(spark, 1):
        want = sorted(r.doc_id for r in run(docs).collect())
        frame = run(docs)  # what it stores is stored by now, the rest is planned below
    with splits(spark, 16):
        assert sorted(r.doc_id for r in frame.collect()) == want
