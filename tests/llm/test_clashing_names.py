"""Input columns named like helper columns stay as they are, and no document gets lost to one."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import edit_counts, exact_dedup, kn_model, mixing, near_dup, quality_rules, suffix_dedup

NAMES = ["__file", "__place", "__number", "_metadata", "__row", "__copies", "kept", "n_words", "row", "document", "base_failed", "symbol_rate"]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "docs")
    few = [r for r in rows[:40] + rows[120:] if len(r[1] or "") < 3000]
    base = spark.createDataFrame([(*r, i) for i, r in enumerate(few)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    base.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("n_chars").cast("string")) for n in NAMES}).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def plain(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.mark.parametrize("place", range(4))
def test_stages_keep_rows_and_values(spark, docs, place):
    _, stage = corpus_pipeline.STAGES[place]
    got = stage(spark, docs, "").collect()
    want = stage(spark, plain(docs), "").collect()
    assert sorted(r.n_chars for r in got) == sorted(r.n_chars for r in want) and got
    for r in got:
        assert set(r.asDict()) == {*plain(docs).columns, *NAMES}
        assert all(r[n] == f"{n} of {r.n_chars}" for n in NAMES)


def edited(docs):
    plain_edits = docs.select("doc_id", F.lit(0).alias("at"), F.lit(1).alias("remove"), F.lit("x").alias("put")).where("doc_id IS NOT NULL").distinct()
    return edit_counts.recount(docs, edit_counts.stored_trees(docs), plain_edits).drop("text", "tree", "row")


OPERATORS = {
    "mix": lambda d, labels: mixing.mix(d).drop("__row"),
    "quality_model": lambda d, labels: kn_model.classify(d, labels, order=2).drop("row"),
    "exact": lambda d, labels: exact_dedup.find_copies(d).drop("__row"),
    "suffix": lambda d, labels: suffix_dedup.remove_repeats(d),
    "near": lambda d, labels: near_dup.near_components(d).drop("row"),
    "edits": lambda d, labels: edited(d),
    "rules": lambda d, labels: quality_rules.apply_rules(d).select("doc_id", "n_words", "kept"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_give_the_same_rows(spark, docs, name):
    labels = spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(100)], "doc_id bigint, quality int, toxic int")
    got, want = (OPERATORS[name](d, labels).collect() for d in (docs, plain(docs)))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) >= docs.count()
