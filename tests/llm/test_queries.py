"""Every query of the training-data operators has SQL or a test against brute force, named here."""

from pathlib import Path

import __spark_entry__ as entry
import corpus_pipeline
from strata.llm import queries

BY_BRUTE_FORCE = {
    "op2_quality_model": "test_kn_model",
    "op4_suffix_dedup": "test_suffix_dedup",
    "op6_token_store": "test_token_store",
    "op7_best_fit_packing": "test_packing",
    "op8_edit_counts": "test_edit_counts",
}


def test_every_query_is_checked():
    assert set(queries.QUERIES) - set(queries.ORACLES) == set(BY_BRUTE_FORCE)
    for module in BY_BRUTE_FORCE.values():
        assert (Path(__file__).parent / f"{module}.py").exists()
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_the_entry_hands_them_on():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert ("pipeline" in entry.oracle_sql()) == (corpus_pipeline.ORACLE_SQL is not None)
