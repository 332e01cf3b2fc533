"""Every stage against its own input on the smallest tables."""

import re

import corpus_pipeline
from strata.llm import mixing, quality_rules
from strata.llm.common import cut

from . import test_near_dup
from .test_quality_rules import verdicts


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], sf), "test"))
    assert all(df.columns == docs.columns for df in kept[:-1])
    tables = [[(r.doc_id, r.text, r.lang, r.source) for r in df.collect()] for df in kept[:-1]]
    whole, good, single, apart, mixed = tables
    assert sorted(r[0] for r in good) == sorted(r[0] for r, k in zip(whole, verdicts(whole, quality_rules.LEAST_DOCS), strict=True) if k)
    best = {}
    for r in good:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        best[norm] = min(best.get(norm, (0, 0)), (-len(r[1]), r[0])) if norm in best else (-len(r[1]), r[0])
    assert sorted(r[0] for r in single) == sorted(i for _, i in best.values())
    want, groups = test_near_dup.brute(single, 5)
    assert len(apart) == groups and {r[0] for r in apart} == {first for _, _, first in want}
    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()}
    assert sorted(r[0] for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    pieces = kept[-1].collect()
    assert sorted(r.doc_id for r in pieces if r.piece == 0) == sorted(r[0] for r in mixed)


def test_run_and_empty(spark, sf, stored):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = stored([])
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), "test")
    assert docs.count() == 0
