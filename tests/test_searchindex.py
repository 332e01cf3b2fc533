import random

import pytest
from pyspark.sql import functions as F

from strata.operators import corpus, searchindex

SCHEMA = "path string, title string, md_title string, tags array<string>, md_body string, search_text string, updated timestamp_ntz, last_run timestamp_ntz"


def entries(spark, n=160, seed=1):
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    words = ["Report", "report two", "the REPORT", "weekly", "x", "ab", "éa", "日本語", "sales, by day", "tab\tbed", "zz", "a", "é", "İx"]
    day = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        pick = lambda k: " ".join(rng.choices(words, k=rng.randrange(k)))
        tags = rng.choice([None, [], ["weekly_report", "EN"], [rng.choice(words), "src1"]])
        rows.append((
            f"queries/{rng.choice(['en', 'de'])}/Q{i}.sql", rng.choice([None, pick(2), "Report"]), rng.choice([None, pick(3)]), tags, rng.choice([None, pick(6)]),
            f"select {pick(5)}".lower(), rng.choice([None, day + timedelta(days=rng.randrange(9))]), rng.choice([None, day + timedelta(days=rng.randrange(30))]),
        ))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


LINES = ["report", '"the report"', "weekly q1", "x", "é a", "日本語", '"sales, by day" q', "q12", "nothing-here", '  ', "", None, "report", "report report", '"tab\tbed"', "select", "a b", "src1 EN", '"two', "q q1 q12", "ab report weekly"]


@pytest.fixture(scope="module")
def index(spark):
    rows = entries(spark)
    return rows, searchindex.build_search_index(rows, chunk=16)


@pytest.mark.parametrize(("rows", "most_sent", "scope"), [(200, searchindex.MOST_SENT, "all"), (3, 0, "all"), (7, searchindex.MOST_SENT, "title")])
def test_every_line_equals_the_scan(spark, index, rows, most_sent, scope):
    df, stored = index
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_id int, line string")
    got = searchindex.search_lines(stored, lines, scope=scope, rows=rows, most_sent=most_sent).collect()
    for i, line in enumerate(LINES):
        mine = [(r.path, r.score) for r in sorted((r for r in got if r.line_id == i), key=lambda r: r["rank"])]
        want = [(r.path, r.score) for r in corpus.corpus_search(df, line or "", scope, rows).collect()]
        assert mine == want, line
    assert [r["rank"] for r in got if r.line_id == 0].count(1) == 1


def test_later_chunks_are_not_opened_for_a_full_list(spark, index):
    """A word that every entry holds: chunks that cannot beat the full list stay closed."""
    _, stored = index
    lines = spark.createDataFrame([(1, "select")], "line_id int, line string")
    asked = searchindex.line_tokens(lines, "line_id", "line")
    tokens = asked.select(F.lit(1).cast("bigint").alias("line"), "tokens")
    grams = searchindex._grams(tokens.select(F.explode("tokens").alias("token")))
    chunks = searchindex.candidate_chunks(stored, tokens.select("line", F.size("tokens").alias("of_line"), F.explode("tokens").alias("token")), grams).collect()
    assert len(chunks) == 10 and all(c.bound >= 10 and c.most >= 1 for c in chunks)


def test_blocks_hold_every_posting_once(spark, index):
    df, stored = index
    import numpy as np

    held = {}
    for b in stored.blocks.collect():
        at = np.cumsum(np.frombuffer(bytes(b.gaps), np.uint16).astype(int)) + b.chunk * stored.chunk
        assert len(at) == b.n == len(b.bounds) and max(b.bounds) == b.best and (b.gram, b.chunk) not in held
        held[b.gram, b.chunk] = set(at.tolist())
    (gram,) = searchindex.grams_of("rep", (3,)).tolist()
    want = {r.entry for r in stored.entries.collect() if any("rep" in (v or "").lower() for v in (r.md_title or (r.title if r.md_title is None else ""), r.md_body, r.search_text, r.path, *(r.tags or [])))}
    assert set().union(*(v for (g, _), v in held.items() if g == gram)) == want


def test_tokens_of_lines(spark):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "line_id int, line string")
    got = {r.line_id: r.tokens for r in searchindex.line_tokens(lines, "line_id", "line").collect()}
    assert got == {i: corpus.search_tokens(t) for i, t in enumerate(LINES) if t and corpus.search_tokens(t)}


def test_an_empty_corpus(spark):
    stored = searchindex.build_search_index(entries(spark).limit(0))
    lines = spark.createDataFrame([(1, "x")], "line_id int, line string")
    assert searchindex.search_lines(stored, lines).count() == 0
