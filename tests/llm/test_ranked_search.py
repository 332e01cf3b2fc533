import math
from collections import Counter

import numpy as np
import pytest

from strata.llm import ranked_search
from strata.llm.terms import terms


def brute(docs, items, top=20):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, n in held:
            m, score = 75 + 25 * n * n_docs // n_terms, 0
            for term, times in Counter(terms(text)).items():
                if tf := counts[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * w * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return out


def items_of(rows):
    texts = [rows[1][1], "one", None, "", " ## ", rows[206 - 200 + 126][1][:400] if len(rows) > 132 else "x", rows[10][1] + " " + rows[10][1], "日本語 é zzz", "nowhere-to-be-found"]
    return [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(1, "two words here"), (None, "ONE ab")]


def found(spark, docs, items, **options):
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    return [tuple(r) for r in ranked_search.search(docs, asked, **options).select("item_id", "rank", "doc_id", "score").collect()]


def tied(rows):
    """Ranks of equal scores and ids may change places; what counts is the list by rank."""
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("options", [{}, {"top": 3, "most_postings": 40}])
def test_equals_brute_force(spark, stored, rows, options):
    items = items_of(rows)
    got = found(spark, stored(rows), items, **options)
    assert tied(got) == tied(brute([r[:2] for r in rows], items, options.get("top", 20))) and len(got) > 10


def test_ties_go_to_the_smaller_id(spark, stored):
    """More copies than a heap holds, over several tasks; null ids last."""
    docs = stored([(i if i % 9 else None, "alpha beta", "en", "a") for i in range(60, 0, -1)] + [(99, "gamma delta epsilon", "en", "a")], parts=5)
    got = found(spark, docs, [(1, "beta"), (2, "beta")], top=5)
    assert [r[2] for r in sorted(got)] == [1, 2, 3, 4, 5] * 2
    got = found(spark, docs, [(1, "beta")], top=60)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [i for i in range(1, 61) if i % 9] + [None] * 6


def test_empty_tables(spark, stored, rows):
    docs = stored(rows[:5])
    assert found(spark, docs.where("doc_id < 0"), [(1, "one")]) == []
    assert found(spark, docs, []) == []
    assert found(spark, stored([(1, None, "en", "a"), (2, " ", "en", "a")]), [(1, "one")]) == []


def test_shares_hold_every_item_once(spark):
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{k}" for k in range(i % 7 + 1))) for i in range(50)], "item_id bigint, text string")
    shares = [[r["item"] for r in s.collect()] for s in ranked_search.item_shares(items, "item_id", "text", most=20)]
    assert sorted(i for s in shares for i in s) == list(range(50)) and len(shares) > 5
    assert all(sum(i % 7 + 1 for i in s) <= 20 + 7 for s in shares)


def test_index():
    index = ranked_search.Index([[b"a", b"b", b"a"], [], [b"b"]])
    assert list(index.vocabulary) == [b"a", b"b"] and index.ends.tolist() == [0, 1, 3]
    assert index.items.tolist() == [0, 0, 2] and index.times.tolist() == [2, 1, 1]
    assert ranked_search.Index([]).ends.tolist() == [0] and isinstance(index.ends, np.ndarray)
