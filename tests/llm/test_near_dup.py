import random

import numpy as np
import pytest

from strata.llm import near_dup
from strata.llm.components import components
from strata.llm.common import WORD


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, percent=80):
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, r in enumerate(rows):
        smallest.setdefault(root(i), []).append((r[0] is None, r[0] or 0))
    first = {c: None if min(m)[0] else min(m)[1] for c, m in smallest.items()}
    return sorted(((r[0], len(s), first[root(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr), len(smallest)


@pytest.mark.parametrize("k", [4, 5])
def test_components_match_brute_force(stored, rows, k):
    want, groups = brute(rows, k)
    found = near_dup.near_components(stored(rows), shingle=k).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == want
    assert sum(r.first for r in found) == groups < len(rows)


def test_a_large_group_and_a_chain(stored, monkeypatch):
    """Copies that differ from each other in places of their own, and a chain whose ends are far apart."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(80):
        words = base[:]
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a"))
    chain = [f"c{i}" for i in range(120)]
    for i in range(12):
        chain = chain[:]
        chain[9 * i + 3] = f"y{i}"
        rows.append((1000 + i, " ".join(chain), "en", "a"))
    want, _ = brute(rows, 4)
    for rounds in (0, 1, 3):
        monkeypatch.setattr(near_dup, "LEADER_ROUNDS", rounds)
        found = near_dup.near_components(stored(rows), shingle=4).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == want


def test_one_document_of_each_group_stays(stored, rows):
    docs = stored(rows)
    left = near_dup.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == brute(rows, 5)[1]


def test_bound_on_matches():
    assert near_dup.least_matches(80) == 33
    sets = np.random.default_rng(1).integers(0, 2**64, (400, 1000), np.uint64)
    agree = []
    for s in sets:
        a, b = s[:900], s[100:]
        agree.append((near_dup.signature(a) == near_dup.signature(b)).sum())
    assert min(agree) >= 33 and abs(np.mean(agree) - 64 * 0.8) < 1


def test_contraction(spark, tmp_path):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(200)} | {(i, i + 1) for i in range(400, 460)}
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    spark.createDataFrame(sorted(pairs), "a bigint, b bigint").write.parquet(str(tmp_path / "e"))
    found = {r.node: r.comp for r in components(spark.read.parquet(str(tmp_path / "e"))).collect()}
    assert found == {n: root(n) for n in parent if root(n) != n}


def test_empty(stored):
    assert near_dup.near_components(stored([])).count() == 0
    only = near_dup.near_components(stored([(1, None, "en", "a"), (2, "", "en", "a"), (None, " ", "en", "a")])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.first) for r in only), key=repr) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
