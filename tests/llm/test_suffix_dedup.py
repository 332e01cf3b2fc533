import hashlib
import random
from collections import Counter

import pytest

from strata.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    found = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if found[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 6))) for _ in range(40)]
    some = [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(some)
            x = rng.randint(0, len(text) // 2)
            parts += [text[x : rng.randint(x, len(text))], " ".join(rng.choices(words, k=rng.randint(0, 20)))]
        rows.append((i, rng.choice([" ", "é ", ""]).join(parts), "en", "a"))
    odd = ["a" * 1000, "ab" * 400, None, "", "x" * 200, "y" * 199, some[0], "a" * 300, "日本" * 60]
    rows += [(200 + i, t, "en", "a") for i, t in enumerate(odd)]
    return [*rows, (206, some[0], "en", "a"), (None, some[0] + some[1], None, None)]


@pytest.mark.parametrize("length", [64, 200])
def test_matches_brute_force(stored, length, monkeypatch):
    rows = cases()
    want = sorted(((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows], length), strict=True)), key=repr)
    for block in (suffix_dedup.BLOCK, 700):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        found = sorted((tuple(r) for r in suffix_dedup.remove_repeats(stored(rows), length=length).collect()), key=repr)
        assert found == want


def test_spans(stored, rows):
    docs = [(1, "head " + rows[0][1] * 2 + " tail", "en", "a"), (2, "other " + rows[0][1] * 2, "en", "a"), (3, "z" * 150, "en", "a")]
    found = suffix_dedup.find_repeats(stored(docs)).collect()
    assert len(found) == 2
    for r in found:
        assert all(s.hi - s.lo >= 200 for s in r.spans)


def test_empty(stored):
    assert suffix_dedup.remove_repeats(stored([])).count() == 0
