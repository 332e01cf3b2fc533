import random
import re

import numpy as np
import pytest

from strata.llm import window_dedup
from strata.session import cut


def brute(docs, window):
    first = {}
    held = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    for doc, words in held:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc is not None and (key not in first or doc < first[key]):
                first[key] = doc
    out = []
    for doc, words in held:
        gone = set()
        for i in range(len(words) - window + 1):
            at = first.get(tuple(words[i : i + window]))
            if doc is not None and at is not None and at < doc:
                gone |= set(range(i, i + window))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def check(docs, rows, window, **options):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in window_dedup.remove_windows(docs, window=window, **options).collect()]
    want = brute([r[:2] for r in rows], window)
    assert sorted(map(key, got)) == sorted(map(key, want))
    return sum(r[2] for r in got)


@pytest.mark.parametrize("cells", [window_dedup.CELLS, 1 << 10])
def test_equals_brute_force(stored, rows, cells):
    """With the small sketch the key grams fall into many slices, each of which is nearly full."""
    few = rows if cells == window_dedup.CELLS else [r for r in rows if len(r[1] or "") < 3000]
    assert check(stored(few), few, 50, cells=cells) > 200


def test_short_windows_and_hot_passages(stored, monkeypatch):
    """A passage in a third of all documents, more rows of one window than a range has, copies, and repeats inside a document."""
    monkeypatch.setattr(window_dedup, "RANGE_ROWS", 50)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    hot = " ".join(rng.choices(words, k=12))
    rows = []
    for i in range(150):
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        text = f"{text} {hot}" if i % 3 == 0 else text
        text = rows[-1][1] if i % 17 == 5 else text
        rows.append((rng.choice([i, i, i, 7, None, -i]), f"{text}\t{text}" if i % 10 == 4 else text, "en", "a"))
    assert check(stored(rows, parts=4), rows, 6) > 300


def test_long_documents_are_hashed_in_chunks(stored, monkeypatch):
    monkeypatch.setattr(window_dedup, "CHUNK_WORDS", 64)
    rng = random.Random(4)
    body = [f"x{rng.randrange(10**6)}" for _ in range(700)]
    rows = [(1, " ".join(body[100:500]), "en", "a"), (2, " ".join(body), "en", "a"), (3, " ".join(body[450:480]), "en", "a")]
    windows = window_dedup.Windows(20)
    found = [(t, a) for b in windows.blocks([r[1] for r in rows]) for t, a in zip(b.text.tolist(), b.at.tolist(), strict=True)]
    assert found == [(0, i) for i in range(381)] + [(1, i) for i in range(681)] + [(2, i) for i in range(11)]
    assert check(stored(rows), rows, 20) == 400 + 30


def test_key_grams_of_equal_windows_are_equal():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    body = rng.choices(words, k=300)
    for window in (1, 2, 3, 8, 50):
        a, b = window_dedup.Windows(window), window_dedup.Windows(window)
        (whole,) = a.blocks([" ".join(body)])
        assert len(whole.grams) == 300 - window + 1
        places = [0, 7, 299 - window]
        (parts,) = b.blocks([None, *(" ".join(body[i : i + window]) for i in places), "x"])
        some = parts.at == 0
        assert parts.grams[some][:3].tolist() == whole.grams[places].tolist()
        for x, y in zip(b.fingerprints(parts, np.flatnonzero(some)[:3]), a.fingerprints(whole, np.array(places)), strict=True):
            assert x.tolist() == y.tolist()


def test_sketch_never_estimates_too_little(spark):
    rng = np.random.default_rng(1)
    grams = rng.integers(-(2**63), 2**63 - 1, 3000)
    twice = np.concatenate([grams, grams[:500]])
    df = cut(spark.createDataFrame([(int(g),) for g in twice], "gram bigint").repartition(5), "grams")
    bits = window_dedup.sketch(df, 1 << 12, 1)
    assert window_dedup.repeated(grams[:500], bits).all()
    bits = window_dedup.sketch(df, 1 << 16, 1)
    assert window_dedup.repeated(grams[:500], bits).all() and window_dedup.repeated(grams[500:], bits).mean() < 0.05


def test_nothing_to_do(stored):
    assert check(stored([(1, None, "en", "a"), (2, "", "en", "a"), (3, "few words", "en", "a")]), [(1, None), (2, ""), (3, "few words")], 50) == 0
    assert window_dedup.remove_windows(stored([(1, "x", "en", "a")]).where("doc_id < 0")).count() == 0
