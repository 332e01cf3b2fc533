import random
import zlib

import numpy as np
import pytest

from strata.llm import packing
from strata.llm.tokens import END_ID, encoder


def plain_best_fit(counts, size):
    rooms = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(size - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 16, 64, 1024])
    counts = {rng.randint(1, size): rng.randint(1, 50) for _ in range(rng.randint(1, 12))}
    plan, used = packing.best_fit(counts, size), {}
    for length, rank, n, first, offset in plan.tolist():
        for i in range(n):
            used.setdefault(first + i, []).append((offset, length))
    for length, n in counts.items():
        mine = plan[plan["length"] == length]
        assert mine["count"].sum() == n and list(mine["rank"]) == [0, *np.cumsum(mine["count"])[:-1]]
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(size - sum(n for _, n in pieces) for pieces in used.values()) == plain_best_fit(counts, size)


def test_plan_does_not_grow_with_counts():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 1000) for n in range(1, 1025)}
    few, many = packing.best_fit(counts), packing.best_fit({n: c * 1_000_000 for n, c in counts.items()})
    assert len(many) < 3 * len(few) + 10_000


def test_pieces_cover_every_document(stored, rows):
    found = packing.pack(stored(rows), size=256).collect()
    tokenizer = encoder().tokenizer
    want, sizes = [], 0
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        sizes += len(ids)
        start, piece = 0, 0
        while start < len(ids):
            n = (len(ids) - start) % 256 or 256
            want.append((doc, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start, piece = start + n, piece + 1
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    lengths = {}
    for r in found:
        lengths[r.length] = lengths.get(r.length, 0) + 1
    assert len(sequences) == len(plain_best_fit(lengths, 256)) >= -(-sizes // 256)


def test_empty(stored):
    assert packing.pack(stored([])).count() == 0
    assert [tuple(r)[1:5] for r in packing.pack(stored([(1, None, "en", "a")])).collect()] == [(0, 0, 1, zlib.crc32(b"\2\0\0\0"))]
