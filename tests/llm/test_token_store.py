import zlib

import numpy as np
import pytest

from strata.llm import token_store
from strata.llm.tokens import END_ID, encoder


def ids_of(text):
    return [*encoder().tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_round_trip(spark, stored, rows, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/store"
    manifest = token_store.write_store(stored(rows), path, shards=4)
    found = token_store.read_store(spark, path, block=7).collect()
    assert len(found) == len(rows) and manifest["tokens"] == sum(len(ids_of(r[1])) for r in rows)
    found.sort(key=lambda r: r.start)
    at, last = 0, None
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        assert last is None or r.doc_id is not None and r.doc_id >= last
        at, last = at + r.n_tokens, r.doc_id
    want = sorted((repr(r[0]), np.array(ids_of(r[1]), "<u4").tobytes()) for r in rows)
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in found) == want
    for number, shard in enumerate(manifest["shards"][:2]):
        index = token_store.Shard(path, shard["file"]).index
        got = token_store.fetch(path, number, len(index) - 1)
        assert any(zlib.crc32(got.astype("<u4").tobytes()) == zlib.crc32(bytes(r.ids)) and r.start == shard["base"] + int(index["before"][-1]) for r in found)


def test_another_dictionary_is_refused(spark, stored, rows, tmp_path):
    path = str(tmp_path / "store")
    manifest = token_store.write_store(stored(rows), path)
    (tmp_path / "store" / "dictionary.zdict").write_bytes(b"other")
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Shard(path, manifest["shards"][0]["file"])


def test_a_trained_dictionary_is_shared(spark, stored, tmp_path):
    rows = [(i, f"The quick brown fox number {i} jumps over the lazy dog and runs away. " * 3, "en", "a") for i in range(400)]
    manifest = token_store.write_store(stored(rows), str(tmp_path / "store"), shards=3)
    assert (tmp_path / "store" / "dictionary.zdict").stat().st_size > 0
    assert token_store.read_store(spark, str(tmp_path / "store")).count() == 400 and len(manifest["shards"]) >= 2


def test_empty(spark, stored, tmp_path):
    assert token_store.write_store(stored([]), str(tmp_path / "store"))["shards"] == []
    assert token_store.read_store(spark, str(tmp_path / "store")).count() == 0
