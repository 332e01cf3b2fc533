import hashlib
import re

from strata.llm import exact_dedup


def expected(rows):
    groups = {}
    for i, (doc, text, *_) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            doc = None if m[1] else m[2]
            out.append((doc, None if best[1] else best[2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(stored, rows):
    found = exact_dedup.find_copies(stored(rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_one_row_stays_with_all_columns(stored, rows):
    docs = stored(rows)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert sorted(norms) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows})


def test_a_large_group_and_negative_ids(stored):
    rows = [(i - 40, "same text" + " " * (i % 3), "en", "a") for i in range(90)] + [(100, "other", "en", "a")]
    found = exact_dedup.find_copies(stored(rows), salts=4).where("group_size > 1").collect()
    assert len(found) == 90 and {r.keep_id for r in found} == {-38} and [r.doc_id for r in found if r.kept] == [-38]


def test_empty(stored):
    assert exact_dedup.find_copies(stored([])).count() == 0
    assert exact_dedup.drop_copies(stored([])).count() == 0


def test_no_python_in_the_plan(spark, stored, rows):
    plan = exact_dedup.find_copies(stored(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
