import pytest

from strata.llm import mixing
from strata.llm.common import WORD


def level_targets(sizes):
    """Share and reshare step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
            left -= target[s]
    return target


@pytest.mark.parametrize("bins", [1, 7, 1 << 14])
def test_targets_and_words(stored, rows, bins):
    found = mixing.mix(stored(rows), bins=bins).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = level_targets(sizes)
    assert len(found) == len(rows)
    for source, size in sizes.items():
        mine = [r for r in found if r.source == source]
        assert {r.source_size for r in mine} == {size}
        assert mine[0].target == pytest.approx(want[source])
        assert abs(sum(r.copies * r.size for r in mine) - want[source]) <= max((r.size for r in mine), default=0) / 2 + 1
        assert {r.copies for r in mine} <= {int(want[source] // size), int(want[source] // size) + 1}


def test_reruns_and_layouts_agree(stored, rows):
    def drawn(docs):
        return sorted((repr(r.doc_id), r.size, r.copies) for r in mixing.mix(docs).collect())

    assert drawn(stored(rows)) == drawn(stored(rows[::-1], parts=1))


def test_ranks_are_ratios_of_odds(spark, stored):
    docs = [(i, "w " * 10, "en", "a" if i % 2 else "b") for i in range(400)]
    found = mixing.mix(stored(docs)).collect()
    u = {r.doc_id: r.u for r in stored(docs).select("doc_id", mixing.uniform("doc_id").alias("u")).collect()}
    for source in "ab":
        mine = [r for r in found if r.source == source]
        more = [u[r.doc_id] for r in mine if r.copies > min(x.copies for x in mine)]
        less = [u[r.doc_id] for r in mine if r.copies == min(x.copies for x in mine)]
        assert not more or not less or max(more) < min(less)


def test_weights(stored):
    docs = [(i, "w " * 10, "en", "a") for i in range(300)]
    frame = stored(docs).selectExpr("*", "IF(doc_id % 3 = 0, 0.0, IF(doc_id % 3 = 1, 1.0, CAST(NULL AS DOUBLE))) AS weight")
    found = mixing.mix(frame, weight_col="weight").collect()
    assert {r.copies for r in found if r.doc_id % 3 != 1} == {0} and {r.copies for r in found if r.doc_id % 3 == 1} == {2}


def test_take_repeats_rows(stored, rows):
    docs = stored(rows)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in mixing.mix(docs).collect())


def test_empty_and_wordless(stored):
    assert mixing.mix(stored([])).count() == 0
    assert [r.copies for r in mixing.mix(stored([(1, None, "en", "a"), (2, "", "en", None)])).collect()] == [0, 0]
