import random

from strata.llm import edit_counts as e
from strata.llm.tokens import encoder

PARTS = ["the", "of", "Foo,", "bar.\nBaz", "x", "é", "日本", "a  b", "1 2", "it's", "<|endoftext|>", "\n", "\t", "...", "a b"]
PUTS = ["", " ", "\n", " x", "x ", "foo bar", "  "]


def whole(text):
    return len(encoder().tokenizer.encode(text, add_special_tokens=False).ids)


def test_trees_follow_random_edits():
    rng, encode = random.Random(3), encoder()
    for case in range(400):
        text = " ".join(rng.choices(PARTS, k=rng.randint(0, 400))) if case % 3 else "".join(rng.choices(["a", "b", " ", "\n", ".", "the "], k=300))
        tree = e.Tree.load(e.Tree.build(encode, text).dump())
        assert (tree.points, tree.tokens) == (len(text), whole(text))
        for _ in range(2):
            edits = [(rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 40]), rng.choice(PUTS)) for _ in range(rng.randint(1, 5))]
            taken = e.accepted(edits, len(text))
            want = text
            for at, remove, put in reversed(taken):
                want = want[:at] + put + want[at + remove :]
            text, _ = e.apply_edits(tree, text, taken, encode)
            assert text == want and (tree.points, tree.tokens) == (len(text), whole(text))
            node = tree.sums
            assert all((node[i] == node[2 * i] + node[2 * i + 1]).all() for i in range(1, tree.leaves))


def test_a_small_edit_encodes_little():
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = e.Tree.build(encoder(), text)
    new, again = e.apply_edits(tree, text, [(70_000, 3, "xyz")], encoder())
    assert again < 2000 and tree.tokens == whole(new)


def test_refused_edits():
    assert e.accepted([(5, 3, "a"), (6, 1, "b"), (5, 0, "c"), (8, 99, None), (-4, None, "d"), (None, 0, "e")], 10) == [(0, 0, "d"), (5, 0, "c"), (6, 1, "b"), (8, 2, "")]


def test_recount(spark, stored, rows):
    docs = stored(rows)
    edits = [(r[0], p, n, t) for i, r in enumerate(rows) if i % 4 for p, n, t in ((i, 3, " new words "), (i + 1, 0, "late"), (50, 2, None))]
    edits += [(None, 0, 1, "x"), (12345, 0, 0, "x"), (1, None, None, None)]
    changes = spark.createDataFrame(edits, "doc_id bigint, at bigint, remove bigint, put string")
    trees = e.stored_trees(docs)
    found = e.recount(docs, trees, changes).collect()
    want = []
    for r in rows:
        text = r[1] or ""
        own = [x[1:] for x in edits if x[0] is not None and x[0] == r[0]]
        taken = e.accepted(own, len(text))
        new = text
        for at, remove, put in reversed(taken):
            new = new[:at] + put + new[at + remove :]
        want.append((r[0], whole(text), whole(new), len(taken), len(own) - len(taken)))
    assert sorted(((x.doc_id, x.n_tokens_before, x.n_tokens, x.n_edits, x.n_refused) for x in found), key=repr) == sorted(want, key=repr)
    for x in found:
        if x.text is not None:
            assert whole(x.text) == x.n_tokens == e.Tree.load(bytes(x.tree)).tokens


def test_empty(spark, stored):
    none = spark.createDataFrame([], "doc_id bigint, at bigint, remove bigint, put string")
    docs = stored([])
    assert e.recount(docs, e.stored_trees(docs), none).count() == 0


def test_documents_without_edits_keep_their_length(spark, stored):
    docs = stored([(1, "one two é", "en", "a"), (2, None, "en", "a"), (None, "日本語 x", "ja", "b")])
    edits = spark.createDataFrame([(1, 0, 1, "")], "doc_id bigint, at bigint, remove bigint, put string")
    found = e.recount(docs, e.stored_trees(docs), edits).collect()
    assert {r.doc_id: r.n_chars for r in found} == {1: 8, 2: 0, None: 5}
