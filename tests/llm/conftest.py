import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, size string, kept string, rank int"


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Rows (doc_id, text, lang, source) as a stored table of several files, with extra columns of clashing names."""

    def make(rows, parts=3):
        path = str(tmp_path_factory.mktemp("docs") / "docs")
        full = [(*r, len(r[1] or ""), 7, "x", "no", 1) for r in rows]
        spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(path)
        return spark.read.schema(SCHEMA).parquet(path)

    return make


def prose(rng, words, n):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="session")
def rows():
    """Prose with exact and near copies and shared passages, and every odd case: nulls, blanks, repeats, long texts."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 7))) for _ in range(400)]
    shared = [prose(rng, words, 70) for _ in range(3)]
    out, base = [], None
    for i in range(120):
        text = prose(rng, words, rng.randint(20, 160)) + "."
        if i % 5 == 1:
            text += "\n" + rng.choice(shared)
        if i % 4 == 2:
            parts = base.split(" ")
            for _ in range(rng.randint(0, 4)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            text = rng.choice([" ", "  ", "\n"]).join([" ".join(parts[:9]), " ".join(parts[9:])])
        elif i % 9 == 0:
            text = " ### ".join(text.split(" "))
        base = text
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", "é", None])))
    long = prose(rng, words, 30_000)
    out += [
        (200, None, "en", "a"), (201, "", "en", "b"), (202, " \t\n", None, None), (203, "one", "en", "a"), (204, "One", "de", "b"),
        (205, "two words here", "en", "a"), (206, long, "en", "a"), (207, long + " end", "en", "c"), (208, "x" * 70_000, "fr", "c"),
        (209, "日本語 テキスト é ü <|endoftext|> x", "ja", "b"), (209, out[0][1], "en", "a"), (0, out[0][1], "en", "a"),
        (None, out[3][1], "en", "a"), (None, out[3][1], "en", "a"), (None, "only here " * 30, None, "b"), (210, "ab " * 400, "en", "a"),
    ]
    return out
