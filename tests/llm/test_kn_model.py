import math
import random
from collections import Counter

import pytest

from strata.llm import kn_model, queries


def brute(texts, trusted):
    def pad(text):
        return bytes([255]) * 3 + (text or "").encode() + bytes([254])

    counts = {4: Counter()}
    for text in trusted:
        data = pad(text)
        counts[4].update(data[k : k + 4] for k in range(len(data) - 3))
    for order in (3, 2, 1):
        counts[order] = Counter()
        for gram, n in counts[order + 1].items():
            counts[order][gram[1:]] += n if gram[1] == 255 else 1
    p, weight = {}, {}
    for order in (1, 2, 3, 4):
        n = Counter(counts[order].values())
        d = (0.5, 1.0, 1.5)
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            own = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
            d = own if all(0 < x < i for i, x in enumerate(own, 1)) else d
        total, off = Counter(), Counter()
        for gram, c in counts[order].items():
            total[gram[:-1]] += c
            off[gram[:-1]] += d[min(c, 3) - 1]
        weight[order] = {h: off[h] / total[h] for h in total}
        p[order] = {
            gram: (c - d[min(c, 3) - 1]) / total[gram[:-1]] + weight[order][gram[:-1]] * (p[order - 1][gram[1:]] if order > 1 else 1 / 256)
            for gram, c in counts[order].items()
        }

    def chance(gram):
        order = len(gram)
        if not order:
            return 1 / 256
        return p[order][gram] if gram in p[order] else weight[order].get(gram[:-1], 1.0) * chance(gram[1:])

    out = []
    for text in texts:
        data = pad(text)
        logs = [math.log(chance(data[k : k + 4])) for k in range(len(data) - 3)]
        out.append(math.exp(-sum(logs) / len(logs)))
    return out


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_perplexities_match_brute_force(spark, stored, rows, monkeypatch):
    monkeypatch.setattr(kn_model, "CHUNK_ROWS", 10)
    marks = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(90)] + [(None, 1, 0), (999, 1, 0), (4, 1, None), (5, 1, 1)]
    good = {i for i, q, t in marks if i is not None and q == 1} - {i for i, q, t in marks if t == 1}
    want = brute([r[1] for r in rows], [r[1] for r in rows if r[0] in good])
    found = kn_model.classify(stored(rows), labels(spark, marks)).collect()
    assert len(found) == len(rows)
    got = sorted((repr(r.doc_id), r.n_symbols, r.perplexity) for r in found)
    for (a, n, x), (b, m, y) in zip(got, sorted((repr(r[0]), len((r[1] or "").encode()) + 1, w) for r, w in zip(rows, want, strict=True)), strict=True):
        assert (a, n) == (b, m) and x == pytest.approx(y, rel=1e-9)
    assert {r.doc_id for r in found if r.trusted} == {r[0] for r in rows if r[0] in good}
    for lang in {r[2] for r in rows}:
        mine = sorted(r.perplexity for r in found if r.lang == lang and r.trusted) or sorted(r.perplexity for r in found if r.trusted)
        limit = mine[math.ceil(len(mine) * kn_model.QUANTILE) - 1]
        assert all(limit * 1.25 <= r.threshold <= limit * 1.25 * 1.011 and r.kept == (r.perplexity <= r.threshold) for r in found if r.lang == lang)


def test_junk_is_told_from_prose(spark, stored, rows):
    prose = [(i, r[1], "en", "a") for i, r in enumerate(rows[:100]) if "#" not in r[1]]
    junk = [(500 + i, "".join(chr(33 + (i * 31 + k * k * 7) % 90) for k in range(300)), "en", "a") for i in range(10)]
    found = kn_model.classify(stored(prose + junk), labels(spark, [(i, 1, 0) for i, *_ in prose[::2]])).collect()
    assert {r.doc_id for r in found if not r.kept} == {j[0] for j in junk}


def test_no_trusted_text_and_empty(spark, stored, rows):
    found = kn_model.classify(stored(rows[:5]), labels(spark, [])).collect()
    assert all(r.kept and r.perplexity == pytest.approx(256) for r in found)
    assert kn_model.classify(stored([]), labels(spark, [(1, 1, 0)])).count() == 0


PROSE = ("the quick brown fox jumps over a lazy dog while seven old men watch from the garden wall and talk about rain".split(),
         "в начале было слово потом пришли люди построили город посадили сад написали книги стали жить долго мирно".split())


def judged(spark, folder, rows, marks):
    """The registered query over documents (doc_id, text, lang) and labels."""
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    labels(spark, marks).write.parquet(f"{folder}/labels.parquet")
    return queries.op2_quality_model(spark, str(folder)).collect()


def clean(words, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=rng.randint(30, 60))) for _ in range(n)]


def test_query_limits_by_the_quantile_itself(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(clean(PROSE[0], 120, 1))]
    found = judged(spark, tmp_path, rows, [(i, 1, 0) for i in range(110)])
    docs, marks = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    out = kn_model.classify(docs, marks, slack=1.0, own_limits=True, order=7, held_out=True).withColumn("held", kn_model.held("doc_id"))
    again = {r.doc_id: r for r in out.collect()}
    assert all(r.threshold == again[r.doc_id].threshold and r.kept == (r.perplexity <= r.threshold) for r in found)
    # Nine tenths of the labels make the second model; its quantile over the others is the limit.
    inside = [r.doc_id for r in again.values() if r.trusted and not r.held]
    second = kn_model.classify(docs, labels(spark, [(i, 1, 0) for i in inside]), slack=1.0, order=7).collect()
    mine = sorted(r.perplexity for r in second if r.doc_id < 110 and again[r.doc_id].held)
    limit = mine[math.ceil(len(mine) * kn_model.QUANTILE) - 1]
    assert mine and all(limit <= r.threshold <= limit * 1.011 for r in found)


def test_query_keeps_clean_documents_it_has_not_counted(spark, tmp_path):
    rng = random.Random(9)
    starts = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmn"]
    rows = [(i, " ".join(ordered(rng, starts, 40)), "en") for i in range(300)]
    found = judged(spark, tmp_path, rows, [(i, 1, 0) for i in range(200)])
    assert sum(r.kept for r in found if r.doc_id >= 200) >= 92


def test_query_keeps_clean_documents_of_unlabelled_languages(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(clean(PROSE[0], 80, 2))]
    rows += [(100 + i, t, "ru") for i, t in enumerate(clean(PROSE[1], 40, 3))] + [(200 + i, t, None) for i, t in enumerate(clean(PROSE[1], 5, 4))]
    rows += [(300, "слово" * 40, "bg")]
    # A label that is not trusted makes no trusted language.
    found = judged(spark, tmp_path, rows, [(i, 1, 0) for i in range(80)] + [(100, 0, 0), (101, 1, 1)])
    assert {r.doc_id for r in found if r.doc_id >= 100 and not r.kept} == set()
    assert max(r.threshold for r in found if r.lang == "en") < min(r.perplexity for r in found if r.lang == "ru")


def test_an_outlier_of_an_unlabelled_language_goes(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(clean(PROSE[0], 40, 5))] + [(100 + i, t, "ru") for i, t in enumerate(clean(PROSE[1], 200, 6))]
    junk = (999, "".join(chr(0x4E00 + i * 37 % 5000) for i in range(200)), "ru")
    found = judged(spark, tmp_path, [*rows, junk], [(i, 1, 0) for i in range(40)])
    gone = {r.doc_id for r in found if r.lang == "ru" and not r.kept}
    assert 999 in gone and len(gone) <= 3


def ordered(rng, starts, n):
    """Words that all end alike, each followed by one of two others: only a context that sees the whole word tells which."""
    at, out = rng.randrange(len(starts)), []
    for _ in range(n):
        out.append(starts[at] + "er")
        at = (2 * at + rng.randrange(2)) % len(starts)
    return out


def test_query_tells_shuffled_words(spark, tmp_path):
    rng = random.Random(8)
    starts = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmn"]
    texts = [ordered(rng, starts, 80) for _ in range(150)]
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(rng.sample(t, len(t))), "en") for i, t in enumerate(texts[:30])]
    found = judged(spark, tmp_path, rows, [(i, 1, 0) for i in range(150)])
    assert all(not r.kept for r in found if r.doc_id >= 1000)
    assert sum(r.kept for r in found if r.doc_id < 150) >= 148


@pytest.mark.parametrize("order", [2, 7])
def test_orders_give_chances_that_sum_to_one(spark, stored, rows, order):
    frames = spark.createDataFrame([(kn_model.zstandard.compress(r[1].encode()),) for r in rows[:60] if r[1]], "data binary")
    model = kn_model.Model(kn_model.count_grams(frames, order), order)
    seen = kn_model.grams_of([rows[0][1].encode()], order)[0].tolist()
    contexts = {seen[0] >> 8, seen[30] >> 8, seen[60] >> 8, int.from_bytes(b"qzqzqz"[: order - 1], "big")}
    asked = spark.createDataFrame([(c << 8 | b,) for c in contexts for b in range(256)], "gram bigint")
    total = {}
    for r in model.score(asked).collect():
        total[r.gram >> 8] = total.get(r.gram >> 8, 0) + math.exp(r.log_p)
    assert set(total) == contexts and all(x == pytest.approx(1, rel=1e-9) for x in total.values())


def test_texts_of_a_small_model_are_scored_where_they_are_read(spark, tmp_path, monkeypatch):
    def moved(*_):
        raise AssertionError("n-grams were asked for, or texts were packed to be moved")

    rows = [(i, t, "en") for i, t in enumerate(clean(PROSE[0], 60, 10))] + [(None, None, None), (3, "", "en")]
    monkeypatch.setattr(kn_model, "requests", moved)
    monkeypatch.setattr(kn_model, "_compressed", moved)
    assert len(judged(spark, tmp_path, rows, [(i, 1, 0) for i in range(50)])) == 62


@pytest.mark.parametrize("order", [1, 2, 3, 7])
def test_a_large_model_and_many_labels_give_the_same(spark, stored, rows, monkeypatch, order):
    marks = labels(spark, [(i, 1, 0) for i in range(0, 90, 2)])
    docs = stored(rows)

    def found():
        out = kn_model.classify(docs, marks, order=order, held_out=True).collect()
        return sorted((repr(r.doc_id), r.lang or "", r.n_symbols, r.trusted, r.kept, r.row, r.perplexity, r.threshold) for r in out)

    monkeypatch.setattr(kn_model, "SCORED_BYTES", 700)
    small = found()
    monkeypatch.setattr(kn_model, "MOST_HELD", 0)
    monkeypatch.setattr(kn_model, "MOST_SENT", 0)
    monkeypatch.setattr(kn_model, "TASK_GRAMS", 50)
    large = found()
    assert [r[:6] for r in small] == [r[:6] for r in large] and len(small) == len(rows)
    for a, b in zip(small, large, strict=True):
        assert a[6:] == pytest.approx(b[6:], rel=1e-9)


def test_counts_are_packed_once_per_shard(spark):
    texts = ["aab", "", "ab" * 40, "ж и ж"]
    frames = spark.createDataFrame([(t, i % 2 == 1) for i, t in enumerate(texts)], "text string, held boolean")
    got = {r.gram: (r.n, r.rest) for r in kn_model.count_grams(frames, 5).collect()}
    n, rest = (Counter(kn_model.grams_of([t.encode() for t in some], 5)[0].tolist()) for some in (texts, texts[::2]))
    assert got == {g: (n[g], rest[g]) for g in n}
    assert kn_model.shard_counts(frames, 5).groupBy("shard").count().where("count > 1").count() == 0
