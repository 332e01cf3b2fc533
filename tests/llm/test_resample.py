import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.llm import resample
from strata.llm.terms import terms


def brute(docs, target, buckets=10_000, max_run=1, least=20, percent=10):
    """doc_id, n_features, weight, score, drawn by the plain definition."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))

    def found(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for text in side for b in found(text)) for side in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out = []
    for doc_id, text in docs:
        f = found(text)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(f), weight, score, len(words(text)) >= least))
    enough = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, enough[: percent * len(enough) // 100]


def key(row):
    return tuple((v is None, v or 0) for v in row)


@pytest.mark.parametrize(("options", "percent"), [({}, 10), ({"buckets": 70_000, "max_run": 2, "least_words": 5}, 40)])
def test_equals_brute_force(spark, stored, rows, options, percent):
    target = [rows[1][1], None, "", "Some WORDS über 3x"]
    docs = stored(rows)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, items, percent=percent, **options).collect()
    want, drawn = brute([r[:2] for r in rows], target, options.get("buckets", 10_000), options.get("max_run", 1), options.get("least_words", 20), percent)
    assert sorted((key(r) for r in ((g.doc_id, g.n_features, g.weight, g.score) for g in got))) == sorted(key(r[:4]) for r in want)
    ranked = sorted((g for g in got if g["rank"] is not None), key=lambda g: g["rank"])
    assert [g["rank"] for g in ranked] == list(range(1, len(drawn) + 1)) and drawn
    assert [(g.score, g.doc_id) for g in ranked] == [(d[3], d[0]) for d in drawn]


def test_draw_keeps_rows_and_columns(spark, stored, rows):
    docs = stored(rows)
    items = spark.createDataFrame([(rows[1][1],)], "text string")
    got = resample.draw(docs.withColumnRenamed("rank", "__row"), items)
    _, drawn = brute([r[:2] for r in rows], [rows[1][1]])
    assert sorted(map(key, ([r.doc_id] for r in got.collect()))) == sorted(map(key, ([d[0]] for d in drawn)))
    assert got.columns == docs.withColumnRenamed("rank", "__row").columns


def test_radix_ranks_order_any_keys(spark):
    """Negative, extreme and null-like keys, hot keys, and blocks far smaller than a key's rows."""
    values = [-(2**63), -5, -1, 0, 1, 7, 7, 7, 2**40, 2**63 - 1]
    rows = [(i, values[i * 7 % 10] if i % 3 else 7, values[i * i % 10]) for i in range(500)]
    df = spark.createDataFrame(rows, "row bigint, a bigint, b bigint")
    got = sorted(resample.radix_ranks(df, ["a", "b"], block_rows=16).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [(r.a, r.b) for r in got] == sorted((a, b) for _, a, b in rows) and {r.row for r in got} == set(range(500))
    same = spark.createDataFrame([(i, 3) for i in range(40)], "row bigint, a bigint")
    assert sorted(r["rank"] for r in resample.radix_ranks(same, ["a"], block_rows=16).collect()) == list(range(1, 41))


def test_empty_tables(spark, stored, rows):
    docs, none = stored(rows[:3]), spark.createDataFrame([], "text string")
    assert resample.resample(docs.where("doc_id < 0"), none).count() == 0
    assert resample.resample(docs, none).count() == 3
    short = resample.resample(stored([(1, None, "en", "a"), (2, "two words", "en", "a")]), none).collect()
    assert [(r.n_features, r["rank"]) for r in sorted(short, key=lambda r: r.doc_id)] == [(0, None), (2, None)]


def test_terms():
    assert terms("Ab-9 Éx\x00_ÀB  日本") == [t.encode() for t in ("ab", "9", "Éx", "Àb", "日本")]
    assert terms(None) == terms("") == terms(" -.") == []


def test_noise_is_the_same_in_any_session(spark):
    df = spark.range(3).select("id", resample.noise(F.col("id"), "2024").alias("v"))
    want = {i: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296))) for i in range(3)}
    assert {r.id: r.v for r in df.collect()} == want
