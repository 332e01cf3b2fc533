from collections import Counter

from strata.llm import quality_rules as q
from strata.llm.common import WORD


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again), len(lines))


def cell(x):
    shift = max(x.bit_length() - 7, 0)
    return x >> shift << shift


def rank(values, share):
    values = sorted(values)
    return values[-(-len(values) * share // 4) - 1]


def verdicts(rows, least):
    docs = []
    for _, text, lang, source in rows:
        n, chars, symbols, dup, again, lines = counts(text)
        rates = (1000 * symbols // n if n else 0, 1000 * chars // n if n else 0, 1000 * dup // lines if lines else 0, 1000 * again // n if n else 0)
        docs.append((lang, source, n < 50 or 100 * again > 50 * n, rates))
    out = []
    for lang, source, failed, rates in docs:
        good = not failed
        group = [d for d in docs if not d[2] and d[:2] == (lang, source)]
        if len(group) < least:
            group = [d for d in docs if not d[2] and d[0] == lang] if group else []
        for k, (_, slack, two_sided) in enumerate(q.RULES.values()):
            if group:
                q1, q3 = (rank([cell(d[3][k]) for d in group], s) for s in (1, 3))
                reach = max(q.REACH * (q3 - q1), slack)
                good &= (q1 - reach if two_sided else 0) <= rates[k] <= q3 + reach
        out.append(good)
    return out


def test_counts_match_brute_force(rows):
    for _, text, *_ in rows:
        assert q.measure_text(text) == counts(text)


def test_verdicts_match_brute_force(stored, rows, monkeypatch):
    for least in (1, 10):
        monkeypatch.setattr(q, "LEAST_DOCS", least)
        docs = stored(rows)
        found = q.apply_rules(docs).collect()
        key = lambda r: (repr(r[0]), repr(r[1]))
        want = sorted((*key(r), k) for r, k in zip(rows, verdicts(rows, least), strict=True))
        assert sorted((repr(r.doc_id), repr(r.text), r.kept) for r in found) == want
        assert 0 < sum(r.kept for r in found) < len(found)


def test_sketches_merge(stored, rows):
    measured = q.measure(stored(rows))
    whole = {tuple(r)[:4]: r.docs for r in q.sketch(measured).collect()}
    halves = Counter()
    for part in (rows[::2], rows[1::2]):
        halves.update({tuple(r)[:4]: r.docs for r in q.sketch(q.measure(stored(part))).collect()})
    assert whole == dict(halves)


def test_empty(stored):
    assert q.apply_rules(stored([])).count() == 0
