import random

import numpy as np
import public_tokenizers
import pytest

from strata.llm import tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(rows, name):
    encode = tokens.Encoder(public_tokenizers.path(name))
    odd = ["", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\nb c", "foo.\nBar, baz!", "it's we'll\tx y", "x<|endoftext|>y z", "日本 語 é a b\x1c d",
           "1 2 3a b4, (c) ...d !e", "a\n", "a b\n", "a b\n\n c", "ﬁ ǅ x", "A" * 300 + " b", "é x", "  a  b"]
    rng = random.Random(4)
    odd += ["".join(rng.choices(["a", "é", " ", "\n", ".", "1", "the", " x", "\t", "'s", "😀"], k=30)) for _ in range(500)]
    for text in odd + [r[1] or "" for r in rows]:
        want = encode.tokenizer.encode(text, add_special_tokens=False).ids
        for _ in range(2):
            assert np.frombuffer(encode.encode(text), "<u4").tolist() == want
        points, counts = encode.counts(text)
        assert sum(points) == len(text) and sum(counts) == len(want)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts_equal_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "_MEMO", 200)
    encode = tokens.Encoder(public_tokenizers.path(name))
    rng = random.Random(6)
    parts = ["a", "é", " ", "\n", ".", "1", "the", " x", "\t", "'s", "'", "😀", " 日本", "\xa0", "&&&", "-", "42", "_", "\"", "\\", "ß", "²", "٣", "§", "\x1c", "\u3000"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(6000)] + ["555-8639 x", "foo&&& (bar)", "a\u3000 b", "don't it's", "a 's b"]
    for at in range(0, len(texts), 500):
        want = encode.tokenizer.encode_batch(texts[at : at + 500], add_special_tokens=False)
        assert [np.frombuffer(encode.encode(t), "<u4").tolist() for t in texts[at : at + 500]] == [w.ids for w in want]


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMO", 50)
    encode = tokens.Encoder()
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(600))
    assert np.frombuffer(encode.encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert max(map(len, (encode._words, encode._words.old, encode._runs, encode._runs.old))) <= 51


def test_letters_are_held_once_with_and_without_marks():
    encode, runs = tokens.Encoder(), []
    run = encode._run
    encode._run = encode._runs.make = lambda text: runs.append(text) or run(text)
    text = "x über tree über, tree. tree\nüber"
    assert np.frombuffer(encode.encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(runs) == sorted([" über", " tree", ",", ".", "\n", "über"])
    assert " tree" not in encode._runs and " über" not in encode._runs
