"""Token ids of whole texts through the tokenizers library, with a memo of words.

A byte-level BPE without normaliser cuts a text before each single space that stands between two
visible characters, and encodes what lies between on its own. So a text's ids are its words' ids one
after the other, and a worker needs the library only for words it has not met lately; of such a word
it encodes the runs of letters, digits or marks, which it remembers as well. Texts that hold
a special token's string, words with other characters, and files of another kind of
tokenizer go through the library as they are.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks of ASCII but for the apostrophe, which may begin a run of letters.
_MARKS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_RUNS = re.compile(rf"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+|\n")
# Possessive runs: a word that is not plain fails at once instead of trying every split of its letters.
_PLAIN = re.compile(rf"(?:[{_LETTERS}]++|[0-9]++|[{_MARKS}]++)(?:[{_LETTERS}]++|[0-9]++|[{_MARKS}]++|\n(?!\n|\Z))*+")
#: Letters, and what most words end with.
_ENDED = re.compile(rf"([{_LETTERS}]++)([{_MARKS}]*+)")
#: A space beside other blanks or an end of the text is no cut.
_UNSURE = re.compile(r"\A | \Z| \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Blanks other than the space and the line feed.
_RARE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_MEMO = 400_000
_MEMO_WORD = 64


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE files use for each byte: printable bytes stand for themselves, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Remembers what `make` gives for short words. At `_MEMO` words it becomes the old generation, from which words that are met again come back."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= _MEMO_WORD:
            if len(self) >= _MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Encodes texts to ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str = DEFAULT_TOKENIZER):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.by_word = (
            kind.get("normalizer") is None
            and kind["model"].get("type") == "BPE"
            and not kind["model"].get("continuing_subword_prefix")
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
        )
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size()
        self._model = self.tokenizer.model
        self._letters = _byte_letters()
        self._words = _Memo(self._spaced)
        self._runs = _Memo(self._run)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of a run of letters or of marks, with its space."""
        if run.isascii():
            shown = run.replace(" ", "\u0120").replace("\n", "\u010a")
        else:
            shown = run.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()

    def _spaced(self, word: str) -> bytes:
        """Ids of a word behind its space; its first run is a word of its own, so that letters are held once with and without marks."""
        if word.isascii() and word.isalpha():
            return self._run(" " + word)
        if len(word) > 4 * _MEMO_WORD:
            return self.whole(" " + word)
        ended = _ENDED.fullmatch(word)
        if ended:
            letters, marks = ended.groups()
            return self._words[letters] + self._runs[marks] if marks else self._run(" " + letters)
        if not _PLAIN.fullmatch(word):
            return self.whole(" " + word)
        first, *more = _RUNS.findall(word)
        runs = self._runs
        return (self._words[first] if more else self._run(" " + first)) + b"".join([runs[r] for r in more])

    def words(self, text: str) -> list[str]:
        """The parts that are encoded on their own; each but the first stands behind one space that belongs to it."""
        if not self.by_word:
            return [text]
        return _CUT.split(text) if self._unsure(text) else text.split(" ")

    @staticmethod
    def _unsure(text: str) -> bool:
        """Whether some space stands beside another blank or at an end."""
        if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text:
            return True
        return any(c in text for c in _RARE) and _UNSURE.search(text) is not None

    def counts(self, text: str) -> tuple[list[int], list[int]]:
        """Code points (with the space) and number of ids of each of the parts of a text."""
        first, *words = self.words(text)
        if any(s in text for s in self.special):
            ids = [len(self.whole(first)), *(len(self.whole(" " + w)) for w in words)]
        else:
            known = self._words
            ids = [len(self.whole(first)), *[len(known[w]) for w in words]]
        return [len(first), *(len(w) + 1 for w in words)], [n // 4 for n in ids]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; null counts as empty."""
        if not text:
            return b""
        if not self.by_word or any(s in text for s in self.special):
            return self.whole(text)
        first, *words = self.words(text)
        known = self._words
        return self.whole(first) + b"".join([known[w] for w in words])


@lru_cache(maxsize=2)
def encoder(path: str = DEFAULT_TOKENIZER) -> Encoder:
    """One encoder per worker process and file, kept across tasks."""
    return Encoder(path)
