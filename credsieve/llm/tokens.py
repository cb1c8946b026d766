"""Token ids of whole texts, word by word, by the tokenizers library.

A text falls into words at single spaces and line ends wherever the tokenizer's own
splitting provably cuts there too.  A word's ids are found once per Python worker by the
library and kept as packed little-endian unsigned 32-bit numbers; a text's ids are then
one join of bytes.  Texts where the cut is not proven go through the library whole.
The table of kept words is bounded; words beyond the bound are encoded each time.
"""

from __future__ import annotations

import json
import re
from array import array

from tokenizers import Tokenizer

from credsieve.llm.common import held_once

#: Words a worker keeps.  The first to come are the frequent ones.
KEPT_WORDS = 400_000

# Letters that normalisation leaves alone or maps one to one when it lowers them.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = frozenset(",.;:!?")
#: Plain letters and then ASCII marks other than apostrophes, which go with letters after them.
_PLAIN_THEN_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
#: Space that runs on over a cut: three in a row, or two at the end of the text.
_RUN = re.compile(r"\s\s(?:\s|\Z)")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


LETTERS = _byte_letters()


def letter_then_mark(word: str) -> bool:
    return word[-1:] in _MARKS and PLAIN.fullmatch(word[-2:-1]) is not None


def byte_level(word: str) -> str:
    # Printable ASCII stands for itself; a plain word holds no other.
    if word.isascii() and word.isalpha():
        return word
    return "".join([LETTERS[b] for b in word.encode()])


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Words(dict):
    """Packed ids by word."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self.encode(word)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


class _Encoder:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.pieces = self.library.model.tokenize
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def holds_special(self, text: str) -> bool:
        return any(s in text for s in self.special)


class LowerWordEncoder(_Encoder):
    """Vocabularies with word ends that lower case and drop white space.

    No token spans white space and normalisation never joins across it, so every space
    and line end is a cut.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.words = _Words(self._word)
        self.words[""] = b""

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            lower = word.lower()
            if lower != word:
                return self.words[lower]
            return _packed([t.id for t in self.pieces(byte_level(word))])
        # Letters are one piece of the tokenizer's splitting, a run of marks another.
        if parts := _PLAIN_THEN_MARKS.fullmatch(word):
            return self.words[parts[1]] + self.words[parts[2]]
        if letter_then_mark(word):
            return self.words[word[:-1]] + self.words[word[-1]]
        return self.whole(word)

    def ids(self, text: str) -> bytes:
        if self.holds_special(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


class SpacedWordEncoder(_Encoder):
    """Byte-level vocabularies whose words carry the space before them.

    A cut lies before each single space or line end.  Runs of three spaces, or of two at
    the end of a text, hold pieces that span a cut: such texts are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.words = _Words(self._spaced)
        self.bare = _Words(self._bare)

    def _plain(self, word: str, space: str) -> bytes:
        return _packed([t.id for t in self.pieces(byte_level(space + word))])

    def _bare(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            return self._plain(word, "")
        return self.whole(word)

    def _spaced(self, word: str) -> bytes:
        if word[:1] == "\n":
            if word == "\n" or not word[1].isspace():
                return self.bare["\n"] + (self.bare[word[1:]] if len(word) > 1 else b"")
            return self.whole(word)
        if PLAIN.fullmatch(word):
            return self._plain(word, " ")
        if letter_then_mark(word):
            return self.words[word[:-1]] + self.bare[word[-1]]
        return self.whole(" " + word)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.holds_special(text) or _RUN.search(text):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.words.__getitem__, rest))


def lower_words(path: str) -> LowerWordEncoder:
    return held_once(("lower words", path), lambda: LowerWordEncoder(path))


def spaced_words(path: str) -> SpacedWordEncoder:
    return held_once(("spaced words", path), lambda: SpacedWordEncoder(path))
