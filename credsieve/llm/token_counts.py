"""Token counts with a proven one-token shortcut.

Before any text is read, every vocabulary string that ends a word is given to the
tokenizer alone.  Those that come back as exactly their own token are proven: as a
pre-token of any text they count one, and no merge has to run.  A text falls into
pre-tokens; proven ones are counted by a table lookup, the rest by the tokenizer's merges.

Null text counts as empty: no bytes, no tokens.  Rows with a null or repeated id are
counted like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from credsieve.llm import tokens
from credsieve.llm.common import batch, held_once, slices, texts_of

COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_shortcut long"

_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_shortcut", pa.int64())]
)
_WORD_END = "</w>"


def proven_strings(path: str) -> frozenset[str]:
    """Vocabulary strings that, as a whole text, encode to their own token and nothing else."""
    library = tokens.lower_words(path).library
    byte_of = {letter: b for b, letter in enumerate(tokens.LETTERS)}
    candidates = {}
    for token, token_id in library.get_vocab(with_added_tokens=False).items():
        letters = token.removesuffix(_WORD_END)
        if letters == token:
            continue
        try:
            candidates[bytes(byte_of[x] for x in letters).decode()] = token_id
        except UnicodeDecodeError:
            continue
    encoded = library.encode_batch_fast(list(candidates), add_special_tokens=False)
    return frozenset(t for (t, i), e in zip(candidates.items(), encoded) if e.ids == [i])


class Counter(dict):
    """Tokens by word: 1 << 32 for each proven pre-token, plus its tokens."""

    SHORTCUT = 1 << 32

    def __init__(self, path: str):
        self.proven = proven_strings(path)
        self.encoder = tokens.lower_words(path)
        self.update(dict.fromkeys((s for s in self.proven if tokens.PLAIN.fullmatch(s)), self.SHORTCUT + 1))
        self[""] = 0

    def __missing__(self, word: str) -> int:
        found = self._count(word)
        if len(self) < tokens.KEPT_WORDS:
            self[word] = found
        return found

    def _count(self, word: str) -> int:
        if tokens.PLAIN.fullmatch(word):
            lower = word.lower()
            if lower in self.proven:
                return self.SHORTCUT + 1
            return len(self.encoder.pieces(tokens.byte_level(lower)))
        if tokens.letter_then_mark(word):
            return self[word[:-1]] + self[word[-1]]
        if word in self.proven:
            return self.SHORTCUT + 1
        return len(self.encoder.whole(word)) // 4

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of a text, and how many of them the shortcut counted."""
        if self.encoder.holds_special(text):
            return len(self.encoder.whole(text)) // 4, 0
        both = sum(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        return both % self.SHORTCUT, both // self.SHORTCUT


def counter(path: str) -> Counter:
    return held_once(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, *, path: str | None = None, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: bytes, tokens, whether tokens exceed ``limit``, shortcut tokens.

    The table lies as it is read; nothing is shuffled.
    """
    path = path or tokens.default_path("word_bpe_49k.json")

    def work(batches):
        known = counter(path)
        for ids, texts in slices(batches):
            counts = [known.count(t) for t in texts]
            yield batch(
                _SCHEMA, ids, [len(t.encode()) for t in texts],
                [c[0] for c in counts], [c[0] > limit for c in counts], [c[1] for c in counts],
            )

    return texts_of(docs).mapInArrow(work, COUNTED)
