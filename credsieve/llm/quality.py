"""Line-first cleaning.

Each line of a text is judged alone, by three rules: punctuation (a line that neither ends
as a sentence does nor has a mark inside), navigation (separators between most of its
words, or a short line of links), and boilerplate (notices that stand on many pages).
Failing lines are removed.  A text that loses more than half of its word characters, or
that fails the base rules on the whole text, is rejected; the rest is kept, cleaned.

Null text has no words and is rejected like any other of under ten words.  Rows with null
or repeated ids are judged one by one.  Other columns are ignored.  An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from credsieve.llm.common import batch, slices, texts_of

LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
#: A text must keep this share of its word characters, in percent.
LEAST_KEPT_PERCENT = 50

_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_SEPARATORS = frozenset("| / > » › · • - –".encode().split())
_NOTICE = re.compile(
    "all rights reserved|copyright ©|copyright \\(c\\)|terms of (?:use|service)|privacy policy|cookie policy"
    "|uses cookies|accept cookies|enable javascript|click here|sign up for|subscribe to our|log in to|skip to (?:main )?content",
    re.IGNORECASE,
)
_MARK = re.compile(r"[.,;:!?…。！？]")


def line_fails(line: str) -> str | None:
    """The rule that removes a line with a word, or None."""
    words = line.encode().split()
    separators = sum(map(_SEPARATORS.__contains__, words))
    if 4 * separators >= len(words) and (separators > 1 or len(words) <= 3):
        return "navigation"
    if _NOTICE.search(line):
        return "boilerplate"
    if not _MARK.search(line):
        return "punctuation"
    return None


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of five that the text has twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    # Windows of two, then four, then five words, each numbered by what it holds.
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    fours = np.unique(pairs[:-2] * n + pairs[2:], return_inverse=True)[1]
    _, place, times = np.unique(fours[:-1] * len(known) + ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[place] > 1)
    if not len(starts):
        return 0
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int((np.cumsum(change[:n]) > 0).sum())


def judge(text: str) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """(words, word characters, symbols, repeated lines, repeated words, base failed, kept, lines removed, cleaned)."""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = text.split("\n")
    filled = [line for line in lines if line.strip(_SPACE)]
    repeated_lines = len(filled) - len(set(filled))
    repeated = _repeated(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * len(words)
    verdicts = dict(zip(dict.fromkeys(filled), repeat(None)))
    for line in verdicts:
        verdicts[line] = line_fails(line)
    left = [line for line in lines if verdicts.get(line) is None]
    removed = len(lines) - len(left)
    cleaned = text if not removed else "\n".join(left)
    left_chars = word_chars if not removed else len(cleaned) - sum(map(cleaned.count, _SPACE))
    kept = not failed and 100 * left_chars >= LEAST_KEPT_PERCENT * word_chars
    return len(words), word_chars, symbols, repeated_lines, repeated, failed, kept, removed, cleaned


_COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_removed_lines long, cleaned string"
)
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_removed_lines", pa.int64()), ("cleaned", pa.string())]
)


def clean(docs: DataFrame, *, with_text: bool = True) -> DataFrame:
    """Measures, verdict and, if wanted, the cleaned text of every row; nothing is shuffled."""

    def work(batches):
        for ids, texts in slices(batches):
            rows = [judge(t) for t in texts]
            if not with_text:
                rows = [(*r[:-1], None) for r in rows]
            yield batch(_SCHEMA, ids, *zip(*rows))

    out = texts_of(docs).mapInArrow(work, _COLUMNS)
    return out if with_text else out.drop("cleaned")
