"""Alignment of two tokenizers over a corpus, each distinct text once.

Rows are shuffled by their full text and counted, so that a text is tokenised and aligned
once however often it is there.  Both tokenizations are laid over the bytes of a space and
the text.  Where a token of either ends at the same byte, a group ends; the two tokens that
end there are linked.  How often a pair of ids is linked counts each text as often as
documents hold it.  A document's measures are those of its text, joined by a digest of it.

Which pairs can be linked is bounded by the vocabularies: the shorter of two tokens that end
together is a suffix of the longer, so there are at most as many as all tokens have bytes
(twice, as a byte may be two pieces), half a million or so, whatever the corpus.  The table of pair
counts is therefore sent to every executor.

Both tokenizers cut before a space or a line end that stands alone between other characters:
no entry of the vocabularies holds one after its beginning (``cuts`` proves that from them).
A text without runs of white space so falls into words, each aligned once in a
worker's bounded table; other texts are aligned whole.

Special tokens' strings are plain text.  Null and empty texts, and those whose tokens do not
spell a space and the text, have no tokens: zeros, and an empty ``groups_sha256``.  Texts of
any length are read whole.  Repeated rows are rows each; so are null and repeated ids.  Copies
of a text, however many, are counted before they are shuffled; their ids then meet one row of
measures.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm import tokens
from credsieve.llm.common import batch, held_once, row_slices, texts_of
from credsieve.session import settled

#: Words a worker keeps, some 300 bytes each.
KEPT_WORDS = 300_000
#: Pair codes are the first id times this, plus the second.
BASE = 1 << 20

_SPACE = "▁"
_RUN = re.compile(r"\s\s")
#: White space that does not stand alone between others, and the character that B writes for a space.
_UNCUT = re.compile(rf"\s\s|\s\Z|\A\s|{_SPACE}")

_ALIGNED = (
    "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long,"
    " groups_sha256 string, pairs array<long>, counts array<long>"
)
_ALIGNED_SCHEMA = pa.schema(
    [
        ("digest", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ]
)


class ByteLevel:
    """Ids and their bytes by a byte-level vocabulary; special strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        byte_of = {letter: b for b, letter in enumerate(tokens.LETTERS)}
        self.bytes = {}
        for token, token_id in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes[token_id] = bytes(byte_of[x] for x in token)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Ids and their bytes by a vocabulary of pieces, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)}
        self.space = self.library.piece_to_id(_SPACE)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def aligned(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple[list[tuple[list, list]], list[tuple[int, int]]]:
    """(groups, links) of two tokenizations, ids and what each spells, of the same bytes."""
    groups, links = [], []
    i = j = from_a = from_b = end_a = end_b = 0
    while i < len(a):
        end_a += len(a_bytes[i])
        i += 1
        while end_b < end_a:
            end_b += len(b_bytes[j])
            j += 1
        if end_a == end_b:
            groups.append((a[from_a:i], b[from_b:j]))
            links.append((a[i - 1], b[j - 1]))
            from_a, from_b = i, j
    return groups, links


def cuts(a: ByteLevel, b: Pieces) -> bool:
    """Whether no entry of either vocabulary goes on over a space or a line end.

    Entries with two characters of white space side by side do not count: texts that are cut have none.
    """

    def goes_on(entry: bytes) -> bool:
        shown = entry.decode(errors="replace")
        return not _RUN.search(shown) and (" " in shown[1:] or "\n" in shown and shown != "\n")

    return not any(goes_on(x) for x in [*a.bytes.values(), *b.bytes.values()])


#: What is known of a word or a text: tokens of A, of B, groups as text, groups, links as packed codes.
Entry = tuple[int, int, str, int, bytes]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.by_word = cuts(self.a, self.b)
        self.known: dict[str, Entry | None] = {}

    def _entry(self, spaced: bytes, a: list[int], b: list[int]) -> Entry | None:
        """None if the tokens do not spell the text."""
        spelled_a, spelled_b = [self.a.bytes[x] for x in a], [self.b.bytes[x] for x in b]
        if b"".join(spelled_a) != spaced or b"".join(spelled_b) != spaced:
            return None
        groups, links = aligned(a, b, spelled_a, spelled_b)
        shown = ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups])
        return len(a), len(b), shown, len(groups), array("q", [x * BASE + y for x, y in links]).tobytes()

    def whole(self, text: str) -> Entry | None:
        return self._entry((" " + text).encode(), self.a.ids([" " + text])[0], self.b.ids([text])[0])

    def _learn(self, words: list[str]) -> dict[str, Entry | None]:
        """Entries of words, each with a space before it, or with the line end it begins with."""
        full = [w if w[:1] == "\n" else " " + w for w in words]
        found = {}
        for word, spaced, a, b in zip(words, full, self.a.ids(full), self.b.ids(words)):
            # The space put before a line end is a piece of its own, which the text does not have.
            found[word] = self._entry(spaced.encode(), a, b[1:] if word[:1] == "\n" and b[:1] == [self.b.space] else b)
        return found

    def entries(self, texts: list[str]) -> list[tuple[int, int, str, int, np.ndarray] | None]:
        """One entry per text, None where it has no tokens."""
        split = [t.replace("\n", " \n").split(" ") if self.by_word and not _UNCUT.search(t) else None for t in texts]
        new = self._learn(list(dict.fromkeys(w for own in split if own for w in own if w not in self.known)))
        out = []
        for text, own in zip(texts, split):
            held = [self.known[w] if w in self.known else new[w] for w in own] if own else [None]
            # A word that is not spelled says nothing of the whole: that is asked itself.
            if None in held:
                held = [self.whole(text)]
            if held == [None]:
                out.append(None)
                continue
            a, b, shown, groups, links = zip(*held)
            out.append((sum(a), sum(b), ";".join(shown), sum(groups), np.frombuffer(b"".join(links), np.int64)))
        for word, entry in new.items():
            if len(self.known) >= KEPT_WORDS:
                break
            self.known[word] = entry
        return out


def aligner(a_path: str, b_path: str) -> Aligner:
    return held_once(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def _aligned(a_path: str, b_path: str):
    def work(batches):
        own = aligner(a_path, b_path)
        for rows, texts in row_slices(batches, 1 << 20):
            n = len(texts)
            found = own.entries(texts)
            pairs = [np.unique(e[4], return_counts=True) if e else (np.zeros(0, np.int64),) * 2 for e in found]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p, _ in pairs])))
            codes, counts = (
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([p[k] for p in pairs]).astype(np.int64)))
                for k in (0, 1)
            ) if n else ([], [])
            yield batch(
                _ALIGNED_SCHEMA, rows.column("digest"), rows.column("copies"),
                *([e[k] if e else 0 for e in found] for k in (0, 1, 3)), [len(e[4]) if e else 0 for e in found],
                [hashlib.sha256(e[2].encode()).hexdigest() if e else "" for e in found], codes, counts,
            )

    return work


def align(docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: tokens of both, groups, links, and what the links' counts say."""
    a_path = a_path or tokens.default_path("byte_bpe_50k.json")
    b_path = b_path or tokens.default_path("piece_bpe_32k.model")
    rows = texts_of(docs).withColumn("text", F.nullif("text", F.lit("")))
    digest = F.unhex(F.sha2("text", 256))
    distinct = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("copies"))
    texts = settled(distinct.withColumn("digest", digest).mapInArrow(_aligned(a_path, b_path), _ALIGNED))
    linked = texts.select("digest", "copies", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    linked = linked.select("digest", "copies", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = linked.groupBy("pair").agg(F.sum(F.col("n") * F.col("copies")).alias("total"))
    # At most the pairs of ids of which one's bytes end the other's.
    of_b = Window.partitionBy(F.col("pair") % BASE)
    ranked = settled(totals.select("pair", "total", (F.col("total") == F.max("total").over(of_b)).alias("best")))
    sums = (
        linked.join(F.broadcast(ranked), "pair").groupBy("digest").agg(
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("total")).alias("count_sum"),
        )
    )
    measures = texts.drop("pairs", "counts", "copies").join(sums, "digest", "left")
    met = rows.select("doc_id", digest.alias("digest")).join(measures, "digest", "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return met.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
