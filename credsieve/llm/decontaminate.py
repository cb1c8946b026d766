"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark.  A passage is two or four neighbouring units of 16
words; its vector has the weighted count of each term, weights being inverse document
frequencies over the units of all documents.  A randomised singular value decomposition
of the passages' matrix, made by distributed products with its transpose, gives the
latent space; passages of documents and of benchmark items meet there by their cosine, for the
items enough of whose words are in the text at all, without which the checks could not succeed.
Each candidate then stands two checks against the words around the passage: the longest
common subsequence with the whole item, and with its answer, the item's last words.  An
item is leaked if nearly all of it is there in order, or most of it and the answer too.

All documents are read once for each block: for the document frequencies, and for which of them
have enough of some item's words; only those are searched.  The decomposition is fitted to
all passages of all documents and of the benchmark.  Items are searched in blocks of ``block`` items, each against all
rows, so nothing that reaches the driver grows with the documents or beyond a block.

Null or empty texts, and items without a word, match nothing.  Long texts are searched whole, in
runs that overlap.  Of several passages of a text that leak an item the best is told, of equal
ones the first.  Rows with null or repeated ids are searched one by one; other columns are ignored, or passed through by ``clean``.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import batch, let_go, row_join, row_slices, texts_of
from credsieve.session import settled

UNIT = 16
RANK = 128
SPARE = 8
BLOCK_ITEMS = 10_000
#: Least cosine of a passage and an item's passage in the latent space.
COSINE = 0.55
#: Share of an item that is leaked alone, with its answer, and of the answer.
WHOLE, MOST, ANSWER = 0.8, 0.6, 0.5
ANSWER_WORDS = 8
#: Weight of a term that is in one unit of two hundred; terms of more are rare.
RARE = 5.3

_EDGES = b".,;:!?\"'()[]{}<>|*#-_/\\`~"
_ROWS = 1 << 15
_GRAM_UNITS = 24
_COVER_CELLS = 1 << 20


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without marks at their edges; lone marks are empty words."""
    return [w.strip(_EDGES) for w in text.lower().encode().split()]


class Terms:
    """Number of each term; 0 for other words."""

    def __init__(self, terms: dict[bytes, int]):
        self.terms = pa.array([w.decode() for w in terms], pa.large_string())
        self.number = np.array([0, *terms.values()], np.int32)

    def numbers_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, and at which of them each text begins, and the last ends."""
        split = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        words = split.values
        # White space at an end of a text gives an empty word there.
        there = pc.greater(pc.binary_length(words), 0)
        first = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()]
        bare = pc.ascii_trim(words.filter(there), characters=_EDGES.decode())
        found = pc.index_in(bare, self.terms).fill_null(-1).to_numpy()
        return self.number[found + 1], first

    def numbers(self, text: str) -> np.ndarray:
        return self.numbers_of([text])[0]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    held = np.sort(values)
    first = np.ones(len(held), bool)
    np.not_equal(held[1:], held[:-1], out=first[1:])
    return held[first]


@dataclass
class Item:
    item_id: int
    words: list[bytes]

    @property
    def answer(self) -> list[bytes]:
        return self.words[-min(ANSWER_WORDS, max(1, len(self.words) // 3)) :]


def _items(rows) -> list[Item]:
    out = []
    for item_id, text in rows:
        words = [w for w in words_of(text or "") if w]
        if words:
            out.append(Item(item_id, words))
    return out


def _units(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, term) of the terms among the words."""
    at = np.flatnonzero(numbers)
    return at // UNIT, numbers[at]


def _unit_sums(unit: np.ndarray, rows: np.ndarray, n_units: int) -> np.ndarray:
    sums = np.zeros((n_units, rows.shape[1]), rows.dtype)
    if len(unit):
        begins = np.ones(len(unit), bool)
        np.not_equal(unit[1:], unit[:-1], out=begins[1:])
        starts = np.flatnonzero(begins)
        sums[unit[starts]] = np.add.reduceat(rows, starts, axis=0)
    return sums


def _passages(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, sum) of all runs of two and of four units, or of all if there are fewer."""
    n = len(sums)
    if n == 1:
        return np.zeros(1, np.int64), sums
    twos = sums[:-1] + sums[1:]
    fours = twos[:-2] + twos[2:] if n > 3 else sums.sum(axis=0, keepdims=True)
    return np.concatenate([np.arange(len(twos)), np.arange(len(fours))]), np.concatenate([twos, fours])


def _n_units(n_words: int) -> int:
    return max(1, -(-n_words // UNIT))


def common_length(pattern: dict, full: int, words: list) -> int:
    """Length of the longest common subsequence; ``pattern`` has the places of each word as bits."""
    row = full
    get = pattern.get
    for word in words:
        match = get(word)
        if match:
            own = row & match
            row = (row + own) | (row - own)
    return (~row & full).bit_count()


def _bits(words: list) -> tuple[dict, int]:
    places: dict = {}
    for i, word in enumerate(words):
        places[word] = places.get(word, 0) | 1 << i
    return places, (1 << len(words)) - 1


class Coverage:
    """Which items have enough of their words in a text."""

    def __init__(self, numbers: list[list[int]], n_terms: int):
        own, term, times = [], [], []
        for i, held in enumerate(numbers):
            found, n = np.unique(held, return_counts=True)
            own.append(np.full(len(found), i))
            term.append(found)
            times.append(n)
        # For each term a run of entries: the items that have it, and how often.
        order = np.argsort(np.concatenate(term), kind="stable")
        self.of_item, self.times = np.concatenate(own)[order], np.concatenate(times)[order]
        self.first_entry = np.searchsorted(np.concatenate(term)[order], np.arange(n_terms + 2))
        self.needed = np.array([MOST * len(n) for n in numbers])

    def covered(self, numbers: np.ndarray) -> np.ndarray:
        """The items; no other can have as many words in common with the text as a leak has."""
        own = _distinct(numbers)
        first = self.first_entry[own]
        n = self.first_entry[own + 1] - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        there = np.bincount(self.of_item[at], weights=self.times[at], minlength=len(self.needed))
        return np.flatnonzero(there >= self.needed)

    def covered_of(self, text: np.ndarray, term: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) in order, what ``covered`` gives for each of some texts; of each place of a term its text is given, in order."""
        size, n_items = len(self.first_entry), len(self.needed)
        text, term = np.divmod(_distinct(text * size + term), size)
        first = self.first_entry[term]
        n = self.first_entry[term + 1] - first
        # As many texts at once as their counts for all items, and the entries, leave room for.
        cost = np.cumsum(n_items + np.bincount(text, weights=n, minlength=n_texts).astype(np.int64))
        found = []
        for texts in np.split(np.arange(n_texts), np.flatnonzero(np.diff(cost // _COVER_CELLS)) + 1):
            own = slice(*np.searchsorted(text, [texts[0], texts[-1] + 1]))
            times = n[own]
            at = np.repeat(first[own] - np.cumsum(times) + times, times) + np.arange(times.sum())
            cell = np.repeat(text[own] - texts[0], times) * n_items + self.of_item[at]
            there = np.bincount(cell, weights=self.times[at], minlength=len(texts) * n_items)
            i, k = np.nonzero(there.reshape(len(texts), n_items) >= self.needed)
            found.append((i + texts[0], k))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Search:
    """All that a task needs: terms, their latent vectors, the items'."""

    def __init__(
        self, items: list[Item], terms: dict[bytes, int], latent: np.ndarray, cosine: float, weights: np.ndarray | None = None
    ):
        self.items, self.cosine = items, cosine
        self.terms = Terms(terms)
        self.latent = latent
        self.numbers = [[terms[w] for w in i.words] for i in items]
        self.places = [_bits(n) for n in self.numbers]
        self.answers = [_bits([terms[w] for w in i.answer]) for i in items]
        vectors, owners = [], []
        for i, numbers in enumerate(self.numbers):
            sums = _unit_sums(*_vectors(np.array(numbers, np.int32), latent))
            own = _unit_length(sums.sum(axis=0, keepdims=True) if len(sums) <= 4 else _passages(sums)[1])
            vectors.append(own)
            owners += [i] * len(own)
        self.vectors = np.concatenate(vectors)
        self.owners = np.array(owners, np.int64)
        self.first_vector = np.searchsorted(self.owners, np.arange(len(items) + 1))
        self.coverage = Coverage(self.numbers, len(terms))
        # What the words of an item that are found anywhere cannot give has to come from its rare ones.
        self.rare = np.zeros(len(terms) + 1, bool) if weights is None else weights >= RARE
        self.rare_needed = np.array([MOST * len(n) - np.count_nonzero(~self.rare[n]) for n in map(np.array, self.numbers)])

    def likely(self, numbers: np.ndarray, items: np.ndarray) -> list[int]:
        """Items that a place of the text can hold: enough of their words are in it, as ``items`` says, and near each
        other enough of their rare ones."""
        if not len(items):
            return []
        wanted = np.zeros(len(self.items), bool)
        wanted[items] = True
        at = np.flatnonzero(self.rare[numbers])
        first = self.coverage.first_entry[numbers[at]]
        n = self.coverage.first_entry[numbers[at] + 1] - first
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, place = self.coverage.of_item[entry], np.repeat(at, n)
        kept = wanted[item]
        item, place = item[kept], place[kept]
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        out = []
        for k, left, right in zip(items.tolist(), np.searchsorted(item, items).tolist(), np.searchsorted(item, items, "right").tolist()):
            needed = math.ceil(self.rare_needed[k])
            if needed > 1:
                own = place[left:right]
                reach = 4 * UNIT + 2 * len(self.numbers[k])
                if len(own) < needed or (own[needed - 1 :] - own[: len(own) - needed + 1]).min() >= reach:
                    continue
            out.append(k)
        return out

    def _covered(self, texts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, its words' numbers, the items that it covers), looked up for some texts at a time."""
        at = 0
        while at < len(texts):
            to, words = at + 1, len(texts[at])
            while to < len(texts) and words + len(texts[to]) <= _COVER_CELLS:
                words += len(texts[to])
                to += 1
            numbers = np.concatenate(texts[at:to])
            there = np.flatnonzero(numbers)
            text = np.repeat(np.arange(to - at), [len(t) for t in texts[at:to]])[there]
            own, item = self.coverage.covered_of(text, numbers[there], to - at)
            for i, first, last in zip(range(at, to), *(np.searchsorted(own, np.arange(to - at), side).tolist() for side in ("left", "right"))):
                yield i, texts[i], item[first:last]
            at = to

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, int, int, float]]:
        """(text, its words' numbers, item, first word of the passage, cosine)."""
        for i, numbers, covered in self._covered(texts):
            items = self.likely(numbers, covered)
            if not len(items):
                continue
            rows = np.concatenate([np.arange(self.first_vector[k], self.first_vector[k + 1]) for k in items])
            vectors = self.vectors[rows].T
            # A long text goes in runs; whole units, and four of them twice at each seam.
            for at in range(0, len(numbers), _ROWS):
                run = numbers[at : at + _ROWS + 3 * UNIT]
                first, sums = _passages(_unit_sums(*_vectors(run, self.latent)))
                near = _unit_length(sums) @ vectors
                for p, v in zip(*np.nonzero(near >= self.cosine)):
                    yield i, numbers, int(self.owners[rows[v]]), at + UNIT * int(first[p]), float(near[p, v])

    def matches(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, int, int, int]]:
        """Of texts as numbers of their words: (text, item, cosine, words in common, of the answer, first word) of leaked items, the best passage each."""
        best: dict[tuple[int, int], tuple] = {}
        for i, numbers, k, first, cosine in self.candidates(texts):
            own = self.numbers[k]
            n = len(own)
            region = numbers[max(0, first - n) : first + 4 * UNIT + n].tolist()
            there = set(region)
            # No more words can be in common than are there at all.
            if sum(map(there.__contains__, own)) < MOST * n:
                continue
            common = common_length(*self.places[k], region)
            if common < MOST * n:
                continue
            answer = common_length(*self.answers[k], region)
            if common >= WHOLE * n or answer >= ANSWER * len(self.items[k].answer):
                found = (common, answer, cosine, -first)
                if found > best.get((i, k), ()):
                    best[i, k] = found
        for (i, k), (common, answer, cosine, first) in sorted(best.items()):
            yield i, k, cosine, common, answer, -first


def _vectors(numbers: np.ndarray, latent: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    unit, term = _units(numbers)
    return unit, latent.take(term, axis=0), _n_units(len(numbers))


def _unit_length(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(length, 1e-12)


_READ = "term int, n long, doc_id long, text_key long, numbers binary, covers boolean"
_READ_SCHEMA = pa.schema([("term", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("numbers", pa.binary()), ("covers", pa.bool_())])


def _read_once(rows: DataFrame, items: list[Item], terms: dict[bytes, int]) -> DataFrame:
    """What one reading of all documents gives: counts of the units that hold each term (term 0: of
    all units), and the texts that hold any, as numbers of the terms, with whether they have enough
    of some item's words.  Written once."""
    size = len(terms) + 1

    def work(batches):
        let_go()
        known, counts, units = Terms(terms), np.zeros(size, np.int64), 0
        coverage = Coverage([[terms[w] for w in i.words] for i in items], len(terms))
        for part, texts in row_slices(batches):
            numbers, first = known.numbers_of(texts)
            lengths = np.diff(first)
            n = np.maximum(1, -(-lengths // UNIT))
            at = np.flatnonzero(numbers)
            text, term = np.repeat(np.arange(len(texts)), lengths)[at], numbers[at]
            unit = (np.cumsum(n) - n)[text] + (at - first[text]) // UNIT
            # All units of the slice at once; a unit counts a term once.
            counts += np.bincount(_distinct(unit * size + term) % size, minlength=size)
            units += int(n.sum())
            kept = np.flatnonzero(np.bincount(text, minlength=len(texts)))
            if len(kept):
                covers = np.bincount(coverage.covered_of(text, term, len(texts))[0], minlength=len(texts))[kept] > 0
                held = [numbers[first[i] : first[i + 1]].tobytes() for i in kept]
                none = [None] * len(kept)
                ids, keys = (part.column(c).take(pa.array(kept)) for c in ("doc_id", "text_key"))
                yield batch(_READ_SCHEMA, none, none, ids, keys, held, covers)
        counts[0] = units
        at = np.flatnonzero(counts)
        none = [None] * len(at)
        yield batch(_READ_SCHEMA, at.astype(np.int32), counts[at], none, none, none, none)

    return settled(rows.mapInArrow(work, _READ))


def _weights(read: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """Inverse document frequency of each term over the units of all documents."""
    counts = np.zeros(len(terms) + 1)
    for r in read.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    weights = np.log((1 + counts[0]) / (1 + counts)) + 1e-3
    weights[0] = 0
    return weights.astype(np.float32)


def _latent(read: DataFrame, items: list[Item], terms: dict[bytes, int], weights: np.ndarray, rank: int) -> np.ndarray:
    """Term vectors (weight times right singular vectors) of the passages' matrix, rows of unit length.

    Two rounds of Y = A'(A Q), summed over partitions by Spark, and the small eigenproblem.
    """
    size = len(terms) + 1
    width = min(rank + SPARE, size - 1)

    def product(texts: Iterator[np.ndarray], basis: np.ndarray) -> np.ndarray:
        total = np.zeros((size, width))
        for runs in _runs(texts):
            _add_grams(total, runs, weights, basis)
        return total

    def partial(basis):
        def work(batches):
            total = product((np.frombuffer(b.as_py(), np.int32) for rows in batches for b in rows.column(0)), basis)
            at = np.flatnonzero(np.abs(total).sum(axis=1))
            columns = [at.astype(np.int32), *(total[at, j] for j in range(width))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term", *(f"c{j}" for j in range(width))])

        return work

    schema = "term int, " + ", ".join(f"c{j} double" for j in range(width))
    own = [np.array([terms[w] for w in i.words], np.int32) for i in items]
    texts = read.where("term is null").select("numbers")

    def of_items(basis: np.ndarray) -> np.ndarray:
        return product(iter(own), basis)

    def of_documents(basis: np.ndarray) -> np.ndarray:
        total = np.zeros((size, width))
        sums = texts.mapInArrow(partial(basis), schema).groupBy("term").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width)))
        found = sums.toArrow()
        total[found["term"].to_numpy()] += np.column_stack([found[f"c{j}"].to_numpy() for j in range(width)])
        return total

    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((size, width)))[0]
    ours, theirs = of_items(basis), of_documents(basis)
    # The items' passages count as much as the documents', however many those are.
    share = np.linalg.norm(theirs) / max(np.linalg.norm(ours), 1e-12) or 1.0
    basis = np.linalg.qr(share * ours + theirs)[0]
    image = share * of_items(basis) + of_documents(basis)
    values, vectors = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    right = basis @ vectors[:, np.argsort(-values)[:rank]]
    return (right * weights[:, None]).astype(np.float32)


def _runs(texts: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts cut into runs of few units, as the work for each grows with the terms of all; the last unit
    of a run is the first of the next, for the passage across.  Some runs at a time."""
    out, held = [], 0
    for numbers in texts:
        for start in range(0, len(numbers), _ROWS // 4):
            part = numbers[start : start + _ROWS // 4]
            for at in range(0, max(1, len(part) - UNIT), _GRAM_UNITS * UNIT):
                out.append(part[at : at + (_GRAM_UNITS + 1) * UNIT])
                held += len(out[-1])
                if held >= _ROWS:
                    yield out
                    out, held = [], 0
    if out:
        yield out


def _add_grams(total: np.ndarray, runs: list[np.ndarray], weights: np.ndarray, basis: np.ndarray) -> None:
    """Add A'(A Q) for the passages, two units each and of unit length, of some runs of words."""
    size = len(weights)
    numbers, lengths = np.concatenate(runs), np.array([len(r) for r in runs])
    at = np.flatnonzero(numbers)
    run, term = np.repeat(np.arange(len(runs)), lengths)[at], numbers[at]
    unit = (at - (np.cumsum(lengths) - lengths)[run]) // UNIT
    # A block of cells for each run, its passages times its terms; a unit is in the passage it begins and in the one before.
    cells = _distinct(run * size + term)
    first = np.searchsorted(cells, np.arange(len(runs) + 1) * size)
    width, n = np.diff(first), np.maximum(1, -(-lengths // UNIT) - 1)
    block = np.cumsum(width * n) - width * n
    cell = block[run] + unit * width[run] + np.searchsorted(cells, run * size + term) - first[run]
    begun, ended = unit < n[run], unit > 0
    places = np.concatenate([cell[begun], (cell - width[run])[ended]])
    values = weights[term].astype(np.float64)
    blocks = np.bincount(places, weights=np.concatenate([values[begun], values[ended]]), minlength=int((width * n).sum()))
    own_terms = cells % size
    for i in np.flatnonzero(width).tolist():
        own = own_terms[first[i] : first[i + 1]]
        rows = blocks[block[i] : block[i] + width[i] * n[i]].reshape(n[i], width[i])
        image = rows @ basis.take(own, axis=0)
        image /= np.maximum(np.einsum("ij,ij->i", rows, rows), 1e-24)[:, None]
        total[own] += rows.T @ image


def searches(
    docs: DataFrame, benchmark: DataFrame, *, rank: int = RANK, block: int = BLOCK_ITEMS, cosine: float = COSINE,
) -> Iterator[tuple[Search, DataFrame]]:
    """One search per block of items, and the rows it has to look at."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    numbered = settled(items.withColumn("at", F.monotonically_increasing_id()))
    rows = texts_of(docs).where("text is not null").withColumn("text_key", F.xxhash64("text"))
    last = -1
    while True:
        own = numbered.where(F.col("at") > last).orderBy("at").limit(block).collect()
        if not own:
            return
        last = own[-1]["at"]
        held = _items((r["item_id"], r["text"]) for r in own)
        if held:
            terms = {w: i + 1 for i, w in enumerate(sorted({w for i in held for w in i.words}))}
            read = _read_once(rows, held, terms)
            weights = _weights(read, terms)
            search = Search(held, terms, _latent(read, held, terms, weights, rank), cosine, weights)
            yield search, read.where("covers").select("doc_id", "text_key", "numbers")


_LEAKS = "doc_id long, text_key long, item_id long, cosine double, n_common int, n_item int, n_answer int, first_word int"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64())]
    + [(n, pa.int32()) for n in ("n_common", "n_item", "n_answer", "first_word")]
)


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document row and item that it leaks: cosine, words in common, of the answer, place.

    Texts are searched where they lie; only leaks leave the task.
    """
    found = []
    for search, rows in searches(docs, benchmark, **options):

        def work(batches, search=search):
            for part in batches:
                ids, keys = part.column("doc_id").to_pylist(), part.column("text_key").to_pylist()
                texts = [np.frombuffer(b.as_py(), np.int32) for b in part.column("numbers")]
                out = [
                    (ids[i], keys[i], search.items[k].item_id, cosine, common, len(search.items[k].words), answer, first)
                    for i, k, cosine, common, answer, first in search.matches(texts)
                ]
                if out:
                    yield batch(_SCHEMA, *zip(*out))

        # Few and of any length: dealt out, so that long texts do not meet in one task.
        found.append(rows.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(work, _LEAKS))
    if not found:
        return docs.sparkSession.createDataFrame([], _LEAKS)
    return reduce(DataFrame.union, found)


def clean(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = settled(leaks(own, benchmark, **options).select("doc_id", "text_key").distinct())
    return row_join(docs, found, "left_anti", key, text)[0].select(*docs.columns)
