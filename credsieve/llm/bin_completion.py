"""Packing of whole documents by bin completion, a branch-and-bound search.

A document's ids, with the end id, stay together; only a document longer than the window is
cut, into full windows and one remainder.  What is to be packed is known by its histogram
alone: how many pieces have each length up to the window.  The search

* starts with best fit decreasing, worked on the histogram (bins of one filling are one
  entry with a count), as its first incumbent, and with a lower bound on the sequences of
  any packing; where the two meet the incumbent is proven best and the search is over;
* otherwise takes the longest length left, enumerates fillings around it, drops each that
  another dominates (some of its pieces could give way to a piece left outside that is at
  least as long), and branches on the rest, those with the least waste first; a filling is
  used as often as the histogram allows;
* leaves a branch whose waste so far and lower bound for what is left reach the incumbent;
* completes every branch by best fit decreasing, which is the new incumbent if it needs
  fewer sequences.

``branches`` (fillings looked at for a node) and ``nodes`` bound the search, not the input:
a search that ends there returns its incumbent, a full packing.

Pieces then find their place by their rank within their length.  Only one number per
length reaches the driver, and the plan has at most some fillings per length whatever the
number of documents; texts and ids are never shuffled.

Null text is an empty one and gives the end id alone.  A very long text is encoded whole in
its task and cut.  Rows with a null or repeated id are packed like any other; which of
several pieces of one length takes which place is arbitrary but fixed once cut.  An empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm import tokens
from credsieve.llm.common import batch, slices, texts_of
from credsieve.session import settled

WINDOW = 2048
END_ID = 0
#: Fillings looked at for one node of the search, and nodes of the whole search.
BRANCHES = 24
NODES = 200

#: What fills one sequence, as sorted (length, copies), longest first.
Filling = tuple[tuple[int, int], ...]

_CUT = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, local_rank long"
_CUT_SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int32()), ("ids_crc32", pa.int64()), ("local_rank", pa.int64()),
    ]
)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit decreasing over a histogram: (filling, sequences filled so).

    Sequences with equal room and filling are handled together.  The fullest that still has
    room takes as many copies of a length as fit, as it stays the fullest until then.
    """
    groups: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((filling, n))

    for length in sorted(left, reverse=True):
        count = left[length]
        at = bisect_left(rooms, length)
        # What gets a copy has too little room for another one, so it lies before `at`.
        while count and at < len(rooms):
            room = rooms[at]
            fit = room // length
            held = groups.pop(room)
            del rooms[at]
            while held and count:
                filling, n = held.pop()
                full = min(n, count // fit)
                if full:
                    put(room - fit * length, (*filling, (length, fit)), full)
                    count -= full * fit
                    n -= full
                if n and count:
                    put(room - count * length, (*filling, (length, count)), 1)
                    count, n = 0, n - 1
                if n:
                    held.append((filling, n))
            if held:
                groups[room] = held
                insort(rooms, room)
            at = bisect_left(rooms, length)
        if count:
            fit = capacity // length
            full, rest = divmod(count, fit)
            if full:
                put(capacity - fit * length, ((length, fit),), full)
            if rest:
                put(capacity - rest * length, ((length, rest),), 1)
    return [entry for room in rooms for entry in groups[room]]


def lower_bound(left: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs.

    For every least length a: pieces longer than ``capacity - a`` are alone, those above half
    the capacity are in sequences of their own, and what is at least a has to find room there
    or in further ones.
    """
    counts = np.zeros(capacity + 2, np.int64)
    for length, n in left.items():
        counts[length] = n
    number = np.concatenate(([0], np.cumsum(counts)))
    size = np.concatenate(([0], np.cumsum(counts * np.arange(capacity + 2))))
    half = capacity // 2
    least = np.arange(0, half + 1)
    alone = number[capacity + 1] - number[capacity - least + 1]
    large = number[capacity - least + 1] - number[half + 1]
    free = large * capacity - (size[capacity - least + 1] - size[half + 1])
    rest = size[half + 1] - size[least]
    return int((alone + large + np.maximum(0, -((free - rest) // capacity))).max())


def dominated(filling: Counter, left: dict[int, int], waste: int) -> bool:
    """Whether a piece left outside fits as well, or some pieces could give way to one of at least their length.

    The first piece, around which the filling is made, stays.  Equal lengths are no exchange.
    """
    if any(outside <= waste and n > filling.get(outside, 0) for outside, n in left.items()):
        return True
    first = max(filling)
    one, several = 0, 0
    for length, copies in filling.items():
        for _ in range(copies - (length == first)):
            several |= (one | several) << length
            one |= 1 << length
    if not one:
        return False
    sums = one | several
    for outside, n in left.items():
        if n <= filling.get(outside, 0):
            continue
        # Sums from what the waste allows up to the piece's own length; alone, the length itself is no exchange.
        low = max(1, outside - waste)
        if (sums >> low) & ((1 << (outside - low)) - 1) or several >> outside & 1:
            return True
    return False


def fillings(left: dict[int, int], capacity: int, most_waste: int, branches: int = BRANCHES) -> list[tuple[int, Counter]]:
    """Undominated fillings around the longest piece, as (waste, filling), least waste first.

    They are looked for from long pieces to short ones; ``branches`` bounds how many are looked at.
    """
    first = max(left)
    lengths = sorted((x for x in left if x <= capacity - first), reverse=True)
    found: list[tuple[int, Counter]] = []
    looked = 0

    def look(at: int, room: int, chosen: Counter) -> None:
        nonlocal looked
        while at < len(lengths) and (lengths[at] > room or left[lengths[at]] == chosen.get(lengths[at], 0)):
            at += 1
        if at == len(lengths):
            looked += 1
            if room <= most_waste and not dominated(chosen, left, room):
                found.append((room, Counter(chosen)))
            return
        length = lengths[at]
        free = left[length] - (length == first)
        for copies in range(min(free, room // length), -1, -1):
            if looked >= branches:
                return
            if copies:
                chosen[length] += copies
            look(at + 1, room - copies * length, chosen)
            if copies:
                chosen[length] -= copies
                if not chosen[length]:
                    del chosen[length]
    look(0, capacity - first, Counter({first: 1}))
    return sorted(found, key=lambda f: (f[0], sorted(f[1].items(), reverse=True)))


def complete(
    histogram: dict[int, int], capacity: int = WINDOW, *, branches: int = BRANCHES, nodes: int = NODES
) -> list[tuple[Filling, int]]:
    """A packing of the histogram into as few sequences as the search finds: (filling, sequences filled so)."""
    left = {length: n for length, n in histogram.items() if n}
    if not left:
        return []
    best = best_fit(left, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(left, capacity)
    # Depth first, the least waste first: (what is left, what is filled, sequences so far).
    open_nodes = [(left, [], 0)]
    while open_nodes and nodes and fewest > bound:
        left, filled, used = open_nodes.pop()
        if used + lower_bound(left, capacity) >= fewest:
            continue
        nodes -= 1
        if filled:
            own = [*filled, *best_fit(left, capacity)]
            n = sum(n for _, n in own)
            if n < fewest:
                best, fewest = own, n
        slack = (fewest - 1 - used) * capacity - sum(length * n for length, n in left.items())
        below = []
        for waste, filling in fillings(left, capacity, slack, branches):
            uses = min(left[length] // copies for length, copies in filling.items())
            if waste:
                uses = max(1, min(uses, slack // waste))
            rest = {length: n - uses * filling.get(length, 0) for length, n in left.items()}
            own = (tuple(sorted(filling.items(), reverse=True)), uses)
            below.append(({length: n for length, n in rest.items() if n}, [*filled, own], used + uses))
        for node in reversed(below):
            if node[0]:
                open_nodes.append(node)
            elif node[2] < fewest:
                best, fewest = node[1], node[2]
    return best


def plan(histogram: dict[int, int], window: int = WINDOW, **search) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, uses, copies, first sequence, offset) of a packing.

    Ranks ``first .. first + uses * copies`` of a length go to sequences ``first sequence ..``,
    one copy after the other, each copy at ``offset`` plus its length per copy before it.
    """
    used: Counter = Counter()
    rows, sequence = [], 0
    for filling, uses in complete(histogram, window, **search):
        offset = 0
        for length, copies in filling:
            rows.append((length, used[length], uses, copies, sequence, offset))
            offset += length * copies
            used[length] += uses * copies
        sequence += uses
    return rows


def cut(docs: DataFrame, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of every document; ``local_rank`` counts a length's pieces within a task."""
    schema = _CUT_SCHEMA.append(pa.field("ids", pa.binary())) if with_ids else _CUT_SCHEMA
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        encoder = tokens.lower_words(path)
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for ids, texts in slices(batches):
            rows = []
            for doc_id, text in zip(ids, texts):
                packed = encoder.ids(text) + end
                for piece, at in enumerate(range(0, len(packed), 4 * window)):
                    own = packed[at : at + 4 * window]
                    length = len(own) // 4
                    row = (part, doc_id, piece, at // 4, length, zlib.crc32(own), seen[length])
                    rows.append((*row, own) if with_ids else row)
                    seen[length] += 1
            yield batch(schema, *zip(*rows))

    return texts_of(docs).mapInArrow(work, _CUT + ", ids binary" if with_ids else _CUT)


def pack(
    docs: DataFrame, *, path: str | None = None, window: int = WINDOW, end_id: int = END_ID,
    with_ids: bool = False, branches: int = BRANCHES, nodes: int = NODES,
) -> DataFrame:
    """One row per piece: document, number and place in it, length, crc32, sequence and offset there.

    ``with_ids`` adds the piece's ids, packed as little-endian unsigned 32-bit numbers.
    """
    path = path or tokens.default_path("word_bpe_49k.json")
    # Ranks are those of one reading: written once, a lost executor cannot change them.
    pieces = settled(cut(docs, path, window, end_id, with_ids))
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per length and task.
    offsets = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One row per length up to the window.
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, window, branches=branches, nodes=nodes)
    # A few rows per length up to the window, whatever the number of documents.
    fillings_of = pieces.sparkSession.createDataFrame(
        rows, "of_length int, first_rank long, uses long, copies long, first_sequence long, first_offset long"
    )
    within = F.col("rank") - F.col("first_rank")
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("local_rank") + F.col("before"))
    placed = ranked.join(
        F.broadcast(fillings_of),
        (F.col("length") == F.col("of_length")) & (within >= 0) & (within < F.col("uses") * F.col("copies")),
    )
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_sequence") + within % F.col("uses")).alias("sequence_id"),
        F.expr("first_offset + (rank - first_rank) div uses * length").alias("offset"),
        *(["ids"] if with_ids else []),
    )
