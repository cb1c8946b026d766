"""Packing by minimum bin slack.

A document's ids, with the end id, are cut into full windows and one remainder.  What is
left to pack is known by its histogram alone: how many pieces have each length up to the
window.  The plan takes the longest length left, finds by subset sums, kept as bits of one
integer per layer, the multiset of remaining lengths that fills a window closest to its
capacity, walks the layers back to counts per length, and uses that filling as often as
the histogram allows.  Every use exhausts a length, so a plan has at most
``window * (2 + ln window)`` fillings whatever the number of documents.

Pieces then find their place by their rank within their length.  Only one number per
length reaches the driver; texts and ids are never shuffled.

Null text is an empty one and gives the end id alone.  Rows with a null or repeated id
are packed like any other.  An empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm import tokens
from credsieve.llm.common import batch, slices, texts_of
from credsieve.session import settled

WINDOW = 1024
END_ID = 0

_PIECES = (
    "part int, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, local_rank long"
)
_PIECE_SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("local_rank", pa.int64()),
    ]
)


def cut(docs: DataFrame, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of every document; ``local_rank`` counts a length's pieces within a task."""
    schema = _PIECE_SCHEMA.append(pa.field("ids", pa.binary())) if with_ids else _PIECE_SCHEMA
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        encoder = tokens.spaced_words(path)
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for ids, texts in slices(batches):
            rows = []
            for doc_id, text in zip(ids, texts):
                packed = encoder.ids(text) + end
                total = len(packed) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    own = packed[4 * start : 4 * (start + length)]
                    row = (part, doc_id, start, length, zlib.crc32(own), total, seen[length])
                    rows.append((*row, own) if with_ids else row)
                    seen[length] += 1
            yield batch(schema, *zip(*rows))

    return texts_of(docs).mapInArrow(work, _PIECES + ", ids binary" if with_ids else _PIECES)


def fullest(counts: dict[int, int], capacity: int) -> Counter:
    """The multiset of ``counts`` that holds the longest length and has the least slack."""
    first = max(counts)
    chosen, room = Counter({first: 1}), capacity - first
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted(counts, reverse=True):
        if length > room or reach >> room & 1:
            continue
        left = min(counts[length] - (length == first), room // length)
        copies = 1
        while left > 0:
            copies = min(copies, left)
            layers.append((length, copies, reach))
            reach |= reach << (length * copies) & mask
            left -= copies
            copies *= 2
    at = reach.bit_length() - 1
    for length, copies, before in reversed(layers):
        if not before >> at & 1:
            chosen[length] += copies
            at -= length * copies
    return chosen


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, uses, copies, first sequence, offset).

    Ranks ``first .. first + uses * copies`` of a length go to sequences ``first sequence ..``,
    one copy after the other, each copy at ``offset`` plus its length per copy before it.
    """
    left = {length: n for length, n in histogram.items() if n}
    used: Counter = Counter()
    rows, sequence = [], 0
    while left:
        filling = fullest(left, window)
        uses = min(left[length] // copies for length, copies in filling.items())
        offset = 0
        for length, copies in sorted(filling.items(), reverse=True):
            rows.append((length, used[length], uses, copies, sequence, offset))
            offset += length * copies
            used[length] += uses * copies
            left[length] -= uses * copies
            if not left[length]:
                del left[length]
        sequence += uses
    return rows


def pack(
    docs: DataFrame,
    *,
    path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: its document, place there, crc32, sequence and offset in it.

    ``with_ids`` adds the piece's ids, packed as little-endian unsigned 32-bit numbers;
    ``sequences`` then makes the token sequences.
    """
    path = path or tokens.default_path("byte_bpe_50k.json")
    # Ranks are those of one reading: written once, a lost executor cannot change them.
    pieces = settled(cut(docs, path, window, end_id, with_ids))
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per length and task.
    offsets = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One row per length up to the window.
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = sorted(plan(histogram, window))
    lengths, firsts, uses, copies, sequences, starts = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 6))
    shift = np.int64(1) << np.int64(44)
    keys = lengths * shift + firsts

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        size, at = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = np.searchsorted(keys, size * shift + at, "right") - 1
        within = at - firsts[row]
        return pd.DataFrame(
            {
                "sequence_id": sequences[row] + within % uses[row],
                "offset": starts[row] + within // uses[row] * size,
            }
        )

    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("local_rank") + F.col("before"))
    placed = ranked.withColumn("place", place("length", "rank"))
    kept = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens"]
    out = placed.select(*kept, "place.sequence_id", "place.offset", *(["ids"] if with_ids else []))
    return out


def sequences(pieces: DataFrame) -> DataFrame:
    """(``sequence_id``, ``ids``, ``pieces``): the sequences of ``pack(with_ids=True)``, at most a window long."""
    own = F.struct("offset", "doc_id", "start", "length", "ids")
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(own)).alias("held"))
    whole = F.aggregate("held", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    named = F.transform("held", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length")))
    return held.select("sequence_id", whole.alias("ids"), named.alias("pieces"))
