"""Token ids in files of patched frame-of-reference blocks.

A segment of the file holds whole documents in ascending order.  Its ids are cut into
blocks; each block stores its least id, the width that holds the chosen percentile of what
is above it, the ids packed at that width, and a list of exceptions (place and the bits
above the width) for the rest.  The segment's index says where every block starts and
where every document ends, so that one block can be read without the others.

    magic  "PFR2"                          4 bytes
    n_docs, n_ids, block, n_blocks         4 x uint32
    token counts of the documents          n_docs x uint32
    doc ids, null flags                    n_docs x int64, n_docs x uint8
    block starts, from the payload's start (n_blocks + 1) x uint32
    payload: per block  least uint32, width uint8, exceptions uint16,
             packed ids (64 of them fill as many 64-bit words as the width), places uint16
             each, high bits uint32 each

Segments are rows of a Parquet table (part, segment, first id, n_ids, data), written by
Spark's own committer: a lost executor's half-written segments never appear, and any
store that Spark writes will do.  Index columns are read without the data.

Null text is an empty one.  A text of any length is encoded whole and is a segment of its own
if it is long; a document's ids have to fit in one row.  Documents are ordered by id, null ids
first, ties by a hash of the text, then by ids; repeated rows are all kept.  An empty table gives
an empty file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsieve.llm import tokens
from credsieve.llm.common import batch, row_slices, texts_of

BLOCK = 256
PERCENTILE = 98.0
#: A segment is closed at so many ids; one longer document is a segment alone.
SEGMENT_IDS = 1 << 18
END_ID = 2
#: Bytes of texts whose ids a task writes, and keys of the sample that says where its part begins.
PART_BYTES = 16 * 1024 * 1024
PART_SAMPLE = 50

_MAGIC = b"PFR2"
_HEAD = struct.Struct("<4s4I")
_BLOCK_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
_SEGMENT = "part int, segment int, n_docs long, n_ids long, data binary"
_SEGMENT_SCHEMA = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]
)


_ENCODED = "at int, doc_id long, text_key long, ids binary"
_ENCODED_SCHEMA = pa.schema([("at", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("ids", pa.binary())])


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _lanes(width: int) -> list[tuple[int, int, int]]:
    """(value, 64-bit word, bit in it) of 64 values of ``width`` bits, which are ``width`` words."""
    return [(i, i * width >> 6, i * width & 63) for i in range(64)]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values at ``width`` bits each, as rows of bytes; the values fill 64-bit words from the lowest bit on."""
    rows, block = values.shape
    runs = -(-block // 64)
    if not width:
        return np.zeros((rows, 0), np.uint8)
    own = np.zeros((rows, runs * 64), np.uint64)
    own[:, :block] = values
    own = own.reshape(rows, runs, 64)
    words = np.zeros((rows, runs, width), "<u8")
    for i, word, bit in _lanes(width):
        words[:, :, word] |= own[:, :, i] << np.uint64(bit)
        if bit + width > 64:
            words[:, :, word + 1] |= own[:, :, i] >> np.uint64(64 - bit)
    return words.reshape(rows, -1).view(np.uint8)


def _packed_size(width, block: int):
    """Bytes of a block's packed values."""
    return -(-block // 64) * 8 * width


def _unpack(rows: np.ndarray, width: int, block: int) -> np.ndarray:
    if not width:
        return np.zeros((len(rows), block), np.uint32)
    runs = -(-block // 64)
    words = np.ascontiguousarray(rows).view("<u8").reshape(len(rows), runs, width)
    out = np.empty((len(rows), runs, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i, word, bit in _lanes(width):
        value = words[:, :, word] >> np.uint64(bit)
        if bit + width > 64:
            value = value | words[:, :, word + 1] << np.uint64(64 - bit)
        out[:, :, i] = value & mask
    return out.reshape(len(rows), -1)[:, :block]


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(block starts, payload) of a run of ids; the last block is filled up with its least id."""
    count = -(-len(ids) // block)
    if not count:
        return np.zeros(1, np.uint32), b""
    padded = np.empty(count * block, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[(count - 1) * block :].min()
    grid = padded.reshape(count, block)
    least = grid.min(axis=1)
    above = grid - least[:, None]
    needed = _bits(above)
    at = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    widths = np.partition(needed, at, axis=1)[:, at]
    outside = needed > widths[:, None]
    n_outside = outside.sum(axis=1)
    sizes = _BLOCK_HEAD.itemsize + _packed_size(widths.astype(np.int64), block) + 6 * n_outside
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.uint32)
    heads = np.zeros(count, _BLOCK_HEAD)
    heads["least"], heads["width"], heads["exceptions"] = least, widths, n_outside
    payload: list = [b""] * count
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        kept = above[own] & np.uint32((1 << int(width)) - 1)
        for i, row in zip(own, _pack(kept, int(width))):
            payload[i] = row.tobytes()
    out = []
    for i in range(count):
        out.append(heads[i].tobytes())
        out.append(payload[i])
        if n_outside[i]:
            places = np.flatnonzero(outside[i])
            out.append(places.astype("<u2").tobytes())
            out.append((above[i, places] >> widths[i]).astype("<u4").tobytes())
    return starts, b"".join(out)


def decode_blocks(starts: np.ndarray, payload: np.ndarray, n_ids: int, block: int) -> np.ndarray:
    count = len(starts) - 1
    if not count:
        return np.zeros(0, np.uint32)
    begin = starts[:-1].astype(np.int64)
    size = _BLOCK_HEAD.itemsize
    heads = payload[begin[:, None] + np.arange(size)].copy().view(_BLOCK_HEAD).reshape(count)
    grid = np.empty((count, block), np.uint32)
    for width in np.unique(heads["width"]):
        own = np.flatnonzero(heads["width"] == width)
        packed = _packed_size(int(width), block)
        rows = payload[(begin[own] + size)[:, None] + np.arange(packed)]
        grid[own] = _unpack(rows, int(width), block)
    for i in np.flatnonzero(heads["exceptions"]):
        n, width = int(heads["exceptions"][i]), int(heads["width"][i])
        at = int(begin[i]) + size + _packed_size(width, block)
        places = payload[at : at + 2 * n].copy().view("<u2")
        high = payload[at + 2 * n : at + 6 * n].copy().view("<u4")
        grid[i, places] |= high << np.uint32(width)
    grid += heads["least"][:, None]
    return grid.reshape(-1)[:n_ids]


def encode_segment(doc_ids: list, packed: list[bytes], block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    ids = np.frombuffer(b"".join(packed), "<u4")
    starts, payload = encode_blocks(ids, block, percentile)
    parts = [
        _HEAD.pack(_MAGIC, len(doc_ids), len(ids), block, len(starts) - 1),
        np.array([len(p) // 4 for p in packed], "<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        starts.astype("<u4").tobytes(),
        payload,
    ]
    return b"".join(parts)


def _opened(data: bytes) -> tuple[list, np.ndarray, int, int, np.ndarray, np.ndarray]:
    """(doc ids, token counts, number of ids, ids of a block, block starts, payload) of a segment."""
    magic, n_docs, n_ids, block, n_blocks = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    counts = np.frombuffer(data, "<u4", n_docs, at)
    doc_ids = np.frombuffer(data, "<i8", n_docs, at + 4 * n_docs)
    missing = np.frombuffer(data, "u1", n_docs, at + 12 * n_docs)
    at += 13 * n_docs
    starts = np.frombuffer(data, "<u4", n_blocks + 1, at)
    payload = np.frombuffer(data, np.uint8, offset=at + 4 * (n_blocks + 1))
    return [None if gone else d for d, gone in zip(doc_ids.tolist(), missing)], counts, n_ids, block, starts, payload


def decode_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, token counts, all ids)."""
    doc_ids, counts, n_ids, block, starts, payload = _opened(data)
    return doc_ids, counts, decode_blocks(starts, payload, n_ids, block)


def decode_range(data: bytes, first: int, last: int) -> np.ndarray:
    """Ids ``first`` up to ``last`` of a segment; only the blocks they lie in are unpacked."""
    _, _, n_ids, block, starts, payload = _opened(data)
    first, last = max(0, first), min(last, n_ids)
    if first >= last:
        return np.zeros(0, np.uint32)
    begin, end = first // block, -(-last // block)
    ids = decode_blocks(starts[begin : end + 1], payload, (end - begin) * block, block)
    return ids[first - begin * block : last - begin * block]


def write(
    docs: DataFrame, to: str, *, path: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS
) -> None:
    """Encode every text and write the segments, in ascending document order, to ``to``."""
    path = path or tokens.default_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    kind = "<u2" if max(end_id, tokens.lower_words(path).library.get_vocab_size()) < 1 << 16 else "<u4"
    # Rows that are wholly alike are told apart by where they are read, so that they can be several parts.
    rows = texts_of(docs).withColumn("text_key", F.xxhash64("text")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    parts, bounds = _bounds(rows)

    def encode(batches):
        encoder = tokens.lower_words(path)
        # On the way to their segments ids are two bytes where the vocabulary allows that.
        for held, texts in row_slices(batches):
            ids = [np.frombuffer(encoder.ids(t) + end, "<u4").astype(kind).tobytes() for t in texts]
            keys = zip(*(held.column(c).to_pylist() for c in ("doc_id", "text_key", "salt")))
            at = [bisect_right(bounds, (doc_id is not None, doc_id or 0, *rest)) for doc_id, *rest in keys]
            yield batch(_ENCODED_SCHEMA, at, held.column("doc_id"), held.column("text_key"), ids)

    def work(batches):
        part, segment = TaskContext.get().partitionId(), 0
        ids, packed, held = [], [], 0

        def closed():
            return batch(_SEGMENT_SCHEMA, [part], [segment], [len(ids)], [held], [encode_segment(ids, packed)])

        for rows in batches:
            for doc_id, own in zip(rows.column("doc_id").to_pylist(), rows.column("ids")):
                own = np.frombuffer(own.as_py(), kind).astype("<u4").tobytes()
                if held and held + len(own) // 4 > segment_ids:
                    yield closed()
                    segment += 1
                    ids, packed, held = [], [], 0
                ids.append(doc_id)
                packed.append(own)
                held += len(own) // 4
        if ids:
            yield closed()

    # Texts are encoded where they lie, once, and their ids shuffled, which are fewer bytes.
    encoded = rows.mapInArrow(encode, _ENCODED).repartitionById(parts, F.col("at"))
    ordered = encoded.sortWithinPartitions("doc_id", "text_key", "ids").select("doc_id", "ids")
    ordered.mapInArrow(work, _SEGMENT).write.option("compression", "uncompressed").parquet(to)


def _bounds(rows: DataFrame) -> tuple[int, list[tuple]]:
    """(number of parts, least key of each part after the first) from a sample of the keys: (id given, id, text key, salt).

    A part gets about ``PART_BYTES`` of text; an id, or a row, that is there very often is several parts.
    """
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = int(size // PART_BYTES) + 1
    wanted = parts * PART_SAMPLE
    keys = rows.select("doc_id", "text_key", "salt")
    chosen = keys if n <= 2 * wanted else keys.sample(fraction=wanted / n, seed=1)
    sample = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_key"], r["salt"]) for r in chosen.collect())
    return parts, sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def _segment_starts(segments: DataFrame) -> DataFrame:
    """(``part``, ``segment``, ``first``): the ids of the file before each segment."""
    sizes = segments.select("part", "segment", "n_ids")
    # One row per task that wrote, then one per segment of such a task.
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before_part), F.lit(0)).alias("part_start"))
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .join(parts, "part")
        .select("part", "segment", (F.col("part_start") + F.col("before")).alias("first"))
    )


def ids_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(``start``, ``ids``): ids ``first`` up to ``last`` of the file, one row per segment they lie in.

    The index tells which segments those are; of them only the blocks asked for are unpacked.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path)
    wanted = _segment_starts(segments).withColumnRenamed("first", "segment_start")
    held = segments.join(wanted, ["part", "segment"]).where((F.col("segment_start") < last) & (F.col("segment_start") + F.col("n_ids") > first))

    def work(batches):
        schema = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for rows in batches:
            for start, data in zip(rows.column("segment_start").to_pylist(), rows.column("data")):
                yield batch(schema, [max(first, start)], [decode_range(data.as_py(), first - start, last - start).tolist()])

    return held.select("segment_start", "data").mapInArrow(work, "start long, ids array<long>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the file: ``doc_id``, ``start`` among all ids, ``n_tokens``, ``ids_crc32``."""
    segments = spark.read.schema(_SEGMENT).parquet(path)
    starts = _segment_starts(segments)
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches):
        for rows in batches:
            for part, segment, data in zip(*(rows.column(c) for c in ("part", "segment", "data"))):
                ids, counts, values = decode_segment(data.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(values.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                n = len(ids)
                yield batch(schema, [part.as_py()] * n, [segment.as_py()] * n, ids, ends - counts, counts, crcs)

    docs = segments.select("part", "segment", "data").mapInArrow(
        work, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    joined = docs.join(starts, ["part", "segment"])
    return joined.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
