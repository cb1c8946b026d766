"""The finding store: verified history of findings with their vectors.

A stored store lies in buckets by the first binary digits of its rows' ids.  A bucket that
grows over its limit in bytes is split on another digit, so a larger store has more buckets,
not larger ones.  Small buckets that are written together share a folder.  A version is a
manifest that names the folder of every bucket; it is published by one rename, so a reader sees all of a version or none, and a writer whose base
is not the newest version any more fails.  Older versions can be read until they are removed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions.identity import snippet_hash
from credsieve.functions.text import pin
from credsieve.session import released, settled

STORE_SCHEMA = (
    "id bigint, file_path string, line_number int, code_snippet string, embedding array<float>,"
    " pattern_type string, entropy double, confidence string, verified boolean, timestamp bigint"
)
KEY = ("file_path", "line_number", "pattern_type")
#: Bytes of rows beyond which a bucket of a stored store is split.
BUCKET_BYTES = 128 * 1024 * 1024
#: Bytes of rows that share a folder: buckets smaller than that lie together, so that a store has
#: as many files as its bytes need, however small its buckets are.
FOLDER_BYTES = 16 * 1024 * 1024
#: Binary digits of a row's place, the id that follows from its key.
PLACE_BITS = 60
#: Digits by which a bucket is split at a time, at most.
SPLIT_LEVELS = 8
_REST = ("id", "code_snippet", "embedding", "entropy", "confidence", "verified")


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORE_SCHEMA)


def store_id(line_number: str = "line_number", pattern_type: str = "pattern_type") -> str:
    """A row id that follows from the key, so that rewriting a row keeps it."""
    key = f"concat_ws('\\u0000', file_path, cast({line_number} as string), {pattern_type})"
    return f"cast(conv(substring(sha2({key}, 256), 1, 15), 16, 10) as bigint)"


def store_rows(
    findings: DataFrame, embedding: str, *, ephemeral: bool = False, timestamp: str | None = None, extra: Sequence[str] = ()
) -> DataFrame:
    """Findings as store rows: the line only as a hash, the vector as given; ``extra`` columns stay."""
    when = timestamp or "unix_timestamp(current_timestamp())"
    return findings.selectExpr(
        "file_path",
        "cast(line_no as int) as line_number",
        f"{snippet_hash('line', ephemeral=ephemeral)} as code_snippet",
        f"{embedding} as embedding",
        "pattern as pattern_type",
        "entropy",
        "confidence",
        "verified",
        f"cast({when} as bigint) as timestamp",
        *extra,
    ).selectExpr(f"{store_id()} as id", "*")


def content_tie(embedding: str, *, ephemeral: bool = False) -> str:
    """What ``upsert`` breaks ties of a finding's store row by."""
    key = store_id("cast(line_no as int)", "pattern")
    return f"xxhash64({key}, {snippet_hash('line', ephemeral=ephemeral)}, {embedding}, entropy, confidence, verified)"


def upsert(store: DataFrame, arriving: DataFrame, *, vectors: str | None = None) -> DataFrame:
    """Store with ``arriving`` rows replacing those of the same key; among arriving
    rows of one key the latest stays, ties by the greatest content.

    The winner is a maximum per key, combined before the shuffle.  With ``vectors``, SQL over
    ``_text``, arriving rows have that text and their ``_tie`` in place of a vector, which is
    far larger and made only for rows that stay.
    """
    tie = F.xxhash64(*_REST).alias("_tie")
    text = ["_text"] if vectors else []
    old = store.select("*", F.lit(0).alias("_new"), tie, *[F.lit(None).cast("string").alias(c) for c in text])
    new = arriving.withColumn("_new", F.lit(1)) if vectors else arriving.select("*", F.lit(1).alias("_new"), tie)
    last = (
        old.unionByName(new)
        .groupBy(*KEY)
        .agg(F.max_by(F.struct("timestamp", *_REST, *text), F.struct("_new", "timestamp", "_tie")).alias("_last"))
        .selectExpr(*KEY, "_last.*")
    )
    if vectors:
        last = pin(last.withColumnRenamed("embedding", "_given"), embedding=f"if(_text is null, _given, {vectors})")
    return last.select(*store.columns)


def mark_verified(store: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set ``verified`` from (``id``, ``verified``) verdicts; other rows keep theirs."""
    given = verdicts.groupBy("id").agg(F.max("verified").alias("_verified"))
    # Each id once on the right.
    return (
        store.join(given, "id", "left")
        .withColumn("verified", F.coalesce("_verified", "verified"))
        .select(*store.columns)
    )


class StoreChanged(RuntimeError):
    """Another writer published the version that was to be written."""


@dataclass(frozen=True)
class Bucket:
    """Rows whose place begins with ``bits``; ``folder`` is null where there are none.

    Small buckets share a folder, which was written with ``held`` rows; those of its buckets
    that have been written elsewhere since are not read.
    """

    bits: str
    folder: str | None = None
    rows: int = 0
    bytes: int = 0
    held: int = 0


@dataclass(frozen=True)
class Manifest:
    """A version of a store: its buckets, which cover every place once, and the last batch of each stream."""

    version: int = 0
    buckets: tuple[Bucket, ...] = (Bucket(""),)
    batches: tuple[tuple[str, int], ...] = ()

    @property
    def depth(self) -> int:
        return max(len(b.bits) for b in self.buckets)


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest version of a store, or the one asked for; an empty one where there is none."""
    known = store_versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"{path} has no version {version}")
    if not known:
        return Manifest()
    file, fs = _folder(spark, f"{path}/manifests/{version or known[-1]:010d}.json")
    stream = fs.open(file)
    try:
        held = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(held["version"], tuple(Bucket(**b) for b in held["buckets"]), tuple((n, i) for n, i in held["batches"]))


def store_versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions that are still kept, oldest first."""
    return [int(n[:10]) for n in _names(spark, f"{path}/manifests") if re.fullmatch(r"\d{10}\.json", n)]


def _publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make a version visible, all of it at once, unless there is one of its number."""
    jvm, name = spark.sparkContext._jvm, f"{path}/manifests/{manifest.version:010d}.json"
    unfinished, fs = _folder(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(unfinished, False)
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(name)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        # Without an option to overwrite, a name that is taken is an error.
        context.rename(fs.makeQualified(unfinished), fs.makeQualified(final), options)
    except Py4JJavaError as error:
        fs.delete(unfinished, False)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            raise StoreChanged(f"version {manifest.version} of {path} was written meanwhile") from None
        raise


def read_store(spark: SparkSession, path: str, *, version: int | None = None) -> DataFrame:
    """A version of the store below ``path``, the newest unless asked for another."""
    return _read(spark, path, read_manifest(spark, path, version).buckets)


def _read(spark: SparkSession, path: str, buckets: Iterable[Bucket]) -> DataFrame:
    """The rows of the buckets alone, whatever else lies in their folders."""
    wanted: dict[str, list[Bucket]] = {}
    for b in buckets:
        if b.folder:
            wanted.setdefault(b.folder, []).append(b)
    if not wanted:
        return empty_store(spark)
    whole = {f for f, held in wanted.items() if sum(b.rows for b in held) == (held[0].held or held[0].rows)}
    part = [b for f, held in wanted.items() if f not in whole for b in held]
    frames = [spark.read.schema(STORE_SCHEMA).parquet(*[f"{path}/{f}" for f in sorted(whole)])] if whole else []
    if part:
        rows = spark.read.schema(STORE_SCHEMA).parquet(*[f"{path}/{f}" for f in sorted(wanted.keys() - whole)])
        write = F.regexp_extract("_metadata.file_path", ".*/data/([^/]+)/bits=", 1).alias("_write")
        listed = [(b.bits, b.folder.split("/")[1]) for b in part]
        directory = spark.createDataFrame(listed, "_bits string, _write string")
        held = rows.select("*", write).select("*", _tried(b.bits for b in part)).join(F.broadcast(directory), ["_bits", "_write"])
        frames.append(held.select(*rows.columns))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def _bits(ids: str = "id") -> str:
    """A row's place: its id as 60 binary digits."""
    return f"lpad(bin({ids}), {PLACE_BITS}, '0')"


def _tried(bits: Iterable[str]) -> Column:
    """A row's place, cut at each number of digits that the buckets have."""
    return F.explode(F.array(*[F.expr(f"substring({_bits()}, 1, {d})") for d in sorted({len(b) for b in bits})])).alias("_bits")


def _placed(rows: DataFrame, buckets: Iterable[Bucket]) -> DataFrame:
    """Rows with ``_bits``, the bucket that their place begins with.

    The directory lists each bucket once, by how many digits it takes and which; a row looks
    itself up at every number of digits in use.  There is one entry for each bucket, some tens of
    bytes, which the manifest held by the driver has too: it is sent to the rows, not they to it.
    """
    listed = sorted({b.bits for b in buckets})
    if listed == [""]:
        return rows.withColumn("_bits", F.lit(""))
    directory = rows.sparkSession.createDataFrame([(b,) for b in listed], "_bits string")
    return rows.select("*", _tried(listed)).join(F.broadcast(directory), "_bits")


def _row_bytes() -> Column:
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("file_path", "code_snippet", "pattern_type", "confidence")]
    return sum(texts, F.lit(40)) + 4 * F.greatest(F.size("embedding"), F.lit(0))


def _levels(bits: str, size: int, bucket_bytes: int) -> int:
    """The digits by which a bucket is split at a time."""
    wanted = (-(-size // max(1, bucket_bytes)) - 1).bit_length() + 1
    return min(SPLIT_LEVELS, wanted, PLACE_BITS - len(bits))


def _split(rows: DataFrame, sizes: dict[str, int], bucket_bytes: int) -> list[str]:
    """The buckets that ``sizes`` become when those over the limit are split, digit by digit."""
    sizes = dict(sizes)
    done = [b for b, n in sizes.items() if n <= bucket_bytes or len(b) >= PLACE_BITS]
    kept = set(done)
    large = [b for b in sizes if b not in kept]
    while large:
        # As many digits as the bytes ask for and one more, so that what reaches the driver grows with
        # the buckets that are made; a bucket whose rows lie unevenly goes another round.
        levels = {b: _levels(b, sizes[b], bucket_bytes) for b in large}
        finer = rows.join(rows.sparkSession.createDataFrame(list(levels.items()), "_bits string, levels int"), "_bits")
        part = F.expr(f"substring({_bits()}, 1, length(_bits) + levels)").alias("part")
        counted: dict[str, dict[str, int]] = {b: {} for b in large}
        for r in finer.groupBy("_bits", part).agg(F.sum(_row_bytes()).alias("n")).collect():
            # Each part counts for every place above it too.
            held = counted[r["_bits"]]
            for depth in range(len(r["_bits"]), len(r["part"]) + 1):
                held[r["part"][:depth]] = held.get(r["part"][:depth], 0) + r["n"]
        again = []
        for whole, held in counted.items():
            open_parts = [whole]
            while open_parts:
                bits = open_parts.pop()
                n = held.get(bits, 0)
                if n <= bucket_bytes or len(bits) >= PLACE_BITS:
                    done.append(bits)
                elif len(bits) - len(whole) == levels[whole]:
                    again.append(bits)
                    sizes[bits] = n
                else:
                    open_parts += [bits + "0", bits + "1"]
        if again:
            rows = _placed(rows.drop("_bits"), [Bucket(b) for b in [*done, *again]])
        large = again
    return sorted(done)


def _shared(counted: dict[str, tuple[int, int]], folder: str) -> tuple[dict[str, Bucket], dict[str, str]]:
    """Buckets by their place, given (rows, bytes), and which part of ``folder`` each is written to."""
    runs: list[list[str]] = []
    size = 0
    for bits in sorted(counted):
        if not runs or size + counted[bits][1] > FOLDER_BYTES:
            runs.append([])
            size = 0
        runs[-1].append(bits)
        size += counted[bits][1]
    buckets, names = {}, {}
    for run in runs:
        held = sum(counted[bits][0] for bits in run)
        for bits in run:
            names[bits] = f"b{run[0]}"
            buckets[bits] = Bucket(bits, f"{folder}/bits=b{run[0]}", *counted[bits], held)
    return buckets, names


def _spent(current: Manifest, touched: set[str]) -> set[str]:
    """The other buckets of folders of which less than half would still be read."""
    rest = [b for b in current.buckets if b.folder and b.bits not in touched]
    live: dict[str, int] = {}
    for b in rest:
        live[b.folder] = live.get(b.folder, 0) + b.rows
    return {b.bits for b in rest if 2 * live[b.folder] < b.held}


def _written(
    spark: SparkSession, path: str, base: Manifest, touched: Iterable[str], rows: DataFrame, bucket_bytes: int, batch: tuple[str, int] | None
) -> Manifest:
    """The version after ``base``, whose touched buckets hold ``rows`` (with ``_bits``) from now on."""
    rows, touched = settled(rows, small=True), set(touched)
    sizes = {r["_bits"]: r["n"] for r in rows.groupBy("_bits").agg(F.sum(_row_bytes()).alias("n")).collect()}
    parts = _split(rows, {b: sizes.get(b, 0) for b in touched}, bucket_bytes)
    folder = f"data/{base.version + 1:010d}-{uuid.uuid4().hex}"
    placed = _placed(rows.drop("_bits"), [Bucket(b) for b in parts]) if set(parts) != touched else rows
    counted = placed.groupBy("_bits").agg(F.count("*").alias("rows"), F.sum(_row_bytes()).alias("bytes")).collect()
    new, shared = _shared({r["_bits"]: (r["rows"], r["bytes"]) for r in counted}, folder)
    if shared:
        # A folder's name needs a value: the root's place is empty.
        names = spark.createDataFrame(list(shared.items()), "_bits string, bits string")
        named = placed.join(F.broadcast(names), "_bits").drop("_bits")
        dealt = named.repartition(len(set(shared.values())), "bits").sortWithinPartitions("bits")
        dealt.write.partitionBy("bits").parquet(f"{path}/{folder}")
    released(rows)
    buckets = [b for b in base.buckets if b.bits not in touched] + [new.get(b, Bucket(b)) for b in parts]
    batches = dict(base.batches) | (dict([batch]) if batch else {})
    made = Manifest(base.version + 1, tuple(sorted(buckets, key=lambda b: b.bits)), tuple(sorted(batches.items())))
    _publish(spark, path, made)
    return made


def upsert_stored(
    arriving: DataFrame, path: str, *, bucket_bytes: int = BUCKET_BYTES, base: int | None = None, batch: tuple[str, int] | None = None
) -> Manifest:
    """Upsert into the store at ``path`` and publish the next version, which is returned.

    Only buckets that arriving keys fall in are read and written, and what is left of a folder
    of which most has been written elsewhere; what grows over ``bucket_bytes`` is split, digit by digit of the place, until it fits.  ``base`` is the
    version the writer has seen (the newest by default): if another has been published since,
    that is ``StoreChanged`` and nothing changes.  ``batch``, a stream's name and the number of
    its batch, is written down, and a batch that was published before does nothing.
    """
    spark = arriving.sparkSession
    current = read_manifest(spark, path, base) if base else read_manifest(spark, path)
    if batch and dict(current.batches).get(batch[0], -1) >= batch[1]:
        return current
    rows = settled(_placed(arriving.withColumn("id", F.expr(store_id())), current.buckets), small=True)
    touched = {r["_bits"] for r in rows.select("_bits").distinct().collect()}
    if not touched:
        return current
    touched |= _spent(current, touched)
    before = _read(spark, path, [b for b in current.buckets if b.bits in touched])
    merged = upsert(before, rows.drop("_bits"))
    made = _written(spark, path, current, touched, _placed(merged, current.buckets), bucket_bytes, batch)
    released(rows)
    return made


def mark_stored(verdicts: DataFrame, path: str, *, base: int | None = None) -> Manifest:
    """``mark_verified`` on the store at ``path``: an id says which bucket it lies in, and only
    buckets in which a row changes are written."""
    spark = verdicts.sparkSession
    current = read_manifest(spark, path, base) if base else read_manifest(spark, path)
    given = settled(_placed(verdicts.select("id", "verified"), current.buckets), small=True)
    asked = {r["_bits"] for r in given.select("_bits").distinct().collect()}
    rows = _placed(_read(spark, path, [b for b in current.buckets if b.bits in asked]), current.buckets)
    marked = settled(
        mark_verified(rows.withColumn("_was", F.col("verified")), given.drop("_bits")), small=True
    )
    touched = {r["_bits"] for r in marked.where("not (verified <=> _was)").select("_bits").distinct().collect()}
    if not touched:
        return current
    chosen = F.broadcast(spark.createDataFrame([(b,) for b in sorted(touched)], "_bits string"))
    # Marks change no size: no bucket is split.
    made = _written(spark, path, current, touched, marked.join(chosen, "_bits", "left_semi").drop("_was"), 1 << 62, None)
    released(given, marked)
    return made


def remove_versions(spark: SparkSession, path: str, *, keep: int) -> None:
    """Remove all versions but the newest ``keep``, and the buckets that none of those has."""
    versions = store_versions(spark, path)
    used = {b.folder for v in versions[-keep:] for b in read_manifest(spark, path, v).buckets}
    for v in versions[:-keep]:
        _delete(spark, f"{path}/manifests/{v:010d}.json")
    newest = versions[-1] if versions else 0
    for write in _names(spark, f"{path}/data"):
        # What a writer has not published yet has a later number.
        if int(write[:10]) <= newest:
            held = [n for n in _names(spark, f"{path}/data/{write}") if n.startswith("bits=")]
            unused = [n for n in held if f"data/{write}/{n}" not in used]
            for name in [""] if len(unused) == len(held) else unused:
                _delete(spark, f"{path}/data/{write}/{name}".rstrip("/"))


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _delete(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots below ``path``."""
    numbers = [int(n.split("=", 1)[1]) for n in _names(spark, path) if n.startswith("snapshot=")]
    return sorted(n for n in numbers if "_SUCCESS" in _names(spark, f"{path}/snapshot={n}"))


def remove_snapshots(spark: SparkSession, path: str, *, keep: int) -> None:
    """Remove all but the newest ``keep`` complete snapshots."""
    for number in snapshots(spark, path)[:-keep]:
        _delete(spark, f"{path}/snapshot={number}")
