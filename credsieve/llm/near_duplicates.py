"""Near-duplicate documents by a chosen-path similarity join.

A document's set is its distinct shingles of five words, lower-cased in A-Z; equal sets
are one class from the start.  Each class has a signature of minwise hashes.  In every one
of several trees a node chooses one or two minwise functions, 1 / 0.75 in the mean, and
its classes go down to the children named by their own value under each.  Below the first
depth that is looked at a node, which only goes down if it is too large, chooses two, so
that a pair at the threshold has in the mean 1.5 times as many common nodes at each
level and is lost hardly more often however deep the nodes of a large group lie.  All
trees draw on the same functions: a pair whose signatures agree less than its sets is
missed more often in all of them.  At a similarity of 0.75 that makes 0.1 % missed
where nodes are small at once, and 0.3 % at the last depth.  Nodes of one class end; the
others are compared:

* a few rounds first join groups of copies of any size by few comparisons: in each node
  all that are outside its largest group meet two members of that group, and of what
  its members met, each group tries the pair whose signatures agree most;
* then each node that still holds several groups is compared exhaustively if it is small,
  by the full sets of all its classes at once, and gives as few links as join the groups
  that links join, at most a row for each; a larger one chooses again and goes one level
  deeper.  At the last level all outside a node's largest group meet all the rest
  whatever its size, so no pair of a common node is left out.

Signatures only say where classes go and spare comparisons that cannot succeed; a link is
confirmed on the full sets.  Components are made of links by distributed steps.

Null text, or text without words, has an empty set: no links, a component of its own.
With fewer words than a shingle the whole sequence is the only one.  Rows with equal ids
are rows of their own; null ids are never the least id of a component that has another.
Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import batch, let_go, row_join, row_slices, sized, texts_of
from credsieve.llm.components import components
from credsieve.session import settled

SHINGLE = 5
SIMILARITY_PERCENT = 75
FUNCTIONS = 64
#: Agreeing functions, of 64, below which a pair at the threshold is not expected (1 in 2000).
LEAST_AGREEING = 36
TREES = 12
FIRST_DEPTH = 4
LAST_DEPTH = 10
#: Rounds in which each group tries its most promising partner.
ROUNDS = 2
#: Classes of a node beyond which it goes a level deeper.
NODE_CLASSES = 16_384
#: Shingles of all its classes beyond which it does, too, unless it has few classes.
NODE_SHINGLES = 1 << 21
FEW_CLASSES = 8

_CHUNK = 8192
_U64 = np.uint64
_LAST = _U64(FUNCTIONS - 1)


def _constants(seed: int, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}/{i}".encode()) | 1 for i in range(n)], _U64)


_PLACES = _constants(1, SHINGLE + 1)
_MULTIPLY, _ADD = _constants(2, FUNCTIONS), _constants(3, FUNCTIONS)
_STEP = _constants(4, 3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _STEP[0]
    x = (x ^ (x >> _U64(29))) * _STEP[1]
    return x ^ (x >> _U64(32))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The set of a text, as sorted 64-bit hashes."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, _U64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    total = np.full(count, _PLACES[SHINGLE], _U64) * _U64(size)
    for i in range(size):
        total += hashes[i : i + count] * _PLACES[i]
    return np.unique(_mixed(total))


def signature(own: np.ndarray) -> np.ndarray:
    """16 bits of the least hash under each function."""
    least = np.full(FUNCTIONS, np.iinfo(_U64).max, _U64)
    for at in range(0, len(own), _CHUNK):
        np.minimum(least, (own[at : at + _CHUNK, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return _mixed(least).astype(np.uint16)


def _children(keys: np.ndarray, rows: np.ndarray, signatures: np.ndarray, twice: bool = False):
    """Next nodes, chosen by the node alone, alike for all in it; all by two functions if ``twice``.

    The last six bits of a node's key are the function that led to it.
    """
    out = []
    for branch in (0, 1):
        at = slice(None) if branch == 0 or twice else _mixed(keys ^ _STEP[2]) % _U64(3) == 0
        key, row = keys[at], rows[at]
        pick = _mixed(key + _U64(1)) % _U64(FUNCTIONS - 1)
        if branch == 1:
            pick = (pick + _U64(1) + _mixed(key + _U64(2)) % _U64(FUNCTIONS - 2)) % _U64(FUNCTIONS - 1)
        chosen = (key + _U64(1) + pick) & _LAST
        value = signatures[row, chosen.astype(np.int64)].astype(_U64)
        out.append(((_mixed(key * _STEP[0] + (value << _U64(8)) + chosen) & ~_LAST) | chosen, row))
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), FUNCTIONS)


_NODES = "node long, cid binary, size long"
_NODE_SCHEMA = pa.schema([("node", pa.int64()), ("cid", pa.binary()), ("size", pa.int64())])


def _roots(batches):
    """Each class at the first depth that is looked at, in all trees."""
    for rows in batches:
        found = _matrix(rows.column("sig"))
        n = len(found)
        keys, own = np.repeat(_constants(5, TREES), n), np.tile(np.arange(n), TREES)
        for _ in range(FIRST_DEPTH):
            keys, own = _children(keys, own, found)
        own = pa.array(own)
        yield batch(_NODE_SCHEMA, keys.view(np.int64), rows.column("cid").take(own), rows.column("size").take(own))


def _deeper(batches):
    for rows in batches:
        found = _matrix(rows.column("sig"))
        keys = rows.column("node").to_numpy(zero_copy_only=False).view(_U64)
        keys, own = _children(keys, np.arange(len(found)), found, twice=True)
        own = pa.array(own)
        yield batch(_NODE_SCHEMA, keys.view(np.int64), rows.column("cid").take(own), rows.column("size").take(own))


_SKETCHES = "doc_id long, text_key long, n_shingles long, cid binary, sig binary"
_SKETCH_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("cid", pa.binary()), ("sig", pa.binary())]
)


def _class(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _sketch(batches):
    let_go()
    for rows, texts in row_slices(batches):
        sets = [shingles(t) for t in texts]
        yield batch(
            _SKETCH_SCHEMA, rows.column("doc_id"), rows.column("text_key"), [len(s) for s in sets],
            [_class(s) for s in sets], [signature(s).tobytes() if len(s) else None for s in sets],
        )


def _agreeing(left, right):
    return F.pandas_udf(lambda a, b: _count_equal(a, b), "int")(left, right)


def _count_equal(a, b):
    import pandas as pd

    one, two = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, FUNCTIONS) for x in (a, b))
    return pd.Series((one == two).sum(axis=1).astype(np.int32))


@lru_cache(maxsize=64)
def _set_of(text: str) -> np.ndarray:
    return shingles(text)


def linked(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY_PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(batches):
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])
    for rows in batches:
        kept = []
        for i, (a, b) in enumerate(zip(rows.column("text_a"), rows.column("text_b"))):
            # Pairs arrive by their first text, so that its set is at hand for all of them.
            if linked(_set_of(a.as_py()), shingles(b.as_py())):
                kept.append(i)
        at = pa.array(kept, pa.int64())
        yield batch(schema, rows.column("of_a").take(at), rows.column("of_b").take(at))


def _agreement(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose signatures agree as often as a link's would, with how often."""
    first = classes.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a"))
    second = classes.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b"))
    seen = pairs.join(first, "a").join(second, "b").withColumn("agreeing", _agreeing("sig_a", "sig_b"))
    return seen.where(F.col("agreeing") >= LEAST_AGREEING).drop("sig_a", "sig_b")


def _texts_of(wanted: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(``cid``, ``text``) of the classes in ``wanted``; of the texts only theirs are read again."""
    first = settled(wanted.join(classes, "cid").select("cid", "first.doc_id", "first.text_key"))
    keyed = sized(first.withColumnsRenamed({"doc_id": "id", "text_key": "key"}))
    met = rows.join(keyed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    return met.groupBy("cid").agg(F.first("text").alias("text"))


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (u, v) between the groups of_a and of_b of pairs (a, b) that hold on full sets."""
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    texts = settled(_texts_of(ends, classes, rows))
    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "of_a", "of_b", "text_a", "text_b")
    return both.mapInArrow(_confirm, "u binary, v binary").distinct()


def _shared(nodes: DataFrame) -> DataFrame:
    """Rows of nodes that more than one class is in."""
    held = nodes.groupBy("node").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least <> most")
    return nodes.join(held.select("node"), "node")


def _open(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of nodes that hold several groups, with their group, the node's largest and two of its members."""
    grouped = nodes.withColumn("group", F.col("cid"))
    if labels is not None:
        named = labels.withColumnsRenamed({"u": "cid", "component": "label"})
        grouped = nodes.join(named, "cid", "left").select("node", "cid", "size", F.coalesce("label", "cid").alias("group"))
    sizes = grouped.groupBy("node", "group").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.min("cid").alias("low"), F.max("cid").alias("high")
    )
    state = sizes.groupBy("node").agg(
        F.sum("n").alias("n"), F.sum("size").alias("shingles"), F.max(F.struct("n", "group", "low", "high")).alias("top"), F.count("*").alias("groups")
    )
    state = state.where("groups > 1").select("node", F.col("top.group").alias("largest"), "top.low", "top.high", "n", "shingles")
    return settled(grouped.join(state, "node"))


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (u, component) after links between groups."""
    step = components(links)
    if labels is None:
        return step
    moved = step.withColumnsRenamed({"u": "from", "component": "to"})
    old = labels.join(moved, F.col("component") == F.col("from"), "left")
    return settled(old.select("u", F.coalesce("to", "component").alias("component")).union(step))


def _promising(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """For each group the pair, with the largest group of a node, whose signatures agree most."""
    outside = rows.where("`group` <> largest")
    met = outside.select(
        F.col("cid").alias("b"), F.col("group").alias("of_b"), F.col("largest").alias("of_a"), F.explode(F.array("low", "high")).alias("a")
    ).distinct()
    best = _agreement(met, classes).groupBy("of_b").agg(F.max(F.struct("agreeing", "a", "b", "of_a")).alias("best"))
    return best.select("best.a", "best.b", "best.of_a", "of_b")


_LINK_SCHEMA = pa.schema([("u", pa.binary()), ("v", pa.binary())])
_SET_SCHEMA = pa.schema([("cid", pa.binary()), ("set", pa.binary())])


def _sets(batches):
    for rows, texts in row_slices(batches):
        yield batch(_SET_SCHEMA, rows.column("cid"), [shingles(t).tobytes() for t in texts])


def spanning_links(sets: list[np.ndarray], groups: list, percent: int = SIMILARITY_PERCENT) -> list[tuple[int, int]]:
    """Links between members of different groups, as few as join all groups that links join.

    Exact: of two linked sets each holds the other's share in all but a few of its own members,
    so that among as many of its rarest members and one more there is one they have in common.
    Only sets that share such a member are compared, and none whose groups are joined already.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    names = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    root = np.array([names[g] for g in groups])
    members, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Members are numbered from the rarest on, and each set's are in that order.
    order = np.argsort(held, kind="stable")
    number = np.empty(len(members), np.int64)
    number[order] = np.arange(len(members))
    row = np.repeat(np.arange(n), size)
    own = number[column]
    own = own[np.lexsort((own, row))]
    first = np.concatenate(([0], np.cumsum(size)))
    rarest = size - -(-percent * size // 100) + 1
    early = np.arange(len(own)) - first[row] < rarest[row]
    at = np.flatnonzero(early & (held[order][own] > 1))
    at = at[np.argsort(own[at], kind="stable")]
    token, holder = own[at], row[at]
    if not len(at):
        return []
    # Members that one group alone holds join nothing.
    starts = np.flatnonzero(np.diff(token, prepend=-1))
    mixed = np.minimum.reduceat(root[holder], starts) != np.maximum.reduceat(root[holder], starts)
    kept = np.repeat(mixed, np.diff([*starts, len(token)]))
    token, holder = token[kept], holder[kept]
    starts = np.concatenate((np.flatnonzero(np.diff(token, prepend=-1)), [len(token)]))
    run_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    by_set = np.argsort(holder, kind="stable")
    of_set = np.searchsorted(holder[by_set], np.arange(n + 1))
    there = np.zeros(len(members), bool)
    out = []
    for i in np.unique(holder).tolist():
        runs = run_of[by_set[of_set[i] : of_set[i + 1]]]
        near = np.unique(np.concatenate([holder[starts[r] : starts[r + 1]] for r in runs.tolist()]))
        near = near[(near < i) & (root[near] != root[i])]
        near = near[100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])]
        if not len(near):
            continue
        mine = own[first[i] : first[i + 1]]
        there[mine] = True
        lengths = size[near]
        begins = np.cumsum(lengths) - lengths
        cells = np.repeat(first[near] - begins, lengths) + np.arange(lengths.sum())
        common = np.add.reduceat(there[own[cells]].astype(np.int64), begins)
        there[mine] = False
        for j in near[100 * common >= percent * (size[i] + lengths - common)].tolist():
            if root[j] != root[i]:
                out.append((j, i))
                root[root == root[j]] = root[i]
    return out


def _exhaustive(batches):
    """Links between the groups of each node's list of classes: a row fewer than it has groups, or less."""
    for rows in batches:
        out = []
        for held in rows.column("held"):
            held = held.as_py()
            groups = [h["group"] for h in held]
            for a, b in spanning_links([np.frombuffer(h["set"], _U64) for h in held], groups):
                out.append(tuple(sorted((groups[a], groups[b]))))
        yield batch(_LINK_SCHEMA, *zip(*set(out))) if out else batch(_LINK_SCHEMA, [], [])


def _remaining(nodes: DataFrame, classes: DataFrame, labels: DataFrame | None, texts: DataFrame) -> DataFrame:
    """Links (u, v) between different groups that share a node, over all depths."""
    found, sets = None, None
    for depth in range(FIRST_DEPTH, LAST_DEPTH + 1):
        rows = _open(nodes, labels)
        if sets is None:
            wanted = rows.select("cid").distinct()
            sets = settled(_texts_of(wanted, classes, texts).mapInArrow(_sets, "cid binary, set binary"))
        small = (F.col("n") <= NODE_CLASSES) & ((F.col("shingles") <= NODE_SHINGLES) | (F.col("n") <= FEW_CLASSES))
        # Each list holds at most NODE_SHINGLES hashes of eight bytes, or FEW_CLASSES sets.
        lists = rows.where(small).join(sets, "cid").groupBy("node").agg(F.collect_list(F.struct("group", "set")).alias("held"))
        likely = lists.select("held").mapInArrow(_exhaustive, "u binary, v binary").distinct()
        found = settled(likely if found is None else found.union(likely))
        deep = rows.where(~small).join(classes.select("cid", "sig"), "cid")
        if depth == LAST_DEPTH:
            return found.union(_confirmed(settled(_last(deep, classes)), classes, texts)).distinct()
        down = settled(deep.select("node", "cid", "size", "sig").mapInArrow(_deeper, _NODES))
        if down.isEmpty():
            return found
        nodes = settled(_shared(down))


def _last(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of different groups of nodes that stayed large, by joins without lists."""
    outside = rows.where("`group` <> largest").select("node", F.col("cid").alias("x"), F.col("group").alias("of_x"))
    rest = rows.select("node", F.col("cid").alias("y"), F.col("group").alias("of_y"), "largest")
    met = outside.join(rest, "node").where("of_x <> of_y and (of_y = largest or x < y)")
    pairs = met.select(F.col("y").alias("a"), F.col("x").alias("b"), F.col("of_y").alias("of_a"), F.col("of_x").alias("of_b"))
    return _agreement(pairs.distinct(), classes).select("a", "b", "of_a", "of_b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key``, ``n_shingles``, ``component_id``, ``component``.

    ``text_key`` is ``xxhash64`` of the text; with the id it tells rows of one id apart.
    ``component`` names the component whatever the ids are.
    """
    rows = texts_of(docs).withColumn("text_key", F.xxhash64("text"))
    sketches = settled(rows.mapInArrow(_sketch, _SKETCHES))
    classes = settled(
        sketches.where("n_shingles > 0").groupBy("cid").agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size")
        )
    )
    nodes = settled(_shared(classes.select("cid", "sig", "size").mapInArrow(_roots, _NODES)))
    labels = None
    for _ in range(ROUNDS):
        still = _open(nodes, labels)
        links = settled(_confirmed(settled(_promising(still, classes)), classes, rows))
        if links.isEmpty():
            break
        labels, nodes = _relabelled(labels, links), still.select("node", "cid", "size")
    rest = settled(_remaining(nodes, classes, labels, rows))
    if not rest.isEmpty():
        labels = _relabelled(labels, rest)
    labels = (labels if labels is not None else classes.selectExpr("cid as u", "cid as component").where("false")).withColumnRenamed("u", "cid")
    named = sketches.drop("sig").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return named.join(least, "component", "left").select("doc_id", "text_key", "n_shingles", own.alias("component_id"), "component")


def kept_rows(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns.

    The least id of a component stays; of rows that repeat it, one.  Rows without words
    stay, except exact repetitions of id and text.
    """
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    wordless = F.when(F.col("n_shingles") == 0, F.col("text_key")).alias("wordless")
    single = own.groupBy("doc_id", "component", wordless).agg(F.min("text_key").alias("text_key"), F.count("*").alias("n"))
    names = ["doc_id", "text_key"]
    # Only what goes is looked up: most rows stay.
    stays = single.where("n = 1").select(*names)
    gone = found.select(*names).distinct().join(
        stays.withColumnsRenamed({"doc_id": "id", "text_key": "key"}),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_anti",
    )
    gone, again = settled(gone), settled(single.where("n > 1").select(*names))
    kept = row_join(docs, gone.union(again), "left_anti", key, text)[0].select(*docs.columns)
    if again.isEmpty():
        return kept
    # Rows that repeat both id and text of one that stays.
    met, prefix = row_join(docs, again, "inner", key, text)
    return kept.union(met.dropDuplicates([prefix + "doc_id", prefix + "text_key"]).select(*docs.columns))
