"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact Jaccard similarity of word shingles decides.

Words are the lower-case runs between white space; a shingle is ``shingle`` successive words (all of them, if there are
fewer). Texts with the same words in the same order are a class, and only a representative of each class goes on: the row
with the largest id. Two classes are linked if the Jaccard similarity of their shingle sets is at least ``threshold``.

The forest has ``TREES`` tries over labels of ``DEPTH`` minima, each a sorted list: what shares a prefix stands together, and
the common prefix of neighbours tells the depth of their node. For each text the matched prefix is shortened from the full
depth until a partner at the least similarity that it can have reaches it in some trie with probability ``RECALL``
(``depths``): a text of n shingles can have few similarities when n is small, so short texts keep long prefixes, and no text
goes below ``prefix_depth``. Two texts are candidates if a trie holds them together at the longer of their two prefixes. In
each node a sketch of the whole signature (``SKETCH_BITS`` of every minimum) sorts out candidates that cannot have the
similarity but by a chance of ``MISS``; what is left is joined into clusters, and every pair of a cluster is verified.
Representatives that share no node (a sieve holds the nodes with two or more) never leave their scan task.

No pair is ever a row: nodes and clusters are dealt out as pairs of blocks of at most about ``NODE_BLOCK`` and ``BLOCK``
members, and a task gives back, for each member, one member it is connected to (and its number of links). Groups are the
connected components of links. Keys that hold many rows are broadcast (``hot_join``), so no join meets them in one task.

Defined cases: a null text counts as empty; texts without words are one class without links; ids may have any type that
can be compared, and a null id is smaller than any other; repeated rows are copies in a class; of equal ids the last in the
order of files and rows is meant; an empty table gives an empty result; other columns pass through ``dedup`` whatever their
names.
"""
from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import components
from .common import OWN, drop_rows, hot_join, materialise, probe, reserve, ship, sieve, with_row_id

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.999
SKETCH_BITS, MISS = 4, 1e-5
NODE_BLOCK = 4096
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
CHUNK_CHARS = 1 << 20
CACHE_WORDS = 1 << 16
BATCH_SHINGLES = 1 << 15

_RID = OWN + "rid"


@functools.cache
def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold shares a node of some tree with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


@functools.lru_cache(1 << 16)
def least_similarity(n: int, threshold: float = THRESHOLD) -> float:
    """The least similarity, not below the threshold, that a set of ``n`` elements can have with any other set."""
    if n > 4096:
        return threshold
    first = math.ceil(threshold * n - 1e-9)
    return min(i / math.floor(i / threshold + 1e-9) for i in range(max(1, first), n + 1))


def depths(sizes: list[int], threshold: float) -> list[int]:
    """For texts of so many shingles the length of the prefix at which their recall is met."""
    return [prefix_depth(least_similarity(n, threshold)) if n else DEPTH for n in sizes]


@functools.cache
def least_agreement(threshold: float, minima: int = TREES * DEPTH) -> int:
    """In how many minima a pair at the threshold agrees, in their last bits, at least, but for a chance of ``MISS``."""
    p = threshold + (1 - threshold) / (1 << SKETCH_BITS)
    missed = 0.0
    for k in range(minima + 1):
        missed += math.comb(minima, k) * p**k * (1 - p) ** (minima - k)
        if missed > MISS:
            return k
    return minima


def sketches(signature: np.ndarray) -> np.ndarray:
    """The last four bits of every minimum, two of them in a byte."""
    low = (signature & np.uint32((1 << SKETCH_BITS) - 1)).astype(np.uint8)
    return low[:, ::2] << np.uint8(SKETCH_BITS) | low[:, 1::2]


@functools.cache
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [xxhash.xxh64_intdigest(f"tessella-{i}") for i in range(2 * n)]
    return np.array(raw[:n], np.uint64) | np.uint64(1), np.array(raw[n:], np.uint64)


class Words:
    """Hashes of words, the frequent ones from a bounded cache."""

    def __init__(self):
        class Cache(dict):
            def __missing__(self, word: str) -> int:
                h = xxhash.xxh64_intdigest(word)
                if len(word) <= 64:
                    if len(self) >= CACHE_WORDS:
                        self.clear()
                    self[word] = h
                return h

        self.cache = Cache()

    def hashes(self, text: str) -> np.ndarray:
        out, at, n = [], 0, len(text)
        while at < n:
            end = min(n, at + CHUNK_CHARS)
            while end < n and not text[end].isspace():
                end += 1
            words = text[at:end].lower().split()
            out.append(np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


@functools.cache
def _words() -> Words:
    return Words()


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of shingles."""
    if not len(words):
        return words
    size = min(size, len(words))
    mult = _coefficients(64)[0][:size]
    mixed = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ words[i : len(words) - size + 1 + i]) * mult[i]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signatures(sets: list[np.ndarray], minima: int) -> np.ndarray:
    """Signatures of non-empty sets: for each of ``minima`` hash functions the least value."""
    a, b = _coefficients(minima)
    whole = np.concatenate(sets)
    begin = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), minima), np.uint32)
    for k in range(minima):
        out[:, k] = np.minimum.reduceat((whole * a[k] + b[k]) >> np.uint64(32), begin)
    return out


def _signed(batches: Iterator[pa.RecordBatch], size: int, minima: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """(rid, id, text) to (rid, id, class key, number of shingles, depth, signature, sketch)."""
    words = _words()
    for batch in batches:
        kind = batch.column(1).type
        schema = pa.schema([("rid", pa.int64()), ("id", kind), ("key", pa.binary()), ("n", pa.int32()), ("depth", pa.int32()), ("sig", pa.list_(pa.int32())), ("sketch", pa.binary())])
        keys: list[bytes] = []
        sets: list[np.ndarray] = []
        begin = total = 0

        def flush(end: int) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            made = signatures(full, minima) if full else np.zeros((0, minima), np.uint32)
            rows, short = iter(made.view(np.int32)), iter(sketches(made))
            sig, sketch = zip(*((next(rows), next(short).tobytes()) if len(s) else (None, None) for s in sets))
            sizes = [len(s) for s in sets]
            made = [batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), keys, sizes, depths(sizes, threshold), sig, sketch]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, schema.types)], schema=schema)

        for k, text in enumerate(batch.column(2)):
            h = words.hashes(text.as_py() or "")
            sets.append(shingles(h, size))
            keys.append(hashlib.md5(h.tobytes()).digest())
            total += len(sets[-1])
            if total >= BATCH_SHINGLES or len(keys) >= 1000:
                yield flush(k + 1)
                keys, sets = [], []
                begin, total = k + 1, 0
        if keys:
            yield flush(batch.num_rows)


def _runs(rest: np.ndarray) -> np.ndarray:
    """For sorted labels and every depth below the floor (0: at it) the number of each row's node."""
    same = np.ones((len(rest) - 1, rest.shape[1] + 1), bool)
    same[:, 1:] = np.logical_and.accumulate(rest[1:] == rest[:-1], axis=1)
    return np.concatenate([np.zeros((1, same.shape[1]), np.int64), np.cumsum(~same, axis=0)]).T


def joined(rest: np.ndarray, depth: np.ndarray, sketch: np.ndarray, left: np.ndarray, agreement: int) -> list[int]:
    """For each row of a sorted trie the first row it is connected to by candidates (itself: none); with rows on both
    sides only pairs across count. ``depth`` counts from the floor.

    A row that is reached leaves the list of those that are looked for, so dense nodes cost little more than their size.
    """
    m = len(rest)
    node, across = _runs(rest), left.any() and not left.all()
    nibbles = np.concatenate([sketch >> 4, sketch & 15], axis=1)
    root, open_ = np.full(m, -1), np.arange(m)
    for first in range(m):
        if root[first] >= 0:
            continue
        root[first] = first
        open_ = open_[open_ != first]
        work = [first]
        while work and len(open_):
            x = work.pop()
            # Candidates stand in one stretch of the sorted list: the node of x at its own depth.
            own = node[depth[x]]
            near = open_[np.searchsorted(own[open_], own[x]) : np.searchsorted(own[open_], own[x], "right")]
            near = near[node[depth[near], near] == node[depth[near], x]]
            if across:
                near = near[left[near] != left[x]]
            if not len(near):
                continue
            hit = near[(nibbles[near] == nibbles[x]).sum(1) >= agreement]
            root[hit] = first
            work += hit.tolist()
            open_ = open_[root[open_] < 0]
    return root.tolist()


def _trie_edges(batches: Iterator[pa.RecordBatch], floor: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, i, j, block, rid, depth, rest, sketch) sorted by (node, i, j, rest): edges (a, b) that connect candidates."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = least_agreement(threshold)
    held: list[pa.RecordBatch] = []
    key = None

    def done() -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        m = whole.num_rows
        if m < 2:
            return None
        block = whole.column(3).to_numpy()
        left = block == key[1]
        if key[1] != key[2] and (left.all() or not left.any()):
            return None
        rest = whole.column(6).flatten().to_numpy().reshape(m, DEPTH - floor)
        sketch = np.frombuffer(b"".join(whole.column(7).to_pylist()), np.uint8).reshape(m, -1)
        root = np.array(joined(rest, whole.column(5).to_numpy() - floor, sketch, left, least))
        some = np.flatnonzero(root != np.arange(m))
        rid = whole.column(4).to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(rid[root[some]])], schema=schema) if len(some) else None

    for batch in batches:
        ids = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        out = []
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            this = tuple(ids[x].tolist())
            if this != key:
                if held and (made := done()):
                    out.append(made)
                held, key = [], this
            held.append(batch.slice(x, y - x))
        yield from out
    if held and (made := done()):
        yield made


def _with_shingles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(rid, root, blocks, text) to (rid, root, blocks, shingles)."""
    schema = pa.schema([("rid", pa.int64()), ("root", pa.int64()), ("blocks", pa.int32()), ("shingles", pa.list_(pa.int64()))])
    words = _words()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(words.hashes(t.as_py() or ""), size).view(np.int64) for t in part.column(3)]
            yield pa.RecordBatch.from_arrays([*(part.column(k).cast(schema.types[k]) for k in range(3)), pa.array(sets, schema.types[3])], schema=schema)


def linked(sets: list[np.ndarray], left: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have the similarity; with members on both sides only pairs across count."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    across = left.any() and not left.all()
    shared = np.zeros((m, m), np.float32)
    if m <= 4:
        for i in range(m):
            for j in range(i + 1, m):
                shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        whole = np.concatenate(sets)
        owner = np.repeat(np.arange(m), size)
        order = np.argsort(whole, kind="stable")
        whole, owner = whole[order], owner[order]
        new = np.append(True, whole[1:] != whole[:-1])
        column = np.cumsum(new) - 1
        often = np.bincount(column) > 1
        owner, column = owner[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
        width = max(1, min(8192, (1 << 23) // m))
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1, width))
        for a, b in zip(edges, [*edges[1:], len(column)]):
            held = np.zeros((m, width), np.float32)
            held[owner[a:b], column[a:b] - column[a]] = 1
            if across:
                shared[np.ix_(left, ~left)] += held[left] @ held[~left].T
            else:
                shared += held @ held.T
    union = size[:, None] + size[None, :] - shared
    out = (shared >= threshold * union - 1e-6) & (shared > 0)
    if across:
        out &= left[:, None] & ~left[None, :]
        out |= out.T
    np.fill_diagonal(out, False)
    return out


def _roots(link: np.ndarray, names: list[int]) -> list[int]:
    """For each member the least name of its component."""
    m = len(names)
    root = [-1] * m
    for first in sorted(range(m), key=names.__getitem__):
        if root[first] >= 0:
            continue
        work = [first]
        root[first] = first
        while work:
            for j in np.flatnonzero(link[work.pop()]).tolist():
                if root[j] < 0:
                    root[j] = first
                    work.append(j)
    return [names[r] for r in root]


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (root, i, j, block, rid, shingles) sorted by (root, i, j): for each task and member with links (rid, links, to)."""
    schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
    key, members, out = None, [], []

    def done():
        names = [m[0] for m in members]
        left = np.array([m[1] == key[1] for m in members])
        if key[1] != key[2] and (left.all() or not left.any()):
            return  # one of two blocks is empty, and pairs within the other are another task's
        link = linked([m[2] for m in members], left, threshold)
        for name, n, to in zip(names, link.sum(1).tolist(), _roots(link, names)):
            if n:
                out.append((name, n, to))

    for batch in batches:
        sets = batch.column(5)
        for r, (root, i, j, block, rid) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
            if (root, i, j) != key:
                if len(members) > 1:
                    done()
                key, members = (root, i, j), []
            members.append((rid, block, sets[r].values.to_numpy()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)
            out.clear()
    if len(members) > 1:
        done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)


def _representatives(rows: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their signature, the classes, and one row with its signature for each class with a word."""
    kind = rows.schema["id"].dataType.simpleString()
    run = lambda it: _signed(it, size, TREES * DEPTH, threshold)
    signed = rows.select("rid", "id", "text").mapInArrow(run, f"rid long, id {kind}, key binary, n int, depth int, sig array<int>, sketch binary")
    signed = materialise(signed, "signatures")
    best = signed.groupBy("key").agg(F.max(F.struct("id", "rid")).alias("best"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(best.select("key", F.col("best.id").alias("class_id"), F.col("best.rid").alias("rep"), "copies"), "classes")
    # Signatures of texts without a copy stay where they are; of the others the representatives are picked by a join.
    several = classes.where("copies > 1").select(F.xxhash64("key").alias("k"), "rep")
    seen = probe(signed.where("n > 0").select("rid", "n", "depth", "sig", "sketch", F.xxhash64("key").alias("k")), F.col("k"), sieve(several.select("k"), "k", "classes-sieve"), OWN + "hit")
    held = seen.where(OWN + "hit")
    picked = held.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    return signed, classes, seen.where(f"not {OWN}hit").unionByName(picked).drop("k", OWN + "hit")


def _clusters(reps: DataFrame, threshold: float) -> DataFrame:
    """(rid, root, blocks) of the representatives that are candidates for another."""
    floor = prefix_depth(threshold)
    label = f"'node', xxhash64(t, slice(sig, t * {DEPTH} + 1, {floor})), 'rest', slice(sig, t * {DEPTH} + {floor + 1}, {DEPTH - floor})"
    nodes = reps.select("rid", "depth", "sketch", F.inline(F.expr(f"transform(sequence(0, {TREES - 1}), t -> named_struct({label}))")))
    several = materialise(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "nodes")
    held = probe(nodes, F.col("node"), sieve(several, "node", "nodes-sieve"), OWN + "hit").where(OWN + "hit").drop(OWN + "hit")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Only nodes of more than one block are known by their size; they are few, at most a row for every NODE_BLOCK rows.
    large = several.where(f"c > {NODE_BLOCK}").select("node", F.expr(f"cast(ceil(c / {NODE_BLOCK}) as int)").alias("blocks"))
    dealt = held.join(large, "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(rid, node), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.selectExpr("node", "least(block, other) as i", "greatest(block, other) as j", "block", "rid", "depth", "rest", "sketch")
    tries = dealt.repartition(n, "node", "i", "j").sortWithinPartitions("node", "i", "j", "rest")
    edges = materialise(tries.mapInArrow(lambda it: _trie_edges(it, floor, threshold), "a long, b long").distinct(), "candidates")
    member = materialise(components(edges).withColumnRenamed("node", "rid").join(reps.select("rid", "n"), "rid"), "clusters")
    blocks = member.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return materialise(hot_join(member, materialise(blocks, "blocks"), "root", "members").select("rid", "root", "blocks"), "members")


def _links(rows: DataFrame, member: DataFrame, size: int, threshold: float) -> DataFrame:
    """(rid, links, to) for each member and task in which it has links."""
    found = probe(rows.select("rid", "text"), F.xxhash64("rid"), sieve(member.select(F.xxhash64("rid").alias("k")), "k", "members-sieve"), OWN + "hit")
    texts = found.where(OWN + "hit").select("rid", "text").join(member, "rid").select("rid", "root", "blocks", "text")
    sets = texts.mapInArrow(lambda it: _with_shingles(it, size), "rid long, root long, blocks int, shingles array<long>")
    sets = sets.withColumn("block", F.expr("cast(pmod(xxhash64(rid, root), blocks) as int)"))
    dealt = sets.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.selectExpr("root", "least(block, other) as i", "greatest(block, other) as j", "block", "rid", "shingles")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = dealt.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return materialise(tasks.mapInArrow(lambda it: _verified(it, threshold), "rid long, links long, to long"), "links")


def _decide(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """rows (rid, id, text) to (rid, id, class_id, copies, n_links, group_id, group_rid)."""
    ship(rows.sparkSession)
    signed, classes, reps = _representatives(rows, size, threshold)
    links = _links(rows, _clusters(reps, threshold), size, threshold)
    counted = links.groupBy("rid").agg(F.sum("links").alias("n_links"))
    group = components(links.selectExpr("rid as a", "to as b")).withColumnRenamed("node", "rid")
    named = materialise(group.join(classes.select(F.col("rep").alias("rid"), "class_id"), "rid"), "groups")
    best = materialise(named.groupBy("root").agg(F.max(F.struct("class_id", "rid")).alias("best"), F.count(F.lit(1)).alias("members")), "group-heads")
    grouped = hot_join(named, best, "root", "members").join(counted, "rid").select(F.col("rid").alias("rep"), "n_links", F.col("best.class_id").alias("group_id"), F.col("best.rid").alias("group_rid"))
    # What is known of a class is put together first: one row a class, so rows meet it in one join.
    told = classes.join(grouped, "rep", "left").select(
        "key",
        "class_id",
        "copies",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("group_rid").isNull(), F.col("class_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce("group_rid", "rep").alias("group_rid"),
    )
    return hot_join(signed.select("rid", "id", "key"), materialise(told, "decided"), "key", "copies").drop("key")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id (id of the class's representative), copies (rows in the class), n_links
    (linked classes), group_id (largest id among all rows connected by copies and links), kept (one row of each group)."""
    rows = with_row_id(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rid")
    return _decide(rows, shingle, threshold).select(F.col("id").alias("doc_id"), "class_id", "copies", "n_links", "group_id", (F.col("rid") == F.col("group_rid")).alias("kept"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The input rows, with their columns, one of each group."""
    rows = with_row_id(reserve(df))
    decided = _decide(rows.select(F.col(_RID).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, threshold)
    losers = materialise(decided.where("rid <> group_rid").select(F.col("rid").alias(_RID)), "losers")
    return drop_rows(rows, _RID, losers, "losers-sieve").select(*df.columns)
