"""N-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles (a shorter text is one shingle of all its words). Texts
with equal sets are one class, and the join works on classes. Each class has a sketch: 64 shared
tokens, the set's least under 64 hash functions. A run starts with all classes in one node; a node
chooses one or two of the 64 places by a hash of its path, and each class goes on to the child named
by its own token at that place, so two sets of similarity ``s`` stay together with chance ``s`` at a
place, and some path of theirs goes on from level to level. Nodes of one class end there; nodes of at
most ``LEAF`` classes are compared by brute force; larger ones are split again, down to ``DEPTH``
levels, and what is still large then is compared in blocks, whole. ``RUNS`` runs bring the chance to
find a pair of similarity 0.8 to over 0.999 (``recall`` computes it).

A large group of near copies would hardly split. So a large node takes one of its least classes as a
center: the classes whose sketch agrees with it in ``BALL`` places form a ball, a leaf that is named by
that class alone and so is the same one for all nodes and runs that have it; and those that agree in
``INNER`` places leave the node. Whatever is similar to an inner class is near enough to the center to be
in its ball (distances obey the triangle inequality), so the node's pairs with it are compared there, once,
and only the rest is split.

A pair that meets in several leaves belongs to the least of them, so links are counted once without
listing them: leaves compare sketches first and name the classes with a likely partner; their texts
are fetched, and the exact similarity decides. A leaf gives each class's number of links and a tree
of edges for every group, not all pairs. Groups are the connected components of those edges, by
hooking trees to the least label next to them and halving their height, in a logarithmic number of
rounds; the trees have small degree, and joins on labels are broadcast up to a counted size or salted.

Null text counts as empty. Texts without words have the empty set; they are copies of each other.
Rows are told apart by id and text; equal ids with different texts are different documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_search.llm.common import fresh, no_nulls, ranges, text_bytes, utf8_parts, with_small, written

WORDS = 5
SIMILAR = 0.8
PLACES = 64
RUNS = 10
LEAF = 256
DEPTH = 6
#: Classes of a block of a leaf that is too large to be compared at once.
SIDE = 512
#: Places that agree with a large node's center: of its ball, and of the classes that need no other leaf of the node.
BALL, INNER = 28, 50
#: Classes of a large node that may be its center.
CENTERS = 8
#: A pair goes on to the exact comparison if so many places agree: 0.8 of 64 less over four deviations.
LIKELY = 37
NO_ID = (1 << 63) - 1
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of texts without nulls, sorted in each, and the n + 1 offsets."""
    raw, ends = text_bytes(texts)
    n = len(texts)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    before, after = np.append(True, space)[:-1], np.append(space, True)[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    stop = np.flatnonzero(~space & (after | edge[1:])) + 1
    factor = 0x9E3779B97F4A7C15
    power = np.cumprod(np.append(np.uint64(1), np.full(len(raw), factor, np.uint64)), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64))
    back = np.cumprod(np.append(np.uint64(1), np.full(len(raw), pow(factor, -1, 1 << 64), np.uint64)), dtype=np.uint64)
    word = _mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, ends)
    count = np.diff(first)
    many = np.where(count > 0, np.maximum(1, count - WORDS + 1), 0)
    at, doc = ranges(first[:-1], many), np.repeat(np.arange(n), many)
    h = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = at + k < first[doc + 1]
        h[inside] = _mix(h[inside] * _C1 + word[at[inside] + k])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])


def sketches(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least tokens (n x PLACES, uint32; empty sets have zeros) and a 16-byte key of each set."""
    n, size = len(ends) - 1, np.diff(ends)
    out, keys = np.zeros((n, PLACES), np.uint32), np.zeros((n, 2), np.uint64)
    has = np.flatnonzero(size > 0)
    if len(has):
        starts = ends[:-1][has]
        keys[has, 0] = np.add.reduceat(_mix(h + _C1), starts)
        keys[has, 1] = np.add.reduceat(_mix(h ^ _C3), starts)
        low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
        for k in range(PLACES):
            # two independent halves of the hash and odd factors give each place its own order
            x = (low * np.uint32(2 * k * 0x3C6EF35F + 0x9E3779B1 & 0xFFFFFFFF) + high * np.uint32((k + 1) * 0x85EBCA6B & 0xFFFFFFFF | 1)) ^ np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            out[has, k] = np.minimum.reduceat(x, starts)
    return out, keys


def children(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child paths: each node (a path) chooses one place, and every fourth node a second one."""
    choice = _mix(path + _C1)
    one = (choice % np.uint64(PLACES)).astype(np.int64)
    two = (one + 1 + (choice >> np.uint64(32)).astype(np.int64) % (PLACES - 1)) % PLACES
    more = np.flatnonzero((choice >> np.uint64(20)) % np.uint64(4) == 0)
    row = np.concatenate([np.arange(len(path)), more])
    place = np.concatenate([one, two[more]])
    child = _mix(path[row] * _C3 + _mix((place.astype(np.uint64) << np.uint64(32)) + tokens[row, place].astype(np.uint64) + _C2))
    return row, child


def recall(similarity: float, depth: int, runs: int = RUNS) -> float:
    """Chance that a pair of this similarity meets at this depth in any of the runs."""
    meet = 1.0
    for _ in range(depth):
        follow = similarity * meet
        meet = 0.75 * follow + 0.25 * (1 - (1 - follow) ** 2)
    return 1 - (1 - meet) ** runs


def _roots() -> np.ndarray:
    return _mix(np.arange(1, RUNS + 1, dtype=np.uint64) * _C1)


def _blob(a: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in a]


def _tokens(column: pa.Array, kind: type) -> np.ndarray:
    raw, _ = text_bytes(column)
    return np.frombuffer(raw.tobytes(), kind).reshape(len(column), -1)


def with_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``rid``, ``th`` (hash of the text), ``key`` of its set, number of shingles and sketch."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in utf8_parts(no_nulls(batch.column(2)), 1 << 20):
                h, ends = shingles(part)
                tokens, keys = sketches(h, ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(part)), batch.column(1).slice(lo, len(part)), pa.array(_blob(keys), pa.binary()), pa.array(_blob(tokens), pa.binary())],
                    ["rid", "th", "key", "tokens"],
                )

    return named(docs, id_col, text_col).mapInArrow(of, "rid long, th long, key binary, tokens binary")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(text).alias("th"), text.alias("text"))


def _named_by(keys: pa.Array) -> np.ndarray:
    """The leaf that a ball around a class is, from the class's key."""
    raw = np.frombuffer(text_bytes(keys)[0].tobytes(), np.uint64).reshape(-1, 2)
    return _mix(raw[:, 0] * _C1 + _mix(raw[:, 1] + _C3)).view(np.int64)


def balls_of(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of large nodes (path, key, tokens): the balls (key, leaf) around their centers, and the nodes without inner classes.

    A node's center is that of its ``CENTERS`` least classes which has the most inner ones.
    """
    least = large.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("key"))).where(F.col("k") <= CENTERS)
    least = least.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("key", "tokens"))).alias("c"))
    least = written(least.select("path", F.array_join(F.transform("c", lambda x: F.hex(x["key"])), "").alias("centers"), F.array_join(F.transform("c", lambda x: F.hex(x["tokens"])), "").alias("about")), "centers")
    # a node is a hot key: its one row of centers is broadcast, or salted
    near = with_small(large, least, ["path"], F.length("centers") + F.length("about") + 32).select("path", "key", "tokens", "about")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, paths = _tokens(batch.column(2), np.uint32), batch.column(0).to_numpy()
            ball, inner = np.zeros((2, len(own)), np.int32)
            _, first, which = np.unique(paths, return_index=True, return_inverse=True)
            for node, at in enumerate(first.tolist()):
                rows = np.flatnonzero(which == node)
                for k, center in enumerate(np.frombuffer(bytes.fromhex(batch.column(3)[at].as_py()), np.uint32).reshape(-1, PLACES)):
                    agree = (own[rows] == center).sum(1)
                    ball[rows] |= (agree >= BALL).astype(np.int32) << k
                    inner[rows] |= (agree >= INNER).astype(np.int32) << k
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ball), pa.array(inner)], ["path", "key", "ball", "inner"])

    found = written(near.mapInArrow(of, "path long, key binary, ball int, inner int"), "balls")
    bit = lambda c, k: F.getbit(F.col(c), F.lit(k)).cast("int")
    counts = found.groupBy("path").agg(*(F.sum(bit("inner", k)).alias(f"n{k}") for k in range(CENTERS)))
    # the most inner classes, the first of equal ones; a class alone has met nobody, and stays
    best = counts.select("path", F.greatest(*(F.struct(F.col(f"n{k}").alias("n"), F.lit(-k).alias("k")) for k in range(CENTERS))).alias("b")).where("b.n > 1")
    best = best.join(least, "path").select("path", (-F.col("b.k")).alias("k"), F.unhex(F.substring(F.col("centers"), F.lit(1) - 32 * F.col("b.k"), F.lit(32))).alias("center"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_named_by(batch.column(2)))], ["path", "k", "leaf"])

    best = written(best.mapInArrow(name, "path long, k int, leaf long"), "best-centers")
    chosen = with_small(found, best, ["path"], F.lit(40), "left")
    has = lambda c: F.getbit(F.col(c), F.col("k")) == 1
    balls = chosen.where(has("ball")).select("key", "leaf").distinct()
    return balls, chosen.where(F.col("k").isNull() | ~has("inner")).select("key", "path")


def leaves_of(classes: DataFrame) -> DataFrame:
    """(key, leaf, n) for every class and leaf of two classes or more."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, keys = _tokens(batch.column(1), np.uint32), batch.column(0)
            for root in _roots():
                row, child = children(np.full(len(keys), root, np.uint64), tokens)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(child.view(np.int64))], ["key", "path"])

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column(2), np.uint32)
            row, child = children(batch.column(1).to_numpy().view(np.uint64), tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(child.view(np.int64))], ["key", "path"])

    def sized(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        return written(rows.join(sizes, "path"), name)

    tokens = classes.select("key", "tokens")
    at, parts, balls = tokens.mapInArrow(first, "key binary, path long"), [], []
    for level in range(1, DEPTH + 1):
        nodes = sized(written(at, f"paths-{level}"), f"nodes-{level}")
        large = nodes.where(F.col("n") > LEAF)
        parts.append(nodes if level == DEPTH else nodes.where(F.col("n") <= LEAF))
        if level == DEPTH or large.isEmpty():
            break
        ball, rest = balls_of(large.select("path", "key").join(tokens, "key").select("path", "key", "tokens"))
        balls.append(ball)
        rest = sized(rest, f"rest-{level}")
        parts.append(rest.where(F.col("n") <= LEAF))
        at = rest.where(F.col("n") > LEAF).select("key", "path").join(tokens, "key").select("key", "path", "tokens").mapInArrow(deeper, "key binary, path long")
    found = reduce(DataFrame.unionByName, (p.select("key", F.col("path").alias("leaf"), "n") for p in parts))
    if not balls:
        return found
    every = written(reduce(DataFrame.unionByName, balls).distinct().withColumnRenamed("leaf", "path"), "all-balls")
    return found.unionByName(sized(every, "ball-sizes").select("key", F.col("path").alias("leaf"), "n"))


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups (equal leaf, a, b: the first three columns) of about so many rows, from sorted batches."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        ids = np.stack([table.column(k).to_numpy() for k in range(3)], 1)
        same = (ids == ids[-1]).all(1)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held, count = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table) -> np.ndarray:
    ids = np.stack([table.column(k).to_numpy() for k in range(3)], 1)
    return np.append(np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(1))), len(ids))


def _pairs(lo: int, hi: int, side: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a group, or all pairs between its two blocks."""
    if cross:
        left, right = lo + np.flatnonzero(side[lo:hi] == side[lo:hi].min()), lo + np.flatnonzero(side[lo:hi] != side[lo:hi].min())
        return np.repeat(left, len(right)), np.tile(right, len(left))
    i, j = np.triu_indices(hi - lo, 1)
    return i + lo, j + lo


def _met_before(leaf: int, lists: list[np.ndarray]) -> np.ndarray:
    """For all pairs of a group, whether they share a leaf less than this one, to which they then belong."""
    names, inverse, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    telling = ((names < leaf) & (count > 1))[inverse]  # what one class alone has is shared by no pair
    shared, inverse = np.unique(inverse[telling], return_inverse=True)
    owner, met, width = owner[telling], np.zeros((len(lists), len(lists)), bool), 2048
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    for lo in range(0, len(shared), width):
        x, y = np.searchsorted(inverse, [lo, lo + width])
        at = np.zeros((len(lists), min(width, len(shared) - lo)), np.float32)
        at[owner[x:y], inverse[x:y] - lo] = 1
        met |= at @ at.T > 0
    return met


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of each group with a likely partner."""
    for table in _groups(batches, 4000):
        bounds = _bounds(table)
        side, tokens = table.column("side").to_numpy(), _tokens(table.column("short").combine_chunks(), np.uint16)
        cross = table.column("a").to_numpy() != table.column("b").to_numpy()
        marked = np.zeros(len(side), bool)
        todo_a, todo_b, waiting = [], [], 0

        def compare() -> None:
            a, b = np.concatenate(todo_a), np.concatenate(todo_b)
            for k in range(0, len(a), 40_000):
                x, y = a[k : k + 40_000], b[k : k + 40_000]
                ok = (tokens[x] == tokens[y]).sum(1) >= LIKELY
                marked[x[ok]] = marked[y[ok]] = True

        for lo, hi in zip(bounds[:-1], bounds[1:]):
            a, b = _pairs(lo, hi, side, cross[lo])
            todo_a.append(a)
            todo_b.append(b)
            waiting += len(a)
            if waiting > 40_000:
                compare()
                todo_a, todo_b, waiting = [], [], 0
        if waiting:
            compare()
        yield from table.filter(pa.array(marked)).select(["leaf", "a", "b", "side", "key"]).combine_chunks().to_batches()


def _tree(keys: list[bytes], a: np.ndarray, b: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Edges that join what the pairs join: in each component a tree where no node has over nine."""
    up = list(range(len(keys)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        up[top(x)] = top(y)
    parts: dict[int, list[bytes]] = {}
    for x in np.unique(np.concatenate([a, b])).tolist():
        parts.setdefault(top(x), []).append(keys[x])
    return [(part[k], part[(k - 1) // 8]) for part in map(sorted, parts.values()) for k in range(1, len(part))]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links of each group: a class's number of linked documents, and edges (``other`` not null)."""
    for table in _groups(batches, 500):
        bounds = _bounds(table)
        side, weight = table.column("side").to_numpy(), table.column("copies").to_numpy()
        leaf, keys = table.column("leaf").to_numpy(), table.column("key").to_pylist()
        lists = [np.unique(x) for x in table.column("leaves").to_pylist()]
        cross = table.column("a").to_numpy() != table.column("b").to_numpy()
        parts = [shingles(p) for _, p in utf8_parts(no_nulls(table.column("text")), 1 << 20)]
        sets = [h[x:y] for h, ends in parts for x, y in zip(ends[:-1], ends[1:])]
        links, edges = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            names, inverse = np.unique(np.concatenate(sets[lo:hi]), return_inverse=True)
            size = np.array([len(s) for s in sets[lo:hi]])
            common = _common(inverse, size, len(names))
            a, b = _pairs(lo, hi, side, cross[lo])
            both = common[a - lo, b - lo]
            # similar: |both| / |either| >= 4 / 5, in whole numbers
            ok = 5 * both >= 4 * (size[a - lo] + size[b - lo] - both)
            ok &= ~_met_before(int(leaf[lo]), lists[lo:hi])[a - lo, b - lo]
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            count = np.bincount(a - lo, weight[b], hi - lo) + np.bincount(b - lo, weight[a], hi - lo)
            links += [(keys[lo + k], None, int(count[k])) for k in np.flatnonzero(count)]
            edges += [(x, y, 0) for x, y in _tree(keys[lo:hi], a - lo, b - lo)]
        rows = links + edges
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["key", "other", "links"]
        )


def _common(inverse: np.ndarray, size: np.ndarray, names: int) -> np.ndarray:
    """Sizes of all pairwise intersections in a group, by products of strips of the membership matrix."""
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    total = np.zeros((n, n), np.float32)
    width = max(1, 4_000_000 // max(n, 1))
    shared = np.bincount(inverse, minlength=names)[inverse] > 1  # what one set alone has is in no intersection
    order = np.argsort(inverse[shared], kind="stable")
    inverse, owner = inverse[shared][order], owner[shared][order]
    place, inverse = np.unique(inverse, return_inverse=True)
    names = len(place)
    for lo in range(0, names, width):
        x, y = np.searchsorted(inverse, [lo, lo + width])
        strip = np.zeros((n, min(width, names - lo)), np.float32)
        strip[owner[x:y], inverse[x:y] - lo] = 1
        total += strip @ strip.T
    return total.astype(np.int64)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, label): the least (rid, key) that edges lead to.

    Each round a class takes the least label next to it, and so does the class that its old label names (a
    tree is hooked to a lesser one); then every class takes the label of its label, which halves the trees.
    """
    both = written(edges.select("key", "other").union(edges.select("other", "key")).distinct(), "edges")
    labels = written(both.select("key").distinct().join(nodes.select("key", F.struct("rid", "key").alias("label")), "key"), "labels")
    while True:
        seen = both.join(labels, "key").groupBy(F.col("other").alias("key")).agg(F.min("label").alias("best"))
        near = written(labels.join(seen, "key").select("key", F.col("label").alias("was"), F.least("label", "best").alias("label")), "near")
        hooks = near.groupBy(F.col("was.key").alias("key")).agg(F.min("label").alias("hook"))
        near = written(near.join(hooks, "key", "left").select("key", "was", F.least("label", "hook").alias("label")), "hooked")
        # many classes have one label: its row is broadcast, or salted
        named = near.select("label.key").distinct()
        tops = written(near.join(named, "key", "left_semi").select(F.col("key").alias("_top"), F.col("label").alias("next")), "tops")
        new = with_small(near.withColumn("_top", F.col("label.key")), tops, ["_top"], F.lit(96), "left")
        new = written(new.select("key", F.least("label", "next").alias("label"), (F.least("label", "next") < F.col("was")).alias("moved")), "labels")
        labels = new.select("key", "label")
        if new.where("moved").isEmpty():
            return labels


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``rid``, ``th``, ``key``, ``label`` (least (rid, key) of its group) and ``n_links``."""
    rows = written(with_sets(docs, id_col, text_col), "sets")
    classes = written(rows.groupBy("key").agg(
        F.min(F.struct("rid", "th")).alias("one"), F.count("*").alias("copies"), F.first("tokens").alias("tokens")
    ).select("key", "one.rid", "one.th", "copies", "tokens"), "classes")
    # the empty set, of which there is one class, has no token to split by
    found = written(leaves_of(classes.where(F.col("key") != F.lit(bytes(16)))), "leaves")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column(1), np.uint32).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_blob(tokens), pa.binary())], ["key", "short"])

    small = classes.select("key", "tokens").mapInArrow(short, "key binary, short binary")
    blocks = F.when(F.col("n") <= LEAF, 1).otherwise(F.ceil(F.col("n") / SIDE)).cast("int")
    own = F.pmod(F.xxhash64("key", "leaf"), blocks).cast("int")
    placed = found.join(small, "key").select("leaf", "key", "short", blocks.alias("blocks"), own.alias("side"))
    # a leaf of more than one block is compared block by block: a row goes to each pair that has its block
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("leaf", F.least("side", "with").alias("a"), F.greatest("side", "with").alias("b"), "side", "key", "short")
    dealt = placed.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b")
    likely = written(dealt.mapInArrow(_likely, "leaf long, a int, b int, side int, key binary"), "likely")
    of_class = found.join(likely.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.collect_list("leaf").alias("leaves"))
    texts = named(docs, id_col, text_col)
    whole = likely.select("key").distinct().join(classes.select("key", "rid", "th", "copies"), "key").join(of_class, "key")
    whole = texts.join(whole, ["rid", "th"]).dropDuplicates(["key"]).select("key", "copies", "leaves", "text")
    dealt = likely.join(whole, "key").select("leaf", "a", "b", "side", "key", "copies", "leaves", "text")
    dealt = dealt.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b")
    exact = written(dealt.mapInArrow(_verified, "key binary, other binary, links long"), "exact")
    labels = components(classes, exact.where("other is not null"))
    counts = exact.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    per_class = classes.select("key", "rid", "copies").join(labels, "key", "left").join(counts, "key", "left").select(
        "key", F.coalesce("label", F.struct("rid", "key")).alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    per_class = written(per_class, "per-class")
    # copies of one text are one key: its row is broadcast, or salted
    return with_small(rows.select("rid", "th", "key"), per_class, ["key"], F.lit(96))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``class_id`` (least id of its group) and ``n_links`` (other rows of similarity 0.8 or more)."""
    found = links(docs, id_col, text_col)
    none = F.lit(None).cast("long")
    return found.select(
        F.when(F.col("rid") != NO_ID, F.col("rid")).otherwise(none).alias(id_col),
        F.when(F.col("label.rid") != NO_ID, F.col("label.rid")).otherwise(none).alias("class_id"), "n_links",
    )


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group, the one with the least id."""
    found = links(docs, id_col, text_col)
    kept = found.where((F.col("rid") == F.col("label.rid")) & (F.col("key") == F.col("label.key")))
    # rows of one set may have several texts (white space): one stays
    kept = kept.groupBy("key").agg(F.min(F.struct("rid", "th")).alias("one")).select(F.col("one.rid").alias("_rid"), F.col("one.th").alias("_th"))
    rid, th, k = (fresh(docs, stem=s) for s in ("_own_rid", "_own_th", "_copy"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumns({rid: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), th: F.xxhash64(text)})
    joined = marked.join(kept, (F.col(rid) == F.col("_rid")) & (F.col(th) == F.col("_th")))
    same = Window.partitionBy(rid, th).orderBy(F.lit(0))
    return joined.withColumn(k, F.row_number().over(same)).where(F.col(k) == 1).select(*docs.columns)


def expected_recall() -> float:
    """The least chance, over all depths, to find a pair of similarity SIMILAR; sketch comparison included."""
    missed = sum(math.comb(PLACES, k) * SIMILAR**k * (1 - SIMILAR) ** (PLACES - k) for k in range(LIKELY))
    return recall(SIMILAR, DEPTH) * (1 - missed)
