"""SimHash near-duplicates by vantage-point trees over Hamming distance.

1. Every whole text gets a 64-bit fingerprint of its shingles of ``words`` words, three unless told otherwise.
2. Equal fingerprints become one node, named by its smallest document id; so a
   group of copies, however large, is one row from here on.
3. A vantage-point tree, fitted on a bounded sample of fingerprints, deals all
   nodes out to shards: at each inner node those within the radius of the
   vantage point go left, the others right.  By the triangle inequality two
   fingerprints within ``bits`` of each other can lie on different sides only
   if the left one is at more than ``radius - bits``; those go to both sides.
   So each close pair meets in at least one shard.
4. A shard divides its fingerprints further in the same way, down to leaves
   that are compared exactly, and returns for each fingerprint one link to the
   smallest node it reaches there: not pairs, so a dense group of n
   fingerprints gives n links at most.  Fingerprints that lie too dense for any
   vantage point meet by their shared neighbours of half the bits, which is
   exact too and takes time in proportion to their number.
5. The links of all shards become components by alternating large-star and
   small-star steps, each a distributed join, until nothing changes.

Cases: a null or empty text has fingerprint zero and is linked like any other.
Rows with a null id get a fingerprint, but neither node nor component (null).
Repeated rows are returned as often as they occur; rows of one id and other
texts are each linked by their own text.  A very long text is hashed in blocks.
The order of rows decides nothing: a component's name is its smallest id.  Columns besides the id and
the text are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, gathered

BITS = 2
SHINGLE_WORDS = 3
#: Fingerprints in a shard aimed at, sampled fingerprints that fit the tree at most, and fingerprints compared all with all.
SHARD_ROWS = 16_384
SAMPLE_ROWS = 262_144
LEAF = 128
#: A division is kept only if each side is smaller than this share of the whole.
DIVIDES = 0.85
#: A leaf of the tree with more rows than this share of a shard is dealt out by shared neighbours instead.
CROWD = 4
#: Edges that a task of a large-star or small-star step has.
TASK_EDGES = 20_000


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The XXH64 of every shingle of a text, in blocks; nothing without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not parts:
        return
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    reach = min(words, len(parts)) - 1
    for a in range(0, len(parts) - reach, 65_536):
        yield np.array([digest(joined[s:e], 42) for s, e in zip(starts[a : a + 65_536], ends[a + reach : a + reach + 65_536])], np.uint64)


def majority_bits(blocks: Iterator[np.ndarray]) -> bytes:
    """Eight bytes, most significant first: the bits set in over half the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        counts += np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return np.packbits(2 * counts > n).tobytes()


def fingerprint_bytes(text: str | None, words: int = SHINGLE_WORDS) -> bytes:
    """A text's fingerprint, most significant byte first."""
    return majority_bits(shingle_hashes(text, words))


def simhash(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([int.from_bytes(fingerprint_bytes(t, words), "big", signed=True) for t in texts], dtype="int64")

    return prints(text)


# The tree: an inner node is (vantage point, radius, left, right), a leaf is its number.


def _distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _divide(points: np.ndarray, bits: int) -> tuple | None:
    """The vantage point and radius, of a few tried, that give the smallest larger side; None if none divides."""
    best, n = None, len(points)
    tried = points[np.linspace(0, n - 1, 5).astype(int)]
    for vantage in np.unique(np.concatenate([tried, ~tried[:2], tried[:2] ^ np.uint64(0xFFFFFFFF)])):
        d = _distances(points, vantage)
        counts = np.cumsum(np.bincount(d, minlength=65))
        for radius in {int(np.searchsorted(counts, n * q)) for q in (0.4, 0.5, 0.6)}:
            inner = counts[radius]
            outer = n - (counts[radius - bits] if radius >= bits else 0)
            if best is None or max(inner, outer) < best[0]:
                best = (max(inner, outer), vantage, radius)
    return best[1:] if best and best[0] < DIVIDES * n else None


def fit_tree(sample: np.ndarray, leaves: int, bits: int) -> tuple[tuple | int, list[int]]:
    """A tree of about ``leaves`` leaves over the sample, and how much of the sample each holds."""
    most, sizes = max(1, len(sample) // max(1, leaves)), []

    def grow(points: np.ndarray) -> tuple | int:
        found = _divide(points, bits) if len(points) > max(most, 2) else None
        if found is None:
            sizes.append(len(points))
            return len(sizes) - 1
        d = _distances(points, found[0])
        return (int(found[0]), found[1], grow(points[d <= found[1]]), grow(points[d > found[1]]))

    return grow(sample), sizes


def deal(tree: tuple | int, points: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indices of the points that it needs)."""
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at
            continue
        d = _distances(points[at], np.uint64(node[0]))
        todo += [(node[2], at[d <= node[1]]), (node[3], at[d.astype(np.int64) > node[1] - bits])]


def _smallest_reached(points: np.ndarray, bits: int) -> np.ndarray:
    """For each point the smallest index that it reaches by links, all compared with all in blocks."""
    n, labels = len(points), np.arange(len(points))
    while True:
        before = labels.copy()
        for a in range(0, n, 512):
            near = _distances(points[a : a + 512, None], points[None, :]) <= bits
            labels[a : a + 512] = np.where(near, labels[None, :], n).min(axis=1)
        labels = labels[labels]
        if np.array_equal(labels, before):
            return labels


def neighbours(bits: int) -> np.ndarray:
    """The differences of up to half of ``bits``: two points are within an even number of bits if and only if they share a neighbour."""
    single = [np.uint64(1) << np.uint64(i) for i in range(64)]
    found, last = {0}, {0}
    for _ in range(bits // 2):
        last = {x ^ int(b) for x in last for b in single} - found
        found |= last
    return np.array(sorted(found), np.uint64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Well spread 24-bit numbers of the keys."""
    return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)


def _same_key(keys: np.ndarray) -> np.ndarray:
    """For each entry the index of the first with the same key."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return first[inverse]


def link(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each of distinct points the smallest index of its component among them."""
    parent = np.arange(len(points)).tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(pairs: Iterator[tuple[int, int]]) -> None:
        for i, j in pairs:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)

    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        found = _divide(points[at], bits) if len(at) > LEAF else None
        if found is not None:
            d = _distances(points[at], found[0]).astype(np.int64)
            todo += [at[d <= found[1]], at[d > found[1] - bits]]
        elif len(at) > 4 * LEAF and bits % 2 == 0:  # too dense to divide: points that share a neighbour, a part of the neighbours at a time
            masks = neighbours(bits)
            parts = -(-len(at) * len(masks) // 4_000_000)
            for part in range(parts):
                keys, own = [], []
                for mask in masks:
                    key = points[at] ^ mask
                    here = np.flatnonzero(_mixed(key) % np.uint64(parts) == part)
                    keys.append(key[here])
                    own.append(at[here])
                keys, own = np.concatenate(keys), np.concatenate(own)
                first = own[_same_key(keys)]
                apart = np.flatnonzero(first != own)
                join(zip(own[apart].tolist(), first[apart].tolist()))
        else:
            labels = _smallest_reached(points[at], bits)
            linked = np.flatnonzero(labels != np.arange(len(at)))
            join(zip(at[linked].tolist(), at[labels[linked]].tolist()))
    return np.array([root(i) for i in range(len(points))], np.int64)


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b), a > b, between the nodes (fp, node) of distinct fingerprints; their components are the nodes' components."""
    total = nodes.count()
    leaves = max(1, -(-total // SHARD_ROWS), min(24, total // 1024))
    every = max(1, total // SAMPLE_ROWS)
    sample = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").limit(2 * SAMPLE_ROWS).toPandas()["fp"]
    tree, sizes = fit_tree(np.sort(sample.to_numpy(np.int64).view(np.uint64)), leaves, bits)
    # A leaf that no vantage point divides and that is too large for one task: its points meet by shared neighbours.
    masks = neighbours(bits) if bits % 2 == 0 else None
    rows = [size * total // max(1, len(sample)) for size in sizes]
    crowds = {leaf: -(-n * len(masks) // SHARD_ROWS) for leaf, n in enumerate(rows) if masks is not None and n > CROWD * SHARD_ROWS}
    starts = dict(zip(crowds, np.cumsum([len(sizes), *crowds.values()]).tolist()))

    def to_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points, names = batch["fp"].to_numpy(np.int64).view(np.uint64), batch["node"].to_numpy()
            for leaf, at in deal(tree, points, bits):
                for mask in masks if leaf in crowds else [np.uint64(0)]:
                    key = points[at] ^ mask
                    shard = starts[leaf] + (_mixed(key) % np.uint64(crowds[leaf])).astype(np.int64) if leaf in crowds else np.full(len(at), leaf, np.int64)
                    yield pd.DataFrame({"shard": shard, "key": key.view(np.int64), "node": names[at]})

    def within(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("node", ignore_index=True)
        names, keys = shard["node"].to_numpy(np.int64), shard["key"].to_numpy(np.int64).view(np.uint64)
        roots = _same_key(keys) if shard["shard"].iloc[0] >= len(sizes) else link(keys, bits)
        linked = roots != np.arange(len(roots))
        return pd.DataFrame({"a": names[linked], "b": names[roots[linked]]})

    return nodes.mapInPandas(to_shards, "shard long, key long, node long").groupBy("shard").applyInPandas(within, "a long, b long")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) of every node with a link: the smallest node that it reaches.

    Large-star and small-star steps in turn; each keeps what is connected and
    brings every node nearer to its component's smallest one.  The steps are
    many, so each takes as many tasks as its edges need.  ``rows``: how many
    edges there are, if that is known.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = durable(edges.distinct() if rows is None else gathered(gathered(edges, rows, TASK_EDGES).distinct(), rows, TASK_EDGES))
    now = state(edges)
    while now[0]:
        few = partial(gathered, rows=now[0], each=TASK_EDGES)
        both = few(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = few(few(large).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = durable(few(few(small.select("e.a", "e.b").where("a != b")).distinct()))
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; fp is the fingerprint as a long."""
    prints = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), simhash(F.col(text_col), words).alias("fp")))
    nodes = durable(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")))
    reached = nodes.join(components(links(nodes, bits)), "node", "left")
    named = reached.select(F.col("fp").alias("__fp"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("__fp"), "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
