"""Near copies by SimHash and exact Jaccard similarity of word shingles.

Texts are linked if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more.

1. Every whole text becomes the set of its shingles' hashes.  Equal sets are one
   node, named by a 128-bit hash of the set, whatever their number.
2. The vantage-point trees of ``simhash`` give the nodes whose five-word
   fingerprints are equal or a few bits apart: first candidates.
3. Texts of similarity 0.8 differ in about ten bits on the average, and with so
   wide a radius no vantage point prunes anything.  So a prefix filter adds all
   that the trees can't see.  All sets are sorted in one order, shingles that a
   bounded sample shows to be common last; two sets of similarity s or more
   share one of the first n - ceil(s * n) + 1 shingles of each.  Only these are
   dealt out, packed into buckets of shingles.  A bucket returns the pairs of
   nodes of the shingles that few have, each pair once, and of the others the
   members.  Common shingles are not gathered: they are dealt out by node.
4. The members of a shingle that many nodes have are first compared with one of
   them, the pivot; what that links needs no more comparisons, so a dense group
   costs rows, not pairs.  When few pairs are left, or pivots link no more, the
   members of each shingle meet in one place with their sizes, odd counts and
   counts by remainder, and only pairs of different components that these allow
   leave it.  Of a node with many such pairs a few go first; what they link makes
   components larger, and the others are looked at again only between those.
5. Where that would be far more work than there are shingles, shared shingles tell
   little, as where texts are put together from common passages: there the
   nodes left are dealt out by parts of their whole sets.  Sets
   of sizes in a range that a similar pair can have differ in at most k elements;
   with the shingles dealt out to more than k parts by their hashes, a similar
   pair has a part in which both sets are the same and not empty.  The sum of a
   part's hashes is its signature.  Nodes that share a signature then meet as
   those that share a shingle do.
6. Candidates whose sizes, odd counts or counts of hashes by remainder bound the
   overlap too low go; of the rest the whole sets are compared.  So the links
   are exact, whichever way a candidate came.  The longer a text, the more
   remainders it is counted by, since many hashes a remainder tell nothing.

Cases: a null or empty text has the empty set; empty sets are equal.  A text of
fewer than five words has one shingle of all its words.  A very long text is
hashed in blocks.  Rows with a null id stay, whatever their text.  Of repeated
rows, and of rows that share an id and a set, the one of the smallest JSON form
stays; rows that share an id but no links all stay.  Columns besides the id and
the text are not read, and may have any names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from . import simhash
from .common import durable, fresh_name, gathered

SHINGLE_WORDS = 5
#: Least similarity of linked texts, as a ratio of integers.
SIMILAR = (4, 5)
#: Texts of the sample that shows which shingles are common, texts of it that a common one is in at least, and common shingles at most.
SAMPLE_ROWS, COMMON_TEXTS, COMMON_MOST = 8_192, 3, 65_536
#: Remainders by which hashes are counted, each up to a byte; longer sets have twice as many until few hashes fall on one, up to a bound.
COUNTS, PER_COUNT, COUNTS_MOST = 256, 4, 65_536
ODD = [f"odd{i}" for i in range(COUNTS // 64)]
#: Orders of shingles in which nodes have a least one, each by a constant (a multiple of the golden ratio's 64 bits, signed).
ORDERS = [(k * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for k in range(8)]
LEAST = [f"least{k}" for k in range(len(ORDERS))]
#: Shingles of a bucket aimed at, and shingles that a task gathers before it deals them out.
BUCKET_ITEMS, GATHERED = 125_000, 200_000
#: Rounds with pivots at most, pairs that are compared at once without more of them, and the share of pairs that a round must leave out at least for another.
PIVOT_ROUNDS, FEW_PAIRS, WORTH = 8, 300_000, 0.2
#: Pairs for each shingle of the nodes left from which signatures cost less than pairs.
PAIRS_PER_SHINGLE = 20
#: Nodes and shingles of a bucket where nodes meet with their counts, and partners of a node there by passes; the last pass takes all.
MEETING_ITEMS, PARTNERS = 25_000, (4, 8, 0)
#: Nodes of a shingle whose pairs are compared without a pivot.
SHORT = 8
#: Rows that a Python function hands back at a time.
SLICE = 128
#: Rows of 16 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Documents or nodes, and entries of prefixes, that a task of a join or grouping has.
TASK_NODES, TASK_ITEMS = 4_000, 50_000


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *simhash.shingle_hashes(text, words)]))


def prefix_length(n: int) -> int:
    return n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1 if n else 0


@cache
def size_ranges() -> np.ndarray:
    """The last sizes of ranges such that the sizes of a similar pair lie in one of them or in neighbours."""
    last = [0]
    while last[-1] < 2**40:
        last.append(max(last[-1] + 1, (last[-1] + 1) * SIMILAR[1] // SIMILAR[0]))
    return np.array(last[1:])


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """Well spread 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (keys ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def signatures(hashes: np.ndarray) -> np.ndarray:
    """Numbers of the parts of a set of distinct hashes; two similar sets, unless they are empty, share at least one.

    For the range of its size and for the next, a set is cut into k + 1 + e
    parts, where similar sets of that range and the one before differ in k
    elements at most.  They agree on 1 + e parts, so on one that isn't empty if
    either has at most e empty parts; a set with more tells its empty parts too.
    """
    own, out = int(np.searchsorted(size_ranges(), len(hashes))), [np.empty(0, np.uint64)]
    for place in (own, own + 1) if len(hashes) else ():
        k = int(2 * size_ranges()[place] * (SIMILAR[1] - SIMILAR[0]) // (SIMILAR[1] + SIMILAR[0]))
        spare = 2 + k // 16
        parts = k + 1 + spare
        mixed = _mix(hashes, 2 * place + 1)
        part = (mixed >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        full, starts = np.unique(part[order], return_index=True)
        with np.errstate(over="ignore"):
            out.append(_mix(np.add.reduceat(_mix(hashes[order], 2), starts) + full, 2 * place + 4))
        if parts - len(full) > spare:
            out.append(_mix(np.setdiff1d(np.arange(parts, dtype=np.uint64), full), 2 * place + 5))
    return np.unique(np.concatenate(out))


def set_key(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes(), 42)


def _part(key: bytes) -> int:
    """The first half of a key."""
    return int.from_bytes(key[:8], "big", signed=True)


def remainders(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each remainder, up to 255; the number of remainders grows with the set."""
    size = COUNTS
    while size < COUNTS_MOST and len(hashes) > PER_COUNT * size:
        size *= 2
    return np.minimum(np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def may_be_alike(counts: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether counts allow the least overlap of the sets i and j; a count of 255 may be more and rules nothing out.

    Sets that are counted by different numbers of remainders meet at the smaller.
    """
    out, sizes = np.zeros(len(i), bool), np.array([len(x) for x in counts])
    full = np.array([bool((x == 255).any()) for x in counts])
    level = np.minimum(sizes[i], sizes[j])
    for size in np.unique(level):
        for at in np.array_split(pairs := np.flatnonzero(level == size), 1 + len(pairs) * int(size) // 4_000_000):
            own, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            table = np.stack([counts[k].reshape(-1, size).sum(axis=0, dtype=np.uint16) for k in own]) if len(own) else np.empty((0, size), np.uint16)
            most = np.minimum(table[place[: len(at)]], table[place[len(at) :]]).sum(axis=1, dtype=np.int64)
            out[at] = (most * SIMILAR[1] >= (n[i[at]] + n[j[at]] - most) * SIMILAR[0]) | full[i[at]] | full[j[at]]
    return out


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for a in range(0, len(batch), SLICE):
            yield batch.iloc[a : a + SLICE]


def _prints(texts: DataFrame) -> DataFrame:
    """(doc_id, key, part, n, fp, counts, odd) of every row; odd tells of which remainders there is an odd number."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _sliced(batches):
            out = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                blocks = list(simhash.shingle_hashes(text, SHINGLE_WORDS))
                hashes = np.unique(np.concatenate([np.empty(0, np.uint64), *blocks]))
                key, fp = set_key(hashes), int.from_bytes(simhash.majority_bits(iter(blocks)), "big", signed=True)
                odd = np.packbits(np.bincount((hashes % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS) & 1).view(">i8").tolist()
                out.append((i, key, _part(key), len(hashes), fp, remainders(hashes).tobytes(), *odd))
            yield pd.DataFrame(out, columns=["doc_id", "key", "part", "n", "fp", "counts", *ODD])

    return texts.mapInPandas(rows, "doc_id long, key binary, part long, n int, fp long, counts binary, " + ", ".join(f"{c} long" for c in ODD))


def _may_fit() -> Column:
    """Whether the sizes and odd counts of nodes a and b allow the least similarity: each remainder whose counts differ in parity holds a shingle of one set only."""
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ODD), F.lit(0))
    return apart * (SIMILAR[1] + SIMILAR[0]) <= (F.col("n_a") + F.col("n_b")) * (SIMILAR[1] - SIMILAR[0])


def _common(texts: DataFrame, total: int) -> np.ndarray:
    """The shingles of the most texts of a bounded sample."""
    every = max(1, total // SAMPLE_ROWS)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _sliced(batches):
            yield pd.DataFrame({"h": np.concatenate([np.empty(0, np.uint64), *map(shingle_set, batch["text"])]).view(np.int64)})

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counted = sample.mapInPandas(hashes, "h long").groupBy("h").count().where(F.col("count") >= COMMON_TEXTS)
    return np.sort(counted.orderBy(F.desc("count"), "h").limit(COMMON_MOST).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def _is_in(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the hashes are common; both ascend."""
    if not len(common):
        return np.zeros(len(hashes), bool)
    return common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes


def _dealt(texts: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, shingles, parts): the prefixes of all rows, packed; a common shingle lies in a bucket of its node's."""
    fields = pa.schema([("bucket", pa.int64()), ("shingles", pa.binary()), ("parts", pa.binary())])

    def packed(shingles: list[np.ndarray], parts: list[tuple[int, int]], hot: list[np.ndarray]) -> pa.RecordBatch:
        h, late = np.concatenate(shingles), np.concatenate(hot)
        p = np.repeat(np.array([x for x, _ in parts], np.int64), [k for _, k in parts])
        bucket = np.where(late, buckets + (p.view(np.uint64) % np.uint64(buckets)).astype(np.int64), (h % np.uint64(buckets)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        cuts = np.append(starts, len(order))
        h, p = h[order], p[order]
        return pa.RecordBatch.from_arrays(
            [pa.array(names), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (h, p))], schema=fields
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, parts, hot, gathered, seen = [], [], [], 0, set()
        for batch in batches:
            for text in batch.column(0):
                hashes = shingle_set(text.as_py())
                key = set_key(hashes)
                if key in seen or not len(hashes):
                    continue
                seen.add(key)
                late = _is_in(hashes, common)
                k = prefix_length(len(hashes))
                shingles.append(np.concatenate([hashes[~late], hashes[late]])[:k])
                hot.append(np.concatenate([late[~late], late[late]])[:k])
                parts.append((_part(key), k))
                gathered += k
                if gathered >= GATHERED:
                    yield packed(shingles, parts, hot)
                    shingles, parts, hot, gathered, seen = [], [], [], 0, set()
        if gathered:
            yield packed(shingles, parts, hot)

    return texts.select("text").mapInArrow(deal, "bucket long, shingles binary, parts binary")


def _shared(texts: DataFrame, common: np.ndarray, items: int) -> DataFrame:
    """(pair, x, y): pairs of parts that share a shingle which few nodes have; else a shingle and a part that has it, of common ones and those that many have."""
    buckets = items // BUCKET_ITEMS + 1

    def several(rows: pd.DataFrame) -> pd.DataFrame:
        both = np.unique(np.stack([np.frombuffer(b"".join(rows[c]), np.int64) for c in ("shingles", "parts")], axis=1), axis=0)
        shingles, parts = both[:, 0], both[:, 1]
        if rows["bucket"].iloc[0] >= buckets or not len(both):
            return pd.DataFrame({"pair": False, "x": shingles, "y": parts})
        starts = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
        lengths = np.repeat(np.diff(np.append(starts, len(shingles))), np.diff(np.append(starts, len(shingles))))
        pairs = [np.empty((0, 2), np.int64)]
        for d in range(1, SHORT):  # neighbours at every distance within a short run; parts ascend there
            at = np.flatnonzero((shingles[:-d] == shingles[d:]) & (lengths[:-d] <= SHORT))
            pairs.append(np.stack([parts[at], parts[at + d]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        many = lengths > SHORT
        return pd.DataFrame({"pair": np.repeat([True, False], [len(pairs), int(many.sum())]), "x": np.append(pairs[:, 0], shingles[many]), "y": np.append(pairs[:, 1], parts[many])})

    return _dealt(texts, common, buckets).groupBy("bucket").applyInPandas(several, "pair boolean, x long, y long")


def _by_signature(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for k, (text, part) in enumerate(zip(batch.column("text"), batch.column("part").to_pylist())):
        hashes = shingle_set(text.as_py())
        if _part(set_key(hashes)) == part and len(hashes):  # not another text of the same id
            yield k, signatures(hashes)


def _by_shingle(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for k, shingles in enumerate(batch.column("shingles")):
        yield k, shingles.values.to_numpy().view(np.uint64)


def _first_partners(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the first ``most`` of either of their nodes, in an order that is a node's own and another for another ``most``."""
    out = np.zeros(len(x), bool)
    for own, other in ((x, y), (y, x)):
        order = np.lexsort((_mix(own.view(np.uint64) ^ _mix(other.view(np.uint64), 3), most), own))
        starts = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))[: len(x)]
        place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
        out[order[place < most]] = True
    return out


def _across(rest: DataFrame, items: int, items_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], most: int = 0) -> DataFrame:
    """(a, b): pairs of nodes of different components that share an item and may be similar.

    ``rest`` has (node, component, n, odd, counts) and what ``items_of`` reads.
    What is dealt out is packed: a bucket's items, each with the place of its
    node in a list.  With ``most`` a node that has more pairs gets that many,
    and a row (node, node) tells that there are others.
    """
    buckets = items // MEETING_ITEMS + 1
    fields = pa.schema([("bucket", pa.int64()), *((name, pa.binary()) for name in ("items", "places", "nodes", "sizes", "counts"))])
    width = 3 + len(ODD)

    def packed(items: list[np.ndarray], nodes: list[list[int]], counts: list[bytes]) -> pa.RecordBatch:
        h, at = np.concatenate(items), np.repeat(np.arange(len(items)), [len(x) for x in items])
        every, bucket = np.array(nodes, np.int64), (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        rows = []
        for name, own in zip(names.tolist(), np.split(order, starts[1:])):
            mine, places = np.unique(at[own], return_inverse=True)
            told = [counts[k] for k in mine]
            rows.append((name, h[own].tobytes(), places.astype(np.int32).tobytes(), every[mine].tobytes(), np.array([len(x) for x in told], np.int32).tobytes(), b"".join(told)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, nodes, counts, gathered = [], [], [], 0
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("node", "component", "n", *ODD)], axis=1)
            for k, found in items_of(batch):
                items.append(found)
                nodes.append(own[k].tolist())
                counts.append(batch.column("counts")[k].as_py())
                gathered += len(found) + len(counts[-1]) // 8
                if gathered >= GATHERED:
                    yield packed(items, nodes, counts)
                    items, nodes, counts, gathered = [], [], [], 0
        if items:
            yield packed(items, nodes, counts)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // (8 * width) for x in rows["nodes"]]
        every = np.frombuffer(b"".join(rows["nodes"]), np.int64).reshape(-1, width)
        ends = np.cumsum(np.frombuffer(b"".join(rows["sizes"]), np.int32).astype(np.int64))
        told = np.frombuffer(b"".join(rows["counts"]), np.uint8)
        counts = np.split(told, ends[:-1])
        h = np.frombuffer(b"".join(rows["items"]), np.uint64)
        at = np.concatenate([np.frombuffer(x, np.int32).astype(np.int64) + start for x, start in zip(rows["places"], np.cumsum([0, *sizes[:-1]]))])
        both = np.unique(np.stack([h, every[at, 0].view(np.uint64)], axis=1), axis=0, return_index=True)[1]  # repeated rows count once
        both = both[np.argsort(h[both], kind="stable")]
        h, at = h[both], at[both]
        found = [np.empty((0, 2), np.int64)]  # as places in ``every``
        for a, b in zip(*(lambda s: (s, np.append(s[1:], len(h))))(np.flatnonzero(np.append(True, h[1:] != h[:-1]))) if len(h) else ((), ())):
            group = every[at[a:b]]
            if b - a < 2 or (group[:, 1] == group[0, 1]).all():
                continue
            for k in range(0, len(group), 256):  # a block of them against those behind
                x, y = group[k : k + 256], group[k:]
                n, m = x[:, None, 2], y[None, :, 2]
                ok = (x[:, None, 1] != y[None, :, 1]) & (x[:, None, 0] < y[None, :, 0]) & (np.minimum(n, m) * SIMILAR[1] >= np.maximum(n, m) * SIMILAR[0])
                apart = sum(np.bitwise_count((x[:, None, 3 + c] ^ y[None, :, 3 + c]).view(np.uint64)).astype(np.int64) for c in range(len(ODD)))
                i, j = np.nonzero(ok & (apart * (SIMILAR[1] + SIMILAR[0]) <= (n + m) * (SIMILAR[1] - SIMILAR[0])))
                found.append(np.stack([at[a + k + j], at[a + k + i]], axis=1))
            if sum(map(len, found)) > 1_000_000:
                found = [distinct(np.concatenate(found))]
        i, j = distinct(np.concatenate(found)).T
        alike = may_be_alike(counts, every[:, 2], i, j)
        x, y = every[i[alike], 0], every[j[alike], 0]
        taken = _first_partners(x, y, most) if most else np.ones(len(x), bool)
        waiting = np.unique(np.append(x[~taken], y[~taken]))
        return pd.DataFrame({"a": np.append(x[taken], waiting), "b": np.append(y[taken], waiting)})

    def distinct(pairs: np.ndarray) -> np.ndarray:
        return np.unique(pairs, axis=0)

    read = rest.select("node", "component", "n", "counts", *ODD, *(c for c in ("text", "part", "shingles") if c in rest.columns))
    names = ", ".join(f"{c} binary" for c in ("items", "places", "nodes", "sizes", "counts"))
    return read.mapInArrow(deal, f"bucket long, {names}").groupBy("bucket").applyInPandas(meet, "a long, b long")


@F.pandas_udf(BooleanType())
def _may_be_alike(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    counts, k = [np.frombuffer(x, np.uint8) for c in (a, b) for x in c], np.arange(len(a))
    return pd.Series(may_be_alike(counts, np.concatenate([n, m]).astype(np.int64), k, k + len(a)), dtype="bool")


@F.pandas_udf(BinaryType())
def _key_of(texts: pd.Series) -> pd.Series:
    return pd.Series([set_key(shingle_set(t)) for t in texts], dtype=object)


def _small(rows: DataFrame) -> DataFrame:
    """Marked for a broadcast if its checked size, in rows of two columns, allows it."""
    return F.broadcast(rows) if rows.count() * max(len(rows.columns), 2) <= 2 * BROADCAST_ROWS else rows


def _beside(few: Callable[[DataFrame], DataFrame], pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = few(pairs.join(rows.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side))
    return pairs


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have the least similarity.

    A set goes to each of its pairs that counts don't rule out, once; the two
    sets of a pair meet by its number.
    """
    few = partial(gathered, rows=nodes.count(), each=TASK_NODES)
    may = durable(_beside(few, few(pairs.distinct()), nodes, "n", *ODD).where(_may_fit()).select("a", "b"))
    may = _beside(few, may, nodes, "counts", "n").where(_may_be_alike("counts_a", "counts_b", "n_a", "n_b"))
    near = durable(may.select("a", "b").withColumn("pair", F.monotonically_increasing_id()))
    sides = near.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node")))).alias("s"))
    sides = durable(few(sides.select("pair", "s.side", "s.node").join(nodes.select("node", "key", "doc_id"), "node").drop("node")))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _sliced(batches):
            hashes = [shingle_set(t) for t in batch["text"]]
            yield pd.DataFrame({"key": [set_key(h) for h in hashes], "hashes": [h.view(np.int64) for h in hashes]})

    found = texts.join(_small(few(sides.select("doc_id").distinct())), "doc_id", "left_semi").mapInPandas(sets, "key binary, hashes array<long>")
    met = found.join(_small(sides.select("key", "pair", "side")), "key")
    both = met.groupBy("pair").agg(*[F.max(F.when(F.col("side") == k, F.col("hashes"))).alias(n) for k, n in enumerate("xy")])  # repeated rows count once
    shared = F.size(F.array_intersect("x", "y"))
    enough = both.where(shared * SIMILAR[1] >= (F.size("x") + F.size("y") - shared) * SIMILAR[0]).select("pair")
    return durable(few(near.join(enough, "pair").select("a", "b")))


def _tree_pairs(nodes: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) of nodes with equal fingerprints, and of those that the vantage-point trees link."""
    first = durable(few(nodes.groupBy("fp").agg(F.min("node").alias("first"))))
    equal = few(nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    return equal.unionByName(simhash.links(first.select("fp", F.col("first").alias("node"))))


def _least(shingle: str) -> list[Column]:
    """A node's least shingle in each of several orders, one order for each constant that is flipped into the shingles."""
    return [F.min(F.col(shingle).bitwiseXOR(F.lit(c))).bitwiseXOR(F.lit(c)).alias(name) for c, name in zip(ORDERS, LEAST)]


def _first_met(shingle: str) -> Column:
    """Whether a pair is formed at this shingle: only at the first least shingle that both have alike, or at all they share if no least one is alike.

    A least shingle that both have alike is one that they share, so each pair
    is still formed once at least.
    """
    at = F.col(shingle)
    rule = F.when(F.col(f"{LEAST[0]}_a") == F.col(f"{LEAST[0]}_b"), at == F.col(f"{LEAST[0]}_a"))
    for name in LEAST[1:]:
        rule = rule.when(F.col(f"{name}_a") == F.col(f"{name}_b"), at == F.col(f"{name}_a"))
    return rule.otherwise(F.lit(True))


def _links(nodes: DataFrame, texts: DataFrame, total: int) -> DataFrame | None:
    """(node, component) of every node with a link."""
    items = nodes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]) + 1)).first()[0] or 0
    few = partial(gathered, rows=max(int(items), total * TASK_ITEMS // TASK_NODES), each=TASK_ITEMS)
    shared = durable(few(_shared(texts, _common(texts, total), int(items))))
    of = nodes.select("part", "node", "n")
    met = few(shared.where("pair").select("x", "y").distinct())
    met = few(met.join(of.select(F.col("part").alias("x"), F.col("node").alias("a"), "n"), "x"))
    met = few(met.join(of.select(F.col("part").alias("y"), F.col("node").alias("b"), F.col("n").alias("m")), "y"))
    members = few(shared.where("not pair").select(F.col("x").alias("shingle"), F.col("y").alias("part")).distinct())
    members = durable(few(members.join(of, "part").select("shingle", "node", "n")))
    fits = F.least("n", "m") * SIMILAR[1] >= F.greatest("n", "m") * SIMILAR[0]
    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    extra: DataFrame | None = met.where("a <> b").where(fits).select(*ordered).unionByName(_tree_pairs(nodes, few).select(*ordered))
    found = before = None

    def linked(pairs: DataFrame) -> DataFrame:
        """The components by what is known and by the similar ones of the pairs."""
        new = _verified(pairs, nodes, texts)
        if found is not None:
            new = new.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return simhash.components(new, new.count())

    for turn in range(PIVOT_ROUNDS + 1):
        named = members.withColumn("component", F.col("node")) if found is None else members.join(_small(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = durable(few(named))
        pivots = named.groupBy("shingle").agg(F.min(F.struct("node", "n", "component")).alias("p"), F.count("*").alias("k"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        pivots = durable(few(pivots.select("shingle", F.col("p.node").alias("b"), F.col("p.n").alias("m"), F.col("p.component").alias("of"), "k")))
        pairs_left = pivots.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0]
        if not pairs_left and extra is None:
            break
        pairs_left = pairs_left or 0
        last = pairs_left <= FEW_PAIRS or turn == PIVOT_ROUNDS or (before is not None and pairs_left > (1 - WORTH) * before)
        before = pairs_left
        live = few(named.join(pivots.select("shingle", F.col("b").alias("pivot")), "shingle"))
        if last:
            # A node's shingles stay in one row with what is told of the node, so that no join makes a row for each of them.
            left = live.groupBy("node").agg(F.first("component").alias("component"), F.collect_list("shingle").alias("shingles")).join(nodes.select("node", "part", "doc_id", "n", "counts", *ODD), "node")
            left = durable(few(left.withColumnRenamed("doc_id", "own_id")))
            several, entries = left.agg(F.sum("n"), F.sum(F.size("shingles"))).first()
            dense = pairs_left > PAIRS_PER_SHINGLE * (several or 0)
            for most in PARTNERS:
                if dense:
                    pairs = _across(texts.join(_small(left.drop("shingles")), F.col("doc_id") == F.col("own_id")), int(several or 0), _by_signature, most)
                else:
                    pairs = _across(left, int(entries or 0), _by_shingle, most)
                pairs = durable(few(few(pairs).distinct()))
                waiting = durable(pairs.where("a = b").select(F.col("a").alias("node")))
                pairs = pairs.where("a <> b")
                if extra is not None:
                    pairs, extra = pairs.unionByName(extra), None
                found = linked(pairs)
                if waiting.isEmpty():
                    break
                # Only nodes with pairs left over meet again, by the components that there are now.
                again = left.drop("component").join(_small(waiting), "node", "left_semi").join(_small(found), "node", "left")
                left = durable(few(again.withColumn("component", F.coalesce("component", "node"))))
                several, entries = left.agg(F.sum("n"), F.sum(F.size("shingles"))).first()
            break
        live = durable(live)
        pairs = few(live.join(pivots, "shingle")).where(F.col("node") != F.col("b"))
        pairs = pairs.where(F.col("component") != F.col("of")).where(fits).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))
        if extra is not None:
            pairs, extra = pairs.unionByName(extra), None
        found = linked(pairs)
        members = live.where(F.col("node") != F.col("pivot")).select("shingle", "node", "n")  # the pivot has met all others
    return found


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, component_id) of every row with an id; rows of one component are linked by pairs of the least similarity."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    rows = durable(_prints(texts))
    total = rows.count()
    few = partial(gathered, rows=total, each=TASK_NODES)
    nodes = few(rows.groupBy("key", "part", "n", "fp", "counts", *ODD).agg(F.min("doc_id").alias("doc_id")))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))  # short numbers, fixed from here on
    found = _links(nodes, texts, total) if total else None
    own = nodes.select("key", "node")
    own = own.withColumn("component", F.col("node")) if found is None else own.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = few(rows.select("doc_id", "key").join(few(own.drop("node")), "key"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return few(named.join(least, "component").select("doc_id", "key", "component_id", "component"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, that of the smallest id and then key; rows without an id stay.

    The choice is made on ids and keys alone; the texts are shuffled once, by
    id, or not at all while the kept ids are few enough to be broadcast.  Only
    ids that occur more than once need a look at their rows.
    """
    rows = durable(near_copies(docs, id_col=id_col, text_col=text_col))
    of_id, few = F.count("*").alias("rows"), partial(gathered, rows=rows.count(), each=TASK_NODES)
    chosen = few(rows.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("c")).select("c.doc_id", "c.key"))
    chosen = durable(few(chosen.join(rows.groupBy("doc_id").agg(of_id), "doc_id")))
    name, key = fresh_name(docs, "kept"), fresh_name(docs, "kept_key")
    mine = F.col(id_col).cast("long") == F.col(name)
    once = docs.join(_small(chosen.where("rows = 1").select(F.col("doc_id").alias(name))), mine, "left_semi")
    kept = once.unionByName(docs.where(F.col(id_col).cast("long").isNull()))
    repeated = chosen.where("rows > 1").select(F.col("doc_id").alias(name), F.col("key").alias(key))
    if not repeated.isEmpty():
        several = docs.join(_small(repeated), mine).where(_key_of(F.col(text_col)) == F.col(key))
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = several.groupBy(name, key).agg(F.min_by(whole, F.to_json(whole)).alias(fresh_name(docs, "row")))
        kept = kept.unionByName(one.select(f"{fresh_name(docs, 'row')}.*"))
    return kept
