"""Hard negatives by a multiway tree of split points with distance ranges.

For each anchor the rows of its own label with the highest inner products are
its positives; the hard negatives of a positive are the best rows of other
labels whose products lie in a window below the positive's.

1. Vectors are scaled and floored to integers, so that products are exact.
2. A tree is fitted on a bounded sample: a node has a few split points, chosen
   far apart, and every row goes on with the nearest of them, so that the
   children are bounded by hyperplanes.  All rows are indexed.  Each split point
   keeps, for each child of its node, the least and greatest distance to the
   child's rows, over all rows; the origin does so too, which gives their norms.
3. A window of products is an annulus around the anchor, since norms are known
   within bounds.  A child is left out if for any split point, or the origin,
   the annulus' range of distances misses the child's range (triangle
   inequality).  What stays is compared exactly, leaf by leaf.
4. An anchor first meets its own block, which gives a least product for its
   positives, then the leaves that can hold better ones, then those that can
   hold a product in one of its windows.

A leaf is cut into blocks of bounded size, and anchors into packs; a block meets
a pack only if one of the pack's anchors needs the leaf.  Each meeting returns a
few rows an anchor.  So copies of one vector, which all lie in one leaf, are
spread like other rows, and no task holds more than one block and one pack.

The result is exact.  Where vectors point in all directions without order, as
random ones of many dimensions do, all distances are alike, no range misses an
annulus, and anchors meet all rows, in blocks.

Cases: a row with a null id, label or vector, or with any null or non-finite
component, takes no part; nor does one whose scaled squared length is 2**55 or
more, whose products might not fit.  Vectors of fewer components are filled up
with zeros; an empty vector is the zero vector.  Repeated rows are rows of their
own: an anchor's copies are others of its label.  Ties go to the smaller id.  An
anchor without positives, or a positive without negatives, gives no rows; so
does an empty table.  Columns besides the id, the vector and the label are not
read, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 5, (80, 100)
#: Children of a node, rows of a leaf aimed at, sampled rows that fit the tree at most, and levels at most.
WAYS, LEAF_ROWS, SAMPLE_ROWS, DEPTH = 8, 8_192, 16_384, 24
#: Rows of a block and anchors of a pack that meet in one task, and anchors whose products are held at once.
BLOCK_ROWS, PACK_ROWS, HELD = 8_192, 8_192, 256
#: Squared lengths from here on take no part: a hundred times a product must fit 64 bits.
TOO_LONG = 2.0**55
#: Narrow rows that are broadcast at most.
BROADCAST_ROWS = 200_000

ROW = "row long, vec_id long, label long, vec binary"


def _matrix(vecs: list[bytes], width: int) -> np.ndarray:
    """The vectors side by side, shorter ones filled up with zeros."""
    if all(len(v) == 4 * width for v in vecs):
        return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), width).astype(np.float64)
    return np.stack([np.frombuffer(v.ljust(4 * width, b"\0"), "<i4") for v in vecs]).astype(np.float64) if vecs else np.zeros((0, width))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers."""
    most = max((a * a).sum(axis=1).max(initial=0), (b * b).sum(axis=1).max(initial=0))
    if most < 2.0**53:  # and so are all partial sums
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class SplitTree:
    """Node k has the split points ``points[k]`` and a child for each: another node, or -1 - the number of a leaf.

    ``paths`` has the nodes and children that lead to each leaf.
    ``low[k][i, j]`` and ``high[k][i, j]`` bound the distances of split point i
    to the rows of child j; the last i is the origin.
    """

    width: int
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    paths: list[list[tuple[int, int]]] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def fit(sample: np.ndarray, leaf: int) -> SplitTree:
        """Nodes over the sample down to leaves of at most ``leaf`` sampled rows, or of equal ones."""
        tree = SplitTree(sample.shape[1])

        def grow(x: np.ndarray, path: list[tuple[int, int]]) -> int:
            chosen = tree._far_apart(x) if len(x) > max(leaf, 1) and len(path) < DEPTH else x[:0]
            near = _distances(x, chosen).argmin(axis=1) if len(chosen) > 1 else np.zeros(len(x), int)
            if len(np.unique(near)) < 2:
                tree.leaves += 1
                tree.paths.append(path)
                return -tree.leaves
            k = len(tree.points)
            tree.points.append(chosen)
            tree.children.append([])
            tree.children[k] = [grow(x[near == j], [*path, (k, j)]) for j in range(len(chosen))]
            return k

        if grow(sample, []) < 0:  # one leaf: a node of one child
            tree.points, tree.children, tree.paths = [np.zeros((1, tree.width))], [[-1]], [[(0, 0)]]
        tree.low = [np.full((len(p) + 1, len(p)), np.inf) for p in tree.points]
        tree.high = [np.full((len(p) + 1, len(p)), -np.inf) for p in tree.points]
        return tree

    @staticmethod
    def _far_apart(x: np.ndarray) -> np.ndarray:
        """Up to WAYS different rows of some spread over x, each the farthest from those before it."""
        tried = x[np.linspace(0, len(x) - 1, min(len(x), 3 * WAYS)).astype(int)]
        at, nearest = [0], _distances(tried, tried[:1])[:, 0]
        while len(at) < WAYS and nearest.max() > 0:
            at.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _distances(tried, tried[at[-1:]])[:, 0])
        return tried[at]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest split point of every node from the root on."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, at = todo.pop()
            if k < 0:
                out[at] = -1 - k
            elif len(at):
                j = _distances(x[at], self.points[k]).argmin(axis=1)
                todo += [(child, at[j == c]) for c, child in enumerate(self.children[k])]
        return out

    def ranges(self, x: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
        """(node, split point, child, least and greatest distance) of rows of known leaves."""
        for one in np.unique(leaf):
            own = x[leaf == one]
            lengths = _lengths(own)
            for k, c in self.paths[one]:
                d = np.column_stack([_distances(own, self.points[k]), lengths])
                yield from ((k, i, c, low, high) for i, (low, high) in enumerate(zip(d.min(axis=0).tolist(), d.max(axis=0).tolist())))

    def hold(self, rows: list[tuple[int, int, int, float, float]]) -> None:
        for k, i, j, low, high in rows:
            self.low[k][i, j] = min(self.low[k][i, j], low)
            self.high[k][i, j] = max(self.high[k][i, j], high)

    def reached(self, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, anchors that may have products from ``least`` to ``most`` there)."""
        lengths = _lengths(x)
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, at = todo.pop()
            if not len(at):
                continue
            if k < 0:
                yield -1 - k, at
                continue
            low, high, own = self.low[k], self.high[k], lengths[at][:, None]
            d = np.column_stack([_distances(x[at], self.points[k]), lengths[at]])
            shortest, longest = low[-1], high[-1]  # norms of each child's rows
            empty = shortest > longest
            squared = own**2 + np.where(empty, 0, longest) ** 2 - 2 * least[at][:, None]
            outer = np.sqrt(np.maximum(squared, 0))
            inner = np.sqrt(np.maximum(own**2 + np.where(empty, 0, shortest) ** 2 - 2 * most[at][:, None], 0))
            slack = 1e-6 * (1 + own + np.where(empty, 0, longest) + _lengths(self.points[k]).max())
            meets = ~empty & (squared >= -(slack**2))
            for i in range(len(low)):
                di = d[:, i : i + 1]
                meets &= (low[i] <= di + outer + slack) & (high[i] >= np.maximum(di - outer, inner - di) - slack)
            todo += [(child, at[meets[:, c]]) for c, child in enumerate(self.children[k])]


def integral(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, vec) of the rows that take part; vec holds the scaled, floored components."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(scale * flat)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                squares = np.bincount(owner, q * q, len(sizes))
            ok = np.flatnonzero(squares < TOO_LONG)  # no NaN and no infinity either
            stops = np.cumsum(sizes)
            whole = np.where(np.abs(q) < 2.0**31, q, 0).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(ok)), batch.column("label").take(pa.array(ok)), pa.array([whole[stops[i] - sizes[i] : stops[i]].tobytes() for i in ok], pa.binary())], ["vec_id", "label", "vec"]
            )

    known = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector")).where("vec_id is not null and label is not null and vector is not null")
    return known.mapInArrow(scaled, "vec_id long, label long, vec binary").withColumn("row", F.monotonically_increasing_id())


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """The indices of the k highest keys, the first among equals."""
    if len(keys) > k:
        at = np.flatnonzero(keys >= np.partition(keys, len(keys) - k)[len(keys) - k])
    else:
        at = np.arange(len(keys))
    return at[np.lexsort((at, -keys[at]))[:k]]


@dataclass
class Index:
    """All rows in blocks of the tree's leaves."""

    tree: SplitTree
    rows: DataFrame
    starts: np.ndarray
    counts: np.ndarray

    @staticmethod
    def build(rows: DataFrame) -> Index:
        """``rows`` as ``integral`` returns them."""
        rows = durable(rows)
        total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(0))).first()
        width //= 4
        every = max(1, total // SAMPLE_ROWS)
        picked = rows.where(F.pmod(F.xxhash64("vec_id", "row"), F.lit(every)) == 0).limit(SAMPLE_ROWS).orderBy("vec_id", "row").select("vec").collect()
        tree = SplitTree.fit(_matrix([bytes(r[0]) for r in picked], width), max(1, LEAF_ROWS * len(picked) // max(1, total)))

        def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.leaf_of(_matrix(batch.column("vec").to_pylist(), width))
                yield batch.append_column("leaf", pa.array(leaf, pa.int64()))

        dealt = durable(rows.select("row", "vec_id", "label", "vec").mapInArrow(to_leaves, ROW + ", leaf long"))

        def to_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame(list(tree.ranges(_matrix(batch["vec"].tolist(), width), batch["leaf"].to_numpy())), columns=["node", "i", "j", "low", "high"])

        found = dealt.select("vec", "leaf").mapInPandas(to_ranges, "node int, i int, j int, low double, high double")
        tree.hold([tuple(r) for r in found.groupBy("node", "i", "j").agg(F.min("low"), F.max("high")).collect()])  # a few for each split point
        counts = np.ones(tree.leaves, np.int64)
        for leaf, n in dealt.groupBy("leaf").count().collect():  # one row a leaf
            counts[leaf] = -(-n // BLOCK_ROWS)
        starts = np.cumsum(counts) - counts
        blocks = dealt.sparkSession.createDataFrame(list(zip(range(tree.leaves), starts.tolist(), counts.tolist())), "leaf long, start long, parts long")
        spread = dealt.join(F.broadcast(blocks), "leaf").withColumn("block", F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts")))  # as many rows as leaves
        return Index(tree, spread.select("row", "vec_id", "label", "vec", "block"), starts, counts)

    def seeds(self, anchor: Column, k: int) -> DataFrame:
        """(row, bound): the k-th best product of each anchor with its label's other rows in its own block, if there are so many."""
        width = self.tree.width

        def own(block: pd.DataFrame) -> pd.DataFrame:
            x, labels = _matrix(block["vec"].tolist(), width), block["label"].to_numpy()
            at, out = np.flatnonzero(block["anchor"].to_numpy()), []
            for a in range(0, len(at), HELD):
                for i, products in zip(at[a : a + HELD], _products(x[at[a : a + HELD]], x)):
                    same = labels == labels[i]
                    same[i] = False
                    if same.sum() >= k:
                        out.append((block["row"].iat[i], int(np.partition(products[same], -k)[-k])))
            return pd.DataFrame(out, columns=["row", "bound"], dtype="int64")

        return self.rows.withColumn("anchor", anchor).groupBy("block").applyInPandas(own, "row long, bound long")

    def met(self, anchors: DataFrame, compare, fields: str) -> DataFrame:
        """What ``compare`` finds for anchors (row, vec_id, label, vec, block, least, most, p) in the blocks that they reach.

        ``compare(anchor, products, labels, rows)`` gives (key, index) pairs,
        where ``products``, ``labels`` and ``rows`` are of a block's rows by
        ascending id; ``fields`` names the key.
        """
        tree, starts, counts = self.tree, self.starts, self.counts
        packs = max(1, -(-anchors.count() // PACK_ROWS))

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _matrix(batch["vec"].tolist(), tree.width)
                for leaf, at in tree.reached(x, batch["least"].to_numpy(np.float64), batch["most"].to_numpy(np.float64)):
                    for block in range(starts[leaf], starts[leaf] + counts[leaf]):
                        yield batch.iloc[at].assign(target=block)

        kept = anchors.select("row", "label", "vec", "p", "least", "most", F.pmod(F.xxhash64("block"), F.lit(packs)).alias("pack"))
        routed = durable(kept.mapInPandas(route, "row long, label long, vec binary, p array<long>, least double, most double, pack long, target long").drop("least", "most"))
        needed = routed.select(F.col("target").alias("block"), F.col("pack").alias("mate")).distinct()
        if needed.count() <= BROADCAST_ROWS:
            needed = F.broadcast(needed)  # its size was counted
        blocks = self.rows.join(needed, "block").withColumnRenamed("block", "target")

        def compared(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.sort_values(["vec_id", "row"], ignore_index=True)
            out = []
            if len(left) and len(right):
                a, x = _matrix(left["vec"].tolist(), tree.width), _matrix(right["vec"].tolist(), tree.width)
                labels, rows, ids = right["label"].to_numpy(), right["row"].to_numpy(), right["vec_id"].to_numpy()
                anchor = list(zip(left["row"], left["label"], left["p"]))
                for b in range(0, len(a), HELD):
                    for one, products in zip(anchor[b : b + HELD], _products(a[b : b + HELD], x)):
                        out += [(one[0], k, int(products[i]), ids[i], rows[i]) for k, i in compare(one, products, labels, rows)]
            return pd.DataFrame(out, columns=["row", fields, "product", "other_id", "other"], dtype="int64")

        return routed.groupBy("target", "pack").cogroup(blocks.groupBy("target", "mate")).applyInPandas(compared, f"row long, {fields} long, product long, other_id long, other long")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k rows of the highest products of each group, with their place from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("product"), "other_id", "other")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on ``vec_id``.  A negative's product lies between
    ``window[0] / window[1]`` of the positive's and the positive's itself.
    """
    index = Index.build(integral(rows, id_col, vector_col, F.col("label") if label is None else label, scale))
    anchors = index.rows.where(anchor)
    bounded = anchors.join(index.seeds(anchor, positives), "row", "left")
    reach = bounded.select("*", F.coalesce(F.col("bound").cast("double"), F.lit(float("-inf"))).alias("least"), F.lit(float("inf")).alias("most"), F.array().cast("array<long>").alias("p"))

    def of_label(one: tuple, products: np.ndarray, labels: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
        at = np.flatnonzero((labels == one[1]) & (others != one[0]))
        return [(0, i) for i in at[_best(products[at], positives)]]

    found = durable(_first(index.met(reach, of_label, "k"), ["row"], positives).select("row", "place", F.col("product").alias("positive_score"), F.col("other_id").alias("positive_id")))
    by_place = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"])  # a few an anchor
    wanted = anchors.join(found.groupBy("row").agg(by_place.alias("p")), "row")
    share = window[0] / window[1]
    wanted = wanted.where(F.array_max("p") >= 0).select("*", (F.array_min(F.filter("p", lambda x: x >= 0)) * share - 1).alias("least"), F.array_max("p").cast("double").alias("most"))

    def in_window(one: tuple, products: np.ndarray, labels: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
        out, at = [], np.flatnonzero(labels != one[1])
        own = products[at]
        for place, p in enumerate(one[2], 1):
            inside = np.flatnonzero((own <= p) & (window[1] * own >= window[0] * int(p)))
            out += [(place, i) for i in at[inside[_best(own[inside], negatives)]]]
        return out

    ranked = _first(index.met(wanted, in_window, "k"), ["row", "k"], negatives)
    named = ranked.select("row", "k", F.col("place").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("product").alias("negative_score"))
    both = named.join(found.withColumnRenamed("place", "k"), ["row", "k"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
