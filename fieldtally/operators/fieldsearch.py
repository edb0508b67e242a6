"""Field vectors of queries against those of all cases, in blocks.

A cell is a block of queries beside a block of cases, both by a hash of their
owner; it lies in one task, holds its queries and reads its cases in batches.
So neither memory nor what is shuffled grows with the pairs, and a selection
goes over the pairs where they are made and hands out a few rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of fields in a cell at most (about), and those from which on another task is worth while.
CELL_PAIRS, TASK_PAIRS = 100_000_000, 3_000_000
#: Fields of queries that a cell holds (about), queries and cases that are compared at a time.
QUERY_FIELDS, QUERIES, CASES = 10_000, 128, 512


def rounded9(x: np.ndarray, error: float, exact: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """To nine digits, halves up in decimal, as Spark rounds; values within ``error`` (in units of the last digit) of a half are first made again by ``exact``."""
    scaled = x * 1e9
    whole = np.rint(scaled)
    out = whole / 1e9
    near = np.flatnonzero((np.abs(np.abs(scaled - whole) - 0.5) < error) | (np.abs(x) > 1e6))
    if len(near):
        again = x.ravel()[near] if exact is None else exact(near)
        out.ravel()[near] = [float(Decimal(repr(float(v))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if math.isfinite(v) and abs(v) < 1e15 else v for v in again]
    return out


def _matrix(vecs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths; -1 where one is null or has a null."""
    lengths = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vecs.flatten()
    width = int(lengths.max(initial=0))
    own = np.arange(width) < lengths[:, None]
    out = np.zeros((len(vecs), width))
    out[own] = values.to_numpy(zero_copy_only=False)
    none = vecs.is_null().to_numpy(zero_copy_only=False)
    if values.null_count:
        none[np.repeat(np.arange(len(vecs)), lengths)[values.is_null().to_numpy(zero_copy_only=False)]] = True
    out[none], lengths[none] = 0.0, -1
    return out, lengths


def _runs(*codes: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal codes."""
    n = len(codes[0])
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    starts = np.flatnonzero(new)
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode("encode")
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


class _Group:
    """Some queries of a cell: their fields by type class, where each stands in its query's vector, and what is known of each query."""

    def __init__(self, rows: pa.Table, more: dict):
        rows = rows.sort_by([("id", "ascending"), ("position", "ascending")])
        query, self.ids = _codes(rows["id"].combine_chunks())
        place, self.positions = _codes(rows["position"].combine_chunks())
        new = _runs(query, place) == 0  # fields of one position are one place of the vector
        slot = np.cumsum(new) - 1
        self.query, self.position, self.repeated = query[new], place[new], not new.all()
        self.rank = _runs(self.query)
        self.n, self.size = len(self.ids), int(self.rank.max(initial=-1)) + 1
        self.n_places = np.bincount(self.query, minlength=self.n)
        self.at = {q: i for i, q in enumerate(self.ids.to_pylist())}
        matrix, lengths = _matrix(rows["vec"].combine_chunks())
        kind = rows["type_class"].to_pylist()
        by_class: dict = {}
        for i, t in enumerate(kind):
            if t is not None:
                by_class.setdefault(t, []).append(i)
        self.layers = {}
        for t, own in by_class.items():
            own = np.array(own)
            turn = _runs(slot[own])
            self.layers[t] = [(slot[own[turn == k]], matrix[own[turn == k]], lengths[own[turn == k]]) for k in range(turn.max() + 1)]
        self.more = [more.get(q) or {} for q in self.at]


class _Chunk:
    """Some cases with all their fields: rows in the order of owner, type class and name."""

    def __init__(self, rows: pa.Table):
        self.no, self.ids = _codes(rows["id"].combine_chunks())
        kind, classes = _codes(rows["type_class"].combine_chunks())
        self.at = {c: i for i, c in enumerate(self.ids.to_pylist())}
        self.n, self.names = len(self.ids), rows["name"].combine_chunks()
        matrix, lengths = _matrix(rows["vec"].combine_chunks())
        turn = _runs(self.no, kind)
        self.layers = {}
        for i, t in enumerate(classes.to_pylist()):
            own = [np.flatnonzero((kind == i) & (turn == k)) for k in range(turn[kind == i].max() + 1)]
            self.layers[t] = [(self.no[r], matrix[r], lengths[r], r) for r in own]


def _similarities(a: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """Dot products of at least 0, rounded; those near a half are summed in the vectors' order.  Vectors of different lengths, or with nulls, have 0."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]  # beyond it one of both has nothing
    with np.errstate(invalid="ignore", over="ignore"):
        raw = np.maximum(a @ b.T, 0.0)
        size = np.sqrt(np.max(np.einsum("ij,ij->i", a, a), initial=0.0) * np.max(np.einsum("ij,ij->i", b, b), initial=0.0))

        def in_order(near: np.ndarray) -> np.ndarray:
            i, j = np.divmod(near, raw.shape[1])
            total = np.zeros(len(near))
            for k in range(width):
                total = total + a[i, k] * b[j, k]
            return np.maximum(total, 0.0)

        out = rounded9(raw, 2e-5 * max(1.0, size if np.isfinite(size) else 1.0), in_order)
    if len(a_lengths) and len(b_lengths) and ((a_lengths != a_lengths[0]).any() or (b_lengths != a_lengths[0]).any() or a_lengths[0] < 0):
        out[(a_lengths[:, None] != b_lengths) | (a_lengths[:, None] < 0)] = 0.0
    return out


def _best(group: _Group, chunk: _Chunk, named: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Per place of the queries and case the best similarity, -1 where no field has the class; and the row of the case's field, the first by name."""
    best = np.full((len(group.query), chunk.n), -1.0)
    row, seen = (np.full(best.shape, -1, np.int64), np.full(best.shape, -2.0)) if named else (None, None)
    for t, layers in group.layers.items():
        for slots, a, a_lengths in layers:
            for cols, b, b_lengths, rows in chunk.layers.get(t, ()):
                found, cells = _similarities(a, a_lengths, b, b_lengths), np.ix_(slots, cols)
                best[cells] = np.maximum(best[cells], found)
                if named:
                    plain = np.where(np.isnan(found), -1.0, found)
                    before = seen[cells]
                    # The names of a case's fields rise with its layers; a place of several fields compares them.
                    wins = plain > before
                    if group.repeated:
                        wins |= (plain == before) & _before(chunk.names, rows, row[cells])
                    seen[cells] = np.where(wins, plain, before)
                    row[cells] = np.where(wins, rows, row[cells])
    return best, row


def _before(names: pa.Array, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether a row's name comes before that of the row found so far; nulls go first."""
    order = np.empty(len(names) + 1, np.int64)
    order[np.asarray(pc.sort_indices(names, null_placement="at_start"))] = np.arange(len(names))
    order[-1] = len(names)
    return order[rows] < order[others]


class _Scored:
    """The candidates of some queries among some cases: vectors as (place, query, case), scores, and which there are."""

    def __init__(self, group: _Group, chunk: _Chunk):
        best, _ = _best(group, chunk)
        shape = (group.n, chunk.n)
        self.group, self.chunk = group, chunk
        self.vec, self.there, total = np.zeros((group.size, *shape)), np.zeros(shape, bool), np.zeros(shape)
        for k in range(group.size):
            at = np.flatnonzero(group.rank == k)
            q, v = group.query[at], best[at]
            self.there[q] |= ~(v < 0)
            self.vec[k, q] = np.where(v < 0, 0.0, v)
            total = total + self.vec[k] * self.vec[k]
        self.score = rounded9(np.sqrt(total), 1e-5)
        for c, i in chunk.at.items():
            if c in group.at:
                self.there[group.at[c], i] = False
        for q, more in enumerate(group.more):
            for c in more.get("excluded") or ():
                if c in chunk.at:
                    self.there[q, chunk.at[c]] = False

    def rows(self, q: np.ndarray, c: np.ndarray) -> list[pa.Array]:
        own = np.arange(self.group.size) < self.group.n_places[q][:, None]
        flat = self.vec[:, q, c].T[own]
        offsets = np.concatenate([[0], np.cumsum(self.group.n_places[q])]).astype(np.int32)
        return [self.group.ids.take(pa.array(q)), self.chunk.ids.take(pa.array(c)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(self.score[q, c])]


ROW = ["query", "case_id", "vec", "score"]


class _All:
    """Every candidate."""

    names = ROW

    def __init__(self, groups: list[_Group]):
        pass

    def step(self, group: _Group, chunk: _Chunk) -> list[pa.Array] | None:
        found = _Scored(group, chunk)
        return found.rows(*np.nonzero(found.there))

    def rest(self) -> Iterator[list[pa.Array]]:
        return iter(())


class _Aligned(_All):
    """Per query field and case the best similarity and the case's field."""

    names = ["query", "case_id", "field", "similarity", "case_field"]

    def step(self, group, chunk):
        best, row = _best(group, chunk, named=True)
        at, c = np.nonzero(~(best < 0))
        take = lambda values, i: values.take(pa.array(i))
        return [take(group.ids, group.query[at]), take(chunk.ids, c), take(group.positions, group.position[at]), pa.array(best[at, c]), take(chunk.names, row[at, c])]


class _Top(_All):
    """The candidates of the highest scores, k a query; cases come in the order of their ids, so the first of equal ones stays."""

    def __init__(self, groups, k: int):
        self.k, self.kept = k, {}

    def step(self, group, chunk):
        found = _Scored(group, chunk)
        height = np.where(np.isnan(found.score), np.inf, found.score)
        height[~found.there] = -1.0
        q, picks = np.arange(group.n), []
        for _ in range(min(self.k, chunk.n)):
            c = height.argmax(axis=1)
            own = height[q, c] >= 0
            picks.append((q[own], c[own], height[q, c][own]))
            height[q, c] = -1.0
        q, c, high = (np.concatenate(x) for x in zip(*picks))
        rows = pa.table(found.rows(q, c), names=ROW)
        before = self.kept.get(id(group))
        if before is not None:
            q, high, rows = np.concatenate([before[0], q]), np.concatenate([before[1], high]), pa.concat_tables([before[2], rows])
        order = np.lexsort((np.arange(len(q)), -high, q))
        order = order[_runs(q[order]) < self.k] if len(order) else order
        self.kept[id(group)] = [q[order], high[order], rows.take(pa.array(order))]

    def rest(self):
        for _, _, rows in self.kept.values():
            yield [x.combine_chunks() for x in rows.columns]


class _Bound(_All):
    """Per query the best score of a pair of one of its first cases (``tops``) and any other."""

    names = ["query", "bound"]

    def __init__(self, groups):
        self.groups = groups
        self.bound = {id(g): np.full(g.n, -1.0) for g in groups}

    def step(self, group, chunk):
        found, bound = _Scored(group, chunk), self.bound[id(group)]
        tops = [m.get("tops") or () for m in group.more]
        for t in range(max(map(len, tops), default=0)):
            q = np.array([i for i, x in enumerate(tops) if len(x) > t])
            vec, score = np.zeros((len(q), group.size)), np.array([tops[i][t]["score"] for i in q])
            open_ = found.there[q]
            for i, j in enumerate(q):
                own = tops[j][t]
                vec[i, : len(own["vec"])] = own["vec"]
                if own["case_id"] in chunk.at:
                    open_[i, chunk.at[own["case_id"]]] = False
            product = np.zeros(open_.shape)
            for k in range(group.size):
                product = product + found.vec[k, q] * vec[:, k, None]
            squares = found.score[q] ** 2 + score[:, None] ** 2
            pair = np.sqrt(np.maximum(squares + 2 * product, 0.0)) + np.sqrt(np.maximum(squares - 2 * product, 0.0))
            bound[q] = np.maximum(bound[q], np.where(open_, pair, -1.0).max(axis=1))

    def rest(self):
        for g in self.groups:
            own = np.flatnonzero(self.bound[id(g)] >= 0)
            yield [g.ids.take(pa.array(own)), pa.array(self.bound[id(g)][own])]


class _Kept(_All):
    """The candidates whose norm can reach a query's ``bound`` with that of its first case (``t_score``)."""

    def step(self, group, chunk):
        found = _Scored(group, chunk)
        of = lambda name: np.array([math.inf if m.get("bound") is None else m[name] for m in group.more])[:, None]  # noqa: E731  without a bound there is no pair
        bound, first = of("bound"), of("t_score")
        with np.errstate(invalid="ignore"):
            far = 4 * (found.score**2 + first**2) < bound * bound - 1e-6 * np.maximum(bound, 1.0)
        return found.rows(*np.nonzero(found.there & ~far & np.isfinite(bound)))


def _cells(batches: Iterator[pa.RecordBatch], kind: Callable[[list[_Group]], _All]) -> Iterator[list[pa.Array]]:
    """Walks rows in the order of cell, side and owner: fields of queries, what is known of queries, fields of cases."""
    cell, sides, groups, work, left = None, [], None, None, None

    def compared(rows: pa.Table) -> Iterator[list[pa.Array]]:
        owner = _codes(rows["id"].combine_chunks())[0]
        starts = np.append(np.flatnonzero(_runs(owner) == 0)[::CASES], len(rows))
        for a, b in zip(starts[:-1], starts[1:]):
            chunk = _Chunk(rows.slice(a, b - a))
            for group in groups:
                out = work.step(group, chunk)
                if out is not None:
                    yield out

    def finished() -> Iterator[list[pa.Array]]:
        if left is not None and len(left):
            yield from compared(left)
        if work is not None:
            yield from work.rest()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        numbers = table["cell"].to_numpy()
        for part in np.split(np.arange(len(table)), np.flatnonzero(np.diff(numbers)) + 1):
            if not len(part):
                continue
            rows = table.slice(part[0], len(part))
            if numbers[part[0]] != cell:
                yield from finished()
                cell, sides, groups, work, left = numbers[part[0]], [], None, None, None
            side = rows["side"].to_numpy()
            if (side < 2).any():
                sides.append(rows.filter(pa.array(side < 2)))
                rows = rows.filter(pa.array(side == 2))
            if not len(rows):
                continue
            if groups is None:
                held = pa.concat_tables(sides) if sides else rows.slice(0, 0)
                own = held["side"].to_numpy() == 0
                told = held.filter(pa.array(~own))
                more = dict(zip(told["id"].to_pylist(), told["more"].to_pylist()))
                fields = held.filter(pa.array(own))
                starts = np.append(np.flatnonzero(_runs(_codes(fields["id"].combine_chunks())[0]) == 0)[::QUERIES], len(fields)) if len(fields) else np.array([0])
                groups = [_Group(fields.slice(a, b - a), more) for a, b in zip(starts[:-1], starts[1:])]
                work, sides = kind(groups), []
            # The last owner's fields may go on in the next batch; a chunk is not begun for few cases.
            left = rows if left is None or not len(left) else pa.concat_tables([left, rows])
            owner = _codes(left["id"].combine_chunks())[0]
            starts = np.flatnonzero(_runs(owner) == 0)
            if len(starts) > CASES:
                ready = int(starts[(len(starts) - 1) // CASES * CASES])
                yield from compared(left.slice(0, ready))
                left = left.slice(ready)
    yield from finished()


class FieldSearch:
    """The cases of each query by its fields: per query field the best similarity (at least 0) to a case field of the same class.

    ``queries`` and ``cases`` have (owner, position, type_class, name, vec).  A
    candidate of a query is any other owner with a field of a class that the
    query has; its vector holds the similarities of the query's fields in
    order, 0 where there is none, and its score is the vector's norm.
    """

    def __init__(self, queries: DataFrame, cases: DataFrame):
        self.queries, self.cases = queries, cases.where("owner is not null and type_class is not null")
        n, m = queries.count(), self.cases.count()
        partitions = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = max(-(-n * m // CELL_PAIRS), min(partitions, -(-n * m // TASK_PAIRS)), 1)
        self.query_blocks = max(1, -(-n // QUERY_FIELDS))
        self.case_blocks = -(-cells // self.query_blocks)
        types = dict(cases.dtypes)
        self.id, self.position, self.name = types["owner"], types["position"], types["name"]
        self.more = f"struct<excluded:array<{self.id}>,tops:array<struct<case_id:{self.id},vec:array<double>,score:double>>,bound:double,t_score:double>"

    def _walked(self, kind: type[_All], schema: str, told: DataFrame | None = None, **options) -> DataFrame:
        """What a kind of selection gives; ``told`` has (query, more) of queries."""
        block = lambda n: F.pmod(F.xxhash64("owner"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        columns = ["position", "type_class", "name", "vec"]
        no_more = F.lit(None).cast(self.more).alias("more")

        def beside(rows: DataFrame, side: int, *rest) -> DataFrame:
            placed = rows.withColumn("q", block(self.query_blocks)).withColumn("c", every(self.case_blocks)) if side < 2 else rows.withColumn("c", block(self.case_blocks)).withColumn("q", every(self.query_blocks))
            return placed.select((F.col("q") * self.case_blocks + F.col("c")).alias("cell"), F.lit(side).alias("side"), F.col("owner").alias("id"), *rest)

        rows = beside(self.queries, 0, *columns, no_more).unionByName(beside(self.cases, 2, *columns, no_more))
        if told is not None:
            types = dict(self.cases.dtypes)
            empty = [F.lit(None).cast(types[c]).alias(c) for c in columns]
            rows = rows.unionByName(beside(told.withColumnRenamed("query", "owner"), 1, *empty, F.col("more").cast(self.more).alias("more")))
        ordered = rows.repartitionById(self.query_blocks * self.case_blocks, "cell").sortWithinPartitions("cell", "side", "id", "type_class", "name")

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for arrays in _cells(batches, partial(kind, **options)):
                yield pa.RecordBatch.from_arrays(arrays, names=kind.names)

        return ordered.mapInArrow(walk, schema)

    @property
    def _rows(self) -> str:
        return f"query {self.id}, case_id {self.id}, vec array<double>, score double"

    def _told(self, rows: DataFrame | None, excluded: DataFrame | None) -> DataFrame | None:
        """(query, more) of rows (query, tops, bound, t_score), any of these, and of a few excluded cases a query."""
        if excluded is not None:
            lists = excluded.groupBy("query").agg(F.collect_list("case_id").alias("excluded"))
            rows = lists if rows is None else rows.join(lists, "query", "left")
        if rows is None:
            return None
        fields = ("excluded", "tops", "bound", "t_score")
        types = dict(zip(fields, (f"array<{self.id}>", f"array<struct<case_id:{self.id},vec:array<double>,score:double>>", "double", "double")))
        return rows.select("query", F.struct(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in fields]).alias("more"))

    def aligned(self) -> DataFrame:
        """(query, case_id, field, similarity, case_field): also of a query and itself."""
        return self._walked(_Aligned, f"query {self.id}, case_id {self.id}, field {self.position}, similarity double, case_field {self.name}")

    def candidates(self, excluded: DataFrame | None = None) -> DataFrame:
        """(query, case_id, vec, score) of all candidates but the excluded (query, case_id)."""
        return self._walked(_All, self._rows, self._told(None, excluded))

    def tops(self, k: int, excluded: DataFrame | None = None) -> DataFrame:
        """The candidates of the highest scores in each cell, k of a query, among them the first k of all."""
        return self._walked(_Top, self._rows, self._told(None, excluded), k=k)

    def bounds(self, first: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
        """(query, bound): what the best pair of a query scores at least, by its ``first`` candidates beside all others."""
        tops = first.groupBy("query").agg(F.collect_list(F.struct("case_id", "vec", "score")).alias("tops"))
        return self._walked(_Bound, f"query {self.id}, bound double", self._told(tops, excluded)).groupBy("query").agg(F.max("bound").alias("bound"))

    def within(self, bound: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
        """The candidates whose norm can reach the ``bound`` (query, bound, t_score) of their query."""
        return self._walked(_Kept, self._rows, self._told(bound, excluded))
