"""Byte-level BPE with a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect
hash: as many slots as entries, one probe, one comparison.  A miss is merged
with a heap of candidate pairs over the linked list of its bytes: the pair of
lowest rank first, the leftmost among equals.  Results for distinct pre-tokens
are kept per Python worker, up to a bound.

Cases: a null text is an empty text: no ids, and no bytes decoded.  Texts of
any length are encoded whole; memory grows with the longest text of a batch.
Of pairs of equal rank the leftmost goes first.  Repeated rows are encoded as
often as they occur.  Columns besides the text are not read, and may have any
names.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pre-tokens whose ids a Python worker keeps at most, and their characters together.
MOST_PIECES, MOST_CHARS = 900_000, 48_000_000
BUCKET = 1
_MASK, _ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash by bucket displacement: keys of a bucket share the displacement that sends each to a slot of its own."""

    def __init__(self, keys: list[bytes]):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        n = len(keys)
        self.buckets = max(1, n // BUCKET)
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * n  # index of the key at each slot
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [self.hash(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) > 1:
                d = 1
                while True:
                    at = [self._slot(hashes[i], d, n) for i in group]
                    if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                        break
                    d += 1
                self.shift[b] = d
                for i, s in zip(group, at):
                    self.slots[s] = i
            elif group:  # a lone key takes a free slot directly, told by a negative displacement
                free = free if free is not None else iter([s for s in range(n) if self.slots[s] < 0])
                s = next(free)
                self.shift[b] = -s - 1
                self.slots[s] = group[0]
        self.keys = [keys[i] for i in self.slots]

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        x = ((h ^ (d * _ODD & _MASK)) * _ODD) & _MASK
        return (x >> 20) % n

    def find(self, key: bytes) -> int:
        """The index of the key, or -1."""
        h = self.hash(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d, len(self.keys))
        return self.slots[s] if self.keys[s] == key else -1


class BytePairCodec:
    """Encodes and decodes by a rank file (base64 token and rank per line)."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as f:
            pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
        self.tokens = {rank: token for rank, token in pairs}
        self.text_of = {rank: str(rank) for rank in self.tokens}
        self.ranks = {token: rank for rank, token in pairs}
        self.last = len(pairs) + max(self.ranks.values())  # above all ranks
        self.rank_at = [rank for rank, _ in pairs]
        self.table = PerfectHash([token for _, token in pairs])
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that is not in the vocabulary."""
        n, rank, last = len(piece), self.ranks.get, self.last
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into the one before
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2], last)) < last]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != e:
                continue  # one of its parts has been merged meanwhile
            end[i], end[middle], before[e] = e, 0, i
            if e < n and (r := rank(piece[i : end[e]], last)) < last:
                heappush(heap, (r, i, end[e]))
            if i and (r := rank(piece[before[i] : e], last)) < last:
                heappush(heap, (r, before[i], e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _resolve(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        at = self.table.find(data)
        return array("I", [self.rank_at[at]] if at >= 0 else self.merge(data)).tobytes()

    def encode(self, text: str | None) -> list[int]:
        found, known = self.pieces(text or ""), self.known
        if len(known) > MOST_PIECES or self.chars > MOST_CHARS:
            known.clear()
            self.chars = 0
        for piece in {*found}.difference(known):
            known[piece] = self._resolve(piece)
            self.chars += len(piece)
        return np.frombuffer(b"".join(map(known.__getitem__, found)), np.uint32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], BytePairCodec] = {}


def codec(ranks_path: str, pattern: str) -> BytePairCodec:
    """One per Python worker and file."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = BytePairCodec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


def encode(text: Column, ranks_path: str, pattern: str) -> Column:
    """The ids as an array of integers."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_path, pattern)
        for texts in batches:
            yield pd.Series([own.encode(t) for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The bytes that ids stand for; null for null."""

    @F.pandas_udf("binary")
    def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_path, pattern)
        for rows in batches:
            yield pd.Series([None if r is None else own.decode(list(r)) for r in rows], dtype=object)

    return data(ids)


def round_trip_digest(text: Column, ranks_path: str, pattern: str) -> Column:
    """A struct: count of ids, sha256 of the ids and of the bytes decoded from them."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(ranks_path, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                ids = own.encode(t)
                told = ",".join(map(own.text_of.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)
