"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Every document becomes ids of a word-level BPE tokenizer plus one end id.  A
document is cut at multiples of the capacity; those full pieces are sequences
of their own.  What remains of each document is gathered, in near-equal pieces
of at most ``piece`` tokens, within its Spark partition into blocks that fill
``block_windows`` windows but for a small slack.  A block is spread over its
windows by multiway differencing: partial partitions with opposing imbalances
are merged until one near-equal partition is left.  Whenever a window exceeds
the capacity, the number of windows rises by one and the block is partitioned
again; nothing is cut afterwards.  Nothing is shuffled; a partition holds one
block at a time.

Cases: a null text is an empty text, whose only token is the end id.  A null
document id stays null.  Repeated rows are packed as often as they occur.  A
very long text gives full sequences one after the other.  Of pieces of equal
size the earlier goes first, so that equal partitions are packed equally.
Columns besides the id and the text are not read, and may have any names.  An
empty table gives no sequences.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
#: Windows of a block, the share of them that is left free, and tokens of a piece that is packed.
BLOCK_WINDOWS, SLACK, PIECE = 32, 0.006, 1024
#: Words whose ids a Python worker keeps at most, and their characters together.
MOST_WORDS, MOST_CHARS = 600_000, 32_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class WordTokenizer:
    """Ids of a word BPE file of the ``tokenizers`` library, word by word.

    The merges never cross white space, so each distinct white-space-delimited
    word is encoded once: its pieces go through ``tiktoken`` with the file's
    own vocabulary as ranks (the word end is one extra byte), which gives the
    ids of the ``tokenizers`` library several times faster.  Texts with
    characters on which the two notions of white space differ go to the
    library itself.
    """

    END = "\x01"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        suffix = spec["model"]["end_of_word_suffix"]
        ranks: dict[bytes, int] = {}
        self.is_end = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        for token, i in spec["model"]["vocab"].items():
            if i not in special:
                ends = token.endswith(suffix)
                ranks[bytes(byte_of[c] for c in token.removesuffix(suffix)) + self.END.encode() * ends] = i
                self.is_end[i] = ends
        self.words = tiktoken.Encoding("words", pat_str="[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.odd = regex.compile("[\x01\x1c-\x1f᠎​]").search
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def _learn(self, words: list[str]) -> None:
        """Encodes the words together and keeps each one's ids as bytes."""
        # Lower case goes character by character: a capital sigma never becomes a final one.
        split = [self.pieces(unicodedata.normalize("NFC", w).replace("Σ", "σ").lower()) for w in words]
        flat = [p for pieces in split for p in pieces]
        ids = np.array(self.words.encode_ordinary(self.END.join(flat) + self.END) if flat else [], np.uint32)
        after = np.concatenate([[0], np.flatnonzero(self.is_end[ids]) + 1])
        at = after[np.cumsum([0] + [len(p) for p in split])].tolist()
        data = ids.tobytes()
        self.known.update((w, data[4 * a : 4 * b]) for w, a, b in zip(words, at, at[1:]))

    def __call__(self, text: str) -> np.ndarray:
        """The ids as uint32."""
        if self.odd(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        words = text.split()
        if len(self.known) > MOST_WORDS or self.chars > MOST_CHARS:
            self.known.clear()
            self.chars = 0
        if new := [w for w in set(words) if w not in self.known]:
            self._learn(new)
            self.chars += sum(map(len, new))
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` near-equal parts, by Karmarkar-Karp multiway differencing."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = size  # sums stay in descending order
        heap.append((-size, i, sums, [[i]] + [[] for _ in range(k - 1)]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, parts_a = heapq.heappop(heap)
        _, _, b, parts_b = heapq.heappop(heap)
        sums = a + b[::-1]  # the fullest part of one with the emptiest of the other
        order = np.argsort(-sums, kind="stable")
        parts = [parts_a[j] + parts_b[k - 1 - j] for j in order.tolist()]
        sums = sums[order]
        sums -= sums[-1]  # only differences matter
        serial += 1
        heapq.heappush(heap, (-int(sums[0]), serial, sums, parts))
    return heap[0][3] if heap else [[] for _ in range(k)]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` in near-equal windows within ``capacity``; their number rises whenever one exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = [p for p in differencing(sizes, k) if p]
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


class _Packer:
    """The pieces of one Spark partition, block by block."""

    def __init__(self, partition: int, capacity: int, block_windows: int, slack: float, piece: int):
        self.capacity, self.piece, self.target = capacity, min(piece, capacity), max(1, int(capacity * block_windows * (1 - slack)))
        self.next_sequence = partition << 33
        self.pending: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset, total = 0, sum(len(p[2]) for p in pieces)
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.next_sequence, offset, total))
            offset += len(ids)
        self.next_sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        full = n - n % self.capacity
        for start in range(0, full, self.capacity):
            self._emit([(doc_id, start, ids[start : start + self.capacity], n)])
        while full < n:  # the last document of a block is cut where the block is full
            take = min(n - full, self.target - self.tokens)
            m = -(-take // self.piece)
            cuts = [full + take * i // m for i in range(m + 1)]
            self.pending += [(doc_id, a, ids[a:b], n) for a, b in zip(cuts, cuts[1:])]
            full += take
            self.tokens += take
            if self.tokens == self.target:
                self.flush()

    def flush(self) -> None:
        parts = windows([len(p[2]) for p in self.pending], self.capacity) if self.pending else []
        if sum(map(len, parts)) != len(self.pending):
            raise AssertionError("a piece was not packed")
        for part in parts:
            self._emit([self.pending[i] for i in part])
        self.pending, self.tokens = [], 0


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_windows: int = BLOCK_WINDOWS,
    slack: float = SLACK,
    piece: int = PIECE,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``sequence_tokens`` is the fill of the piece's sequence.  ``sequence_id``
    holds the Spark partition in its upper bits; a partition that is computed
    again gives the same ids, because it reads the same rows.
    """
    from pyspark import TaskContext

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId(), capacity, block_windows, slack, piece)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, np.concatenate([encode(text.as_py() or ""), end]))
                if len(packer.rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packer.rows)], schema=schema)
                    packer.rows = []
        packer.flush()
        if packer.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packer.rows)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
