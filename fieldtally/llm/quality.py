"""Quality classifier: a byte-level convolutional network in numpy.

A text is read as UTF-8 bytes.  A convolution of learned filters, each four
bytes wide, runs over every byte.  Chunks of 128 bytes that overlap by half
cover the whole document; in each chunk every filter gives its mean and its
maximum, so that a chunk in which few different bytes follow each other shows
by low maxima.  A learned layer takes these, its units are max-pooled over the
chunks and combined into one probability.  All inputs are bytes; all weights
are learned, by back-propagation with Adam on a bounded labelled sample.  Only
chunks that won a maximum carry gradients.

Cases: a null or empty text scores like a document of one empty chunk.  Without
labelled rows of both classes every score is the smoothed share of label 1, and
a warning says so.  Labels, language, source and id are no inputs.  Equal texts
score equally, so repeated rows and ties do too.  A very long text is convolved
in segments, as if whole.  Columns besides the text are not read, and may have
any names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

BLOCK, WIDTH, FILTERS, UNITS = 64, 4, 12, 8
#: The training sample: rows and bytes of each label at most (one text at least); and how training runs.
PER_CLASS, MOST_BYTES, EPOCHS, BATCH, RATE = 1200, 6_000_000, 4, 16, 0.015
#: Bytes that are convolved at a time; a multiple of BLOCK.
SEGMENT = BLOCK * 128
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0
NAMES = ("tables", "bias", "layer", "layer_bias", "out", "out_bias")


def _normal(seed: int, scale: float, *shape: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, scale, shape).astype(np.float32)


@dataclass
class ByteNetwork:
    """Parameters; ``constant`` is set instead where there was nothing to learn from."""

    seed: int = 7
    tables: np.ndarray = field(init=False)
    bias: np.ndarray = field(init=False)
    layer: np.ndarray = field(init=False)
    layer_bias: np.ndarray = field(init=False)
    out: np.ndarray = field(init=False)
    out_bias: np.ndarray = field(init=False)
    constant: float | None = None
    pairs: list[np.ndarray] | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        self.tables = _normal(self.seed, 0.25, WIDTH, 257, FILTERS)
        self.bias = np.full(FILTERS, 0.1, np.float32)
        self.layer = _normal(self.seed + 1, 0.3, 2 * FILTERS, UNITS)
        self.layer_bias = np.zeros(UNITS, np.float32)
        self.out = _normal(self.seed + 2, 0.3, UNITS)
        self.out_bias = np.zeros(1, np.float32)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "pairs": None}  # large, and made again where it is needed

    def paired(self) -> list[np.ndarray]:
        """The filters' sums for two bytes in a row, so that a place costs two look-ups instead of four."""
        if self.pairs is None:
            both = [(self.tables[j][:, None, :] + self.tables[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, WIDTH, 2)]
            self.pairs = [both[0] + self.bias, *both[1:]]
        return self.pairs

    def activations(self, codes: np.ndarray) -> np.ndarray:
        """The convolution's (len(codes) - WIDTH + 1) x FILTERS outputs; codes has WIDTH - 1 more at its end."""
        n = len(codes) - WIDTH + 1
        two = codes[:-1] * 257 + codes[1:]
        first, *others = self.paired()
        h = first.take(two[:n], axis=0, mode="clip")
        for j, table in enumerate(others, 1):
            h += table.take(two[2 * j : 2 * j + n], axis=0, mode="clip")
        return np.maximum(h, 0, out=h)

    def chunks(self, data: bytes) -> np.ndarray:
        """The mean and maximum activations of every chunk, side by side."""
        n = max(len(data), 1)
        codes = np.full(n + WIDTH - 1, 256, np.int64)
        codes[: len(data)] = np.frombuffer(data, np.uint8)
        sums, tops = [], []
        for a in range(0, n, SEGMENT):
            h = self.activations(codes[a : min(n, a + SEGMENT) + WIDTH - 1])
            blocks = np.zeros((FILTERS, -(-len(h) // BLOCK), BLOCK), h.dtype)  # zeros change neither sum nor maximum
            blocks.reshape(FILTERS, -1)[:, : len(h)] = h.T
            sums.append(blocks.sum(axis=2).T)
            tops.append(blocks.max(axis=2).T)
        blocks, tops = np.concatenate(sums), np.concatenate(tops)
        sizes = np.full(len(blocks), BLOCK, np.float32)
        sizes[-1] = n - BLOCK * (len(blocks) - 1)
        if len(blocks) == 1:
            return np.concatenate([blocks / sizes[:, None], tops], axis=1)
        return np.concatenate([(blocks[:-1] + blocks[1:]) / (sizes[:-1] + sizes[1:])[:, None], np.maximum(tops[:-1], tops[1:])], axis=1)

    def margin(self, text: str | None) -> float:
        z = np.maximum(self.chunks((text or "").encode("utf-8", "surrogatepass")) @ self.layer + self.layer_bias, 0).max(axis=0)
        return float(z @ self.out + self.out_bias[0])

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return round(float(1 / (1 + np.exp(-np.clip(self.margin(text), -30, 30)))), 6)

    def gradients(self, data: bytes, label: float, weight: float, grads: dict[str, np.ndarray]) -> None:
        """Adds one document's gradients of the weighted log loss."""
        chunks = self.chunks(data)
        z = chunks @ self.layer + self.layer_bias
        winners = z.argmax(axis=0)
        top = np.maximum(z[winners, np.arange(UNITS)], 0)
        delta = weight * (1 / (1 + np.exp(-np.clip(top @ self.out + self.out_bias[0], -30, 30))) - label)
        grads["out"] += delta * top
        grads["out_bias"] += delta
        dz = delta * self.out * (top > 0)
        grads["layer"] += chunks[winners].T * dz
        grads["layer_bias"] += dz
        if not (won := np.unique(winners[dz != 0])).size:
            return
        # The winning chunks side by side, each with the bytes behind it; what lies beyond a chunk counts nothing.
        n, size = max(len(data), 1), 2 * BLOCK
        codes = np.full(n + size + WIDTH, 256, np.int64)
        codes[: len(data)] = np.frombuffer(data, np.uint8)
        h = np.stack([self.activations(codes[a : a + size + WIDTH - 1]) for a in (won * BLOCK).tolist()])
        lengths = np.minimum(n - won * BLOCK, size)
        h *= (np.arange(size) < lengths[:, None])[:, :, None]
        back = np.stack([(self.layer * (dz * (winners == k))).sum(axis=1) for k in won])
        dh = np.repeat((back[:, :FILTERS] / lengths[:, None])[:, None, :], size, axis=1)
        dh[np.arange(len(won))[:, None], h.argmax(axis=1), np.arange(FILTERS)] += back[:, FILTERS:]
        dh = (dh * (h > 0)).reshape(-1, FILTERS)
        grads["bias"] += dh.sum(axis=0)
        places = (won[:, None] * BLOCK + np.arange(size)).ravel()
        for j in range(WIDTH):
            seen = codes[places + j]
            order = np.argsort(seen, kind="stable")
            values, starts = np.unique(seen[order], return_index=True)
            grads["tables"][j][values] += np.add.reduceat(dh[order], starts, axis=0)

    def train(self, texts: list[str], labels: list[int], *, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE) -> ByteNetwork:
        """Adam over the sample, both classes weighing the same."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        y = np.array(labels, np.float64)
        weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        first = {k: np.zeros_like(getattr(self, k)) for k in NAMES}
        second = {k: np.zeros_like(getattr(self, k)) for k in NAMES}
        rng, step = np.random.default_rng(self.seed + 4), 0
        steps = max(epochs * -(-len(data) // batch), 400)  # a small sample is seen more often
        while step < steps:
            order = rng.permutation(len(data))
            for a in range(0, len(order), batch):
                grads = {k: np.zeros_like(getattr(self, k)) for k in NAMES}
                at, self.pairs = order[a : a + batch], None
                for i in at:
                    self.gradients(data[i], y[i], weights[i] / len(at), grads)
                step += 1
                fall = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                for k in NAMES:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                    getattr(self, k)[...] -= fall * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        self.pairs = None
        return self


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> ByteNetwork:
    """The network, trained on at most PER_CLASS labelled documents of each class outside the held-out fold."""
    texts, y, counts = labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, PER_CLASS, MOST_BYTES, id_col=id_col, text_col=text_col)
    if len(set(y)) < 2:
        return ByteNetwork(constant=(counts[1] + 1) / (sum(counts) + 2))
    return ByteNetwork().train(texts, y)


def quality_score(model: ByteNetwork, text: Column) -> Column:
    """The probability of label 1 as a double."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    return docs.where(quality_score(train_quality(docs, labels, id_col=id_col, text_col=text_col), F.col(text_col)) >= threshold)
