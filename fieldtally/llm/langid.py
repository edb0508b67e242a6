"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A whole text in small letters, in which everything but letters is one space,
gives the counts of its runs of one to three characters, each hashed to a slot.
Damped counts times learned document frequencies, scaled to length one, are the
inputs of a multinomial logistic regression.  It is trained by
follow-the-regularised-leader with an elastic net, whose absolute penalty leaves
most weights zero; only slots with a weight are kept.  A temperature, fitted on
a part of the sample that training didn't see, calibrates the probabilities.

The sample is bounded: of each language the documents of the smallest hashes of
their id, a fixed number and a fixed number of bytes at most; a text that
doesn't fit any more is passed over.

Cases: a null text, or one without any letter, is ``und`` with score 0.  Rows
without a language are not learned from; of rows of one id the text of the
smallest hash with its language is.  Of more than LANGUAGES languages the most
frequent are learned.  Without anything to learn from every text is ``und``, and
a warning says so; with one language only every text with a letter is of it.
Equal texts are equally predicted, so repeated rows and ties are too; between
equal probabilities the first language by name holds.  A very long text is read
in parts, as if whole.  Language, source and id are no inputs.  Columns besides
the id, the text and the language are not read, and may have any names.  An
empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, durable

MODULUS, HELD_OUT = 3, 1
#: The training sample: languages, documents of each, and bytes of all at most.
LANGUAGES, PER_LANGUAGE, MOST_BYTES = 64, 1_200, 16_000_000
#: Slots of hashed n-grams, and characters that are read at a time.
SLOTS, PART = 1 << 16, 1 << 20
#: Step size and its offset, absolute and squared penalties, passes over the sample; every FOLD-th text calibrates.
ALPHA, BETA, ABSOLUTE, SQUARED, PASSES, FOLD = 1.0, 1.0, 0.05, 0.01, 3, 5
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@cache
def _letters() -> np.ndarray:
    """Which code points are letters or marks that belong to them."""
    import unicodedata

    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


def ngram_counts(text: str) -> np.ndarray:
    """How often each slot's n-grams of one to three characters occur; a text has a space before and behind it."""
    counts, letters = np.zeros(SLOTS, np.int64), _letters()
    tail = np.array([32], np.uint32)
    low = text.lower()
    for a in range(0, len(low), PART):
        codes = np.frombuffer(low[a : a + PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters[codes], codes, np.uint32(32))
        if a + PART >= len(low):
            codes = np.append(codes, np.uint32(32))
        kept = (codes != 32) | (np.append(tail[-1:], codes[:-1]) != 32)  # one space for a run of them
        codes = np.concatenate([tail, codes[kept]]).astype(np.uint64)
        fresh = len(codes) - len(tail)
        hashed = codes
        slots = []
        for n in (1, 2, 3):  # those n-grams that end in this part
            if n > 1:
                hashed = hashed[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            new = hashed[max(0, len(hashed) - fresh) :]
            slots.append((new + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48))
        counts += np.bincount(np.concatenate(slots).astype(np.int64), minlength=SLOTS)
        tail = codes[-2:].astype(np.uint32)
    return counts


def damped(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, 1 + ln count) of a text."""
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    """Weights of the slots that have any (``place`` is a slot's row, the last one being zero), biases, and the temperature."""

    languages: tuple[str, ...] = ()
    idf: np.ndarray | None = None
    place: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def margins(self, text: str) -> np.ndarray:
        at, tf = damped(text)
        x = tf * self.idf[at]
        return (x @ self.weights[self.place[at]]) / max(float(np.sqrt(x @ x)), 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        p = _softmax(self.margins(text) / self.temperature)
        return self.languages[int(p.argmax())], round(float(p.max()), 6)

    @staticmethod
    def fit(texts: list[str], names: list[str]) -> LanguageModel:
        languages = tuple(sorted(set(names)))
        if len(languages) < 2:
            return LanguageModel(languages)
        rows = [damped(t) for t in texts]
        y = np.array([languages.index(n) for n in names])
        df = np.bincount(np.concatenate([at for at, _ in rows]), minlength=SLOTS)
        idf = np.log((1 + len(rows)) / (1 + df)) + 1
        inputs = []
        for at, tf in rows:
            x = tf * idf[at]
            inputs.append((at, x / max(float(np.sqrt(x @ x)), 1e-12)))
        order = np.random.default_rng(11).permutation(len(rows))
        calibrating = order[::FOLD]
        training = np.setdiff1d(order, calibrating)
        if len(np.unique(y[training])) < len(languages):
            training = order  # a language with a single text
        weights, bias = follow_the_leader([inputs[i] for i in training], y[training], len(languages))
        z = np.stack([x @ weights[at] + bias for at, x in (inputs[i] for i in calibrating)])
        used = np.flatnonzero((weights != 0).any(axis=1))
        place = np.full(SLOTS, len(used), np.int32)
        place[used] = np.arange(len(used))
        return LanguageModel(languages, idf, place, np.vstack([weights[used], np.zeros(len(languages))]), bias, fitted_temperature(z, y[calibrating]))


def follow_the_leader(inputs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by per-coordinate FTRL; classes weigh the same, whatever their numbers."""
    z, n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))
    weigh = len(y) / (classes * np.bincount(y, minlength=classes))

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= ABSOLUTE, 0.0, (np.sign(z) * ABSOLUTE - z) / ((BETA + np.sqrt(n)) / ALPHA + SQUARED))

    rng = np.random.default_rng(5)
    for _ in range(PASSES):
        for i in rng.permutation(len(y)):
            at, x = np.append(inputs[i][0], SLOTS), np.append(inputs[i][1], 1.0)  # the last slot is the bias
            za, na = z[at], n[at]
            w = solved(za, na)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = weigh[y[i]] * x[:, None] * p
            squares = na + g * g
            z[at] = za + g - (np.sqrt(squares) - np.sqrt(na)) / ALPHA * w
            n[at] = squares
    w = solved(z, n)
    return w[:-1], w[-1]


def fitted_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section over its logarithm."""

    def loss(t: float) -> float:
        p = _softmax(z / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    low, high, ratio = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def language_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample outside the held-out fold."""
    known = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("i is not null and text is not null and lang is not null").where(crc_remainder("i", MODULUS) != HELD_OUT)
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return [], []
    # The smallest hashes: twice the expected share of them, so that a hot language is cut down before anything is shuffled.
    h = F.pmod(F.xxhash64("i"), F.lit(1 << 40)).alias("h")
    share = known.sparkSession.createDataFrame([(r[0], min(1 << 40, int((1 << 40) * 2.0 * PER_LANGUAGE / r[1]) + 1)) for r in sizes], "lang string, below long")
    near = known.join(F.broadcast(share), "lang").select("i", "lang", h, "below", "text").where("h < below")  # at most LANGUAGES rows
    once = near.groupBy("i", "h").agg(F.min(F.struct(F.xxhash64("text").alias("k"), "lang", "text")).alias("r")).select("i", "h", "r.lang", "r.text")
    held = durable(once)
    most, texts, names = MOST_BYTES // len(sizes), [], []
    for lang, _ in sorted((r[0], r[1]) for r in sizes):
        rows = held.where(F.col("lang") == lang).orderBy("h", "i").limit(PER_LANGUAGE)
        left, kept = most, []
        for i, n in rows.select("i", F.octet_length("text")).collect():
            if n <= left:
                kept.append(i)
                left -= n
        for _, text in sorted(tuple(r) for r in rows.where(F.col("i").isin(kept)).select("i", "text").collect()):
            texts.append(text)
            names.append(lang)
    return texts, names


def train_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    texts, names = language_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    told = [(t, n) for t, n in zip(texts, names) if has_letter(t)]
    if not told:
        warnings.warn("no texts with a language: every text is unknown", stacklevel=2)
        return LanguageModel()
    return LanguageModel.fit(*map(list, zip(*told)))


def language(model: LanguageModel, text: Column) -> Column:
    """A struct of the language and its probability."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)
