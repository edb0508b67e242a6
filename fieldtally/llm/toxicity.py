"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a whole text are the densities of a lexicon (words and word
beginnings, learned from the training rows by a likelihood-ratio test), the
nearness of its hits to second-person words, and the rates of capitals,
punctuation, obfuscated and stretched words.  Histogram-based boosted trees of
depth three give a margin; pool-adjacent-violators on out-of-fold margins turns
it into a probability.

Cases: a null or empty text has all features zero.  Without labelled rows of
both classes every score is the smoothed share of label 1, and a warning says
so.  Labels, language, source and id are no inputs.  Equal texts score equally,
so repeated rows and ties do too.  A very long text is read as a whole.
Columns besides the text are not read, and may have any names.  An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: The training sample: rows and bytes of each label at most (one text at least).
PER_CLASS, MOST_BYTES = 2500, 12_000_000
#: A lexicon entry: letters of a word beginning, least likelihood ratio, least toxic documents and their share, least lift.
STEM, LEAST_G2, LEAST_DOCS, LEAST_SHARE, LEAST_LIFT = 4, 30.0, 4, 0.02, 6.0
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE, FOLDS = 30, 3, 0.2, 32, 3, 1.0, 10
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself ya u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes tú ti vosotros os vuestro".split())
LEET = str.maketrans("013457@$!|", "oleastasil")

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!|*]+[^\W\d_]+)+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SHOUTED = re.compile(r"\b[A-Z]{3,}\b")
_MARKS = re.compile(r"[!-/:-@\[-`{-~]")
FEATURES = ("hits", "hit_rate", "distinct_hits", "strongest_hit", "strength_rate", "plain_obfuscated_hits", "near_second_person", "second_person_rate", "capital_rate", "shouted_rate", "exclamation_rate", "punctuation_rate", "obfuscation_rate", "stretched_rate", "length")


@dataclass(frozen=True)
class Lexicon:
    """Entries with the logarithm of how much more often toxic documents hold them."""

    words: dict = field(default_factory=dict)
    stems: dict = field(default_factory=dict)

    @staticmethod
    def learn(texts: list[str], labels: list[int]) -> Lexicon:
        """Words and word beginnings that toxic documents hold significantly more often."""
        toxic, clean = sum(labels), len(labels) - sum(labels)

        def telling(entries: Iterator[set]) -> dict:
            pos, neg = Counter(), Counter()
            for found, y in zip(entries, labels):
                (pos if y else neg).update(found)
            out = {}
            for entry, p in sorted(pos.items()):
                n = neg[entry]
                if p >= max(LEAST_DOCS, LEAST_SHARE * toxic) and p / toxic > LEAST_LIFT * (n + 0.5) / (clean + 1):
                    share = (p + n) / (toxic + clean)
                    g2 = 2 * (p * np.log(p / (toxic * share)) + (n * np.log(n / (clean * share)) if n else 0))
                    if g2 >= LEAST_G2:
                        out[entry] = float(np.log((p / toxic) / ((n + 0.5) / (clean + 1))))
            return out

        found = [set(_WORD.findall(t.lower())) for t in texts]
        return Lexicon(telling(iter(found)), telling({w[:STEM] for w in ws if len(w) > STEM} for ws in found))

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = _WORD.findall(low)
        n, size = len(words) or 1, len(text) or 1
        lexicon, stems = self.words, self.stems
        heads = [w[:STEM] for w in words]
        hits: dict[int, float] = {}  # place: strength of the word or, if it goes on, its beginning
        if not (lexicon.keys().isdisjoint(words) and stems.keys().isdisjoint(heads)):
            found = [max(lexicon.get(w, 0.0), stems.get(h, 0.0) if len(w) > STEM else 0.0) for w, h in zip(words, heads)]
            hits = {i: x for i, x in enumerate(found) if x > 0}
        mixed = _MIXED.findall(low)
        plain = sum(1 for w in mixed if w.translate(LEET) in lexicon or w.replace("*", "") in lexicon)
        you = [] if SECOND_PERSON.isdisjoint(words) else [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if you and hits:
            at, spots = np.array([*hits]), np.array(you)
            k = np.searchsorted(spots, at)
            gap = np.minimum(np.abs(at - spots[np.minimum(k, len(spots) - 1)]), np.abs(at - spots[np.maximum(k - 1, 0)]))
            near = float((gap <= NEAR).mean())
        capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return [
            len(hits), len(hits) / n, len({heads[i] for i in hits}), max(hits.values(), default=0.0), sum(hits.values()) / n,
            plain, near, len(you) / n, capitals / size, len(_SHOUTED.findall(text)) / n, text.count("!") / size,
            len(_MARKS.findall(text)) / size, len(mixed) / n, len(_STRETCHED.findall(low)) / n, np.log1p(n),
        ]


@dataclass
class BoostedTrees:
    """Complete trees of one depth: per tree the split features and thresholds level by level, and the leaf values."""

    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _leaf(x: np.ndarray, features: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), features[node]] > thresholds[node])
        return node - (2**DEPTH - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t, v in zip(self.features, self.thresholds, self.values):
            out += v[self._leaf(x, f, t)]
        return out

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        """Second-order boosting of the weighted log loss on quantile histograms."""
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        # A column that is mostly zero still gets a split between zero and the rest.
        edges = [np.unique(np.concatenate([e, np.quantile(c[c > 0], [0, 0.25, 0.5]) * 0.999])) if (c > 0).any() else e for c, e in zip(x.T, edges)]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
        share = float((w * y).sum() / w.sum())
        model = BoostedTrees(base=float(np.log(share / (1 - share))))
        margin = np.full(len(y), model.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (p - y), w * p * (1 - p)
            features, thresholds = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    at = np.flatnonzero(node == k)
                    best = (1e-6, 0, np.inf)
                    for f in range(len(edges)) if len(at) >= 2 * LEAST_ROWS else ():
                        size = len(edges[f]) + 1
                        gs, hs, cs = (np.cumsum(np.bincount(binned[f, at], weights, size))[:-1] for weights in (g[at], h[at], None))
                        gt, ht = g[at].sum(), h[at].sum()
                        gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                        gain[(cs < LEAST_ROWS) | (len(at) - cs < LEAST_ROWS)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), f, edges[f][gain.argmax()])
                    features[k], thresholds[k] = best[1], best[2]
                    node[at] = 2 * k + 1 + (x[at, best[1]] > best[2])
            leaf = node - (2**DEPTH - 1)
            values = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
            margin += values[leaf]
            model.features.append(features)
            model.thresholds.append(thresholds)
            model.values.append(values)
        return model


def isotonic(margins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing weighted least-squares fit."""
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []  # weighted sum, weight, first margin, last margin
    for m, v, k in zip(margins[order], y[order], w[order]):
        blocks.append([v * k, k, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, k2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + k2, blocks[-1][2], last]
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return xs, ys


@dataclass
class ToxicityModel:
    lexicon: Lexicon = field(default_factory=Lexicon)
    trees: BoostedTrees = field(default_factory=BoostedTrees)
    knots: tuple = ()
    constant: float | None = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant or 0.0)
        x = np.array([self.lexicon.features(t) for t in texts], np.float64)
        return np.round(np.interp(self.trees.margin(x), *self.knots), 6)

    @staticmethod
    def fit(texts: list[str], labels: list[int], class_sizes: list[int]) -> ToxicityModel:
        """class_sizes: how many rows of each label the sample stands for."""
        lexicon = Lexicon.learn(texts, labels)
        x, y = np.array([lexicon.features(t) for t in texts], np.float64), np.array(labels, np.float64)
        w = np.where(y == 1, class_sizes[1] / y.sum(), class_sizes[0] / (1 - y).sum())
        w /= w.mean()
        fold = np.random.default_rng(3).permutation(len(y)) % FOLDS
        out = np.zeros(len(y))
        for k in range(FOLDS):
            train = fold != k
            if 0 < y[train].sum() < train.sum():
                out[~train] = BoostedTrees.fit(x[train], y[train], w[train]).margin(x[~train])
        return ToxicityModel(lexicon, BoostedTrees.fit(x, y, w), isotonic(out, y, w))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """The model, trained on at most PER_CLASS labelled documents of each class outside the held-out fold."""
    texts, y, counts = labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, PER_CLASS, MOST_BYTES, id_col=id_col, text_col=text_col)
    if len(set(y)) < 2:
        return ToxicityModel(constant=(counts[1] + 1) / (sum(counts) + 2))
    return ToxicityModel.fit(texts, y, counts)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The probability of label 1 as a double."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()), dtype="float64")

    return score(text)


def keep_civil(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    return docs.where(toxicity_score(train_toxicity(docs, labels, id_col=id_col, text_col=text_col), F.col(text_col)) < threshold)
