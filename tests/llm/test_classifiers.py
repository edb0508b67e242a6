"""Training samples, features and boosted trees against plain versions."""

import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import common, queries, quality, toxicity


def test_sample_is_bounded_whole_and_one_row_an_id(spark):
    rows = [(i % 20, f"text {i} of {i % 20}", "x", 1) for i in range(400)] + [(100 + i, "long " * 10_000 * (i + 1), "x", 1) for i in range(6)] + [(None, "none", "x", 1)]
    docs = spark.createDataFrame([(t, i, a, b) for i, t, a, b in rows], "body string, key long, i string, label int")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20)] + [(100 + i, i % 2, None) for i in range(6)] + [(3, 1, None), (None, 1, None), (50, 1, None)], "doc_id long, toxic int, text string")
    texts, y, sizes = common.labelled_sample(docs, labels, "toxic", 3, 1, 1000, 10**9, id_col="key", text_col="body")
    ids = [i for i in [*range(20), *range(100, 106)] if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(texts) == len(ids) and sorted(len(t) for t in texts)[-1] > 100_000  # long texts train whole
    assert sum(y) == sum(i % 2 for i in ids) and sum(sizes) == len(ids) + (zlib.crc32(b"50") % 3 != 1)
    few, _, _ = common.labelled_sample(docs, labels, "toxic", 3, 1, 2, 10**9, id_col="key", text_col="body")
    assert len(few) == 4
    short, y, _ = common.labelled_sample(docs, labels, "toxic", 3, 1, 1000, 60, id_col="key", text_col="body")
    assert set(y) == {0, 1} and len(short) < len(texts)
    with pytest.warns(UserWarning):
        common.labelled_sample(docs, labels.where("toxic = 1"), "toxic", 3, 1, 5, 10**9, id_col="key", text_col="body")


def test_column_names_are_passed_on(spark):
    docs = spark.createDataFrame([(i, "you bad word" if i % 2 else "calm prose here") for i in range(60)], "key long, body string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, toxic int, quality int")
    kept = toxicity.keep_civil(docs, labels, id_col="key", text_col="body")
    assert kept.columns == docs.columns and 0 < kept.count() < 60
    assert quality.keep_good(docs, labels, id_col="key", text_col="body").columns == docs.columns


def grow(x, y, w):
    """The same boosting by trying every split of every feature on the rows themselves."""
    edges = []
    for c in x.T:
        e = set(np.quantile(c, np.linspace(0, 1, toxicity.BINS + 1)[1:-1]).tolist())
        if (c > 0).any():
            e |= {v * 0.999 for v in np.quantile(c[c > 0], [0, 0.25, 0.5]).tolist()}
        edges.append(sorted(e))
    base = np.log((w * y).sum() / (w * (1 - y)).sum())
    margin = np.full(len(y), base)
    for _ in range(toxicity.TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def split(rows, depth):
            gain, best = 1e-6, None
            if depth == toxicity.DEPTH:
                return np.full(len(rows), -toxicity.RATE * g[rows].sum() / (h[rows].sum() + toxicity.RIDGE))
            for f in range(x.shape[1]) if len(rows) >= 2 * toxicity.LEAST_ROWS else ():
                for e in edges[f]:
                    left = x[rows, f] <= e
                    if min(left.sum(), (~left).sum()) < toxicity.LEAST_ROWS:
                        continue
                    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + toxicity.RIDGE)
                    value = part(rows[left]) + part(rows[~left]) - part(rows)
                    if value > gain + 1e-12:
                        gain, best = value, left
            out = np.zeros(len(rows))
            if best is None:
                return split(rows, depth + 1) if depth + 1 < toxicity.DEPTH else np.full(len(rows), -toxicity.RATE * g[rows].sum() / (h[rows].sum() + toxicity.RIDGE))
            out[best], out[~best] = split(rows[best], depth + 1), split(rows[~best], depth + 1)
            return out

        margin = margin + split(np.arange(len(y)), 0)
    return margin


def test_trees_equal_exhaustive_splits(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    rng = np.random.default_rng(4)
    x = rng.random((120, 4)) * (rng.random((120, 4)) < [1, 0.4, 0.9, 0.1])
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.random(120) > 0.9).astype(float)
    w = np.where(y == 1, 1.5, 0.75)
    assert np.allclose(toxicity.BoostedTrees.fit(x, y, w).margin(x), grow(x, y, w), atol=1e-9)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(5)
    margins, y, w = np.sort(rng.normal(size=40)), rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.1
    xs, ys = toxicity.isotonic(margins, y, w)
    # By definition: at i the largest over starts of the least over ends of the weighted mean between them.
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(np.interp(margins, xs, ys), want)


def test_features_by_hand():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "stupid": 3.0}, {"idio": 1.5})
    names = toxicity.FEATURES
    row = dict(zip(names, lexicon.features("YOU are an idiot!! idiotic 1d10t St*pid soooo far away from this one, dear reader of words")))
    words = toxicity._WORD.findall("you are an idiot!! idiotic 1d10t st*pid soooo far away from this one, dear reader of words")
    assert row["hits"] == 2 and row["distinct_hits"] == 1 and row["strongest_hit"] == 2.0
    assert row["hit_rate"] == pytest.approx(2 / len(words)) and row["strength_rate"] == pytest.approx(3.5 / len(words))
    assert row["near_second_person"] == 1.0 and row["second_person_rate"] == pytest.approx(1 / len(words))
    assert row["shouted_rate"] == pytest.approx(1 / len(words)) and row["stretched_rate"] == pytest.approx(1 / len(words))
    assert row["exclamation_rate"] > 0 and row["capital_rate"] > 0 and row["obfuscation_rate"] > 0
    assert set(lexicon.features("")) == set(lexicon.features(None)) and lexicon.features("")[:14] == [0] * 14


def test_registered_scores(spark):
    """op3 and op10 as registered: every row once, folds by crc32, thresholds."""
    sf_dir = "/root/testdata/sf0.001"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for query, modulus, remainder, threshold in ((queries.op3_quality, 5, 0, 0.3), (queries.op10_toxicity, 3, 1, 0.7)):
            rows = query(spark, sf_dir).collect()
            assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
            for r in rows:
                assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
                assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def test_registered_fingerprints(spark):
    rows = queries.op4_simhash(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    from fieldtally.llm import simhash

    assert {r.doc_id: r.fingerprint for r in rows} == {i: simhash.fingerprint_bytes(t).hex() for i, t in docs.items()}
    null_id = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    scored = queries._scored(null_id, F.lit(0.5), 5, 0, 0.3).first()
    assert scored.held_out is False and scored.predicted == 1
