"""Resampling, hard negatives and language identification against brute force and held-out labels."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import langid, negatives, queries, resampling

ODD = [None, "", " \n", "a", "A b", "Ünïcode ΣΑΣ 日本語", "x" * 4000, "one two three " * 9000, "tab\tnew\x0bline\x00end don't 3.5", "same words here", "same words here"]


# resampling


def grams(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def drawn(docs, target, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in docs:
        for g in grams(text)[1]:
            s[bucket(g)] += 1
    for text in target:
        for g in grams(text)[1]:
            t[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        words, found = grams(text)
        weight = sum(gain[bucket(g)] for g in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2]))
    for place, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resampling_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PART", 7)  # parts end between words of a run
    rng = random.Random(2)
    texts = [*ODD, *(" ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "é"]) for _ in range(rng.randrange(60))) for _ in range(300))]
    docs = [*enumerate(texts), (None, "no id has " + "words " * 30), (5, "again an id " * 12), (5, "again an id " * 12), (2**60 + 1, "a large id " * 12)]
    target = ["alpha beta gamma", None, "é é delta"]
    own = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(own, aim)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == drawn(docs, target)
    assert resampling.resampled(own.limit(0), aim).count() == 0
    assert resampling.resampled(own.limit(3), aim.limit(0)).where("rank is not null").count() == 0


def test_spans_of_any_length_are_hashed():
    for text in ODD:
        words, n, kept = resampling.features(text)
        want = [zlib.crc32(g.encode()) % 10_000 for g in grams(text)[1]]
        assert (words, n) == (len(grams(text)[0]), len(want))
        values = np.arange(10_000) ** 2
        assert resampling.bucket_values(kept, n, values) == sum(int(values[w]) for w in want)


# hard negatives


def mined(rows, positives=5, negatives_=5):
    """By every pair; rows are (id, label, integer components)."""
    out = []
    width = max(len(q) for _, _, q in rows)
    q = np.array([list(q) + [0] * (width - len(q)) for _, _, q in rows], object)
    for k, (i, label, _) in enumerate(rows):
        if i % 100:
            continue
        scores = [(-int(q[k] @ q[m]), rows[m][0], rows[m][1]) for m in range(len(rows)) if m != k]
        for p, other, own in sorted(x for x in scores if x[2] == label)[:positives]:
            inside = sorted(x for x in scores if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)[:negatives_]
            out += [(i, other, rank, x[1], -p, -x[0]) for rank, x in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "copies", "short"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(negatives, "PACK_ROWS", 4)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8)) * 3
    rows = []
    for i in range(900):
        vector = (centres[i % 6] + rng.normal(size=8) * 0.2).tolist() if kind == "clustered" else [1.0, 0.5, -0.25] if i % 3 else rng.normal(size=3).tolist() if kind == "copies" else rng.normal(size=int(rng.integers(0, 5))).tolist()
        rows.append((i, int(rng.integers(0, 4)), vector))
    odd = [(901, None, [1.0]), (902, 1, None), (903, 1, [1.0, None]), (904, 1, [float("nan")]), (905, 1, [float("inf")]), (None, 1, [1.0]), (906, 1, [3e30, 1.0])]
    df = spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in [*rows, *odd]], "vec_id long, label int, embedding array<double>, vec string, row int").repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined([(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows])
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_ranges_leave_out_far_leaves():
    """Clusters far apart: an anchor reaches few leaves, and none that holds a product in its window is left out."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(8, 16))[rng.integers(0, 8, 4000)] * 4 + rng.normal(size=(4000, 16)) * 0.05))
    tree = negatives.SplitTree.fit(x[::4], 60)
    leaf = tree.leaf_of(x)
    tree.hold(list(tree.ranges(x, leaf)))
    anchors = x[:40]
    products = negatives._products(anchors, x)
    best = np.sort(products, axis=1)[:, -50].astype(float)
    met = {(int(a), k) for k, at in tree.reached(anchors, best, np.full(40, np.inf)) for a in at}
    assert {(a, int(leaf[m])) for a, m in zip(*np.nonzero(products >= best[:, None]))} <= met
    assert len(met) < 0.5 * 40 * tree.leaves


# languages


def test_languages_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op13_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(rows) == docs.count() and len(held) > 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_languages_of_odd_rows(spark):
    words = {"xx": "alpha beta gamma delta", "yy": "zeta ypsilon omega theta"}
    rows = [(i, f"{words[lang]} {i}", lang) for i, lang in enumerate(["xx", "yy"] * 20)]
    odd = [(100, None, "xx"), (101, "", "yy"), (102, "123 ½ !?", None), (103, "alpha beta " * 20_000, None), (None, "omega theta", "yy"), (1, rows[1][1], "yy")]
    docs = spark.createDataFrame([(i, t, lang, 0.5, "z") for i, t, lang in [*rows, *odd]], "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.train_languages(docs)
    got = [(r.doc_id, r.l.lang_pred, r.l.score) for r in docs.select("doc_id", langid.language(model, F.col("text")).alias("l")).collect()]
    told = {i: (lang, score) for i, lang, score in got}
    assert told[100] == told[101] == told[102] == ("und", 0.0)
    assert told[103][0] == "xx" and told[None][0] == "yy"
    assert all(told[i][0] == lang for i, _, lang in rows)
    with pytest.warns(UserWarning):
        nothing = langid.train_languages(docs.limit(0))
    assert nothing.predict("alpha") == ("und", 0.0)
    assert langid.train_languages(docs.where("lang = 'xx'")).predict("omega")[0] == "xx"


def test_grams_of_parts_equal_those_of_whole_texts(monkeypatch):
    text = "Größe, 12 İstanbul—naïve  café \n日本 x" * 5
    want = langid.ngram_counts(text)
    for part in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PART", part)
        assert (langid.ngram_counts(text) == want).all()
    assert want.sum() > 0


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=langid._softmax(r)) for r in z])
    assert abs(langid.fitted_temperature(z * 3, y) - 3) < 0.4
