"""Near copies against all pairs."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from fieldtally.llm import near


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least(rows):
    sets = [(i, grams(t)) for i, t in rows]
    names = list(range(len(sets)))
    near_pairs = [(p, q) for p in range(len(sets)) for q in range(p) if 5 * len(sets[p][1] & sets[q][1]) >= 4 * len(sets[p][1] | sets[q][1])]
    changed = True
    while changed:
        changed = False
        for p, q in near_pairs:
            low = min(names[p], names[q])
            changed |= names[p] != low or names[q] != low
            names[p] = names[q] = low
    first = {}
    for k, (i, _) in enumerate(sets):
        first[names[k]] = min(first.get(names[k], i), i)
    return {i: first[names[k]] for k, (i, _) in enumerate(sets)}, len(near_pairs)


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


def sample(seed=3):
    rng = random.Random(seed)
    texts = ["", None, "one", "one two", "ONE  two", "a b c d e f", "a b c d e g"]
    for _ in range(40):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([30, 120, 250]))]
        texts += [" ".join(base), *(" ".join(edited(rng, base, rng.randrange(0, 8))) for _ in range(3)), "a common line of many words stands here " + " ".join(f"x{rng.randrange(900)}" for _ in range(60))]
    group = [f"g{i}" for i in range(200)]
    texts += [" ".join(edited(rng, group, rng.randrange(1, 5))) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_equal_all_pairs(spark, monkeypatch):
    rows = sample()
    want, pairs = least(rows)
    assert pairs > 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few, per_shingle in ((near.FEW_PAIRS, 20), (10, 20), (10, -1)):  # all pairs at once, pivots first, pivots and signatures
        monkeypatch.setattr(near, "FEW_PAIRS", few)
        monkeypatch.setattr(near, "PAIRS_PER_SHINGLE", per_shingle)
        assert {r.doc_id: r.component_id for r in near.near_copies(docs).collect()} == want


def test_stage_takes_near_copies_out(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(250)]
    far = [*base[:120], *(f"v{i}" for i in range(130))]
    rows = [(1, " ".join(base)), (2, " ".join(edited(rng, base, 4))), (3, " ".join(far)), (None, " ".join(base)), (4, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.stage_near_duplicates(spark, docs, "").collect()) == [0, 1, 3]
    assert corpus_pipeline.stage_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_common_shingles_and_many_buckets(spark, monkeypatch):
    """Everything is common, buckets are small, and tasks deal out what they have after a few rows."""
    rows = sample(5)
    want, _ = least(rows)
    monkeypatch.setattr(near, "COMMON_TEXTS", 1)
    monkeypatch.setattr(near, "BUCKET_ITEMS", 500)
    monkeypatch.setattr(near, "GATHERED", 300)
    monkeypatch.setattr(near, "BROADCAST_ROWS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near.near_copies(docs).collect()} == want


def test_rows_of_one_id(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(5, words, "b"), (5, words, "a"), (5, "quite another text stands under the same id", "c"), (7, words + " more", "d"), (8, "quite another text stands under the same id", "e"), (None, words, "f")]
    kept = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    assert sorted((r.doc_id or 0, r.kept) for r in kept.collect()) == [(0, "f"), (5, "a"), (5, "c")]
    assert kept.columns == ["doc_id", "text", "kept"]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(4000):
        n = int(rng.integers(1, 150))
        numbers = rng.permutation(np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64)))
        both, more = int(rng.integers(1, n + 1)), rng.integers(0, n // 5 + 1, 2)
        a = np.unique(numbers[: both + more[0]])
        b = np.unique(np.concatenate([numbers[:both], numbers[both + more[0] : both + more.sum()]]))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            met += 1
            assert len(np.intersect1d(near.signatures(a), near.signatures(b)))
    assert met > 1000
    assert not len(near.signatures(np.empty(0, np.uint64)))


def passages(n, seed=2):
    """Texts put together from five of 40 passages, few of which are similar."""
    rng = random.Random(seed)
    every = [" ".join(f"p{k}w{i}" for i in range(15)) for k in range(40)]
    return [(i, " ".join(rng.sample(every, 5))) for i in range(n)]


def test_common_passages_make_few_candidates(spark, monkeypatch):
    """What reaches the comparison grows far less than the pairs with a passage in common, which grow with the square."""
    seen, checked = [], near._verified

    def counted(pairs, nodes, texts):
        seen[-1] += pairs.count()
        return checked(pairs, nodes, texts)

    monkeypatch.setattr(near, "_verified", counted)
    monkeypatch.setattr(near, "FEW_PAIRS", 1000)
    for n in (1000, 2000):
        rows = passages(n)
        seen.append(0)
        found = {r.doc_id: r.component_id for r in near.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        if n == 1000:
            assert found == least(rows)[0]
    assert seen[1] < 3.4 * seen[0] and seen[1] < 0.06 * 2000 * 2000 / 2, seen  # all pairs with a passage in common are half of all pairs


def test_pairs_are_formed_where_their_least_shingle_says(spark):
    """Every pair that shares a shingle is still formed, and most of them once only, where a shingle has many nodes."""
    r = random.Random(5)
    passages = [[r.randrange(-(2**63), 2**63) for _ in range(30)] for _ in range(6)]
    own = {n: {s for p in r.sample(passages, 2) for s in p[: r.randint(5, 30)]} for n in range(60)}
    live = spark.createDataFrame([(s, n) for n, shingles in own.items() for s in shingles], "shingle long, node long")
    rows = live.join(live.groupBy("node").agg(*near._least("shingle")), "node")
    one, two = ([F.col("shingle").alias(f"shingle_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", *near.LEAST)]] for x in "ab")
    met = rows.select(*one).join(rows.select(*two), (F.col("shingle_a") == F.col("shingle_b")) & (F.col("node_a") > F.col("node_b")) & near._first_met("shingle_a"))
    formed = [(x.node_a, x.node_b) for x in met.select("node_a", "node_b").collect()]
    want = {(a, b) for a in own for b in own if a > b and own[a] & own[b]}
    assert set(formed) == want
    assert len(formed) < 0.3 * sum(len(own[a] & own[b]) for a, b in want)


def test_counts_tell_long_texts_apart():
    """Long sets without a hash in common are ruled out by counts, similar ones are not."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (9000, 9100, 250, 240)]
    sets += [np.unique(np.append(sets[0][400:], sets[1][:400])), np.unique(np.append(sets[2][10:], sets[3][:10]))]
    counts, n = [near.remainders(x) for x in sets], np.array([len(x) for x in sets])
    a, b = np.array([0, 2, 0, 2, 0]), np.array([1, 3, 4, 5, 2])
    assert near.may_be_alike(counts, n, a, b).tolist() == [False, False, True, True, False]
    edge = [np.arange(0, 8 * 1024, 2, dtype=np.uint64), np.arange(0, 8 * 1024 + 2, 2, dtype=np.uint64)]  # 256 and 512 remainders or more meet
    edge[0] = edge[0][:1024]
    edge[1] = edge[1][:1025]
    counts = [near.remainders(x) for x in edge]
    assert len(counts[0]) != len(counts[1])
    assert near.may_be_alike(counts, np.array([1024, 1025]), np.array([0]), np.array([1])).all()


def test_a_dense_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies of one text with edits, a part of whose pairs are similar: few of their pairs reach the comparison."""
    seen, checked = [], near._verified

    def counted(pairs, nodes, texts):
        seen[-1] += pairs.where("a <> b").distinct().count()
        return checked(pairs, nodes, texts)

    monkeypatch.setattr(near, "_verified", counted)
    monkeypatch.setattr(near, "FEW_PAIRS", 0)
    monkeypatch.setattr(near, "PIVOT_ROUNDS", 0)
    for n in (180,):
        rng = random.Random(4)
        base = [f"g{i}" for i in range(300)]
        rows = [(i, " ".join(edited(rng, base, rng.randrange(3, 9)))) for i in range(n)]
        seen.append(0)
        found = {r.doc_id: r.component_id for r in near.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == least(rows)[0]
    assert seen[0] < 0.15 * 180 * 179 / 2, seen


def test_tasks_follow_rows_not_partitions(spark):
    """A session of very many partitions gives the same components, in far fewer tasks than its partitions for each stage."""
    rng = random.Random(7)
    bases = [[f"b{k}w{i}" for i in range(60)] for k in range(20)]
    rows = [(i, " ".join(edited(rng, bases[i % 20], rng.randrange(0, 4)))) for i in range(120)]
    context, before = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("near-tasks", "near copies of few rows")
    try:
        found = {r.doc_id: r.component_id for r in near.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    want, pairs = least(rows)
    assert pairs and found == want
    told = context.statusTracker()
    stages = [told.getStageInfo(s) for s in {s for j in told.getJobIdsForGroup("near-tasks") for s in told.getJobInfo(j).stageIds}]
    tasks = sum(s.numCompletedTasks for s in stages if s)
    assert 0 < tasks < 2500, tasks
