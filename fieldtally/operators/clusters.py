"""Consensus of a text field by joins, so that a field of a task may have any number of trials.

1. Values with the same normal form are one class, named by the trial that
   brought it first; a trial has one value.
2. Pairs of classes at the threshold come from a set-similarity join: the score
   is 0.45 of the words' and 0.40 of the trigrams' bag F1, so both have a least
   share.  By the words' share two classes must have one of the first rare words
   of each in common, and their numbers of words must be near; texts without
   words take their trigrams instead.  What meets so is compared exactly.
3. The walk in order of arrival needs these pairs only: a class joins the cluster
   of its most similar earlier class, else opens one.  It runs for each field on
   numbers, without the texts.
4. The medoid of the largest cluster: the sum of a class's scores over all members
   is a sum over its words and trigrams of how many members of which size have
   them, so it takes time in proportion to the members, not to their pairs.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small_batches
from ..sources.files import durable
from .consensus import normal_text, string_similarity

KEY = ["task_id", "field"]
WORDS, GRAMS = 0.45, 0.40
#: A threshold from which both shares bound what can be similar.
LEAST = max(WORDS, GRAMS) + 0.01


def _bags(normal: str) -> tuple[list[str], list[str]]:
    """The words and trigrams of a normal text, each with its number among its equals."""
    numbered = lambda bag: [f"{x}\u0001{k}" for x, n in bag.items() for k in range(n)]
    grams = Counter(normal[i : i + 3] for i in range(max(1, len(normal) - 2))) if normal else Counter()
    return numbered(Counter(re.findall(r"\w+", normal))), numbered(grams)


def classes(values: DataFrame) -> DataFrame:
    """(task_id, field, c, value, normal, support, n) of every class; c is the trial that came first with it."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normal_text(json.loads(t)))

    rows = values.withColumn("normal", normal("value"))
    found = rows.groupBy(*KEY, "normal").agg(F.min(F.struct("trial", "item", "value")).alias("f"), F.count_distinct("trial").alias("support"), F.count("*").alias("n"))
    return found.select(*KEY, F.col("f.trial").cast("long").alias("c"), F.col("f.value").alias("value"), "normal", "support", "n")


def with_bags(rows: DataFrame) -> DataFrame:
    """Classes with their words and trigrams."""

    @F.pandas_udf("words array<string>, grams array<string>")
    def bags(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_bags(t) for t in texts], columns=["words", "grams"])

    return rows.withColumn("b", bags("normal")).select(*rows.columns, "b.*")


def similar_pairs(bagged: DataFrame, threshold: float) -> DataFrame:
    """(task_id, field, a, b, score), a before b, of the classes whose score reaches the threshold."""
    share = lambda other, own: max(0.0, (threshold - other) / own - 1e-9)  # noqa: E731  the least F1 of one side if the other's is 1
    by_words = F.size("words") > 0
    least = F.when(by_words, share(GRAMS, WORDS)).otherwise(share(WORDS, GRAMS))
    rows = bagged.select(*KEY, "c", by_words.alias("by_words"), least.alias("least"), F.when(by_words, F.col("words")).otherwise(F.col("grams")).alias("bag")).withColumn("size", F.size("bag"))
    entries = durable(rows.select(*KEY, "c", "by_words", "least", "size", F.explode("bag").alias("entry")))
    rarity = entries.groupBy(*KEY, "by_words", "entry").agg(F.count("*").alias("df"))
    order = Window.partitionBy(*KEY, "c").orderBy("df", "entry")
    first = F.col("size") - F.ceil(F.col("size") * F.col("least") / (2 - F.col("least")) - 1e-6) + 1
    prefix = entries.join(rarity, [*KEY, "by_words", "entry"]).withColumn("at", F.row_number().over(order)).where(F.col("at") <= first)
    prefix = durable(prefix.where("df > 1").select(*KEY, "by_words", "entry", "c", "size", "least"))
    left = prefix.select(*KEY, "by_words", "entry", F.col("c").alias("a"), F.col("size").alias("a_size"))
    right = prefix.withColumnRenamed("c", "b")
    near = F.least("a_size", "size") * (2 - F.col("least")) >= F.greatest("a_size", "size") * F.col("least") - 1e-6
    pairs = left.join(right, [*KEY, "by_words", "entry"]).where((F.col("a") < F.col("b")) & near).select(*KEY, "a", "b").distinct()
    # A text without words or trigrams is a class of its own.
    texts = bagged.select(*KEY, "c", "normal")
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(*KEY, F.col("c").alias(side), F.col("normal").alias(f"{side}_text")), [*KEY, side])

    @F.pandas_udf("double")
    def score(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([string_similarity(x, y) for x, y in zip(xs, ys)], dtype="float64")

    return pairs.withColumn("score", score("a_text", "b_text")).where(F.col("score") >= threshold - 1e-12).select(*KEY, "a", "b", "score")


def largest_clusters(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(task_id, field, c, cluster_support) of the classes of each field's cluster of most trials, the earliest among equals."""
    earlier = pairs.groupBy(*KEY, F.col("b").alias("c")).agg(F.collect_list(F.struct("a", "score")).alias("near"))
    rows = found.select(*KEY, "c", "support").join(earlier, [*KEY, "c"], "left")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        of: dict[int, int] = {}
        support: list[int] = []
        for c, n, near in zip(group["c"], group["support"], group["near"]):
            best: dict[int, float] = {}
            for x in near if near is not None else ():
                k = of[x["a"]]
                best[k] = max(best.get(k, -1.0), x["score"])
            k = min(best, key=lambda k: (-best[k], k)) if best else len(support)
            if k == len(support):
                support.append(0)
            of[c] = k
            support[k] += int(n)
        k = min(range(len(support)), key=lambda k: (-support[k], k))
        members = [c for c in group["c"] if of[c] == k]
        return pd.DataFrame({"task_id": group["task_id"].iloc[0], "field": group["field"].iloc[0], "c": members, "cluster_support": support[k]})

    return rows.groupBy(*KEY).applyInPandas(walk, "task_id long, field string, c long, cluster_support long")


def medoids(members: DataFrame) -> DataFrame:
    """(task_id, field, value, cluster_support): of each field's members (c, value, support, words, grams) the one of the highest summed score."""
    none = F.array(F.lit("\u0001"))  # an empty bag is like another empty one
    sides = []
    for name, weight in (("words", WORDS), ("grams", GRAMS)):
        bag = F.when(F.size(name) > 0, F.col(name)).otherwise(none)
        sides.append(members.select(*KEY, "c", "support", F.lit(name).alias("side"), F.lit(weight).alias("weight"), F.size(bag).alias("size"), F.explode(bag).alias("entry")))
    entries = durable(sides[0].unionByName(sides[1]))
    have = entries.groupBy(*KEY, "side", "entry", F.col("size").alias("other")).agg(F.sum("support").alias("k"))
    gained = entries.join(have, [*KEY, "side", "entry"]).groupBy(*KEY, "c").agg(F.sum(F.col("weight") * 2 * F.col("k") / (F.col("size") + F.col("other"))).alias("gained"))
    total = F.round(F.col("gained") + (1 - WORDS - GRAMS) * F.col("support"), 9)  # equal texts count 1
    scored = members.join(gained, [*KEY, "c"]).withColumn("total", total)
    best = scored.groupBy(*KEY).agg(F.max(F.struct("total", (-F.col("c")).alias("first"))).alias("m"), F.first("cluster_support").alias("cluster_support"))
    named = best.select(*KEY, (-F.col("m.first")).alias("c"), "cluster_support")
    return named.join(members.select(*KEY, "c", "value"), [*KEY, "c"])


def text_consensus(values: DataFrame, threshold: float) -> DataFrame:
    """(task_id, field, value, support, n_rows) of text fields with one value a trial, as JSON texts."""
    with small_batches(values.sparkSession):  # a text becomes hundreds of words and trigrams
        found = durable(with_bags(classes(values)))
        won = largest_clusters(found, similar_pairs(found, threshold))
        members = durable(found.join(won, [*KEY, "c"]))
    total = found.groupBy(*KEY).agg(F.sum("n").alias("n_rows"))
    return medoids(members).join(total, KEY).select(*KEY, "value", F.col("cluster_support").cast("int").alias("support"), F.col("n_rows").cast("int").alias("n_rows"))


def by_joins(values: DataFrame) -> DataFrame:
    """The (task_id, field) whose values are all texts, one a trial."""
    told = values.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("trial").alias("trials"), F.every(F.col("value").startswith('"') & ~F.col("is_array")).alias("texts"))
    return told.where("texts and n = trials").select(*KEY)

