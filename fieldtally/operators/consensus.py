"""Consensus over repeated outputs: votes, clusters, medoids, arrays, disputes.

``values`` has one row per (task_id, field, trial, item) with ``value``, a
canonical JSON text.  Exact steps are groupings; steps that depend on the order
of arrival run per (task_id, field) group, which holds a task's few trials.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import canonical, json_kind, opened


def valid_trials(trials: DataFrame) -> DataFrame:
    """Trials with an output, without errors and without an ``error`` key."""
    no_errors = F.coalesce(F.size("errors"), F.lit(0)) <= 0
    return trials.where(F.col("output").isNotNull() & no_errors & F.get_json_object("output", "$.error").isNull())


def first_valid(trials: DataFrame, tasks: DataFrame) -> DataFrame:
    """The first valid output of every task; a task without one gets an error."""
    best = valid_trials(trials).groupBy("task_id").agg(F.min_by("output", "trial").alias("output"), F.min("trial").alias("trial"), F.count("*").alias("n_valid"))
    out = tasks.select("task_id").distinct().join(best, "task_id", "left")
    return out.withColumns({"n_valid": F.coalesce("n_valid", F.lit(0)), "error": F.when(F.col("trial").isNull(), "no valid trial")})


def support(values: DataFrame) -> DataFrame:
    """Distinct trials and first place of each value."""
    return values.groupBy("task_id", "field", "value").agg(F.countDistinct("trial").alias("support"), F.min(F.struct("trial", "item")).alias("first"))


def exact_vote(values: DataFrame) -> DataFrame:
    """The value of most trials; the earliest among equals."""
    order = Window.partitionBy("task_id", "field").orderBy(F.desc("support"), "first", "value")
    return support(values.where("value <> 'null'")).withColumn("place", F.row_number().over(order)).where("place = 1").select("task_id", "field", "value", "support")


def null_vote(values: DataFrame, fields: DataFrame, *, null_wins_ties: bool = False) -> DataFrame:
    """The exact vote against nulls: null wins where it may, with more trials than the best value, or as many if it wins ties; all null gives null, or the empty value.

    ``fields`` has (field, nullable, empty_json).
    """
    nulls = values.groupBy("task_id", "field").agg(F.countDistinct(F.when(F.col("value") == "null", F.col("trial"))).alias("nulls"))
    voted = nulls.join(exact_vote(values), ["task_id", "field"], "left").join(fields, "field")
    support_of = F.coalesce("support", F.lit(0))
    wins = F.col("nullable") & (F.col("nulls") >= support_of if null_wins_ties else F.col("nulls") > support_of)
    value = F.when(F.col("value").isNull() & ~F.col("nullable"), F.col("empty_json")).when(wins | F.col("value").isNull(), "null").otherwise(F.col("value"))
    return voted.select("task_id", "field", value.alias("value"), "nulls", F.coalesce("support", F.lit(0)).alias("support"))


def support_floors(values: DataFrame) -> DataFrame:
    """Distinct arrays of the items that reach a support floor: two trials, and 40, 50 and 60 % of them."""
    n = values.groupBy("task_id", "field").agg(F.countDistinct("trial").alias("n"))
    floors = F.array_distinct(F.array(F.lit(2), *[F.ceil(F.col("n") * F.lit(x)).cast("int") for x in (0.4, 0.5, 0.6)]))
    rows = support(values).join(n, ["task_id", "field"]).withColumn("floor", F.explode(floors)).where(F.col("support") >= F.col("floor"))
    items = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("support"), F.col("first"), F.col("value")))), lambda x: x["value"])
    arrays = rows.groupBy("task_id", "field", "floor").agg(items.alias("items"))
    return arrays.groupBy("task_id", "field", "items").agg(F.min("floor").alias("floor"))


def field_scope(values: DataFrame, tasks: DataFrame) -> DataFrame:
    """stable, disputed or skipped per field: arrays compare as multisets; a trial without the field disputes it.

    ``tasks`` has (task_id, field, n_trials, required) for all fields of all tasks.
    """
    per_trial = values.groupBy("task_id", "field", "trial").agg(F.array_join(F.array_sort(F.collect_list("value")), "\u0001").alias("key"))
    seen = per_trial.groupBy("task_id", "field").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))
    out = tasks.join(seen, ["task_id", "field"], "left")
    scope = F.when(F.col("n").isNull() & ~F.col("required"), "skipped").when((F.col("n") == F.col("n_trials")) & (F.col("n_keys") == 1), "stable").otherwise("disputed")
    return out.select("task_id", "field", scope.alias("scope"))


def present_fields(values: DataFrame, share: float = 0.5) -> DataFrame:
    """Values of the fields that an object keeps: root fields always, nested ones (with a dot) if enough of the task's trials have them."""
    n = values.groupBy("task_id").agg(F.countDistinct("trial").alias("__n"))
    seen = values.groupBy("task_id", "field").agg(F.countDistinct("trial").alias("__seen")).join(n, "task_id")
    kept = seen.where(~F.col("field").contains(".") | (F.col("__seen") >= F.ceil(F.col("__n") * share))).select("task_id", "field")
    return values.join(kept, ["task_id", "field"], "left_semi")


def vote_table(values: DataFrame, groups: DataFrame) -> DataFrame:
    """Trials and groups of every value; repeats within a trial count once.  ``groups`` has (task_id, trial, group)."""
    rows = values.select("task_id", "field", "value", "trial").distinct().join(groups, ["task_id", "trial"])
    by_group = rows.groupBy("task_id", "field", "value", "group").agg(F.count("*").alias("n"), F.collect_set("trial").alias("t"))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")
    return by_group.groupBy("task_id", "field", "value").agg(
        F.sum("n").alias("count"), text(F.array_sort(F.flatten(F.collect_list("t")))).alias("trials"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "group", "n"))), ",").alias("groups")
    )


def vote_counters(presence: DataFrame, trials: DataFrame) -> DataFrame:
    """Per task and field: trials in which it is null, an empty or a non-empty list, something else where a list is due, or missing.

    ``presence`` has (task_id, field, trial, value, is_array), one row per
    field of a trial's output; ``trials`` all (task_id, trial).
    """
    n = trials.groupBy("task_id").agg(F.countDistinct("trial").alias("__n"))
    value = F.col("value")
    is_list = value.startswith("[")
    kind = (
        F.when(value == "null", "null").when(~F.col("is_array"), "value").when(is_list & value.rlike(r"^\[\s*\]$"), "empty").when(is_list, "non_empty").otherwise("invalid")
    )
    found = presence.withColumn("kind", kind).groupBy("task_id", "field").agg(F.countDistinct("trial").alias("__seen"), *[F.countDistinct(F.when(F.col("kind") == k, F.col("trial"))).alias(f"{k}_count") for k in ("null", "empty", "non_empty", "value", "invalid")])
    return found.join(n, "task_id").withColumn("missing_count", F.col("__n") - F.col("__seen")).drop("__n", "__seen")


def merged_candidates(values: DataFrame, key: Column) -> DataFrame:
    """Candidates whose keys are equal, under their earliest spelling, in a fixed order."""
    rows = values.withColumn("key", key)
    merged = rows.groupBy("task_id", "field", "key").agg(F.countDistinct("trial").alias("count"), F.min_by("value", F.struct("trial", "item", "value")).alias("value"), F.min(F.struct("trial", "item")).alias("first"))
    order = Window.partitionBy("task_id", "field").orderBy(F.desc("count"), "first", "value")
    return merged.withColumn("place", F.row_number().over(order)).select("task_id", "field", "value", "count", "place")


def merged_judgement(stable: DataFrame, judged: DataFrame) -> DataFrame:
    """Judged fields over stable ones."""
    both = stable.select("task_id", "field", F.col("value").alias("s")).join(judged.select("task_id", "field", F.col("value").alias("j")), ["task_id", "field"], "full_outer")
    return both.select("task_id", "field", F.coalesce("j", "s").alias("value"), F.when(F.col("j").isNotNull(), "judge").otherwise("stable").alias("source"))


def reconstructed_fields(candidates: DataFrame, verdicts: DataFrame, fallback: DataFrame) -> DataFrame:
    """Per field its included values, in order, and its issues.

    A field none of whose candidates has a verdict takes the value of
    ``fallback`` (task_id, field, value); one whose verdict counts other
    candidates than there are is told so.
    """
    rows = reconstructed(candidates, verdicts)
    said = verdicts.groupBy("task_id", "field").agg(F.count("*").alias("n_verdicts"))
    own = candidates.groupBy("task_id", "field").agg(F.count("*").alias("n_candidates"))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("place", "value")))), lambda x: x["value"])
    out = rows.groupBy("task_id", "field").agg(F.array_join(kept, ",").alias("included"), F.array_join(F.array_sort(F.collect_set("issue")), ",").alias("issues"))
    both = own.join(said, ["task_id", "field"], "left").join(out, ["task_id", "field"], "left").join(fallback.select("task_id", "field", F.col("value").alias("other")), ["task_id", "field"], "left")
    missing = F.col("n_verdicts").isNull()
    counted = F.when(missing, "missing verdict").when(F.col("n_verdicts") != F.col("n_candidates"), "count mismatch")
    return both.select(
        "task_id", "field", F.when(missing, F.col("other")).otherwise(F.col("included")).alias("value"), F.when(missing, "fallback").otherwise("verdict").alias("source"),
        F.concat_ws(",", counted, F.when(~missing, F.nullif("issues", F.lit("")))).alias("issues"),
    )


def reconstructed(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates against verdict rows (task_id, field, place, value, include): included values and what is wrong with each verdict."""
    c = candidates.select("task_id", "field", "place", F.col("value").alias("candidate"))
    both = c.join(verdicts.select("task_id", "field", "place", F.col("value").alias("verdict"), "include"), ["task_id", "field", "place"], "full_outer")
    issue = (
        F.when(F.col("candidate").isNull(), "unknown candidate").when(F.col("verdict").isNull(), "missing").when(F.col("include").isNull(), "not boolean").when(F.col("candidate") != F.col("verdict"), "value mismatch")
    )
    return both.select("task_id", "field", "place", F.when(F.col("include") & issue.isNull(), F.col("candidate")).alias("value"), issue.alias("issue"))


#: Parts of a name or description that speak for or against the field that identifies an item, and what each counts.
IDENTITY_NAMES = ("text", "name", "title", "reaction", "symptom", "ingredient", "entity", "mention")
IDENTITY_DESCRIPTIONS = ("verbatim", "name", "mention", "source", "ingredient", "symptom", "adverse effect", "reaction")
ATTRIBUTE_NAMES = ("label", "category", "class", "type", "probability", "frequency", "impact", "severity", "amount", "unit", "date", "year", "count", "number", "score", "is_", "has_")
IDENTITY_POINTS = {"required": 3, "free string": 4, "name": 3, "description": 2, "attribute type": -4, "attribute name": -3}


def identity_scores(fields: DataFrame, least: float = 8.0, margin: float = 3.0) -> DataFrame:
    """The field that identifies an object's items, by rules on requirement, type, name and description.

    ``fields`` has (owner, name, description, json_type, required, enum_size).
    High confidence takes the least score and the margin to the next, medium
    the least score alone; without it there is no identity (a null name).
    """
    holds = lambda c, parts: F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(parts))
    has_enum = F.col("enum_size") > 0
    rules = {
        "required": F.col("required"), "free string": (F.col("json_type") == "string") & ~has_enum, "name": holds(F.col("name"), IDENTITY_NAMES), "description": holds(F.col("description"), IDENTITY_DESCRIPTIONS),
        "attribute type": has_enum | F.col("json_type").isin("integer", "number", "boolean"), "attribute name": holds(F.col("name"), ATTRIBUTE_NAMES),
    }
    score = sum((F.when(rule, IDENTITY_POINTS[k]).otherwise(0) for k, rule in rules.items()), F.lit(0))
    best = fields.withColumn("score", score).groupBy("owner").agg(F.slice(F.array_sort(F.collect_list(F.struct(-F.col("score"), "name"))), 1, 2).alias("b"))  # an object's few fields
    first = -F.get("b", 0)["col1"]
    ahead = first + F.coalesce(F.get("b", 1)["col1"], F.lit(0))
    sure = F.when((first >= least) & (ahead >= margin), "high").when(first >= least, "medium").otherwise("none")
    return best.select("owner", F.when(first >= least, F.get("b", 0)["name"]).alias("name"), first.alias("score"), ahead.alias("margin"), sure.alias("confidence"))


def identity_points(node: dict, root: dict) -> list[tuple[float, str]]:
    """(less the score, name) of the fields of one object schema, the best first."""
    scored = []
    for name, raw in node.get("properties", {}).items():
        inner = opened(raw, root)[0]
        kind, has_enum = json_kind(inner), "enum" in inner
        told = {
            "required": name in node.get("required", []), "free string": kind == "string" and not has_enum, "name": any(x in name.lower() for x in IDENTITY_NAMES),
            "description": any(x in str(inner.get("description") or raw.get("description") or "").lower() for x in IDENTITY_DESCRIPTIONS),
            "attribute type": has_enum or kind in ("integer", "number", "boolean"), "attribute name": any(x in name.lower() for x in ATTRIBUTE_NAMES),
        }
        scored.append((-sum(IDENTITY_POINTS[k] for k, v in told.items() if v), name))
    return sorted(scored)


def identity_field(node: dict, root: dict, least: float = 8.0) -> str | None:
    """The same choice for one object schema."""
    best = min(identity_points(node, root), default=(0, ""))
    return best[1] if -best[0] >= least else None


# Steps that depend on the order of arrival.

#: Texts, and pairs of texts, whose normal form or similarity a worker keeps: more than a task's, as texts may be long.
CACHED = 2_000


@lru_cache(maxsize=CACHED)
def normal_text(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", plain.lower()).strip()


def _bags(text: str) -> tuple[Counter, Counter]:
    """Words and trigrams of a normal text."""
    return Counter(re.findall(r"\w+", text)), Counter(text[i : i + 3] for i in range(max(1, len(text) - 2))) if text else Counter()


def _bag_f1(a: Counter, b: Counter) -> float:
    if not a or not b:
        return float(not a and not b)
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


@lru_cache(maxsize=CACHED)
def string_similarity(a: str, b: str) -> float:
    """1 if equal but for marks, case and spaces, else 0.45 of the words' and 0.40 of the trigrams' bag F1."""
    a, b = normal_text(a), normal_text(b)
    if a == b:
        return 1.0
    return sum(w * _bag_f1(x, y) for w, x, y in zip((0.45, 0.40), _bags(a), _bags(b)))


#: How much a field's kind weighs in an object's similarity; all others weigh 1.
WEIGHTS = {"enum": 1.1, "string": 1.2, "integer": 1.1, "number": 1.1, "boolean": 1.1, "array": 0.9}
_KINDS = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array"}


@dataclass(frozen=True)
class Comparer:
    """Similarity of two parsed values under a schema; without one by what the values are.

    Strings compare by ``texts``, lists by greedy matching over their union,
    objects by their weighted fields.
    """

    root: dict | None = None
    texts: Callable[[str, str], float] = string_similarity

    def kind(self, raw: dict | None, *values) -> str:
        if raw is None:
            return next((_KINDS.get(type(v), "") for v in values if v is not None), "")
        node = opened(raw, self.root or {})[0]
        return "enum" if "enum" in node else json_kind(node)

    def inner(self, raw: dict | None, name: str | None = None) -> dict | None:
        """The schema of a property, or without a name of a list's items; an empty one where it isn't told."""
        if raw is None:
            return None
        node = opened(raw, self.root or {})[0]
        found = node.get("properties", {}).get(name) if name is not None else node.get("items")
        return found if isinstance(found, dict) else {}

    def __call__(self, a, b, raw: dict | None = None) -> float:
        kind = self.kind(raw, a, b)
        if a is None or b is None:
            return float(a is b)
        if kind in ("enum", "integer", "number", "boolean"):
            return float(a == b and (raw is not None or type(a) is type(b)))
        if isinstance(a, str) and isinstance(b, str) and kind in ("string", ""):
            return self.texts(a, b)
        if isinstance(a, list) and isinstance(b, list) and kind in ("array", ""):
            if not a or not b:
                return float(not a and not b)
            return matched_share(np.array([[self(x, y, self.inner(raw)) for y in b] for x in a]))
        if isinstance(a, dict) and isinstance(b, dict) and kind in ("object", ""):
            names = [*{**a, **b}] if raw is None else [n for n in opened(raw, self.root or {})[0].get("properties", {}) if n in a or n in b]
            if raw is not None and not opened(raw, self.root or {})[0].get("properties"):
                return float(canonical(a) == canonical(b))
            weights = {n: WEIGHTS.get(self.kind(self.inner(raw, n), a.get(n), b.get(n)), 1.0) for n in names}
            total = sum(weights.values())
            return sum(weights[n] * self(a[n], b[n], self.inner(raw, n)) for n in names if n in a and n in b) / total if total else 1.0
        return float(canonical(a) == canonical(b))


def similarity(a, b) -> float:
    """Of two parsed values without a schema."""
    return Comparer()(a, b)


def matched_share(matrix: np.ndarray) -> float:
    """Greedily matched similarity over the items of both sides less the matched."""
    from .scoring import greedy_total

    total = greedy_total(matrix)
    return total / (matrix.shape[0] + matrix.shape[1] - total)


def value_similarities(a: Column, b: Column, schema: str | None = None) -> Column:
    """The weighted similarity of two JSON values, under a schema if one is given; null if either doesn't parse."""
    root = None if schema is None else json.loads(schema)

    @F.pandas_udf("double")
    def compare(xs: pd.Series, ys: pd.Series) -> pd.Series:
        comparer, out = Comparer(root), []
        for x, y in zip(xs, ys):
            try:
                out.append(comparer(json.loads(x), json.loads(y), root))
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out, dtype="float64")

    return compare(a, b)


class Similarities:
    """Rows of the similarities of a list of values, made when they are asked for, so that memory grows with the values only.

    Texts under the library's own similarity take one pass over the values that
    share a word or trigram; other values are compared one by one, equal ones
    once.
    """

    def __init__(self, values: Sequence, alike: Callable[[object, object], float] = similarity, texts_alike: bool = True):
        keys: dict[str, int] = {}
        self.of = np.array([keys.setdefault(canonical(v), len(keys)) for v in values], np.int64)
        self.distinct = [values[i] for i in np.unique(self.of, return_index=True)[1]] if len(values) else []
        self.alike, self.made = alike, {}
        self.texts = texts_alike and all(isinstance(v, str) for v in self.distinct)
        if self.texts:
            self.normal = [normal_text(v) for v in self.distinct]
            self.bags: list[list] = [[], []]
            self.places: list[dict] = [{}, {}]
            for i, t in enumerate(self.normal):
                for bags, places, bag in zip(self.bags, self.places, _bags(t)):
                    entries = [(x, k) for x, n in bag.items() for k in range(n)]  # each entry with its number among its equals
                    bags.append(entries)
                    for e in entries:
                        places.setdefault(e, []).append(i)
            self.sizes = [np.array([len(b) for b in bags]) for bags in self.bags]
            same: dict[str, int] = {}
            self.same = np.array([same.setdefault(t, len(same)) for t in self.normal])

    def _of_distinct(self, i: int) -> np.ndarray:
        n = len(self.distinct)
        if not self.texts:
            return np.array([self.alike(self.distinct[i], v) for v in self.distinct])
        out = np.zeros(n)
        for weight, bags, places, sizes in zip((0.45, 0.40), self.bags, self.places, self.sizes):
            shared = np.bincount(np.fromiter(chain.from_iterable(map(places.__getitem__, bags[i])), np.int64), minlength=n)
            both = sizes + sizes[i]
            out += weight * np.where(both > 0, 2 * shared / np.maximum(both, 1), 1.0)
        out[self.same == self.same[i]] = 1.0
        return out

    def row(self, k: int) -> np.ndarray:
        """The similarities of value k to all values."""
        i = int(self.of[k])
        if i not in self.made:
            if len(self.made) >= 512:
                self.made.clear()
            self.made[i] = self._of_distinct(i)
        return self.made[i][self.of]

    def block(self, rows: Sequence[int], columns: Sequence[int]) -> np.ndarray:
        return np.array([self.row(k)[list(columns)] for k in rows]).reshape(len(rows), len(columns))


class FieldSimilarities(Similarities):
    """The same of objects under a schema: their fields' rows, weighted, so that texts in objects are compared as fast as texts."""

    def __init__(self, values: Sequence[dict], raw: dict, compare: Comparer, texts_alike: bool):
        self.n, self.made, self.parts = len(values), {}, []
        for name, inner in opened(raw, compare.root or {})[0].get("properties", {}).items():
            there = np.array([name in v for v in values], bool)
            own = [v.get(name) for v in values]
            none = np.array([v is None for v in own], bool)
            kind = compare.kind(inner)
            if kind in ("enum", "integer", "number", "boolean") and all(isinstance(v, (str, int, float, bool, type(None))) for v in own):
                codes: dict = {}
                near: object = np.array([codes.setdefault(v, len(codes)) for v in own])
            elif kind == "string" and texts_alike and all(isinstance(v, (str, type(None))) for v in own):
                near = Similarities([v or "" for v in own])
            else:
                near = Similarities(own, lambda a, b, inner=inner: compare(a, b, inner), False)
            self.parts.append((WEIGHTS.get(kind, 1.0), there, none, near))

    def row(self, k: int) -> np.ndarray:
        if k not in self.made:
            if len(self.made) >= 512:
                self.made.clear()
            total, weights = np.zeros(self.n), np.zeros(self.n)
            for weight, there, none, near in self.parts:
                weights += weight * (there | there[k])
                if there[k]:
                    alike = none.astype(float) if none[k] else np.where(none, 0.0, (near == near[k]).astype(float) if isinstance(near, np.ndarray) else near.row(k))
                    total += weight * there * alike
            self.made[k] = np.where(weights > 0, total / np.maximum(weights, 1e-12), 1.0)
        return self.made[k]


class IdentitySimilarities(Similarities):
    """The similarities of items by the field that identifies them, of pairs that both have it, and whole of all others."""

    def __init__(self, whole: Similarities, named: Similarities, has: Sequence[bool]):
        self.whole, self.named, self.has = whole, named, np.array(has, bool)

    def row(self, k: int) -> np.ndarray:
        if not self.has[k]:
            return self.whole.row(k)
        by_name = self.named.row(k)
        return by_name if self.has.all() else np.where(self.has, by_name, self.whole.row(k))


def cluster(items: list[tuple[int, int, object]], threshold: float, alike: Callable[[object, object], float] | Similarities = similarity) -> list[list[int]]:
    """In order of arrival each (trial, item, value) joins the cluster whose nearest member is most similar, if at the threshold and without a value of its trial; the first among equals."""
    near = alike if isinstance(alike, Similarities) else Similarities([v for _, _, v in items], alike, alike is similarity)
    labels = np.zeros(len(items), np.int64)
    of_trial: dict[int, list[int]] = {}
    count = 0
    for k, (trial, _, _) in enumerate(items):
        taken, label = of_trial.setdefault(trial, []), count
        if count:
            nearest = np.full(count, -1.0)
            np.maximum.at(nearest, labels[:k], near.row(k)[:k])
            nearest[taken] = -1.0
            best = int(nearest.argmax())
            if nearest[best] >= threshold - 1e-12:
                label = best
        labels[k] = label
        count = max(count, label + 1)
        taken.append(label)
    return [np.flatnonzero(labels == c).tolist() for c in range(count)]


def medoid(values: list, alike: Callable[[object, object], float] | Similarities = similarity, among: Sequence[int] | None = None) -> int:
    """The index of the highest mean similarity to the others, the first among equals."""
    near = alike if isinstance(alike, Similarities) else Similarities(values, alike, alike is similarity)
    among = range(len(values)) if among is None else among
    return max(range(len(among)), key=lambda i: (round(float(near.row(among[i])[list(among)].sum()), 12), -i))


def _mean_share(chosen: list[int], observed: list[list[int]], near: Similarities) -> tuple[float, list[float]]:
    """The mean similarity of chosen values to the observed arrays, and the matched total of each."""
    from .scoring import greedy_total

    shares, totals = [], []
    for o in observed:
        total = greedy_total(near.block(chosen, o)) if chosen and o else 0.0
        totals.append(total)
        shares.append(total / (len(chosen) + len(o) - total) if chosen and o else float(not chosen and not o))
    return sum(shares) / max(1, len(observed)), totals


def grown(candidates: list[int], observed: list[list[int]], near: Similarities) -> list[int]:
    """Starting from none, the candidate is added that raises the mean similarity to the observed arrays most, while one does.

    A candidate raises an array's matched total by its best similarity there at
    most; so those are tried first whose bound is highest, and the others left
    once none can win.
    """
    chosen: list[int] = []
    score, totals = _mean_share(chosen, observed, near)
    left = list(candidates)
    best_in = {c: [float(near.row(c)[o].max()) if o else 0.0 for o in observed] for c in left}
    while left:
        size = len(chosen) + 1
        bounds = []
        for c in left:
            most = [min(t + b, size, len(o)) for t, b, o in zip(totals, best_in[c], observed)]
            bounds.append(sum(m / (size + len(o) - m) for m, o in zip(most, observed)) / len(observed))
        best, at, best_totals = -1.0, -1, totals
        for i in sorted(range(len(left)), key=lambda i: (-bounds[i], i)):
            if bounds[i] < best - 1e-12:
                break
            value, own = _mean_share([*chosen, left[i]], observed, near)
            if value > best + 1e-12 or (abs(value - best) <= 1e-12 and i < at):
                best, at, best_totals = value, i, own
        if best <= score + 1e-12:
            break
        score, totals = best, best_totals
        chosen.append(left.pop(at))
    return chosen


def picked(candidates: list[list[int]], observed: list[list[int]], near: Similarities, within: float = 0.0) -> list[int]:
    """The candidate of the best mean similarity; with ``within``, the longest of those that come so near it."""
    scores = [_mean_share(c, observed, near)[0] for c in candidates]
    good = [i for i, s in enumerate(scores) if s >= max(scores) - within - 1e-12]
    return candidates[max(good, key=lambda i: (len(candidates[i]) if within else 0, round(scores[i], 12), -i))]


@dataclass(frozen=True)
class Options:
    """Thresholds and replaceable parts of the consensus: the similarity of texts, the choice among arrays, the identity of items."""

    scalar_threshold: float = 0.78
    item_threshold: float = 0.78
    object_threshold: float = 0.62
    identity_threshold: float = 0.62
    duplicate_threshold: float = 0.96
    within: float = 0.06
    null_wins_ties: bool = False
    optional_share: float = 0.5
    texts: Callable[[str, str], float] = string_similarity
    pick: Callable[..., list[int]] = picked
    identity: Callable[[dict, dict], str | None] = identity_field


@dataclass
class Merger:
    """The consensus of repeated values of one schema."""

    root: dict | None = None
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        self.compare = Comparer(self.root, self.options.texts)

    def near(self, values: Sequence, raw: dict | None) -> Similarities:
        if raw is not None and self.compare.kind(raw) == "object" and opened(raw, self.root or {})[0].get("properties") and all(isinstance(v, dict) for v in values):
            return FieldSimilarities(values, raw, self.compare, self.options.texts is string_similarity)
        return Similarities(values, lambda a, b: self.compare(a, b, raw), self.options.texts is string_similarity and self.compare.kind(raw, *values) in ("string", ""))

    def identity_of(self, raw: dict | None) -> str | None:
        node = opened(raw, self.root or {})[0] if raw is not None else {}
        return self.options.identity(node, self.root or {}) if node.get("properties") else None

    def identity_margin(self, raw: dict | None) -> tuple[float, float]:
        """The score of the best field of an item's schema and its lead over the next; 0 for items without fields."""
        node = opened(raw, self.root or {})[0] if raw is not None else {}
        points = [-p for p, _ in identity_points(node, self.root or {})]
        return (float(points[0]), float(points[0] - (points[1] if len(points) > 1 else 0))) if points else (0.0, 0.0)

    def clusters(self, rows: list[tuple[int, int, object]], raw: dict | None, is_item: bool) -> tuple[list[list[int]], Similarities]:
        """Clusters by falling support, the earliest first, and the similarities of the values."""
        values = [v for _, _, v in rows]
        near, kind, o = self.near(values, raw), self.compare.kind(raw, *values), self.options
        exact = kind in ("enum", "integer", "number", "boolean")
        told = "string" if kind == "" and all(isinstance(v, str) for v in values) else kind or "object"  # what values are where no schema says it
        threshold = 1.0 if exact else o.scalar_threshold if not is_item else {"string": o.item_threshold, "object": o.object_threshold}.get(told, 1.0)
        by, name = near, self.identity_of(raw)
        if is_item and name:
            has = [isinstance(v, dict) and name in v for v in values]
            named = self.near([v[name] if h else None for v, h in zip(values, has)], self.compare.inner(raw, name))
            by, threshold = IdentitySimilarities(near, named, has), o.identity_threshold
        found = cluster(rows, threshold, by)
        return sorted(found, key=lambda c: (-len({rows[k][0] for k in c}), c[0])), near

    def chosen(self, members: list, near: Similarities, at: list[int], raw: dict | None):
        """One value for a cluster: the medoid, or of objects and lists the consensus of what is in them."""
        kind = self.compare.kind(raw, *members)
        if raw is not None and kind == "object":
            return self.object([m for m in members if isinstance(m, dict)], raw)
        if raw is not None and kind == "array":
            return self.array([m for m in members if isinstance(m, list)], raw)
        return members[medoid(members, near, at)]

    def scalar(self, rows: list[tuple[int, int, object]], raw: dict | None = None) -> tuple[object, int]:
        """(value, support) of the cluster of most trials."""
        if len(rows) == 1 and self.compare.kind(raw, rows[0][2]) not in ("object", "array"):
            return rows[0][2], 1
        found, near = self.clusters(rows, raw, False)
        best = found[0]
        return self.chosen([rows[k][2] for k in best], near, best, raw), len({rows[k][0] for k in best})

    def items(self, rows: list[tuple[int, int, object]], raw: dict | None = None, n_trials: int | None = None) -> list:
        """The array of the best expected similarity to the trials' arrays as they came, of those by support floors and a grown one."""
        came, near = rows, self.near([v for _, _, v in rows], raw)
        kept: list[int] = []
        of_trial: dict[int, list[int]] = {}
        for k, (trial, _, _) in enumerate(rows):  # what repeats within its trial goes
            mine = of_trial.setdefault(trial, [])
            if not mine or near.row(k)[mine].max() < self.options.duplicate_threshold:
                mine.append(k)
                kept.append(k)
        rows = [rows[k] for k in kept]
        if not rows:
            return []
        found, near = self.clusters(rows, raw, True)
        support = [len({rows[k][0] for k in c}) for c in found]
        values = [self.chosen([rows[k][2] for k in c], near, c, raw) for c in found]
        arrays: dict[int, list[int]] = {}
        for k, (trial, _, _) in enumerate(came):
            arrays.setdefault(trial, []).append(k)
        n = n_trials or len(arrays)
        # The clusters' values stand behind the observed ones, so that both have similarities.
        near = self.near([*(v for _, _, v in came), *values], raw)
        of_cluster = [len(came) + c for c in range(len(found))]
        observed = [arrays[t] for t in sorted(arrays)] + [[]] * (n - len(arrays))
        floors = sorted({max(1, min(n, f)) for f in (2, *(math.ceil(n * p) for p in (0.4, 0.5, 0.6)))})
        candidates = [[v for v, s in zip(of_cluster, support) if s >= f] for f in floors] + [grown(of_cluster, observed, near)]
        return [values[k - len(came)] for k in self.options.pick(candidates, observed, near, self.options.within)]

    def array(self, arrays: list[list], raw: dict) -> list:
        rows = [(t, i, v) for t, items in enumerate(arrays) for i, v in enumerate(items)]
        return self.items(rows, self.compare.inner(raw), len(arrays)) if arrays else []

    def object(self, objects: list[dict], raw: dict, top: bool = False) -> dict:
        """Field by field; an optional nested field needs its share of the objects, fields of the root always stay."""
        node, out = opened(raw, self.root or {})[0], {}
        for name, inner in node.get("properties", {}).items():
            seen = [o[name] for o in objects if name in o]
            needed = max(1, math.ceil(len(objects) * self.options.optional_share)) if not top and name not in node.get("required", []) else 0
            if len(seen) >= needed:
                out[name] = self.value(seen, inner)
        return out

    def value(self, values: list, raw: dict):
        node, nullable = opened(raw, self.root or {})
        there = [(t, 0, v) for t, v in enumerate(values) if v is not None]
        kind, nulls = "enum" if "enum" in node else json_kind(node), len(values) - len(there)
        if not there:
            return None if nullable else {"array": [], "object": {}}.get(kind)
        beaten = lambda support: nullable and (nulls >= support if self.options.null_wins_ties else nulls > support)
        if kind in ("object", "array"):
            wanted = [v for _, _, v in there if isinstance(v, dict if kind == "object" else list)]
            return None if beaten(len(there)) else self.object(wanted, raw) if kind == "object" else self.array(wanted, raw)
        found, support = self.scalar(there, raw)
        return None if beaten(support) else found

    def diagnosis(self, objects: list[dict], merged: dict, raw: dict, prefix: str = "") -> list[tuple]:
        """Of every field: path, kind, strategy, n, nulls, least, most and final length, and of a list how its items were clustered, by which field, with what score and margin."""
        node, out = opened(raw, self.root or {})[0], []
        for name, inner in node.get("properties", {}).items():
            seen = [o[name] for o in objects if name in o]
            there = [v for v in seen if v is not None]
            kind, final, path = self.compare.kind(inner), merged.get(name) if isinstance(merged, dict) else None, f"{prefix}{name}"
            lengths = [len(v) for v in there if isinstance(v, list)] if kind == "array" else []
            identity = self.identity_of(self.compare.inner(inner)) if kind == "array" else None
            by = None if kind != "array" else "identity field" if identity else "whole items"
            score, margin = self.identity_margin(self.compare.inner(inner)) if kind == "array" else (None, None)
            strategy = {"array": "items", "object": "fields"}.get(kind, "cluster medoid")
            out.append((path, kind, strategy, len(seen), len(seen) - len(there), min(lengths, default=None), max(lengths, default=None), len(final) if isinstance(final, list) else None, identity, by, score, margin))
            if kind == "object":
                out += self.diagnosis([v for v in there if isinstance(v, dict)], final, inner, f"{path}.")
        return out


def consensus_value(rows: list[tuple[int, int, object]], is_array: bool, options: Options = Options()) -> tuple[object, int]:
    """(value, support) of (trial, item, value) rows of one field without a schema."""
    rows = sorted(rows, key=lambda r: r[:2])
    merger = Merger(None, options)
    return (merger.items(rows), len({r[0] for r in rows})) if is_array else merger.scalar(rows)


def _dealt_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys over all cores and more: groups are small in bytes and long in time, so partitions must not be joined by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def clustered_consensus(values: DataFrame, options: Options = Options()) -> DataFrame:
    """(task_id, field, value, support, n_rows) of string and array fields; ``is_array`` marks the latter.

    Text fields with one value a trial are clustered by joins (``clusters``).
    Other fields go by order of arrival in one group for a field of a task: equal values of a trial's field become one row with their places first; a
    group's memory grows with its places and distinct values, its time with the
    square of the latter.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        once = {v: json.loads(v) for v in set(rows["value"])}
        parsed = [(int(t), int(i), once[v]) for t, at, v in zip(rows["trial"], rows["items"], rows["value"]) for i in at]
        value, n = consensus_value(parsed, bool(rows["is_array"].iloc[0]), options)
        return pd.DataFrame([(rows["task_id"].iloc[0], rows["field"].iloc[0], json.dumps(value, ensure_ascii=False), n, int(rows["n"].sum()))], columns=["task_id", "field", "value", "support", "n_rows"])

    from . import clusters

    values = values.where("value <> 'null'")
    joined = None
    if options.texts is string_similarity and options.scalar_threshold > clusters.LEAST:
        told = clusters.by_joins(values)
        joined = clusters.text_consensus(values.join(told, ["task_id", "field"], "left_semi"), options.scalar_threshold)
        values = values.join(told, ["task_id", "field"], "left_anti")
    kept = values.groupBy("task_id", "field", "trial", "value", "is_array").agg(F.when(F.col("is_array"), F.array_sort(F.collect_list("item"))).otherwise(F.array(F.min("item"))).alias("items"), F.count("*").alias("n"))
    grouped = kept.groupBy("task_id", "field").applyInPandas(merge, "task_id long, field string, value string, support int, n_rows int")
    return grouped if joined is None else grouped.unionByName(joined)


DIAGNOSIS = "path string, kind string, strategy string, n int, nulls int, least_length int, most_length int, final_length int, identity string, clustered_by string, identity_score double, identity_margin double"


def record_consensus(trials: DataFrame, schema: str, options: Options = Options()) -> DataFrame:
    """(task_id, output, n_trials, fields): one record per task from its valid trials' outputs, and how each field came about.

    ``trials`` has (task_id, trial, output, errors); equal outputs of a task
    are one row with their trials before they are grouped.
    """
    root = json.loads(schema)
    names = [f.split()[0] for f in DIAGNOSIS.split(", ")]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted((int(t), o) for o, ts in zip(rows["output"], rows["trials"]) for t in ts)
        parsed = {o: json.loads(o) for o in set(rows["output"])}
        objects = [parsed[o] for _, o in ordered if isinstance(parsed[o], dict)]
        merger = Merger(root, options)
        merged = merger.object(objects, root, top=True)
        told = [dict(zip(names, d)) for d in merger.diagnosis(objects, merged, root)]
        return pd.DataFrame([(rows["task_id"].iloc[0], canonical(merged), len(objects), told)], columns=["task_id", "output", "n_trials", "fields"])

    from ..functions.records import coerced_json

    valid = valid_trials(trials).select("task_id", "trial", coerced_json(F.col("output"), F.lit(schema)).alias("output")).where("output is not null")
    grouped = _dealt_out(valid, "task_id").groupBy("task_id", "output").agg(F.array_sort(F.collect_set("trial")).alias("trials"))
    return grouped.groupBy("task_id").applyInPandas(merge, f"task_id long, output string, n_trials int, fields array<struct<{DIAGNOSIS.replace(', ', ',').replace(' ', ':')}>>")


def records(fields: DataFrame) -> DataFrame:
    """One JSON record per task from its fields' values, with how many there are."""
    pairs = F.array_sort(F.collect_list(F.struct("field", "value")))
    body = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["field"], F.lit('":'), p["value"])), ",")
    return fields.groupBy("task_id").agg(F.concat(F.lit("{"), body, F.lit("}")).alias("output"), F.count("*").alias("n_fields"))
