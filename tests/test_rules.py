"""Rules with fixed expectations: scores under schemas, types, tags, profiles, consensus of records, places."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import records, text
from fieldtally.operators import compare, consensus, lexical, metrics, ranking, retrieval, schemas, scoring

ENTITIES = {
    "$defs": {"Entity": {"type": "object", "properties": {"text": {"type": "string"}, "label": {"enum": ["PERSON", "ORG", "LOC"]}}}},
    "type": "object",
    "properties": {"entities": {"type": "array", "items": {"$ref": "#/$defs/Entity"}}},
}


def tps(gold, system, schema):
    return sum(f[0] for f in scoring.RecordScorer(schema).record(gold, system).values())


def test_lists_score_by_their_item_schema():
    apple, jobs = {"text": "Apple", "label": "ORG"}, {"text": "Steve Jobs", "label": "PERSON"}
    assert tps({"entities": [apple, jobs]}, {"entities": [jobs, apple]}, ENTITIES) == 1.0
    assert 0.32 < tps({"entities": [apple, jobs]}, {"entities": [apple, {"text": "Microsoft", "label": "ORG"}]}, ENTITIES) < 0.5
    assert tps({"entities": []}, {"entities": []}, ENTITIES) == 1.0 and tps({"entities": []}, {"entities": [apple]}, ENTITIES) == 0.0
    item = {**ENTITIES["$defs"]["Entity"], "$defs": ENTITIES["$defs"]}
    assert tps(apple, {**apple, "label": "PERSON"}, item) == 1.0  # a label is right or wrong
    # Half of a free text's words, the label right: 0.75 of an item, 0.75 / 1.25 of a list.
    assert tps({"entities": [jobs]}, {"entities": [{"text": "Steve", "label": "PERSON"}]}, ENTITIES) == pytest.approx(0.75 / 1.25)


def test_nested_lists_and_nulls():
    schema = {"type": "object", "properties": {"rows": {"type": "array", "items": {"type": "object", "properties": {"tags": {"type": "array", "items": {"type": "string"}}}}}, "name": {"type": "string"}, "when": {"anyOf": [{"type": "string"}, {"type": "null"}], "default": None}}}
    assert tps({"rows": [{"tags": ["a", "b"]}]}, {"rows": [{"tags": ["b", "c d"]}]}, schema) == pytest.approx((1 / 3) / (2 - 1 / 3))
    gold = {"name": "GIMP", "when": None}
    assert tps(gold, gold, schema) == 2.0 and tps(gold, {"name": "GIMP", "when": "x"}, schema) == 1.0


def test_semantic_part_weighs_seven_tenths():
    schema = {"type": "object", "properties": {"d": {"type": "string"}, "day": {"type": "string", "format": "date"}}}
    scorer = scoring.RecordScorer(schema, semantic=lambda a, b: 0.9)
    assert scorer.record({"d": "A fast red car."}, {"d": "A quick crimson vehicle."})["d"][0] == pytest.approx(0.7 * 0.9 + 0.3 / 7)
    assert scorer.record({"day": "2026-05-22"}, {"day": "2026-05-21"})["day"][0] == 0.0


def test_failed_and_empty_records(spark):
    rows = [('{"a": 1}', "no json"), ("{}", "{}"), ("{}", '{"b": 1}'), ("broken", "{}")]
    df = spark.createDataFrame([(g, s, '{"type": "object", "properties": {"a": {"type": "integer"}}}') for g, s in rows], "g string, s string, sc string")
    assert [(r.tps, r.gold_keys, r.system_keys) for r in schemas.instance_scores(df, "g", "s", "sc").collect()] == [(0.0, 1, 0), (1.0, 0, 0), (0.0, 0, 1), (None, None, None)]


SCHEMA = {
    "type": "object", "required": ["id"],
    "$defs": {"Kind": {"enum": ["A", "B"]}},
    "properties": {
        "id": {"type": "string", "description": " The code. "}, "n": {"anyOf": [{"type": "integer"}, {"type": "null"}], "minimum": 0}, "kind": {"$ref": "#/$defs/Kind"}, "maybe": {"anyOf": [{"$ref": "#/$defs/Kind"}, {"type": "null"}]},
        "names": {"type": "array", "items": {"type": "string"}}, "people": {"type": "array", "description": "persona", "items": {"type": "object", "properties": {"age": {"type": "number"}}}}, "grid": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}, "any": {},
        "flag": {"type": ["boolean", "null"], "description": "verbatim source"},
    },
}


def test_types_texts_and_tags(spark):
    df = records.schema_fields(spark.createDataFrame([("s", json.dumps(SCHEMA))], "k string, schema string"), "k", "schema").where("depth = 0")
    got = {r.name: r for r in df.select("*", schemas.field_text(F.col("name"), F.col("type_text"), F.col("description")).alias("said"), schemas.field_tags().alias("tags")).collect()}
    assert {n: r.type_class for n, r in got.items()} == {"id": "string", "n": "numeric", "kind": "enum", "maybe": "enum", "names": "array[string]", "people": "array[object]", "grid": "array[array[numeric]]", "any": "any", "flag": "boolean"}
    assert [got[n].said for n in ("id", "n", "kind", "maybe", "names", "people", "grid")] == ["id (string): The code.", "n (integer|null)", "kind (enum[Kind])", "maybe (enum|null)", "names (array of string)", "people (array of object): persona", "grid (array of array of integer)"]
    assert got["id"].tags == ["direct_string", "sentinel_pattern"] and got["kind"].tags == ["enum_classification"]
    assert got["n"].tags == ["grounded_null", "nullable", "numeric_normalization"] and got["names"].tags == ["simple_array"]
    assert got["people"].tags == ["complex_object_array", "entity_array", "nested_numeric_object_array"]
    assert got["flag"].tags == ["boolean_inference", "grounded_null", "long_verbatim_evidence", "nullable", "nullable_boolean"]


def test_identity_of_items(spark):
    item = {"type": "object", "required": ["text", "label"], "properties": {"text": {"type": "string"}, "label": {"type": "string", "enum": ["PERSON", "LOCATION"]}}}
    assert consensus.identity_field(item, item) == "text"
    assert consensus.identity_field({"properties": {"a": {"type": "string"}}}, {}) is None
    rows = [("o", "text", "", "string", True, 0), ("o", "label", "", "string", True, 2), ("p", "a", "", "string", False, 0), ("q", "text", "", "string", True, 0), ("q", "name", "", "string", True, 0)]
    got = {r.owner: (r.name, r.score, r.margin, r.confidence) for r in consensus.identity_scores(spark.createDataFrame(rows, "owner string, name string, description string, json_type string, required boolean, enum_size int")).collect()}
    assert got == {"o": ("text", 10, 14, "high"), "p": (None, 4, 4, "none"), "q": ("name", 10, 0, "medium")}


def test_records_are_merged_field_by_field():
    label = {"type": "string", "enum": ["LOCATION", "MISCELLANEOUS"]}
    schema = {"type": "object", "properties": {"entities": {"type": "array", "items": {"type": "object", "properties": {"text": {"type": "string"}, "label": label}, "required": ["text", "label"]}}}}
    outputs = [{"entities": [{"text": "Nakatomi", "label": x}]} for x in ("LOCATION", "MISCELLANEOUS", "LOCATION")]
    merger = consensus.Merger(schema)
    merged = merger.object(outputs, schema, top=True)
    assert merged == {"entities": [{"text": "Nakatomi", "label": "LOCATION"}]}
    assert merger.diagnosis(outputs, merged, schema) == [("entities", "array", "items", 3, 0, 1, 1, 1, "text", "identity field", 10.0, 14.0)]


def test_optional_nested_fields_and_nulls():
    inner = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}}
    schema = {"type": "object", "properties": {"o": inner, "n": {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "gone": {"type": "array", "items": {"type": "string"}}}}
    outputs = [{"o": {"a": 1, "b": 2}, "n": None}, {"o": {"a": 1}, "n": 3}, {"o": {"a": 2}, "n": None}]
    assert consensus.Merger(schema).object(outputs, schema, top=True) == {"o": {"a": 1}, "n": None, "gone": []}
    assert consensus.Merger(schema).object(outputs[:2], schema, top=True)["n"] == 3
    assert consensus.Merger(schema, consensus.Options(null_wins_ties=True)).object(outputs[:2], schema, top=True)["n"] is None


def test_similarity_under_a_schema():
    schema = {"type": "object", "properties": {"label": {"enum": ["x", "y"]}, "text": {"type": "string"}, "n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}
    compare = consensus.Comparer(schema)
    a = {"label": "x", "text": "same words", "n": 1, "tags": ["p"]}
    assert compare(a, a, schema) == 1.0
    assert compare(a, {**a, "label": "y"}, schema) == pytest.approx((1.2 + 1.1 + 0.9) / 4.3)
    assert compare(a, {k: v for k, v in a.items() if k != "tags"}, schema) == pytest.approx(3.4 / 4.3)


def test_rows_of_similarities_equal_pairs():
    rng = random.Random(3)
    values = [" ".join(rng.choice(["dolor", "Dólor", "de", "cabeza", "fatiga", "leve", ""]) for _ in range(rng.randint(0, 5))) for _ in range(40)]
    near = consensus.Similarities(values)
    for i, v in enumerate(values):
        assert near.row(i).tolist() == pytest.approx([consensus.string_similarity(v, w) for w in values])


def test_rows_of_objects_equal_pairs():
    rng = random.Random(5)
    item = {"type": "object", "properties": {"text": {"type": "string"}, "n": {"anyOf": [{"type": "integer"}, {"type": "null"}]}, "tags": {"type": "array", "items": {"type": "string"}}, "label": {"enum": ["x", "y"]}}}
    every = {"text": ["dolor de cabeza", "dolor", "fatiga leve", None], "n": [1, 2, None], "tags": [["a"], ["a", "b"], []], "label": ["x", "y"]}
    values = [{k: rng.choice(v) for k, v in every.items() if rng.random() < 0.8} for _ in range(40)]
    merger = consensus.Merger(item)
    near = merger.near(values, item)
    assert isinstance(near, consensus.FieldSimilarities)
    for i, v in enumerate(values):
        assert near.row(i).tolist() == pytest.approx([merger.compare(v, w, item) for w in values])


def test_clusters_equal_plain_ones():
    rng = random.Random(6)
    words = ["dolor", "de", "cabeza", "fatiga", "leve", "aguda"]
    for _ in range(40):
        items = sorted((rng.randrange(5), i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(14))
        plain: list[list[int]] = []
        for k, (trial, _, value) in enumerate(items):
            scored = [(max(consensus.string_similarity(value, items[m][2]) for m in c), -n) for n, c in enumerate(plain) if all(items[m][0] != trial for m in c)]
            best = max(scored, default=(-1.0, 0))
            if best[0] >= 0.6:
                plain[-best[1]].append(k)
            else:
                plain.append([k])
        assert consensus.cluster(items, 0.6) == plain
        values = [v for _, _, v in items]
        assert consensus.medoid(values) == max(range(14), key=lambda i: (round(sum(consensus.string_similarity(values[i], v) for v in values), 12), -i))


def plain_consensus(arrays, alike, threshold, duplicate, by=None):
    """The array consensus restated step by step: arrays of values, a similarity, and one for clustering."""
    by = by or alike
    kept = []
    for trial, items in enumerate(arrays):
        mine = []
        for v in items:
            if all(alike(v, w) < duplicate for w in mine):
                mine.append(v)
        kept += [(trial, v) for v in mine]
    clusters = []
    for trial, v in kept:
        near = [(max(by(v, w) for _, w in c), -k) for k, c in enumerate(clusters) if all(t != trial for t, _ in c)]
        best = max(near, default=(-1.0, 0))
        clusters[-best[1]].append((trial, v)) if best[0] >= threshold else clusters.append([(trial, v)])
    clusters = sorted(enumerate(clusters), key=lambda c: (-len(c[1]), c[0]))
    middle = lambda c: max(range(len(c)), key=lambda i: (round(sum(alike(c[i][1], w) for _, w in c), 12), -i))
    values = [c[middle(c)][1] for _, c in clusters]

    def share(a, b):
        if not a or not b:
            return float(not a and not b)
        left, right, total = list(range(len(a))), list(range(len(b))), 0.0
        while left and right:
            s, i, j = max(((alike(a[i], b[j]), -i, -j) for i in left for j in right))
            total += s
            left.remove(-i)
            right.remove(-j)
        return total / (len(a) + len(b) - total)

    score = lambda chosen: sum(share(chosen, a) for a in arrays) / len(arrays)
    n = len(arrays)
    candidates = [[v for v, (_, c) in zip(values, clusters) if len(c) >= f] for f in sorted({max(1, min(n, f)) for f in (2, *(math.ceil(n * p) for p in (0.4, 0.5, 0.6)))})]
    chosen, left = [], list(range(len(values)))
    while left:
        tried = [(round(score([*chosen, values[i]]), 12), -i) for i in left]
        if max(tried)[0] <= score(chosen) + 1e-12:
            break
        left.remove(-max(tried)[1])
        chosen.append(values[-max(tried)[1]])
    candidates.append(chosen)
    scores = [score(c) for c in candidates]
    good = [i for i, s in enumerate(scores) if s >= max(scores) - 0.06 - 1e-12]
    return candidates[max(good, key=lambda i: (len(candidates[i]), round(scores[i], 12), -i))]


def test_array_consensus_equals_the_plain_rule():
    """Texts whose members differ, choices with repeats within a trial, thousands of random groups."""
    rng = random.Random(12)
    words = ["dolor", "de", "cabeza", "leve", "fatiga"]
    strings, choices = {"type": "array", "items": {"type": "string"}}, {"type": "array", "items": {"enum": ["a", "b", "c", "d"]}}
    for k in range(3000):
        if k % 3:
            arrays = [[rng.choice("abcd") for _ in range(rng.randrange(4))] for _ in range(rng.randint(1, 5))]
            assert consensus.Merger(choices).array(arrays, choices) == plain_consensus(arrays, lambda a, b: float(a == b), 1.0, 1.0)
        else:
            arrays = [[" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randrange(4))] for _ in range(rng.randint(1, 4))]
            assert consensus.Merger(strings).array(arrays, strings) == plain_consensus(arrays, consensus.string_similarity, 0.78, 0.96)
    assert consensus.Merger(choices).array([["d", "d"], []], choices) == []


def test_scalar_consensus_joins_the_nearest_member():
    near = {("a", "b"): 0.8, ("b", "c"): 0.8, ("a", "c"): 0.2}
    alike = lambda x, y: 1.0 if x == y else near[min(x, y), max(x, y)]
    assert consensus.cluster([(0, 0, "a"), (1, 0, "b"), (2, 0, "c")], 0.78, alike) == [[0, 1, 2]]


def test_text_fields_by_joins_equal_groups(spark):
    """Random fields, chains, marks and case, texts without words, a field with most rows; against the walk in one group."""
    rng = random.Random(8)
    words = ["dolor", "de", "cabeza", "leve", "fatiga", "aguda", "Dólor", "en", "la", "noche"]
    rows = []
    for task in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 9, 14]))]
        for trial in range(120 if task == 7 else rng.randint(1, 9)):
            own = [w if rng.random() < 0.9 else rng.choice(words) for w in base]
            value = rng.choice(["", "!?", "!? ...", "  "]) if rng.random() < 0.1 else " ".join(own)
            rows.append((task, "f", trial, 0, json.dumps(value, ensure_ascii=False), False))
    df = spark.createDataFrame(rows, "task_id long, field string, trial int, item int, value string, is_array boolean").repartition(3)
    got = {r.task_id: (r.value, r.support, r.n_rows) for r in consensus.clustered_consensus(df).collect()}
    for task in range(60):
        own = [(t, i, json.loads(v)) for k, _, t, i, v, _ in rows if k == task]
        value, support = consensus.consensus_value(own, False)
        assert got[task] == (json.dumps(value, ensure_ascii=False), support, len(own)), task


def test_items_are_identified_pair_by_pair():
    """An item without the identifying field is compared whole; the others still by their field."""
    item = {"type": "object", "required": ["name", "kind"], "properties": {"name": {"type": "string"}, "kind": {"type": "string"}}}
    schema = {"type": "array", "items": item}
    items = [{"name": "alpha beta", "kind": "one"}, {"kind": "q"}, {"name": "alpha beta", "kind": "zzz"}]
    merger = consensus.Merger(schema)
    rows = [(t, 0, v) for t, v in enumerate(items)]
    assert merger.clusters(rows, item, True)[0] == [[0, 2], [1]]
    assert consensus.Merger(schema).array([[v] for v in items], schema)[0]["kind"] == "one"
    compare = consensus.Comparer(item)
    rng = random.Random(4)
    for _ in range(200):
        rows = [(t, 0, {k: rng.choice(["alpha", "alpha beta", "zz"]) for k in ("name", "kind") if rng.random() < 0.8}) for t in range(5)]
        plain: list[list[int]] = []
        for k, (_, _, v) in enumerate(rows):
            alike = lambda w: compare(v["name"], w["name"], item["properties"]["name"]) if "name" in v and "name" in w else compare(v, w, item)  # noqa: B023, E731
            best = max(((max(alike(rows[m][2]) for m in c), -n) for n, c in enumerate(plain)), default=(-1.0, 0))
            plain[-best[1]].append(k) if best[0] >= 0.62 else plain.append([k])
        assert merger.clusters(rows, item, True)[0] == sorted(plain, key=lambda c: (-len(c), c[0]))


def test_fields_without_values():
    schema = {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "list": {"type": "array"}, "inner": {"type": "object"}}}
    assert consensus.Merger(schema).object([], schema, top=True) == {"text": None, "list": [], "inner": {}}


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k, n in (("hot", 501), ("a", 2), ("b", 1), (None, 40)) for v in rng.integers(0, 50, n)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    for r in ranking.quantiles(df, ["k"], "v", [0.25, 0.5, 1 / 3]).collect():
        own = [v for k, v in rows if k == r.k and v is not None]
        assert r.n == len(own) and r.q == pytest.approx(np.quantile(own, [0.25, 0.5, 1 / 3]).tolist())
    assert ranking.quantiles(df, [], "v", [0.1]).first().q == pytest.approx([np.quantile([v for _, v in rows if v is not None], 0.1)])
    assert len(metrics.describe(df, "v", ["k"]).collect()) == 4


def test_grown_arrays_equal_trying_all():
    import numpy as np

    rng = random.Random(4)
    for _ in range(25):
        values = [f"{rng.choice('abcd')}{rng.choice('xyz')} {rng.choice('klm')}" for _ in range(12)]
        near = consensus.Similarities(values)
        observed, candidates = [[0, 1, 2], [3, 4], [5, 6, 7]], [8, 9, 10, 11]

        def mean(chosen):
            return np.mean([consensus.matched_share(near.block(chosen, o)) if chosen else 0.0 for o in observed])

        chosen, score, left = [], 0.0, list(candidates)
        while left:
            tried = [(round(mean([*chosen, c]), 12), -i) for i, c in enumerate(left)]
            best, i = max(tried)
            if best <= score + 1e-12:
                break
            score = best
            chosen.append(left.pop(-i))
        assert consensus.grown(candidates, observed, near) == chosen


def test_places_over_many_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("k")).repartition(9)
    want = sorted(((-(i % 7), i) for i in range(1000)))
    assert [(-r.v, r.id) for r in ranking.numbered(df, "place", F.desc("v"), "id").orderBy("place").collect()] == want
    within = ranking.numbered_within(df, ["k"], "place", F.desc("v"), "id").collect()
    for key in ("rare", "hot"):
        mine = sorted((r.place, -r.v, r.id) for r in within if r.k == key)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert ranking.numbered(df.limit(0), "place", "id").count() == 0


def test_pair_ties_and_exclusion(spark):
    rows = [(0, c, [1.0, 0.0]) for c in (5, 3, 9)] + [(1, 1, [0.0]), (1, 2, [0.0])]
    cands = spark.createDataFrame(rows, "query long, case_id long, vec array<double>").withColumn("score", F.sqrt(retrieval.dot(F.col("vec"), F.col("vec"))))
    assert [(r.query, r.a, r.b) for r in retrieval.complementary_pairs(cands).orderBy("query").collect()][0] == (0, 3, 5)
    out = spark.createDataFrame([(0, 3)], "query long, case_id long")
    assert [r.case_id for r in retrieval.diverse_top(cands, 2, excluded=out).where("query = 0").orderBy("place").collect()] == [5, 9]
    assert [r.case_id for r in retrieval.diverse_top(cands, 2).where("query = 1").orderBy("place").collect()] == [1, 2]


def test_size_goes_before_rank(spark):
    profile = "fingerprint string, fields array<string>, tags array<string>, names array<string>, terms array<string>"
    tasks = spark.createDataFrame([(1, "f", ["x"], [], ["x"], ["word", "health"])], f"task_id long, {profile}")
    cases = [(i, "f", ["x"], [], ["x"], ["word"], 9000, "d") for i in range(12)] + [(20, "g", [], [], [], ["word"], 10, "public_health"), (21, "g", [], [], [], ["none"], 10, "d")]
    df = spark.createDataFrame(cases, f"case_id long, {profile}, n_chars long, domain string")
    found = retrieval.lexical_ranked(tasks, df, k=2, largest=100).collect()
    assert [(r.case_id, r.score) for r in found] == [(20, 0.5 + 2 - 0.001)]
    assert [r.case_id for r in retrieval.lexical_ranked(tasks, df, k=2).orderBy("place").collect()] == [0, 1]


def test_profiles_take_descriptions_and_all_tags(spark):
    schema = '{"type":"object","description":"Side Effects of drugs","properties":{"dose":{"type":"string","description":"as told"}}}'
    row = (1, schema, ["own"], {"dose": {"value": "1", "tags": ["shown", "own"]}, "form": {"value": None, "tags": None}}, '{"fields":{"dose":{"tags":["judged"],"verdict":true},"form":{}}}')
    cases = spark.createDataFrame([row, (2, schema, None, None, "no json")], "case_id long, schema string, tags array<string>, examples map<string, struct<value string, tags array<string>>>, judge string")
    every = retrieval.case_tags("tags", "examples", "judge")
    got = {r.case_id: r for r in retrieval.profiles(cases.withColumn("all", every).drop("tags"), "schema", F.lit("said"), F.col("all")).collect()}
    assert {"side", "effects", "of", "drugs", "dose", "as", "told", "said"} == set(got[1].terms)
    assert {"own", "shown", "judged"} <= set(got[1].tags) and len(got[1].tags) == len(set(got[1].tags))
    assert not {"own", "shown", "judged"} & set(got[2].tags)


def test_bounded_search_equals_every_pair(spark, monkeypatch):
    """Many tasks and cases, hot groups, tasks without a schema in common, ties; against every pair."""
    rng = random.Random(9)
    monkeypatch.setattr(lexical, "FIRST_CASES", 2)
    monkeypatch.setattr(lexical, "FIRST_GROUPS", 3)
    words = [f"w{i}" for i in range(40)]

    def profile(k):
        if k % 5 == 0:
            return ["none" + str(k), [], [], []]
        kind = 0 if k % 3 else rng.randrange(6)  # one schema has most rows
        return [f"s{kind}", [f"f{kind}", "f"], rng.sample(["t0", "t1", "t2"], rng.randrange(3)), [f"n{kind % 2}"]]

    tasks = [(k, *profile(k), rng.sample(words, rng.choice([0, 1, 20]))) for k in range(30)]
    cases = [(k, *profile(k), rng.sample(words, rng.choice([0, 2, 15, 30])), rng.choice([5, 40, 900, 12_000, 90_000]), rng.choice(["w1", "w2_w3", "far", None])) for k in range(400)]
    schema = "fingerprint string, fields array<string>, tags array<string>, names array<string>, terms array<string>"
    found = retrieval.lexical_ranked(spark.createDataFrame(tasks, f"task_id long, {schema}"), spark.createDataFrame(cases, f"case_id long, {schema}, n_chars long, domain string"), k=3)
    expected = []
    for t, tf, tfields, ttags, tnames, tterms in tasks:
        scores = []
        for c, cf, cfields, ctags, cnames, cterms, n, domain in cases:
            both = lambda a, b: len(set(a) & set(b))
            score = 100 * (tf == cf) + 8 * both(tfields, cfields) + 4 * both(ttags, ctags) + 2 * both(tnames, cnames) + 0.5 * min(12, both(tterms, cterms)) + 2 * bool(set((domain or "").split("_")) & set(tterms)) - min(n / 10_000, 2)
            scores.append((-round(score, 9), c))
        expected += [(t, c, -s, place) for place, (s, c) in enumerate(sorted(scores)[:3], 1) if s < 0]
    got = sorted((r.task_id, r.case_id, r.score, r.place) for r in found.collect())
    assert got == sorted(expected)


def test_grounding_and_shapes(spark):
    leaves = [(1, "code", "ZZZ", "string"), (2, "code", "ABC", "string"), (2, "tags[0]", " ", "string"), (2, "tags[1]", "ﬁne", "string"), (3, "tags", "x", "string")]
    df = spark.createDataFrame(leaves, "task_id long, path string, value string, kind string")
    fields = spark.createDataFrame([("code", True, "string", None, "^[A-Z]{3}$", None, None), ("tags", True, "array", None, None, None, None), ("tags[]", True, "string", None, None, 2, None)], "path string, required boolean, kind string, enum array<string>, pattern string, least_length int, most_length int")
    texts = spark.createDataFrame([(i, "It says abc and FINE") for i in (1, 2, 3)], "task_id long, text string")
    got = {tuple(r) for r in schemas.validation_errors(df, fields, texts, texts).collect()}
    assert got == {(1, "code", "not in text"), (1, "tags", "required"), (2, "tags[0]", "too short"), (2, "tags[0]", "not in text"), (3, "code", "required"), (3, "tags", "shape")}


def test_nulls_break_enums_and_shapes(spark):
    leaves = [(1, "kind", None, "null"), (1, "free", None, "null"), (1, "maybe", None, "null"), (1, "list", None, "null"), (1, "inner", None, "null"), (1, "either", None, "null"), (2, "kind", "a", "string")]
    df = spark.createDataFrame(leaves, "task_id long, path string, value string, kind string")
    spec = [("kind", False, "string", ["a"]), ("free", False, "string", None), ("maybe", False, None, ["a", None]), ("list", False, "array", None), ("inner", False, "object", None), ("either", False, None, None)]
    fields = spark.createDataFrame([(*f, None, None, None) for f in spec], "path string, required boolean, kind string, enum array<string>, pattern string, least_length int, most_length int")
    texts = spark.createDataFrame([(1, "a"), (2, "so: A")], "task_id long, text string")
    got = {tuple(r) for r in schemas.validation_errors(df, fields, texts, texts).collect()}
    assert got == {(1, "kind", "enum"), (1, "list", "shape"), (1, "inner", "shape")}


def test_hot_fingerprints_and_strata(spark):
    """One key has 90 % of the rows."""
    cases = [(k, "hot" if k % 10 else f"f{k % 3}", [float(k % 7), 1.0]) for k in range(400)]
    df = spark.createDataFrame(cases, "case_id long, fingerprint string, vec array<double>").repartition(5)
    tasks = df.where("case_id % 50 < 2").withColumnRenamed("case_id", "task_id")
    own = {i: f for i, f, _ in cases}
    wanted = [i for i in own if i % 50 < 2]
    of = lambda f: sorted(i for i in own if own[i] == f)
    assert sorted((r.task_id, r.case_id, r.n) for r in retrieval.same_schema(tasks, df, 20).collect()) == sorted((t, c, len(of(own[t]))) for t in wanted if len(of(own[t])) >= 20 for c in of(own[t]))
    assert sorted((r.task_id, r.case_id) for r in retrieval.nth_same_schema(tasks, df, 3).collect()) == sorted((t, of(own[t])[2]) for t in wanted)
    sample = retrieval.stratified_sample(df, "case_id", "fingerprint", 0.1, F.col("case_id") % 13)
    taken = {f: {r.case_id for r in sample.collect() if r.fingerprint == f} for f in set(own.values())}
    assert taken == {f: set(sorted(of(f), key=lambda i: (i % 13, i))[: max(1, round(len(of(f)) * 0.1))]) for f in taken}


def test_nearest_report_on_edges_of_bands(spark):
    rng = random.Random(5)
    cells = [(k, "m", round(rng.randrange(40) * 0.00005, 6)) for k in range(60)]
    reports = [("m", round(rng.randrange(40) * 0.00005, 6), f"e{k}") for k in range(60)] + [("m", None, "none")]
    got = compare.attach_nearest(spark.createDataFrame(cells, "cell_id long, model string, f1 double"), spark.createDataFrame(reports, "model string, f1 double, event string"), ["model"]).collect()
    expected = {}
    for k, _, f in cells:
        near = [(abs(f - r), -r, e) for _, r, e in reports if r is not None and abs(f - r) <= 1e-4]
        if near:
            expected[k] = min(near)[2]
    assert {r.cell_id: r.event for r in got} == expected


def test_an_index_grows_by_unseen_texts_only(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def embed(texts):
        import uuid

        (calls / uuid.uuid4().hex).write_text("\n".join(texts))
        return schemas.hashed_vectors(texts)

    old, new = spark.createDataFrame([("one",), ("two",), ("one",)], "t string"), spark.createDataFrame([("two",), ("three",), (None,)], "t string")
    path = str(tmp_path / "index")
    schemas.grown_vectors(None, old, "t", embed).write.parquet(path)
    for f in calls.iterdir():
        f.unlink()
    known = spark.read.parquet(path)
    grown = schemas.grown_vectors(known, new, "t", embed).collect()
    assert sorted(x for f in calls.iterdir() for x in f.read_text().split("\n")) == ["", "three"]
    whole = {r["__key"]: r.vec for r in schemas.grown_vectors(None, old.unionByName(new), "t").collect()}
    assert {r["__key"]: r.vec for r in grown} == whole and len(grown) == 4
    both = lambda **k: sorted((r.t or "", r.vec) for r in schemas.embedded(new, "t", **k).collect())
    assert both(known=known) == both()


def test_field_index_over_an_earlier_one(spark, tmp_path):
    from fieldtally.sources import files

    schema = lambda k: f'{{"type":"object","properties":{{"f{k}":{{"type":"string","description":"told {k}"}}}}}}'
    cases = spark.createDataFrame([(k, schema(k % 4)) for k in range(8)], "owner long, schema string")
    first, second, whole = (str(tmp_path / n) for n in ("first", "second", "whole"))
    files.build_field_index(cases.where("owner % 4 < 2"), first)
    seen = tmp_path / "seen"
    seen.mkdir()

    def embed(texts):
        import uuid

        (seen / uuid.uuid4().hex).write_text("\n".join(texts))
        return schemas.hashed_vectors(texts)

    grown = files.build_field_index(cases, second, embed, before=first)
    told = [t for f in seen.iterdir() for t in f.read_text().split("\n") if t]
    assert len(told) == 2 and {x for t in told for x in ("f0", "f1", "f2", "f3") if x in t} == {"f2", "f3"}
    full = files.build_field_index(cases, whole)
    assert all(sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect())) for a, b in zip(grown, full))


def test_many_strings_in_one_text():
    rng = random.Random(3)
    for _ in range(200):
        source = "".join(rng.choice("ab ") for _ in range(60))
        values = ["".join(rng.choice("ab ") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(30))]
        assert text.found_in(values, source) == [bool(v) and v in source for v in values]


def test_extremes_of_ties(spark):
    rows = [("m", k, float(k % 3)) for k in range(30)] + [("n", 1, -1.0)]
    got = compare.extremes(spark.createDataFrame(rows, "model string, task_id long, delta double").repartition(4), ["model"], 3).collect()
    assert sorted((r.model, r.side, r.place, r.task_id) for r in got) == [("m", "gain", 1, 2), ("m", "gain", 2, 5), ("m", "gain", 3, 8), ("m", "loss", 1, 0), ("m", "loss", 2, 3), ("m", "loss", 3, 6), ("n", "gain", 1, 1), ("n", "loss", 1, 1)]


def test_names_and_words(spark):
    parts = metrics.report_name_parts(F.lit("/x/ev__p__Qwen3-14B__think.json"))
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()], text.folded(F.lit(" ＡB ß ")).alias("folded")).first()
    assert tuple(row) == ("ev", "p", "qwen3-14b", "think", None, "ab ss")


def test_bucket_tasks_keep_null_buckets_and_cross_ranges(spark, monkeypatch):
    """Lists of many ranges make the same parts as one list a bucket; buckets without a name and null tasks stay."""
    monkeypatch.setattr(metrics, "RANGE_ROWS", 7)
    ids = [*range(40), *range(40), None]
    data = [("p" if k % 3 else None, i, "ab"[(i or 0) % 2], None if i is None or i % 5 == 0 else "s", ["t"] if (i or 0) % 4 == 0 else []) for k, i in enumerate(ids)]
    rows = spark.createDataFrame(data, "pipeline string, task_id long, prefix string, schema string, tags array<string>")
    want = {}
    for pipeline, i, prefix, schema, tags in data:
        for family, bucket in [("overall", "all"), ("prefix", prefix), ("schema", schema), *(("tag", t) for t in tags)]:
            want.setdefault((pipeline, family, bucket), set()).add(i)
    parts = {}
    for group, own in want.items():
        order = sorted(own, key=lambda i: (i is None, i))
        for k in range(0, len(order), 9):
            parts[*group, k // 9] = (";".join(str(i) for i in order[k : k + 9] if i is not None), len(order[k : k + 9]))
    got = metrics.bucket_tasks(rows, ["pipeline"], "tags", 9).collect()
    assert len(got) == len(parts)
    assert {(r.pipeline, r.family, r.bucket, r.part): (r.tasks, r.n_tasks) for r in got} == parts


def test_ngram_counts_equal_the_ngrams(spark):
    texts = ["", None, "a", "ab", "abc", "abab" * 50, "x\U0001f600y" * 40, "no two alike"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    g, c = text.char_ngrams(F.col("t")), text.char_ngram_counts(F.col("t"))
    for r in rows.select("t", g.alias("g"), c.alias("c")).collect():
        expected = (None,) * 4 if r.t is None else (len(r.g), len(set(r.g)), r.g[0] if r.g else None, r.g[-1] if r.g else None)
        assert tuple(r.c) == expected
    long = spark.createDataFrame([("ab" * 1_000_000,)], "t string").select(text.char_ngram_counts(F.col("t")).alias("c")).first().c
    assert tuple(long) == (1_999_998, 2, "aba", "bab")
    assert text._distinct_ngrams("abcdabcd", 4) == 4


def test_ngrams_of_documents_without_text(spark, tmp_path):
    from fieldtally.plans import registry

    spark.createDataFrame([(0, ""), (1, None), (2, "Ab")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "x"), (1, "y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = registry.queries()["p3_char_ngrams"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, None, None), (1, 1, 0, None, None), (2, 1, 1, "ab", "ab")]
