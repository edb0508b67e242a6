"""Hand-written records with exact expectations."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.functions import records, text
from fieldtally.operators import compare, consensus, metrics, ranking, retrieval, scoring
from fieldtally.sources import files


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_micro_metrics_and_failed_tasks(spark):
    df = spark.createDataFrame([("r", 2.0, 2, 2), ("r", 1.0, 2, 2), ("s", 0.0, 3, 0)], "run string, tps double, gold_keys int, system_keys int")
    assert values(metrics.micro_metrics(df, ["run"]), "run", "precision", "recall", "f1") == [("r", 0.75, 0.75, 0.75), ("s", 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("system, baseline, gap", [(0.8, 0.6, 0.5), (0.9, 0.6, 0.75), (0.6, 0.6, 0), (0.5, 0.6, 0), (1, 0.6, 1), (1, 1, 1), (0.7, 1, 0)])
def test_gap_closed(spark, system, baseline, gap):
    assert spark.range(1).select(metrics.gap_closed(F.lit(float(system)), F.lit(float(baseline))).alias("g")).first().g == pytest.approx(gap)


def test_timing_and_tokens(spark):
    df = spark.createDataFrame([(10.0, 15000), (20.0, 30000), (90.0, 80000), (None, None)], "elapsed_s double, tokens long")
    assert tuple(metrics.timing_summary(df, [], 60.0).first()) == (3, 40.0, 90.0, 1, True)
    assert metrics.token_summary(df, [], 32000).select("total_tokens", "over_target", "over_soft_cap").first() == (125000, 1, 1)


def test_usage_disagreement(spark):
    rows = [(1, 10000, 10050), (2, 10000, 20000), (3, 500, 1400), (4, 500, 1600)]
    log = spark.createDataFrame([(k, a, 0) for k, a, _ in rows], "key long, prompt_tokens long, completion_tokens long")
    header = spark.createDataFrame([(k, b) for k, _, b in rows], "key long, header_tokens long")
    assert values(metrics.usage_totals(log, header, ["key"]), "key", "disagrees") == [(1, False), (2, True), (3, False), (4, True)]


REPORT = "team string, model string, pipeline string, slug string, f1 double, file string"


def test_ranking_with_clashing_baselines(spark):
    df = spark.createDataFrame([("org", "m1", "baseline", "official", 0.6, "a"), ("x", "m1", "baseline", "other", 0.7, "b"), ("x", "m1", "p", "other", 0.8, "c"), ("y", "m2", "p", "y", 0.9, "d")], REPORT)
    base = ranking.baselines(df, "official")
    assert values(base, "model", "baseline_f1", "n_baselines") == [("m1", 0.6, 2)]
    entries = ranking.ranked_entries(df, base)
    assert [(r.team, r.pipeline, round(r.gap, 6), r.place) for r in entries.orderBy("place").collect()] == [("x", "p", 0.5, 1), ("x", "baseline", 0.25, 2)]
    assert values(ranking.without_baseline(df, base), "model") == [("m2",)]


def test_leaderboard_counts_missing_models_as_zero(spark):
    df = spark.createDataFrame([("a", "m1", "p", "s", 0.5, "1"), ("a", "m2", "p", "s", 0.5, "2"), ("b", "m1", "p", "s", 0.9, "3")], REPORT)
    got = ranking.leaderboard(df, "f1").orderBy("place").collect()
    assert [(r.team, round(r.average, 6)) for r in got] == [("a", 0.5), ("b", 0.45)]


def test_tertiles_need_three_values(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, v double")
    assert values(metrics.tertiles(df, "id", "v", "bin"), "bin") == [(None,), (None,)]


def test_value_similarity(spark):
    rows = [("null", "null", True, 1.0), ('"a"', "null", True, 0.0), ("null", '"a"', False, 0.0), ("1", "1.0", True, 1.0), ("true", "1", True, 1.0), ('"2026-05-22"', '"2026-05-21"', True, 0.0), ('"red car"', '"red bus"', False, 1 / 3)]
    df = spark.createDataFrame(rows, "g string, s string, rigid boolean, want double")
    for r in df.select("*", scoring.value_similarity(F.col("g"), F.col("s"), F.col("rigid")).alias("got")).collect():
        assert r.got == pytest.approx(r.want), r


def test_lists_are_order_free(spark):
    gold = [{"text": "Apple", "label": "ORG"}, {"text": "Steve Jobs", "label": "PERSON"}]
    assert scoring.list_score(gold, gold[::-1]) == 1.0
    assert 0.32 < scoring.list_score(gold, [gold[0], {"text": "Microsoft", "label": "ORG"}]) < 0.5
    assert scoring.list_score([], []) == 1.0 and scoring.list_score([], gold) == 0.0
    df = spark.createDataFrame([(json.dumps(gold), json.dumps(gold[::-1])), (None, "[]")], "g string, s string")
    assert [r.v for r in df.select(scoring.list_scores(F.col("g"), F.col("s")).alias("v")).collect()] == [1.0, None]


def test_greedy_takes_the_best_pair_first():
    rng = np.random.default_rng(0)
    for _ in range(50):
        m = np.round(rng.random((4, 3)), 1)
        pairs, left, right, total = sorted((-m[i, j], i, j) for i in range(4) for j in range(3)), set(), set(), 0.0
        for s, i, j in pairs:
            if i not in left and j not in right and s < 0:
                left.add(i)
                right.add(j)
                total -= s
        assert scoring.greedy_total(m) == pytest.approx(total)


def test_flatten():
    assert records.flatten({"a": {"b": 1, "c": {}}, "d": [], "e": [{"x": 1}]}) == [("a.b", 1), ("d", []), ("e", [{"x": 1}])]
    assert records.flatten({"e": [{"x": 1}, 2]}, expand_lists=True) == [("e[0].x", 1), ("e[1]", 2)]


def test_rigid_rules():
    props = {"s": {"type": "string"}, "n": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "d": {"type": "string", "format": "date"}, "o": {"type": "object", "properties": {"t": {"type": "string"}}}, "k": {"$ref": "#/$defs/K"}}
    got = {f["path"]: f["rigid"] for f in records.fields({"type": "object", "properties": props, "$defs": {"K": {"enum": ["A", "B"]}}})}
    assert got == {"s": False, "n": True, "d": True, "o": True, "o.t": True, "k": True}


def test_schema_fields_and_recursion(spark):
    loop = {"properties": {"a": {"$ref": "#"}}, "type": "object"}
    df = spark.createDataFrame([("f", json.dumps({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "string"}}}}}})), ("g", json.dumps(loop)), ("g", json.dumps(loop)), ("h", None)], "fp string, schema string")
    got = records.schema_fields(df, "fp", "schema").collect()
    assert sorted((r.fp, r.path or "", bool(r.required)) for r in got) == [("f", "a", True), ("f", "b", False), ("f", "b[].c", False), ("g", "", False), ("h", "", False)]


def test_fingerprint_ignores_wording_and_order(spark):
    a, b, c = ({"type": "object", "description": d, "required": r, "properties": {"x": {"type": t}}} for d, r, t in (("one", ["x", "y"], "string"), ("two", ["y", "x"], "string"), ("two", ["y", "x"], "integer")))
    df = spark.createDataFrame([(json.dumps(s),) for s in (a, b, c)], "s string")
    x, y, z = (r.f for r in df.select(records.schema_fingerprint(F.col("s")).alias("f")).collect())
    assert x == y != z


def test_null_coercion_and_repair():
    schema = {"properties": {"a": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "b": {"type": "string"}, "c": {"type": "array", "items": {"$ref": "#/$defs/N"}}}, "$defs": {"N": {"type": ["string", "null"]}}}
    assert records.coerce_nulls({"a": " NULL ", "b": "null", "c": ["null", "x"], "d": "null"}, schema) == {"a": None, "b": "null", "c": [None, "x"], "d": "null"}
    assert records.repaired({"a": "caf\\u00e9 \\u0007 \\ud800 é \\u12"}) == {"a": "café \\u0007 \\ud800 é \\u12"}
    assert records.first_json('Sure: {bad} {"a": 1} end') == ('{"a":1}', "salvaged") and records.first_json("[1") == (None, "invalid")


def test_words_are_unicode(spark):
    row = spark.createDataFrame([("Ñandú  Über_x, 2",)], "t string").select(text.words(F.col("t")).alias("w"), text.normalized(F.col("t")).alias("n"), text.char_ngrams(F.lit("ab")).alias("g")).first()
    assert row.w == ["ñandú", "über_x", "2"] and row.n == "nandu uber_x, 2" and row.g == ["ab"]


def test_consensus_of_strings_and_arrays():
    rows = [(0, 0, "dolor de cabeza"), (1, 0, "dolor de la cabeza"), (2, 0, "cefalea aislada")]
    assert consensus.consensus_value(rows, False, consensus.Options(scalar_threshold=0.65))[0].startswith("dolor")
    lists = [["fatiga", "cefalea", "dolor lumbar"], ["fatiga", "cefalea"], ["fatiga", "dolor lumbar leve", "cefalea"]]
    got = consensus.consensus_value([(t, i, v) for t, items in enumerate(lists) for i, v in enumerate(items)], True, consensus.Options(item_threshold=0.65))[0]
    assert {"fatiga", "cefalea"} <= set(got) and any(v.startswith("dolor") for v in got)
    objects = [(t, 0, {"text": "Nakatomi", "label": label}) for t, label in enumerate(["LOCATION", "LOCATION", "MISCELLANEOUS"])]
    assert consensus.consensus_value(objects, True, consensus.Options(object_threshold=0.4))[0] == [{"text": "Nakatomi", "label": "LOCATION"}]
    assert consensus.cluster([(0, 0, "a b"), (0, 1, "a b")], 0.5) == [[0], [1]]


def test_scope_compares_arrays_as_multisets(spark):
    vals = spark.createDataFrame([(1, "f", t, i, v) for t, items in enumerate([["x", "y"], ["y", "x"]]) for i, v in enumerate(items)], "task_id long, field string, trial long, item long, value string")
    tasks = spark.createDataFrame([(1, "f", 2, True), (1, "g", 2, False), (1, "h", 2, True)], "task_id long, field string, n_trials long, required boolean")
    assert values(consensus.field_scope(vals, tasks), "field", "scope") == [("f", "stable"), ("g", "skipped"), ("h", "disputed")]


def test_pair_choice_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(q, c, [float(max(0, rng.gauss(0.2, 0.4))) for _ in range(4)]) for q in range(3) for c in range(12)]
    cands = spark.createDataFrame(rows, "query long, case_id long, vec array<double>").withColumn("score", F.sqrt(retrieval.dot(F.col("vec"), F.col("vec"))))
    got = {r.query: (r.a, r.b) for r in retrieval.complementary_pairs(cands).collect()}
    for q in range(3):
        own = {c: np.array(v) for k, c, v in rows if k == q}
        pair = lambda a, b: np.linalg.norm(own[a] + own[b]) + np.linalg.norm(own[a] - own[b])  # noqa: B023, E731
        assert got[q] == max(((a, b) for a in own for b in own if a < b), key=lambda p: pair(*p))


def test_stratified_samples_are_nested(spark):
    df = spark.range(8).select("id", F.lit("s").alias("t"))
    a, b = ({r.id for r in retrieval.stratified_sample(df, "id", "t", f, F.xxhash64("id")).collect()} for f in (0.25, 0.5))
    assert len(a) == 2 and len(b) == 4 and a < b


def test_usage_falls_into_windows(spark):
    log = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,i * 30,0) ts, 'k' key, i from range(8) t(i)")
    windows = spark.sql("select 'k' key, 'a' task_id, timestamp'2024-01-01 00:30:00' started, timestamp'2024-01-01 02:00:00' ended")
    assert values(compare.attribute_usage(log, windows), "i") == [(1,), (2,), (3,)]


def test_sources(spark, tmp_path):
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks/t_1.json").write_text(json.dumps({"id": "t_1", "input_text": "x", "instruction": "i", "target_schema": {"b": 1, "a": 1.0}, "output": None, "metadata": {"domain": "d"}}))
    (tmp_path / "tasks/t_1.review.json").write_text(json.dumps({"id": "t_1"}))
    row = files.read_tasks(spark, str(tmp_path / "tasks")).collect()
    assert len(row) == 1 and row[0].target_schema == '{"b":1,"a":1.0}' and row[0].metadata == {"domain": "d"} and row[0].output is None
    (tmp_path / "reports").mkdir()
    good = {"participant": {"team_name": "a"}, "config": {"model": "m", "pipeline": "p"}, "metrics": {"f1": 0.5}, "tasks": [{"task_id": "t", "tps": 1.0}]}
    (tmp_path / "reports/team--m.json").write_text(json.dumps(good))
    (tmp_path / "reports/x__m.json").write_text(json.dumps(good))
    (tmp_path / "reports/bad.json").write_text("{")
    (tmp_path / "reports/no.json").write_text(json.dumps({"metrics": {}}))
    assert values(files.read_reports(spark, str(tmp_path / "reports")), "slug") == [("team",), ("x",)]
    for name, found in (("task", "gold pred prediction"), ("task2", "gold prediction"), ("task3", "gold")):
        (tmp_path / f"details/{name}").mkdir(parents=True)
        for f in ["task", *found.split()]:
            (tmp_path / f"details/{name}/{f}.json").write_text(json.dumps({"of": f}))
    assert values(files.read_details(spark, str(tmp_path / "details")), "task_id", "prediction") == [("task", '{"of": "pred"}'), ("task2", '{"of": "prediction"}')]
    for path, body in (("direct/p/r1/t_1", {"output": {"a": 1}}), ("mixed/p/r1/t_1/trial_1", {"output": {}, "extraction": "strict"}), ("mixed/p/r1/t_1/trial_2", {"output": {}, "extraction": "none"}), ("mixed/p/r1/t_1/judge", {"output": {}, "extraction": "strict"}), ("direct/p/r1/t_9", {"output": {}})):
        f = tmp_path / f"runs/{path}.json"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(body))
    golden = spark.createDataFrame([("t_1",)], "task_id string")
    assert values(files.read_predictions(spark, str(tmp_path / "runs"), golden), "source", "step") == [("direct", ""), ("mixed", "trial_1")]
    (tmp_path / "cases").mkdir()
    for i, schema in enumerate(({"type": "object", "properties": {}}, {"type": "array"})):
        (tmp_path / f"cases/{i}.json").write_text(json.dumps({"id": f"c{i}", "domain": "d", "schema": schema}))
    assert values(files.read_cases(spark, str(tmp_path / "cases")), "id") == [("c0",)]


def test_many_documents_make_few_files(spark, tmp_path):
    from fieldtally.plans import stores

    rows = spark.range(1, 201).select(F.col("id").alias("k"), F.col("id").alias("__no"), F.col("id").cast("string").alias("id"))
    path = stores._single_files(rows, str(tmp_path / "tasks"))
    assert len(list((tmp_path / "tasks").rglob("part-*"))) < 60
    assert files.read_tasks(spark, path).count() == 200


def test_packed_documents_read_as_files(spark, tmp_path):
    (tmp_path / "reports").mkdir()
    good = {"participant": {"team_name": "a"}, "config": {"model": "m"}, "metrics": {"f1": 0.5}}
    (tmp_path / "reports/own--m.json").write_text(json.dumps(good))
    names = ["/x__m.json", "/y--m__x.json"]
    packed = spark.createDataFrame([*[(n, json.dumps(good)) for n in names], ("/bad.json", "{")], "file string, value string")
    files.write_packed(packed, str(tmp_path / "reports/packed"))
    assert values(files.read_reports(spark, str(tmp_path / "reports")), "slug") == [("own",), ("x",), ("y",)]


def test_packed_details_go_with_single_files(spark, tmp_path):
    (tmp_path / "details/b").mkdir(parents=True)
    for f in ("task", "gold", "prediction"):
        (tmp_path / f"details/b/{f}.json").write_text(json.dumps({"of": f}))
    rows = [(f"/a/{f}.json", json.dumps({"of": f})) for f in ("task", "gold", "pred", "prediction")] + [("/c/task.json", "{}")]
    files.write_packed(spark.createDataFrame(rows, files.PACKED_SCHEMA), str(tmp_path / "details/packed"))
    assert values(files.read_details(spark, str(tmp_path / "details")), "task_id", "prediction") == [("a", '{"of": "pred"}'), ("b", '{"of": "prediction"}')]


def test_packed_predictions(spark, tmp_path):
    good = json.dumps({"output": {"a": 1}, "extraction": "strict"})
    failed = json.dumps({"output": {}, "extraction": "strict", "error": "x"})
    rows = [("/direct/p/r1/t_1.json", good), ("/mixed/p/r1/t_1/trial_1.json", good), ("/mixed/p/r1/t_1/trial_2.json", failed), ("/mixed/p/r1/t_1/judge.json", good), ("/direct/p/r1/t_9.json", good)]
    files.write_packed(spark.createDataFrame(rows, files.PACKED_SCHEMA), str(tmp_path / "runs/packed"))
    golden = spark.createDataFrame([("t_1",)], "task_id string")
    assert values(files.read_predictions(spark, str(tmp_path / "runs"), golden), "source", "step") == [("direct", ""), ("mixed", "trial_1")]


def test_packed_tasks_leave_sidecars_out(spark, tmp_path):
    task = json.dumps({"id": "t", "target_schema": {"b": 1, "a": 1.0}, "metadata": {"domain": "d"}})
    rows = [("/t.json", task), ("/t.review.json", task), ("/bad.json", "{")]
    files.write_packed(spark.createDataFrame(rows, files.PACKED_SCHEMA), str(tmp_path / "tasks"))
    assert values(files.read_tasks(spark, str(tmp_path / "tasks")), "id", "target_schema") == [("t", '{"b":1,"a":1.0}')]


def test_schema_tasks_in_parts_join_to_whole_lists(spark):
    ids = [str(i) for i in range(25)]
    tasks = spark.createDataFrame([("a" if int(i) % 2 else None, i, f"t{int(i) % 3}") for i in ids] + [("a", "1", "t9")], "fingerprint string, task_id string, title string")
    parts = metrics.schema_tasks(tasks, 5)
    assert parts.count() > 4 and all(len(r.task_ids.split(";")) <= 5 for r in parts.collect())
    found = {r.fingerprint: (r.task_ids, r.titles, r.n_tasks) for r in metrics.whole_schema_tasks(parts).collect()}
    side = lambda odd: ";".join(sorted(i for i in ids if int(i) % 2 == odd))
    assert found == {"a": (side(1), "t0;t1;t2;t9", 13), None: (side(0), "t0;t1;t2", 13)}


def test_frequent_and_rare_texts_get_their_vectors_without_a_wide_broadcast(spark, monkeypatch):
    from fieldtally.operators import schemas

    monkeypatch.setattr(schemas, "HOT_ROWS", 5)
    monkeypatch.setattr(schemas, "MOST_HOT", 1)
    rows = spark.createDataFrame([(i, "often" if i < 20 else "too" if i < 30 else f"rare {i}") for i in range(40)] + [(40, None)], "owner int, text string")
    known = schemas.grown_vectors(None, rows, "text", lambda ts: [[float(len(t))] for t in ts])
    found = schemas.with_known_vectors(rows, "text", known)
    assert {r.owner: r.vec[0] for r in found.collect()} == {r.owner: float(len(r.text or "")) for r in rows.collect()} and found.count() == 41
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_entity_lists_score_as_their_items(spark):
    from fieldtally.operators import scoring

    gold = [(1, 0, ["a", "b", "a"]), (1, 1, ["c"]), (2, 0, ["d"]), (4, 1, [])]
    found = [(1, 0, ["b", "x"]), (2, 0, ["d"]), (3, 1, ["y", "z"])]
    lists = [spark.createDataFrame(x, "task_id int, category int, items array<string>") for x in (gold, found)]
    items = [x.select("task_id", "category", F.explode("items").alias("item")) for x in lists]
    for keys in (["task_id"], ["category"]):
        columns = [*keys, "tp", "fp", "fn", "precision", "recall", "f1"]
        assert values(scoring.entity_list_scores(*lists, keys), *columns) == values(scoring.entity_scores(*items, keys), *columns)
    columns = ["task_id", "category", "item", "issue"]
    found = scoring.entity_list_differences(*lists)
    assert values(found, *columns) == values(scoring.entity_differences(*items), *columns)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # lists of either side once, no item by itself


def test_candidates_are_made_once_for_all_selections(spark, sf_dir):
    from fieldtally.plans import lookups

    found = lookups.cands(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # kept, not joined and grouped again by each that reads it


def test_results_without_diagnostics_are_found_without_a_sort(spark):
    results = spark.range(12).select((F.col("id") % 6).alias("task_id"), F.col("id").alias("run"))
    told = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (None, "c")], "task_id long, route string")
    missing = compare.join_diagnostics(results, told)[1]
    assert values(missing, "task_id", "run") == [(i % 6, i) for i in (2, 8, 3, 9, 4, 10, 5, 11)]
    assert "strategy=shuffle_hash" in missing._jdf.queryExecution().optimizedPlan().toString()
