"""What keeps steps in proportion to their input, with whole results."""

import glob
import re

from pyspark.sql import functions as F

from fieldtally.functions import sizes
from fieldtally.llm import near
from fieldtally.operators import consensus, schemas
from fieldtally.plans import stores, texts
from fieldtally.sources import files


def _reports(spark, ids):
    rows = spark.createDataFrame([(f"s{i}--{i}", i, ("team",), ("m", "p"), (0.5,)) for i in ids], "k string, __no long, participant struct<team_name:string>, config struct<model:string,pipeline:string>, metrics struct<f1:double>")
    return rows.coalesce(1)


def test_packed_documents_are_spread(spark, tmp_path):
    """One small file of rows gives packed files for all cores; numbers below 1 are packed too, so that only a fixed number of folders is made."""
    path = stores._single_files(_reports(spark, [*range(-300, 300)]), f"{tmp_path}/r")
    assert len(glob.glob(f"{path}/packed/part-*.parquet")) > 3
    assert len(glob.glob(f"{path}/k=*")) == stores.SINGLE_FILES + 1  # and the one that isn't JSON
    found = files.read_reports(spark, path)
    assert sorted(r.slug for r in found.collect()) == sorted(f"s{i}" for i in range(-300, 300))


def test_report_is_parsed_once(spark, tmp_path):
    path = stores._single_files(_reports(spark, [1, 50]), f"{tmp_path}/r")
    plan = files.read_reports(spark, path).groupBy("slug").agg(F.max("metrics.f1"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_last_join_of_near_copies_takes_whole_nodes(spark, monkeypatch):
    """No join makes a row for every shingle of a node; texts with a common passage stay apart, copies meet."""
    passage = " ".join(f"common{i}" for i in range(40))
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"{passage} {own(i // 2)}" + (" tail" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    plans, verified = [], near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, *more: (plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()), verified(pairs, *more))[1])
    found = {r.doc_id: r.component_id for r in near.near_copies(docs).collect()}
    assert found == {i: i // 2 * 2 for i in range(60)}
    assert plans and not any(re.search(r"Join Inner, \(node#\d+L = node#\d+L\)", p) for p in plans)


def _few_at_a_time(values):
    assert len(values) <= 256, "a batch grows with its task"
    return schemas.hashed_vectors(values)


def test_texts_are_embedded_in_small_batches(spark):
    pairs = spark.range(3000, numPartitions=1).select("id", F.concat(F.lit("text "), "id").alias("a"), F.lit("text 7").alias("b"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = schemas.hybrid_similarity(pairs, "a", "b", embed=_few_at_a_time)
    assert found.count() == 3000 and found.where("id = 7").first().hybrid == 1.0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_consensus_groups_are_dealt_over_all_cores(spark):
    """Groups of few bytes take long, so adaptive execution must not join them into one task."""
    rows = [(t, k, f'{{"head":"text {t}"}}', []) for t in range(40) for k in range(3)]
    trials = spark.createDataFrame(rows, "task_id long, trial long, output string, errors array<string>")
    merged = consensus.record_consensus(trials, '{"type":"object","properties":{"head":{"type":"string"}}}')
    assert merged.count() == 40 and merged.rdd.getNumPartitions() == 4


def test_records_are_walked_on_all_cores(spark, sf_dir):
    assert texts.order_records(spark, sf_dir).rdd.getNumPartitions() == 4


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_of_a_small_file_are_not_broadcast(spark, tmp_path, sf_dir):
    from fieldtally.plans import registry

    spark.range(300).write.parquet(f"{tmp_path}/a")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.range(1000)
    assert "BroadcastHashJoin" in _plan(b.join(a, "id")) and "BroadcastHashJoin" in _plan(b.join(sizes.meeting(a, 300), "id"))
    many = b.join(sizes.meeting(a, 299), "id")
    assert "BroadcastHashJoin" not in _plan(many) and many.count() == 300
    assert "BroadcastHashJoin [owner" not in _plan(registry.queries()["snk4_case_index"](spark, sf_dir))  # the last one, of two sides, may be


def test_texts_of_an_index_are_not_broadcast_beyond_the_limit(spark, tmp_path, monkeypatch):
    """The index is the same whether its texts are few enough for a broadcast or not."""
    schema = '{"type":"object","properties":{"a%d":{"type":"integer"},"b":{"type":"string"}}}'
    cases = spark.createDataFrame([(i, schema % (i % 7)) for i in range(20)], "owner long, schema string")
    plain = lambda rows: sorted((r.owner, r.name, tuple(r.vec)) for r in rows.collect())
    few = plain(files.build_field_index(cases, f"{tmp_path}/few")[0])
    asked, own = [], sizes.meeting
    monkeypatch.setattr(sizes, "meeting", lambda rows: asked.append(1) or own(rows, 3))
    assert plain(files.build_field_index(cases, f"{tmp_path}/many")[0]) == few and len(few) == 40 and asked
