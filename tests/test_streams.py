"""Streams in several runs of one checkpoint: late rows, restarts, hot keys, state against batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldtally.streaming import live, logs

START = datetime(2024, 1, 1)
STATUS = logs.STATUS_SCHEMA


def at(minutes):
    return START + timedelta(minutes=minutes)


def reports(n, seed=1):
    """Rows of which one model, and one team in it, has nine of ten; ties, nulls and repeated rows among them."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        model, team = ("m0", "t0") if r.random() < 0.9 else (r.choice(["m1", "m2", None]), r.choice(["t1", "t2", "t3", "t4", "t5", None]))
        if model == "m0" and r.random() < 0.1:
            team = f"t{r.randrange(9)}"
        rows.append((at(i), team, f"p{r.randrange(3)}", model, r.choice(["done", "failed", "queued", None]), r.choice([None, 0.25, 0.5, round(r.random(), 2)])))
    return rows + rows[:20]


def runs(spark, path, rows, schema, parts, step):
    """Writes the rows in parts and lets ``step`` run after each, as a stream that stops and goes on."""
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
        step()


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_board_and_progress_over_restarts_equal_the_batch(spark, tmp_path):
    rows, source = reports(400), str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(STATUS).parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def step():
        live.resume(live.board(stream(), 3), str(tmp_path / "board"), "update")
        live.resume(live.progress(stream()), str(tmp_path / "progress"), "append")

    runs(spark, source, rows, STATUS, 3, step)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    best = {}
    for _, team, _, model, _, f1 in rows:
        if team is not None and f1 is not None:
            best[(model, team)] = max(f1, best.get((model, team), -1))
    want = []
    for model in {m for m, _ in best}:
        first = sorted(((-f1, t) for (m, t), f1 in best.items() if m == model))[:3]
        want += [(t, model, -f1, i + 1) for i, (f1, t) in enumerate(first)]
    assert plain(live.board_now(spark, str(tmp_path / "board"), 3)) == sorted(want, key=repr)
    held = live.state(spark, str(tmp_path / "board"), "board")
    assert held.agg(F.max(F.size("slugs"))).first()[0] <= 3
    assert held.where("model = 'm0'").count() == live.SALTS  # the hot model is spread
    sums = {}
    for _, team, pipeline, model, status, f1 in rows:
        s = sums.setdefault((team, model), [0, 0, None, None])
        s[0] += status == "done"
        s[1] += status == "failed"
        if f1 is not None and (s[2] is None or (f1, pipeline) > (s[2], s[3])):
            s[2:] = f1, pipeline
    assert plain(live.progress_now(spark, str(tmp_path / "progress"))) == sorted(((*k, *v) for k, v in sums.items()), key=repr)


def test_silent_keys_are_closed_and_late_rows_dropped(spark, tmp_path):
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    made = lambda: live.progress(spark.readStream.schema(STATUS).parquet(source), idle_s=3600, late="10 minutes", salts=1)
    row = lambda minute, slug, f1, status="done": (at(minute), slug, "p", "m", status, f1)
    parts = [[row(0, "a", 0.5), row(5, "a", 0.7)], [row(50, "a", 0.6, "failed"), row(100, "b", 0.1)], [row(300, "b", 0.2)], [row(3, "a", 0.9), row(310, "b", 0.3)]]
    closed = []
    for part in parts:
        spark.createDataFrame(part, STATUS).coalesce(1).write.mode("append").parquet(source)
        live.resume(made(), run, "append")
        closed.append(spark.read.schema(made().schema).parquet(f"{run}/out").count())
    assert closed[1:] == [0, 1, 1]  # a closes at 110, when the mark stands at 290; the row of 300 has moved b's timer to 360 before
    assert plain(live.state(spark, run, "progress").select("slug", "done")) == [("b", 3)]
    assert plain(live.progress_now(spark, run, made().schema)) == [("a", "m", 2, 1, 0.7, "p"), ("b", "m", 3, 0, 0.3, "p")]  # the row of minute 3 came too late


USAGE = "ts timestamp, api_key string, model string, prompt_tokens bigint, completion_tokens bigint"
WINDOWS = "key string, task_id bigint, started timestamp, ended timestamp"


def both(spark, tmp_path, batches, **options):
    """Runs the join after each (log rows, windows) and returns what it gave."""
    log, tasks, run = (str(tmp_path / x) for x in ("log", "tasks", "run"))
    for rows, windows in batches:
        spark.createDataFrame(rows, USAGE).coalesce(1).write.mode("append").parquet(log)
        spark.createDataFrame(windows, WINDOWS).coalesce(1).write.mode("append").parquet(tasks)
        met = live.attributed(spark.readStream.schema(USAGE).parquet(log), spark.readStream.schema(WINDOWS).parquet(tasks), "1 day", salts=2, **options)
        live.resume(met, run, "append")
    return plain(spark.read.schema(met.schema).parquet(f"{run}/out").select("task_id", "prompt_tokens"))


def test_two_streams_either_side_first_and_late_on_both(spark, tmp_path):
    row = lambda minute, tokens, key="k": (at(minute), key, "m", tokens, 0)
    batches = [
        ([row(5, 1), row(10, 2), row(30, 3, None), row(65, 4)], [("k", 7, at(0), at(10))]),  # 10 is the end, outside
        ([row(70, 5)], [("k", 8, at(60), at(80)), (None, 9, at(60), at(80))]),  # the window comes after its row 4
        ([row(2000, 6)], [("k", 10, at(1990), None)]),  # still running: it reaches as far as the longest
        ([row(6, 100), row(2010, 7)], [("k", 11, at(1), at(20)), ("k", 12, at(2005), at(2011))]),  # row 100 and window 11 are late
    ]
    assert both(spark, tmp_path, batches) == [(10, 6), (10, 7), (12, 7), (7, 1), (8, 4), (8, 5)]


def test_two_streams_refuse_a_window_beyond_the_longest(spark, tmp_path):
    with pytest.raises(Exception, match="longer than 1 day"):
        both(spark, tmp_path, [([(at(5), "k", "m", 1, 0)], [("k", 1, at(0), at(2000))])])
