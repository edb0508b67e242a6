"""Queries over files and streams: tables written by the library's sinks, read by its sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import files
from ..streaming import live, logs
from .registry import query
from .results import rounded, scores
from .standins import REPORTS_SQL, TASK_RESULTS_SQL, USAGE_LOG_SQL, reports, table, task_results, usage_log


def _usage_files(spark, d) -> str:
    """The usage log as JSON lines, with a malformed file beside it."""
    path = files.shared_folder(spark, "usage")
    rows = usage_log(spark, d).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.col("key").cast("string").alias("api_key"), "model", "prompt_tokens", "completion_tokens")
    rows.repartitionByRange(8, "ts").write.json(path)
    spark.createDataFrame([('{"ts": "2024-01-01T00:00:00Z", "api_key": "1", broken',)], "value string").coalesce(1).write.mode("append").text(path)
    return path


@query("src4_usage_lines", f"WITH {USAGE_LOG_SQL} SELECT key::VARCHAR AS api_key, count(*) AS n, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM usage_log GROUP BY key")
def _(spark, d):
    rows = files.read_usage(spark, _usage_files(spark, d))
    return rows.groupBy("api_key").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


@query("st1_running_tokens", f"""WITH {USAGE_LOG_SQL}, b AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM usage_log), w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS started, key::VARCHAR AS api_key, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, count(*) AS calls FROM usage_log GROUP BY ALL)
SELECT started::VARCHAR AS started, api_key, prompt_tokens, completion_tokens, calls FROM w, b WHERE started + INTERVAL 1 HOUR <= mark""")
def _(spark, d):
    # One micro-batch reads all files, so nothing is late; windows that the watermark hasn't passed stay open.
    path = files.shared_folder(spark, "log")
    usage_log(spark, d).select("ts", F.col("key").cast("string").alias("api_key"), "model", "prompt_tokens", "completion_tokens").repartitionByRange("ts").write.json(path)
    stream = spark.readStream.schema(files.USAGE_SCHEMA).json(path)
    return logs.available_now(logs.running_tokens(stream), "running").withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


WINDOWS_SQL = f"WITH {USAGE_LOG_SQL}, w AS (SELECT user_id AS key, event_id AS task_id, ts AS started, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended FROM events WHERE event_type = 'signup') SELECT w.task_id, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens FROM usage_log u JOIN w ON u.key = w.key AND u.ts >= w.started AND u.ts < w.ended GROUP BY w.task_id"


def _windows(spark, d):
    """A task runs from one signup of its key to the next."""
    ended = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("task_id"), F.col("ts").alias("started"), ended.alias("ended")).where("ended is not null")


def _calls(rows):
    return rows.groupBy("task_id").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"))


@query("st2_attributed", WINDOWS_SQL)
def _(spark, d):
    return _calls(logs.available_now(logs.attributed(logs.usage_stream(spark, _usage_files(spark, d)), _windows(spark, d)), "attributed"))


@query("st2_two_streams", WINDOWS_SQL)
def _(spark, d):
    """The windows arrive as a stream too, in files of their own; lateness is as long as the log, so that the order of files drops nothing."""
    path = files.shared_folder(spark, "windows")
    _windows(spark, d).repartitionByRange(4, "started").write.parquet(path)
    windows = spark.readStream.schema("key string, task_id bigint, started timestamp, ended timestamp").parquet(path)
    met = live.attributed(logs.usage_stream(spark, _usage_files(spark, d)), windows, "40 days", "40 days", bucket_s=86400)
    run = files.shared_folder(spark, "two-streams")
    live.resume(met, run, "append")
    return _calls(spark.read.schema(met.schema).parquet(f"{run}/out"))


@query("st3_progress", f"""WITH {REPORTS_SQL} SELECT team AS slug, model, count_if(file % 6 > 0)::BIGINT AS done, count_if(file % 6 = 0)::BIGINT AS failed, max(f1) AS best_f1, arg_max(pipeline, {{'a': f1, 'b': pipeline}}) AS best_pipeline FROM reports GROUP BY ALL""")
def _(spark, d):
    path = files.shared_folder(spark, "status")
    rows = reports(spark, d).select(F.col("team").alias("slug"), "pipeline", "model", F.when(F.col("file") % 6 == 0, "failed").otherwise("done").alias("status"), "f1")
    rows.repartition(6).write.json(path)
    stream = spark.readStream.schema(logs.STATUS_SCHEMA).option("maxFilesPerTrigger", 2).json(path)
    run = files.shared_folder(spark, "progress")
    live.resume(live.progress(stream), run, "append")
    return live.progress_now(spark, run)


@query("src1_tasks", "SELECT s_suppkey::VARCHAR AS id, s_name AS instruction, '{\"type\":\"object\"}' AS target_schema, s_nationkey::VARCHAR AS domain FROM supplier")
def _(spark, d):
    rows = table(spark, d, "supplier")
    task = [F.col("s_suppkey").cast("string").alias("id"), F.lit("text").alias("input_text"), F.col("s_name").alias("instruction"), F.struct(F.lit("object").alias("type")).alias("target_schema"), F.struct(F.col("s_nationkey").cast("string").alias("domain")).alias("metadata")]
    path = _single_files(rows.select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").alias("__no"), *task), files.shared_folder(spark, "tasks"))
    return files.read_tasks(spark, path).select("id", "instruction", "target_schema", F.col("metadata")["domain"].alias("domain"))


#: Documents with a number from 1 up to this stand in files of their own, all others packed, so that the folders don't grow with the table.
SINGLE_FILES = 20


def _documents(rows, path: str, name, folders: list[str]) -> str:
    """One JSON document a row: of the first by ``__no`` a file each in its folders, of all others a packed row of this name."""
    single = F.coalesce(F.col("__no").between(1, SINGLE_FILES), F.lit(False))
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in (*folders, "__no")]))
    files.write_packed(files.spread(rows.where(~single)).select(name.alias("file"), body.alias("value")), f"{path}/packed")
    rows.where(single).drop("__no").repartition(1).write.mode("append").partitionBy(*folders).json(path)
    return path


def _single_files(rows, path: str) -> str:
    """One JSON document a row, named by ``k``, and one that isn't JSON of either kind."""
    spark = rows.sparkSession
    _documents(rows, path, F.concat(F.lit("/"), F.col("k").cast("string"), F.lit(".json")), ["k"])
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.text(f"{path}/k=bad")
    files.write_packed(spark.createDataFrame([("/bad.json", "{not json")], files.PACKED_SCHEMA).coalesce(1), f"{path}/packed")
    return path


@query("src2_cases", "SELECT p_partkey::VARCHAR AS id, p_brand AS domain, p_size::VARCHAR AS size FROM part WHERE p_size % 2 = 0")
def _(spark, d):
    even = F.col("p_size") % 2 == 0
    schema = F.when(even, '{"type":"object","properties":{}}').otherwise('{"type":"array"}')
    example = F.create_map(F.lit("size"), F.struct(F.col("p_size").cast("string").alias("value"), F.array(F.lit("t")).alias("tags")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("__no"), F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("domain"), schema.alias("schema"), example.alias("field_examples"))
    return files.read_cases(spark, _single_files(rows, files.shared_folder(spark, "cases"))).select("id", "domain", F.col("field_examples")["size"]["value"].alias("size"))


@query("src3_reports", f"WITH {REPORTS_SQL} SELECT team, model, pipeline, f1, CASE WHEN file % 2 = 0 THEN slug || '-' || file ELSE slug END AS slug FROM reports")
def _(spark, d):
    name = F.when(F.col("file") % 2 == 0, F.concat_ws("-", "slug", F.concat(F.col("file").cast("string"), F.lit("--m__x")))).otherwise(F.concat_ws("__", "slug", F.col("file").cast("string")))
    rows = reports(spark, d).select(name.alias("k"), F.col("file").alias("__no"), F.struct(F.col("team").alias("team_name")).alias("participant"), F.struct("model", "pipeline").alias("config"), F.struct("f1").alias("metrics"))
    found = files.read_reports(spark, _single_files(rows, files.shared_folder(spark, "report-files")))
    return found.select(F.col("participant.team_name").alias("team"), "config.model", "config.pipeline", "metrics.f1", "slug")


@query("snk1_csv", f"WITH {REPORTS_SQL} SELECT team, model, pipeline, f1, file FROM reports")
def _(spark, d):
    path = files.write_table(reports(spark, d).select("team", "model", "pipeline", "f1", "file"), files.shared_folder(spark, "csv"), "csv")
    return spark.read.schema("team string, model string, pipeline string, f1 double, file bigint").option("header", True).csv(path)


@query("snk1_json", f"WITH {REPORTS_SQL} SELECT team, model, pipeline, f1, file FROM reports")
def _(spark, d):
    path = files.write_table(reports(spark, d).select("team", "model", "pipeline", "f1", "file"), files.shared_folder(spark, "json"), "json")
    return spark.read.schema("team string, model string, pipeline string, f1 double, file bigint").json(path)


@query("snk2_predictions", "SELECT 'p' || (c_custkey % 2) AS pipeline, (c_custkey % 30)::VARCHAR AS task_id, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL")
def _(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.concat(F.lit("p"), (k % 2).cast("string")).alias("pipeline"), (k % 30).cast("string").alias("task_id"), k.alias("run"))
    path = files.shared_folder(spark, "predictions")
    manifest = files.write_predictions(rows, path)
    stored = spark.read.schema("run bigint, pipeline string, task_id string").json(f"{path}/data")
    return stored.join(manifest.select("pipeline", "task_id").distinct(), ["pipeline", "task_id"]).groupBy("pipeline", "task_id").agg(F.count("*").alias("n"), F.min("run").alias("first"))


@query("snk3_reports", f"WITH {TASK_RESULTS_SQL}, m AS (SELECT *, {scores()} FROM (SELECT run, model, round(sum(tps), 6) AS tps, sum(gold_keys) AS gold_keys, sum(system_keys) AS system_keys, count(*) AS n_tasks, sum(tokens)::BIGINT AS tokens FROM task_results GROUP BY ALL)) SELECT run, model, f1, tokens, n_tasks FROM m")
def _(spark, d):
    path = files.write_table(files.evaluation_reports(task_results(spark, d)), files.shared_folder(spark, "reports"), "json")
    schema = "run string, config struct<model:string>, metrics struct<f1:double>, token_usage struct<total_tokens:bigint>, tasks array<struct<task_id:bigint>>"
    back = spark.read.schema(schema).json(path)
    rows = back.select("run", "config.model", "metrics.f1", F.col("token_usage.total_tokens").alias("tokens"), F.size("tasks").cast("long").alias("n"))
    return rounded(rows.groupBy("run", "model", "f1", "tokens").agg(F.sum("n").alias("n_tasks")))


@query("snk4_field_index", "SELECT label % 3 AS type_class, count(*) AS n, min(vec_id // 5) AS first_owner FROM embeddings GROUP BY ALL")
def _(spark, d):
    from .lookups import fields

    index = files.write_field_index(fields(spark, d), files.shared_folder(spark, "index"))
    return index.groupBy("type_class").agg(F.count("*").alias("n"), F.min("owner").alias("first_owner"))


@query("snk4_case_index", """SELECT CASE p_size % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS side, 4 * count(*) AS n_fields, count(*) AS n_cases, 1.0::DOUBLE AS longest FROM part GROUP BY ALL""")
def _(spark, d):
    """Fields of real schemas through texts and vectors into an index, beside the table of its cases."""
    from .shapes import part_schemas

    cases = part_schemas(spark, d).select(F.col("p_partkey").alias("owner"), "schema", "p_size")
    fields, owners = files.build_field_index(cases.select("owner", "schema"), files.shared_folder(spark, "cases-index"))
    side = cases.select("owner", F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("side")).hint("merge")  # a row a case: a small file of many rows is no reason for a broadcast
    norm = F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 6)
    a = fields.select("owner", norm.alias("norm")).join(side, "owner").groupBy("side").agg(F.count("*").alias("n_fields"), F.max("norm").alias("longest"))
    return a.join(owners.join(side, "owner").groupBy("side").agg(F.count("*").alias("n_cases")), "side")


@query("src5_predictions", """SELECT s_suppkey::VARCHAR AS task_id, 'direct' AS source, '' AS step, s_nationkey::VARCHAR AS found FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey::VARCHAR, 'mixed', 'trial_' || (s_suppkey % 2), s_nationkey::VARCHAR FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 4 > 0""")
def _(spark, d):
    """Files of direct runs and of mixed trials; trials with an error and tasks that aren't golden stay out."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("__no"), F.lit("p").alias("pipeline"), F.lit("r1").alias("run"), k.cast("string").alias("task_id"), F.concat(F.lit("trial_"), (k % 2).cast("string")).alias("step"), F.struct(F.col("s_nationkey").cast("string").alias("n")).alias("output"), F.lit("strict").alias("extraction"), F.when(k % 4 == 0, "failed").alias("error"))
    path = files.shared_folder(spark, "runs")
    name = lambda kind, folders: F.concat(F.concat_ws("/", F.lit(f"/{kind}"), *folders), F.lit(".json"))
    run = ["pipeline", "run", "task_id"]
    _documents(rows.drop("step"), f"{path}/direct", name("direct", run), run)
    _documents(rows, f"{path}/mixed", name("mixed", [*run, "step"]), [*run, "step"])
    golden = rows.where("cast(task_id as int) % 3 > 0").select("task_id")
    return files.read_predictions(spark, path, golden).select("task_id", "source", "step", F.get_json_object("output", "$.n").alias("found"))


@query("src6_details", """SELECT s_suppkey::VARCHAR AS task_id, s_name AS gold, CASE WHEN s_suppkey % 2 = 0 THEN 'pred' ELSE 'prediction' END AS of FROM supplier WHERE s_suppkey % 5 > 0""")
def _(spark, d):
    """Folders of task, gold and prediction; those without a prediction are left out, ``pred`` goes before ``prediction``."""
    k = F.col("s_suppkey")
    names = F.array_compact(F.array(F.lit("task"), F.lit("gold"), F.when((k % 5 > 0) & (k % 2 == 0), "pred"), F.when(k % 5 > 0, "prediction")))
    rows = table(spark, d, "supplier").select(k.alias("task_id"), F.explode(names).alias("name"), "s_name").select("task_id", "name", F.col("name").alias("of"), "s_name")
    path = files.shared_folder(spark, "details")
    _documents(rows.withColumn("__no", F.col("task_id")), path, F.concat_ws("/", F.lit(""), F.col("task_id").cast("string"), F.concat("name", F.lit(".json"))), ["task_id", "name"])
    return files.read_details(spark, path).select("task_id", F.get_json_object("gold", "$.s_name").alias("gold"), F.get_json_object("prediction", "$.of").alias("of"))


@query("st3_top_three", f"""WITH {REPORTS_SQL}, b AS (SELECT team AS slug, model, max(f1) AS best_f1 FROM reports GROUP BY ALL) SELECT slug, model, best_f1, row_number() OVER (PARTITION BY model ORDER BY best_f1 DESC, slug) AS place FROM b QUALIFY place <= 3""")
def _(spark, d):
    """The three best teams of each model over the state of the stream."""
    path = files.shared_folder(spark, "status")
    rows = reports(spark, d).select(F.col("team").alias("slug"), "pipeline", "model", F.lit("done").alias("status"), "f1")
    rows.repartition(6).write.json(path)
    stream = spark.readStream.schema(logs.STATUS_SCHEMA).option("maxFilesPerTrigger", 2).json(path)
    run = files.shared_folder(spark, "board")
    live.resume(live.board(stream, 3), run, "update")
    return live.board_now(spark, run, 3)
