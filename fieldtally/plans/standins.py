"""Views over the driver's tables that stand in for evaluation data, in Spark and, as WITH clauses, in SQL.

Both sides use integer arithmetic only.  Names ending in ``_SQL`` hold
definitions without the leading WITH, so that queries can chain them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks, run by two models with three pipelines each."""
    runs = spark.range(6).select(
        F.col("id").alias("run_no"),
        F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("model"),
        F.element_at(F.array(F.lit("baseline"), F.lit("schema"), F.lit("vote")), (F.floor(F.col("id") / 2) + 1).cast("int")).alias("pipeline"),
    )
    k, r = F.col("o_orderkey"), F.col("run_no")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").crossJoin(F.broadcast(runs))  # six runs
    rows = rows.withColumns({
        "failed": (k + r) % 17 == 0, "gold_keys": 1 + k % 12, "system_keys0": (k * 7 + r * 3) % 13, "calls": F.when(k % 11 == 0, 0).otherwise((k * 5 + r * 11) % 7),
        "tokens": F.when((k + r) % 10 != 0, (k * 13 + r * 101) % 90000), "elapsed_s": ((k * 3 + r * 29) % 900) / 10.0,
    })
    rows = rows.withColumns({"system_keys": F.when(F.col("failed"), 0).otherwise(F.col("system_keys0")), "run": F.concat_ws("/", "model", "pipeline")})
    points = F.when(F.col("failed"), 0).otherwise(F.least("gold_keys", "system_keys") * ((k * 31 + r * 17) % 101))
    return rows.select(
        "run", "run_no", "model", "pipeline", k.alias("task_id"), (points / 100.0).alias("tps"), "gold_keys", "system_keys", "calls", "tokens", "elapsed_s", "failed",
        F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("schema"),
    )


TASK_RESULTS_SQL = """
runs AS (SELECT range AS run_no, 'm' || (range % 2) AS model, ['baseline','schema','vote'][(range // 2) + 1] AS pipeline FROM range(6)),
results0 AS (SELECT *, (o_orderkey + run_no) % 17 = 0 AS failed, 1 + o_orderkey % 12 AS gold_keys, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE (o_orderkey * 5 + run_no * 11) % 7 END AS calls,
  CASE WHEN (o_orderkey + run_no) % 10 <> 0 THEN (o_orderkey * 13 + run_no * 101) % 90000 END AS tokens, ((o_orderkey * 3 + run_no * 29) % 900) / 10.0::DOUBLE AS elapsed_s
  FROM orders CROSS JOIN runs),
results1 AS (SELECT *, CASE WHEN failed THEN 0 ELSE (o_orderkey * 7 + run_no * 3) % 13 END AS system_keys FROM results0),
task_results AS (SELECT model || '/' || pipeline AS run, run_no, model, pipeline, o_orderkey AS task_id,
  (CASE WHEN failed THEN 0 ELSE least(gold_keys, system_keys) * ((o_orderkey * 31 + run_no * 17) % 101) END)::DOUBLE / 100.0::DOUBLE AS tps,
  gold_keys, system_keys, calls, tokens, elapsed_s, failed, o_orderpriority AS domain, o_orderstatus AS schema FROM results1)"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval diagnostics of most tasks."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(k % 23 != 0).select(
        k.alias("task_id"),
        F.when(k % 3 == 0, "same_schema").when(k % 3 == 1, "fields").otherwise("lexical").alias("route"),
        F.when(k % 5 != 0, (k * 37) % 1000 / 1000.0).alias("similarity"),
        F.when(k % 7 != 0, (k * 53) % 700 / 1000.0).alias("pair_gain"),
        ((k * 11) % 400 / 100.0 - 1).alias("coverage_gain"),
        F.concat_ws(";", F.concat(F.lit("c"), (k % 19).cast("string")), F.concat(F.lit("c"), (k % 31).cast("string"))).alias("case_ids"),
    )


DIAGNOSTICS_SQL = """
diagnostics AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN 'same_schema' WHEN o_orderkey % 3 = 1 THEN 'fields' ELSE 'lexical' END AS route,
  CASE WHEN o_orderkey % 5 <> 0 THEN ((o_orderkey * 37) % 1000)::DOUBLE / 1000.0::DOUBLE END AS similarity,
  CASE WHEN o_orderkey % 7 <> 0 THEN ((o_orderkey * 53) % 700)::DOUBLE / 1000.0::DOUBLE END AS pair_gain,
  ((o_orderkey * 11) % 400)::DOUBLE / 100.0::DOUBLE - 1 AS coverage_gain,
  'c' || (o_orderkey % 19) || ';c' || (o_orderkey % 31) AS case_ids FROM orders WHERE o_orderkey % 23 <> 0)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reports: nations are teams, market segments models."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("team"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("team"), F.col("c_mktsegment").alias("model"),
        F.when(k % 4 == 0, "baseline").otherwise(F.concat(F.lit("p"), (k % 4).cast("string"))).alias("pipeline"),
        F.when(k % 20 == 0, "official").otherwise(F.concat(F.lit("s"), (k % 11).cast("string"))).alias("slug"),
        ((k * 37) % 1000 / 1000.0).alias("f1"), k.alias("file"), F.concat(F.lit("d"), (k % 3).cast("string")).alias("dataset"),
        F.concat(F.lit("mode"), (F.floor(k / 4) % 2).cast("string")).alias("mode"), (k * 7919 % 1009).alias("event"), (k * 17 % 5000 + 100).alias("tokens"),
    )


REPORTS_SQL = """
reports AS (SELECT 'team' || lpad(c_nationkey::VARCHAR, 2, '0') AS team, c_mktsegment AS model, CASE WHEN c_custkey % 4 = 0 THEN 'baseline' ELSE 'p' || (c_custkey % 4) END AS pipeline,
  CASE WHEN c_custkey % 20 = 0 THEN 'official' ELSE 's' || (c_custkey % 11) END AS slug, ((c_custkey * 37) % 1000)::DOUBLE / 1000.0::DOUBLE AS f1, c_custkey AS file, 'd' || (c_custkey % 3) AS dataset,
  'mode' || (c_custkey // 4 % 2) AS mode, c_custkey * 7919 % 1009 AS event, c_custkey * 17 % 5000 + 100 AS tokens FROM customer)"""


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a usage log."""
    cents = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id"), F.col("ts"), F.col("user_id").alias("key"), F.col("event_type").alias("model"), cents.alias("prompt_tokens"), (cents % 97).alias("completion_tokens"))


USAGE_LOG_SQL = """
usage_log AS (SELECT event_id, ts, user_id AS key, event_type AS model, floor(value * 100)::BIGINT AS prompt_tokens, floor(value * 100)::BIGINT % 97 AS completion_tokens FROM events)"""
