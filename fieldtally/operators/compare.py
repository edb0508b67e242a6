"""Joins of results with diagnostics, and comparisons of two pipelines task by task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import by_families, with_scores
from .ranking import quantiles


def join_diagnostics(results: DataFrame, diagnostics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results with their task's diagnostics, results that have none).

    The second looks ids up by hash, so that no task sorts its share of the results.
    """
    known = diagnostics.select("task_id").hint("shuffle_hash")
    return results.join(diagnostics, "task_id"), results.join(known, "task_id", "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, which a comparison doesn't allow."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def paired(results: DataFrame, left: str, right: str) -> DataFrame:
    """Each model's tasks under two pipelines, side by side, with their deltas.

    Both pipelines are filtered before the join, so only their rows are shuffled.
    """
    values = ("tps", "gold_keys", "system_keys", "calls", "f1")

    def side(pipeline: str, prefix: str) -> DataFrame:
        return results.where(F.col("pipeline") == pipeline).select("model", "task_id", "domain", *[F.col(c).alias(f"{prefix}{c}") for c in values])

    both = side(left, "a_").join(side(right, "b_").drop("domain"), ["model", "task_id"])
    delta = F.round(F.col("b_f1") - F.col("a_f1"), 9)  # equal scores stay equal whatever their sums' last bits
    change = F.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("unchanged")
    return both.withColumns({"delta": delta, "change": change, "both_called": (F.col("a_calls") > 0) & (F.col("b_calls") > 0)})


def paired_summary(pairs: DataFrame, families: dict[str, Column]) -> DataFrame:
    """Both sides' micro metrics and the changes per group, over all pairs and over those that both sides called for."""
    spread = by_families(pairs, families).withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("both_called"), F.lit("called"))))))
    sums = [F.sum(f"{s}{c}").alias(f"{s}{c}") for s in ("a_", "b_") for c in ("tps", "gold_keys", "system_keys")]
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("improved", "regressed", "unchanged")]
    out = spread.groupBy("model", "family", "group", "scope").agg(F.count("*").alias("n_tasks"), *sums, *counts)
    return with_scores(with_scores(out, "a_"), "b_").withColumn("delta_f1", F.col("b_f1") - F.col("a_f1"))


def overview(pairs: DataFrame, keys: list[str], large: float = 0.1) -> DataFrame:
    """Mean and median delta, and how many are large."""
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("n_tasks"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") >= large).alias("large_gains"), F.count_if(F.col("delta") <= -large).alias("large_losses"))
    medians = quantiles(pairs, keys, "delta", [0.5]).select(*keys, F.col("q")[0].alias("median_delta"))
    return sums.join(medians, keys, "left")


def extremes(pairs: DataFrame, keys: list[str], limit: int = 8) -> DataFrame:
    """The largest gains and losses of each comparison.

    Both ends go through one ranking; Spark keeps the first few of each
    partition before it brings a comparison together.
    """
    ends = F.array(F.struct(F.lit("gain").alias("side"), (-F.col("delta")).alias("order")), F.struct(F.lit("loss").alias("side"), F.col("delta").alias("order")))
    rows = pairs.select(*keys, "task_id", "delta", F.explode(ends).alias("e")).select(*keys, "task_id", "delta", "e.*")
    place = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("order", "task_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select(*keys, "task_id", "delta", "side", "place")


def never_called(results: DataFrame) -> DataFrame:
    """Tasks that no run called for; one grouping instead of an intersection per run."""
    return results.groupBy("task_id").agg(F.max("calls").alias("m"), F.countDistinct("run").alias("n_runs")).where("m = 0").select("task_id", "n_runs")


def common_tasks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("task_id").intersect(b.select("task_id"))


def resolve_aliases(ids: DataFrame, tasks: DataFrame, prefix: str = "test_") -> DataFrame:
    """The task of each id, which may carry the prefix or lack it: (id, task_id, problem).

    ``problem`` is ``ambiguous`` where two tasks answer to an id, ``unknown`` where none does.
    """
    task = F.col("task_id")
    other = F.when(task.startswith(prefix), F.substring(task, F.lit(len(prefix) + 1), F.length(task))).otherwise(F.concat(F.lit(prefix), task))
    names = tasks.select("task_id", F.explode(F.array(task, other)).alias("id")).groupBy("id").agg(F.countDistinct("task_id").alias("n"), F.min("task_id").alias("task_id"))
    problem = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous")
    return ids.select("id").join(names, "id", "left").select("id", F.when(F.col("n") == 1, F.col("task_id")).alias("task_id"), problem.alias("problem"))


def attach_nearest(cells: DataFrame, reports: DataFrame, keys: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Each cell with the report of the same keys whose F1 is nearest, within the tolerance; ties by higher F1, then event.

    F1 falls into bands of twice the tolerance; a cell meets the reports of its
    band and of both neighbours only.
    """
    band = lambda c: F.floor(F.col(c) / (2 * tolerance)).cast("long")
    spread = cells.withColumn("__band", F.explode(F.array(*[band("f1") + k for k in (-1, 0, 1)])))
    told = reports.select(*keys, F.col("f1").alias("report_f1"), "event", band("f1").alias("__band"))
    near = spread.join(told, [*keys, "__band"]).drop("__band").where(F.abs(F.col("f1") - F.col("report_f1")) <= tolerance)
    order = Window.partitionBy(*keys, "cell_id").orderBy(F.abs(F.col("f1") - F.col("report_f1")), F.desc("report_f1"), "event")
    return near.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def attribute_usage(log: DataFrame, windows: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """The task in whose time window [started, ended) of the same key each log row fell.

    The range condition becomes an equi-join on (key, time bucket): a window
    stands in each bucket it touches, so a hot key is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_s)
    spread = windows.withColumn("bucket", F.explode(F.sequence(bucket("started"), bucket("ended"))))
    return log.withColumn("bucket", bucket("ts")).join(spread, ["key", "bucket"]).where("ts >= started and ts < ended").drop("bucket", "started", "ended")


def route_metrics(cells: DataFrame, results: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Micro metrics of every cell (cell_id, run) by the route of its tasks."""
    from .metrics import micro_metrics

    return micro_metrics(cells.join(results, "run").join(diagnostics.select("task_id", "route"), "task_id"), ["cell_id", "route"])
