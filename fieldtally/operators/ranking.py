"""Baselines, gaps and leaderboards over evaluation reports.

A report has ``team``, ``model``, ``pipeline``, ``slug``, ``f1`` and ``file``;
reports stand in the order of their file names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import durable
from .metrics import gap_closed


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows with their place from 1 in a total order, without bringing them together.

    Rows are sorted by range over all partitions; a partition's places begin
    where those before it end, which takes one count a partition.
    """
    mark = F.monotonically_increasing_id()
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mark", mark))
    part = F.shiftright("__mark", 33)
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    both = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return both.withColumn(name, F.col("__start") + F.col("__mark").bitwiseAND(2**33 - 1) + 1).drop("__mark", "__part", "__start")


def numbered_within(rows: DataFrame, keys: list[str], name: str, *order: Column | str) -> DataFrame:
    """Rows with their place from 1 within their keys, however many rows one key has."""
    everywhere = numbered(rows, "__place", *keys, *order)
    firsts = everywhere.groupBy(*keys).agg(F.min("__place").alias("__first"))
    return everywhere.join(firsts, keys).withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__first")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, n, q): exact quantiles with linear interpolation of every group's values, however many values one group has.

    The values are placed in order by range; each quantile then takes the one
    or two places that it lies between.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    placed = numbered(known, "__p", *keys, "__v")
    spans = placed.groupBy(*keys).agg(F.min("__p").alias("__first"), F.count("*").alias("n"))
    spread = spans.select("*", F.posexplode(F.array(*map(F.lit, shares))).alias("__i", "__share"))
    at = F.col("__share") * (F.col("n") - 1)
    low = F.floor(at)
    ends = F.array(F.struct((F.col("__first") + low).alias("place"), (1 - (at - low)).alias("weight")), F.struct((F.col("__first") + F.ceil(at)).alias("place"), (at - low).alias("weight")))
    wanted = spread.select(*keys, "n", "__i", F.explode(ends).alias("e")).select(*keys, "n", "__i", F.col("e.place").alias("__place"), F.col("e.weight").alias("__w"))
    met = wanted.join(placed.select(F.col("__p").alias("__place"), "__v"), "__place")
    found = met.groupBy(*keys, "n", "__i").agg(F.sum(F.col("__w") * F.col("__v")).alias("__q"))
    q = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__q"))), lambda x: x["__q"])
    return found.groupBy(*keys, "n").agg(q.alias("q"))


def baselines(reports: DataFrame, slug: str, pipeline: str = "baseline") -> DataFrame:
    """One baseline per model: the canonical slug first, then the highest F1; ``n_baselines`` over 1 is a collision."""
    found = reports.where(F.col("pipeline") == pipeline)
    order = F.struct((~F.coalesce(F.col("slug") == slug, F.lit(False))).alias("other"), F.coalesce(-F.col("f1"), F.lit(float("inf"))).alias("less"), "file", "slug", "f1")
    best = found.groupBy("model").agg(F.min(order).alias("b"), F.count("*").alias("n_baselines"))  # no model's rows come together
    return best.select("model", F.col("b.slug").alias("baseline_slug"), F.col("b.f1").alias("baseline_f1"), F.col("b.file").alias("baseline_file"), "n_baselines")


def ranked_entries(reports: DataFrame, base: DataFrame, pipeline: str = "baseline") -> DataFrame:
    """The reports of models with a baseline, with the gap closed and the place in their model.

    Reports with the baseline's pipeline and slug are left out, the chosen one and its twins alike.
    """
    entries = reports.join(base, "model").where(~((F.col("pipeline") == pipeline) & F.col("slug").eqNullSafe(F.col("baseline_slug"))))
    gap = gap_closed(F.col("f1"), F.col("baseline_f1"))
    return numbered_within(entries.withColumn("gap", gap), ["model"], "place", F.desc("gap"), "file")


def leaderboard(entries: DataFrame, value: str) -> DataFrame:
    """Teams by the mean of their best value per model over all ranked models; a missing model counts 0."""
    best = first_by(entries, ["team", "model"], F.desc(value), "file")
    models = entries.agg(F.countDistinct("model").alias("n_models"))
    detail = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "model", "pipeline"))), ";")
    sums = best.groupBy("team").agg(F.sum(value).alias("total"), F.count("*").alias("n_own"), detail.alias("detail"))
    scored = sums.crossJoin(F.broadcast(models)).withColumn("average", F.col("total") / F.col("n_models"))  # one row
    return scored.select("team", "average", "n_own", "n_models", "detail", F.row_number().over(Window.orderBy(F.desc(F.round("average", 9)), "team")).alias("place"))


def dataset_boards(reports: DataFrame) -> DataFrame:
    """Per model and dataset: the place among all pipelines, and among each team's best (null for the others)."""
    keys = ["model", "dataset"]
    placed = numbered_within(reports, keys, "place", F.desc("f1"), "file")
    best = reports.groupBy(*keys, "team").agg(F.min(F.struct((-F.col("f1")).alias("f"), "file")).alias("b")).select(*keys, (-F.col("b.f")).alias("f1"), F.col("b.file").alias("file"))
    teams = numbered_within(best, keys, "team_place", F.desc("f1"), "file").select(*keys, "file", "team_place")
    return placed.join(teams, [*keys, "file"], "left")


def unique_cells(reports: DataFrame, keys: list[str]) -> DataFrame:
    """One cell per key: the highest F1, then the latest event."""
    return reports.groupBy(*keys).agg(F.max(F.struct("f1", "event")).alias("b")).select(*keys, "b.f1", "b.event")


def best_cells(cells: DataFrame) -> DataFrame:
    """The best mode of each model and pipeline."""
    return first_by(cells, ["model", "pipeline"], F.desc("f1"), "mode")


def compare_cells(cells: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """Two pipelines' cells side by side."""
    a = cells.where(F.col("pipeline") == left).select(*keys, F.col("f1").alias("a_f1"))
    b = cells.where(F.col("pipeline") == right).select(*keys, F.col("f1").alias("b_f1"))
    return a.join(b, keys).withColumn("delta", F.col("b_f1") - F.col("a_f1"))


def without_baseline(reports: DataFrame, base: DataFrame) -> DataFrame:
    """Reports of models that have no baseline, which can't be ranked."""
    return reports.join(base.select("model"), "model", "left_anti")
