"""Aggregates over per-task results.

``task_results`` has one row per (run, task_id) with ``tps``, ``gold_keys`` and
``system_keys``; further columns are named by the functions that need them.
Every function takes and returns DataFrames and collects nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small
from ..sources.files import durable

#: Rows in a range of tasks that becomes one list a bucket.
RANGE_ROWS = 60_000


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0 or missing."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def with_scores(sums: DataFrame, prefix: str = "") -> DataFrame:
    """Adds precision, recall and F1 to sums of tps, gold and system keys."""
    tps, gold, system = (F.col(f"{prefix}{c}") for c in ("tps", "gold_keys", "system_keys"))
    out = sums.withColumns({f"{prefix}precision": ratio(tps, system), f"{prefix}recall": ratio(tps, gold)})
    return out.withColumn(f"{prefix}f1", f1(F.col(f"{prefix}precision"), F.col(f"{prefix}recall")))


def micro_metrics(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Micro precision, recall and F1 per group, from sums; a failed task adds to the gold keys only."""
    sums = [F.sum("tps").alias("tps"), F.sum("gold_keys").alias("gold_keys"), F.sum("system_keys").alias("system_keys"), F.count("*").alias("n_tasks")]
    return with_scores(rows.groupBy(*keys).agg(*sums, *more))


def metric_buckets(rows: DataFrame, keys: list[str], tag_col: str | None = None) -> DataFrame:
    """Micro and mean metrics over all rows and per prefix, schema and tag: (keys, family, bucket).

    One explode to (family, bucket) and one grouping; a row counts once for each
    of its tags.  Distinct tasks are counted by bitmaps over numbered tasks: one
    of 4 KB for every 32,768 tasks of a bucket, merged before the last grouping.
    """
    from .ranking import numbered

    ids = numbered(rows.select("task_id").distinct(), "__no", "task_id")
    own = rows.withColumns({"p": ratio(F.col("tps"), F.col("system_keys")), "r": ratio(F.col("tps"), F.col("gold_keys"))}).withColumn("f", f1(F.col("p"), F.col("r")))
    spread = in_buckets(own.join(ids, "task_id"), tag_col).withColumn("__bits", F.bitmap_bucket_number(F.col("__no")))
    sums = {"tps": "tps", "gold_keys": "gold_keys", "system_keys": "system_keys", "p": "mean_precision", "r": "mean_recall", "f": "mean_f1"}
    groups = [*keys, "family", "bucket"]
    parts = spread.groupBy(*groups, "__bits").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n_tasks"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("__no")))).alias("__seen"))
    whole = parts.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in sums], F.sum("n_tasks").alias("n_tasks"), F.sum("__seen").alias("distinct_tasks"))
    return with_scores(whole.select(*groups, *[(F.col(c) / F.col("n_tasks") if n.startswith("mean") else F.col(c)).alias(n) for c, n in sums.items()], "n_tasks", "distinct_tasks"))


def in_buckets(rows: DataFrame, tag_col: str | None = None) -> DataFrame:
    """Rows with their family and bucket: all, by prefix, by schema and by each tag."""
    pairs = [("overall", F.lit("all")), ("prefix", F.col("prefix")), ("schema", F.col("schema"))]
    families = F.array(*[F.struct(F.lit(n).alias("family"), c.cast("string").alias("bucket")) for n, c in pairs])
    if tag_col:
        families = F.concat(families, F.transform(F.col(tag_col), lambda t: F.struct(F.lit("tag").alias("family"), t.alias("bucket"))))
    return rows.select("*", F.explode(families).alias("e")).select("*", "e.family", "e.bucket").drop("e")


def bucket_tasks(rows: DataFrame, keys: list[str], tag_col: str | None = None, part_tasks: int = 1000, schemas: DataFrame | None = None) -> DataFrame:
    """The tasks of every bucket in order, in parts of so many, so that no list grows with a bucket; of a schema's bucket its description too.

    ``schemas`` has (schema, description).  Tasks are dealt out by range, once and
    before they are spread over their buckets; each range makes one sorted list
    a bucket, and only the counts of these lists are placed in order.  Null tasks
    are counted, last, but have no text.
    """
    groups = [*keys, "family", "bucket"]
    slim = rows.select(*keys, "task_id", "prefix", "schema", *([tag_col] if tag_col else []))
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // RANGE_ROWS + 1)
    spread = in_buckets(slim.repartitionByRange(ranges, F.col("task_id").asc_nulls_last()).withColumn("__range", F.spark_partition_id()), tag_col)
    lists = spread.groupBy(*groups, "__range").agg(F.sort_array(F.collect_set("task_id")).alias("__ids"), F.max(F.col("task_id").isNull().cast("int")).alias("__null"))
    lists = durable(lists.withColumns({"__n": F.size("__ids") + F.col("__null"), "__list": F.monotonically_increasing_id()}))
    before = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = lists.select(*groups, "__range", "__n", "__list").select("__list", F.coalesce(before, F.lit(0)).alias("__start"))

    def piece(part: Column) -> Column:
        first = F.greatest(part * part_tasks - F.col("__start"), F.lit(0))
        n = F.least((part + 1) * part_tasks - F.col("__start"), F.col("__n")) - first
        last = F.least(first + n, F.size("__ids")) - 1
        ids = F.transform(F.sequence(first, last), lambda i: F.get("__ids", i.cast("int")).cast("string"))  # a slice would unpack the whole list for each piece
        return F.struct(part.alias("part"), n.alias("n"), F.when(first <= last, F.array_join(ids, ";")).alias("t"))

    own = F.sequence(F.floor(F.col("__start") / part_tasks), F.floor((F.col("__start") + F.col("__n") - 1) / part_tasks))
    pieces = lists.join(small(starts), "__list").select(*groups, "__range", F.explode(F.transform(own, piece)).alias("e")).select(*groups, "__range", "e.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__range", "t"))), lambda x: x["t"]), ";")
    parts = pieces.groupBy(*groups, "part").agg(text.alias("tasks"), F.sum("n").alias("n_tasks"))
    if schemas is None:
        return parts
    told = schemas.select(F.lit("schema").alias("family"), F.col("schema").cast("string").alias("bucket"), "description")
    return parts.join(told, ["family", "bucket"], "left")


def timing_summary(rows: DataFrame, keys: list[str], budget_s: float) -> DataFrame:
    """Mean and longest time, tasks over the budget, and whether the mean keeps within it."""
    mean = F.coalesce(F.avg("elapsed_s"), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count("elapsed_s").alias("n_timed"), mean.alias("avg_s"), F.coalesce(F.max("elapsed_s"), F.lit(0.0)).alias("max_s"),
        F.count_if(F.col("elapsed_s") > budget_s).alias("over_budget"), (mean <= budget_s).alias("within_budget"),
    )


def token_summary(rows: DataFrame, keys: list[str], target: int, soft_multiple: float = 2.0) -> DataFrame:
    """Tokens against a target and a soft cap; rows without usage don't count."""
    used = rows.where(F.col("tokens").isNotNull())
    return used.groupBy(*keys).agg(
        F.count("*").alias("n_counted"), F.sum("tokens").alias("total_tokens"), F.avg("tokens").alias("avg_tokens"), F.max("tokens").alias("max_tokens"),
        F.count_if(F.col("tokens") > target).alias("over_target"), F.count_if(F.col("tokens") > target * soft_multiple).alias("over_soft_cap"),
    )


def usage_totals(log: DataFrame, header: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of a usage log beside those that response headers told, and which of them holds.

    They disagree if they differ by more than a tenth of the log's total or 1000, whichever is more.
    """
    sums = log.groupBy(*keys).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls"))
    both = sums.withColumn("log_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).join(header, keys, "full_outer")
    differs = F.abs(F.col("log_tokens") - F.col("header_tokens")) > F.greatest(F.col("log_tokens") * 0.1, F.lit(1000.0))
    source = F.when(F.col("log_tokens").isNotNull(), "log").when(F.col("header_tokens").isNotNull(), "header").otherwise("unavailable")
    return both.withColumns({"tokens": F.coalesce("log_tokens", "header_tokens"), "disagrees": F.coalesce(differs, F.lit(False)), "source": source})


def source_label(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One source of several rows, or ``mixed``."""
    return rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.when(F.countDistinct("source") == 1, F.min("source")).otherwise("mixed").alias("source"))


def run_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Micro metrics with calls, tokens, time and failures, over all tasks and over those with calls."""
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("calls") > 0, F.lit("called"))))
    return micro_metrics(
        rows.withColumn("scope", F.explode(scopes)), [*keys, "scope"],
        F.sum("calls").alias("calls"), F.count_if(F.col("calls") == 0).alias("zero_calls"), F.avg((F.col("calls") == 0).cast("double")).alias("zero_call_share"),
        F.sum("tokens").alias("tokens"), F.avg("elapsed_s").alias("avg_s"), F.count_if(F.col("failed")).alias("n_failed"),
    )


def by_families(rows: DataFrame, families: dict[str, Column]) -> DataFrame:
    """One row per (row, family) with the row's group in it; blank groups are left out."""
    every = F.array(*[F.struct(F.lit(n).alias("family"), c.cast("string").alias("group")) for n, c in families.items()])
    return rows.select("*", F.explode(every).alias("e")).select("*", "e.family", "e.group").drop("e").where("`group` is not null and `group` <> ''")


def group_metrics(rows: DataFrame, keys: list[str], families: dict[str, Column]) -> DataFrame:
    """Micro metrics of every group of several families in one grouping."""
    return micro_metrics(by_families(rows, families), [*keys, "family", "group"], F.count_if(F.col("calls") == 0).alias("zero_calls"))


def selected_metrics(rows: DataFrame, ids_col: str, keys: list[str]) -> DataFrame:
    """Micro metrics per selected case; a task counts for each of its cases."""
    return micro_metrics(rows.withColumn("case_id", F.explode(F.split(ids_col, ";"))).where("case_id <> ''"), [*keys, "case_id"])


def selection_counts(rows: DataFrame, ids_col: str) -> DataFrame:
    """How often each case is selected, with its place by count, then id."""
    counts = rows.select(F.explode(F.split(ids_col, ";")).alias("case_id")).where("case_id <> ''").groupBy("case_id").agg(F.count("*").alias("n"))
    from .ranking import numbered

    return numbered(counts, "place", F.desc("n"), "case_id")


def run_counts(rows: DataFrame, tasks: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Predictions per task and pipeline, 0 where there are none, with the runs and the counts per source."""
    grid = tasks.select("task_id").distinct().crossJoin(small(pipelines.select("pipeline").distinct()))
    per_source = rows.groupBy("task_id", "pipeline", "source").agg(F.count("*").alias("n"), F.collect_set("run").alias("runs"))
    counted = per_source.groupBy("task_id", "pipeline").agg(
        F.sum("n").alias("n_predictions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.array_sort(F.collect_list(F.concat_ws("=", "source", "n"))).alias("per_source")
    )
    joined = grid.join(counted, ["task_id", "pipeline"], "left")
    return joined.select("task_id", "pipeline", F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"), F.array_join(F.coalesce("runs", F.array().cast("array<string>")), ";").alias("runs"), F.array_join(F.coalesce("per_source", F.array().cast("array<string>")), ";").alias("per_source"))


def trace_metrics(spans: DataFrame) -> DataFrame:
    """Requests, failures, tokens, mean duration and the ordered steps of every task."""
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("started", "step"))), lambda s: s["step"]), ">")
    return spans.groupBy("task_id").agg(
        F.count("*").alias("requests"), F.count_if(F.col("failed")).alias("failures"), F.sum("tokens").alias("tokens"), F.avg("duration_s").alias("avg_duration_s"), steps.alias("steps")
    )


def trace_steps(spans: DataFrame, part_steps: int = 1000) -> DataFrame:
    """The steps of every task in order, in parts of so many, so that a task of any length is no row of its own length: (task_id, part, first_started, steps, n_steps)."""
    from .ranking import numbered_within

    placed = numbered_within(spans.select("task_id", "started", "step"), ["task_id"], "__at", "started", "step")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__at", "step"))), lambda x: x["step"])
    parts = placed.withColumn("part", F.floor((F.col("__at") - 1) / part_steps)).groupBy("task_id", "part")
    return parts.agg(F.min("started").alias("first_started"), F.array_join(ordered, ">").alias("steps"), F.count("*").alias("n_steps"))


def run_count_spread(counts: DataFrame) -> DataFrame:
    """Least, most and mean count of predictions a task, per pipeline."""
    return counts.groupBy("pipeline").agg(F.min("n_predictions").alias("least"), F.max("n_predictions").alias("most"), F.avg("n_predictions").alias("mean"), F.count("*").alias("n_tasks"))


def schema_tasks(tasks: DataFrame, part_tasks: int = 1000) -> DataFrame:
    """The tasks and titles of every schema in order, in parts of at most ``part_tasks`` tasks, so that no list grows with a schema: (fingerprint, part, task_ids, titles, n_tasks)."""
    from .ranking import numbered

    once = tasks.groupBy("fingerprint", "task_id").agg(F.collect_set("title").alias("titles"), F.count("*").alias("n"))
    placed = numbered(once, "__at", "fingerprint", "task_id").withColumn("part", F.floor((F.col("__at") - 1) / part_tasks))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("__at", "task_id"))), lambda x: x["task_id"])
    text = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("titles")))), ";")
    return placed.groupBy("fingerprint", "part").agg(F.array_join(ids, ";").alias("task_ids"), text.alias("titles"), F.sum("n").alias("n_tasks"))


def whole_schema_tasks(parts: DataFrame) -> DataFrame:
    """One row a schema of its parts: their texts one after the other, their titles once."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "task_ids"))), lambda x: x["task_ids"]), ";")
    titles = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("titles", ";"))))), ";")
    return parts.groupBy("fingerprint").agg(ids.alias("task_ids"), titles.alias("titles"), F.sum("n_tasks").alias("n_tasks"))


def schema_overlap(tasks: DataFrame, seen: DataFrame) -> DataFrame:
    """Per fingerprint: tasks, domains and whether it was seen before."""
    grouped = tasks.groupBy("fingerprint").agg(F.count("*").alias("n_tasks"), F.array_join(F.array_sort(F.collect_set("domain")), ";").alias("domains"), F.min("task_id").alias("first_task"))
    known = seen.select("fingerprint").distinct().withColumn("was_seen", F.lit(True))
    return grouped.join(known, "fingerprint", "left").withColumn("was_seen", F.coalesce("was_seen", F.lit(False)))


def overlap_summary(overlap: DataFrame) -> DataFrame:
    """Totals and shares of seen schemas and their tasks."""
    seen = F.col("was_seen")
    return overlap.agg(
        F.count("*").alias("n_schemas"), F.count_if(seen).alias("seen_schemas"), F.sum("n_tasks").alias("n_tasks"), F.sum(F.when(seen, F.col("n_tasks")).otherwise(0)).alias("seen_tasks")
    ).withColumn("seen_task_share", ratio(F.col("seen_tasks"), F.col("n_tasks")))


def subset_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Micro metrics of six subsets: all, seen, unseen, and the same without tasks that no run called for."""
    names = [("all", F.lit(True)), ("seen", F.col("was_seen")), ("unseen", ~F.col("was_seen"))]
    subsets = F.array_compact(F.array(*[F.when(c & extra, F.lit(n + suffix)) for suffix, extra in (("", F.lit(True)), ("_called", ~F.col("never_called"))) for n, c in names]))
    return micro_metrics(rows.withColumn("subset", F.explode(subsets)), [*keys, "subset"])


def describe(rows: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Count, extremes, mean and exact linear quartiles of a column."""
    from .ranking import quantiles

    keys = keys or []
    known = rows.where(F.col(col).isNotNull())
    sums = known.groupBy(*keys).agg(F.min(col).cast("double").alias("lowest"), F.avg(col).alias("mean"), F.max(col).cast("double").alias("highest"))
    q = quantiles(known, keys, col, [0.25, 0.5, 0.75])
    both = _beside(sums, q, keys)
    return both.select(*keys, "n", "lowest", F.col("q")[0].alias("p25"), "mean", F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "highest")


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of one row a group side by side, null keys too."""
    if not keys:
        return a.crossJoin(b)  # one row each
    named = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(named, on).drop(*[f"__{k}" for k in keys])


def gap_closed(system: Column, baseline: Column) -> Column:
    """The share of what a baseline leaves that a system gains, never negative; against a perfect baseline 1 or 0."""
    return F.when(baseline >= 1, F.when(system >= 1, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (system - baseline) / (1 - baseline)))


def quality_per_cost(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean F1 over total tokens."""
    return rows.groupBy(*keys).agg(F.avg("f1").alias("avg_f1"), F.sum("tokens").alias("tokens")).withColumn("quality_per_token", ratio(F.col("avg_f1"), F.col("tokens")))


def pivot_table(rows: DataFrame, group_col: str, pipelines: list[str]) -> DataFrame:
    """One column per pipeline with F1 and support, "-" where there is none."""
    table = rows.groupBy(group_col).pivot("pipeline", pipelines).agg(F.first(F.concat(F.format_number("f1", 4), F.lit(" ("), F.col("n_tasks"), F.lit(")"))))
    return table.select(group_col, *[F.coalesce(F.col(f"`{p}`"), F.lit("-")).alias(p) for p in pipelines])


def tertiles(rows: DataFrame, id_col: str, value_col: str, name: str) -> DataFrame:
    """Adds low, mid or high by the thirds of the values of distinct ids; blank if fewer than three have one."""
    return tertile_bins(rows, id_col, {value_col: name})


def tertile_bins(rows: DataFrame, id_col: str, names: dict[str, str]) -> DataFrame:
    """The same for several columns, by the names of their bins; the values of all are placed in order in one pass."""
    from .ranking import quantiles

    every = F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("v")) for c in names])
    values = rows.select(id_col, F.explode(every).alias("x")).select(id_col, "x.of", "x.v").where("v is not null").dropDuplicates([id_col, "of"])
    found = quantiles(values, ["of"], "v", [1 / 3, 2 / 3])
    cut = found.agg(F.map_from_entries(F.collect_list(F.struct("of", F.struct("q", "n")))).alias("__cuts"))  # one entry a column, also without values
    out = rows.crossJoin(F.broadcast(cut))  # one row
    for c, name in names.items():
        own, value = F.try_element_at("__cuts", F.lit(c)), F.col(c)
        out = out.withColumn(name, F.when((F.coalesce(own["n"], F.lit(0)) < 3) | value.isNull(), F.lit(None)).when(value <= own["q"][0], "low").when(value <= own["q"][1], "mid").otherwise("high"))
    return out.drop("__cuts")


def bins(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The name of the first edge that the value doesn't exceed, else the last name."""
    return reduce(lambda c, e: c.when(value <= e[0], e[1]), edges[1:], F.when(value <= edges[0][0], edges[0][1])).otherwise(last)


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the drop set."""
    return rows.join(dropped, key, "left_anti")


#: Parts of a model's name and the family that it stands for.
FAMILIES = {"qwen": "qwen3-14b", "gemma": "gemma-4-e4b-it", "gema": "gemma-4-e4b-it"}


def model_family(model: Column) -> Column:
    """The family of a model's name, or the name itself."""
    return reduce(lambda c, kv: c.when(F.lower(model).contains(kv[0]), kv[1]), list(FAMILIES.items())[1:], F.when(F.lower(model).contains("qwen"), FAMILIES["qwen"])).otherwise(model)


def report_name_parts(path: Column) -> dict[str, Column]:
    """Event, pipeline, model family and run mode of a report's file name ``event__pipeline__model__mode.json``, and what is wrong with it."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "__")
    last = F.element_at(parts, -1)
    return {
        "event": F.get(parts, 0), "pipeline": F.get(parts, 1), "family": model_family(F.get(parts, 2)), "mode": F.when(last.isin("think", "nothink"), last).otherwise(""),
        "problem": F.when(F.size(parts) != 4, "unexpected name"),
    }
