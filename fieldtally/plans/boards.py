"""Queries over reports: baselines, gaps, leaderboards, cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, metrics, ranking
from .registry import query
from .results import rounded
from .standins import REPORTS_SQL, reports

SLUG = "official"
BASE_SQL = f"""{REPORTS_SQL}, base AS (SELECT * FROM (SELECT model, slug AS baseline_slug, f1 AS baseline_f1, file AS baseline_file, count(*) OVER (PARTITION BY model) AS n_baselines,
row_number() OVER (PARTITION BY model ORDER BY (slug = '{SLUG}') DESC, f1 DESC, file) AS rn FROM reports WHERE pipeline = 'baseline') WHERE rn = 1)"""
ENTRIES_SQL = f"""{BASE_SQL}, gaps AS (SELECT r.*, baseline_f1, CASE WHEN baseline_f1 >= 1 THEN (CASE WHEN f1 >= 1 THEN 1.0 ELSE 0.0 END) ELSE greatest(0.0::DOUBLE, (f1 - baseline_f1) / (1 - baseline_f1)) END::DOUBLE AS gap
FROM reports r JOIN base USING (model) WHERE NOT (pipeline = 'baseline' AND slug = baseline_slug)), entries AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY gap DESC, file) AS place FROM gaps)"""


def board_sql(value: str) -> str:
    return f"""WITH {ENTRIES_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team, model ORDER BY {value} DESC, file) AS rn FROM entries) WHERE rn = 1),
sums AS (SELECT team, sum({value}) / (SELECT count(DISTINCT model) FROM entries) AS average, count(*) AS n_own, (SELECT count(DISTINCT model) FROM entries) AS n_models, string_agg(model || '=' || pipeline, ';' ORDER BY model || '=' || pipeline) AS detail FROM best GROUP BY team)
SELECT team, round(average, 6) AS average, n_own, n_models, detail, row_number() OVER (ORDER BY round(average, 9) DESC, team) AS place FROM sums"""


def ranked(spark, d):
    rows = reports(spark, d)
    return ranking.ranked_entries(rows, ranking.baselines(rows, SLUG))


@query("w1_baselines", f"WITH {BASE_SQL} SELECT model, baseline_slug, baseline_f1, baseline_file, n_baselines FROM base")
def _(spark, d):
    return ranking.baselines(reports(spark, d), SLUG)


@query("w2_ranked_entries", f"WITH {ENTRIES_SQL} SELECT model, team, pipeline, file, round(gap, 6) AS gap, place FROM entries")
def _(spark, d):
    return rounded(ranked(spark, d).select("model", "team", "pipeline", "file", "gap", "place"))


@query("w3_gap_leaderboard", board_sql("gap"))
def _(spark, d):
    return rounded(ranking.leaderboard(ranked(spark, d), "gap"))


@query("w4_f1_leaderboard", board_sql("f1"))
def _(spark, d):
    return rounded(ranking.leaderboard(ranked(spark, d), "f1"))


@query("w5_dataset_boards", f"""WITH {REPORTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY f1 DESC, file) AS place, row_number() OVER (PARTITION BY model, dataset, team ORDER BY f1 DESC, file) AS own FROM reports)
SELECT model, dataset, team, file, place, CASE WHEN own = 1 THEN row_number() OVER (PARTITION BY model, dataset, own = 1 ORDER BY f1 DESC, file) END AS team_place FROM o""")
def _(spark, d):
    return ranking.dataset_boards(reports(spark, d)).select("model", "dataset", "team", "file", "place", "team_place")


CELLS_SQL = f"{REPORTS_SQL}, cells AS (SELECT model, pipeline, mode, max(f1) AS f1, max(event) FILTER (f1 = m) AS event FROM (SELECT *, max(f1) OVER (PARTITION BY model, pipeline, mode) AS m FROM reports) GROUP BY model, pipeline, mode), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, pipeline ORDER BY f1 DESC, mode) AS rn FROM cells) WHERE rn = 1)"


def cells(spark, d):
    return ranking.unique_cells(reports(spark, d), ["model", "pipeline", "mode"])


@query("w6_unique_cells", f"WITH {CELLS_SQL} SELECT model, pipeline, mode, f1, event FROM cells")
def _(spark, d):
    return cells(spark, d)


@query("w6_best_cells", f"WITH {CELLS_SQL} SELECT model, pipeline, mode, f1, event FROM best")
def _(spark, d):
    return ranking.best_cells(cells(spark, d))


@query("a22_compared_best_cells", f"WITH {CELLS_SQL} SELECT a.model, a.f1 AS a_f1, b.f1 AS b_f1, round(b.f1 - a.f1, 6) AS delta FROM best a JOIN best b ON a.model = b.model AND a.pipeline = 'p1' AND b.pipeline = 'p2'")
def _(spark, d):
    return rounded(ranking.compare_cells(ranking.best_cells(cells(spark, d)), "p1", "p2", ["model"]))


@query("a22_compared_modes", f"WITH {CELLS_SQL} SELECT a.model, a.mode, a.f1 AS a_f1, b.f1 AS b_f1, round(b.f1 - a.f1, 6) AS delta FROM cells a JOIN cells b ON a.model = b.model AND a.mode = b.mode AND a.pipeline = 'p1' AND b.pipeline = 'p2'")
def _(spark, d):
    return rounded(ranking.compare_cells(cells(spark, d), "p1", "p2", ["model", "mode"]))


@query("a19_gap_closed", f"WITH {ENTRIES_SQL} SELECT model, team, round(max(gap), 6) AS best_gap, round(avg(gap), 6) AS mean_gap FROM entries GROUP BY ALL")
def _(spark, d):
    return rounded(ranked(spark, d).groupBy("model", "team").agg(F.max("gap").alias("best_gap"), F.avg("gap").alias("mean_gap")))


@query("a20_quality_per_cost", f"WITH {REPORTS_SQL} SELECT team, round(avg(f1), 6) AS avg_f1, sum(tokens)::BIGINT AS tokens, round(avg(f1) / sum(tokens), 9) AS quality_per_token FROM reports GROUP BY team")
def _(spark, d):
    out = metrics.quality_per_cost(reports(spark, d), ["team"])
    return out.withColumns({"avg_f1": F.round("avg_f1", 6), "quality_per_token": F.round("quality_per_token", 9)})


@query("a21_pivot", f"""WITH {REPORTS_SQL}, c AS (SELECT model, pipeline, max(f1) AS f1, count(*) AS n FROM reports WHERE NOT (model = 'BUILDING' AND pipeline = 'p3') GROUP BY ALL)
SELECT model, {", ".join(f"coalesce(max(CASE WHEN pipeline = '{p}' THEN printf('%.4f', f1) || ' (' || n || ')' END), '-') AS {p}" for p in ("baseline", "p1", "p2", "p3"))} FROM c GROUP BY model""")
def _(spark, d):
    rows = reports(spark, d).where("not (model = 'BUILDING' and pipeline = 'p3')").groupBy("model", "pipeline").agg(F.max("f1").alias("f1"), F.count("*").alias("n_tasks"))
    return metrics.pivot_table(rows, "model", ["baseline", "p1", "p2", "p3"])


@query("j8_nearest_reports", f"""WITH {CELLS_SQL}, named AS (SELECT model || '/' || pipeline || '/' || mode AS cell_id, model, pipeline, mode, f1 + 0.00004::DOUBLE AS f1 FROM cells),
near AS (SELECT cell_id, r.event, r.f1 AS report_f1, row_number() OVER (PARTITION BY cell_id ORDER BY abs(n.f1 - r.f1), r.f1 DESC, r.event) AS place FROM named n JOIN reports r USING (model, pipeline, mode) WHERE abs(n.f1 - r.f1) <= 0.0001::DOUBLE) SELECT cell_id, event, report_f1 FROM near WHERE place = 1""")
def _(spark, d):
    named = cells(spark, d).select(F.concat_ws("/", "model", "pipeline", "mode").alias("cell_id"), "model", "pipeline", "mode", (F.col("f1") + 0.00004).alias("f1"))
    return compare.attach_nearest(named, reports(spark, d), ["model", "pipeline", "mode"]).select("cell_id", "event", "report_f1")


@query("j10_missing_baseline", f"WITH {REPORTS_SQL} SELECT model, file FROM reports WHERE model NOT IN (SELECT model FROM reports WHERE pipeline = 'baseline' AND c_ok) ".replace("AND c_ok", "AND file % 500 = 0"))
def _(spark, d):
    rows = reports(spark, d)
    return ranking.without_baseline(rows, ranking.baselines(rows.where("file % 500 = 0"), SLUG)).select("model", "file")
