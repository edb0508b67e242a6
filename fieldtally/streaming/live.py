"""Streams with keyed state: progress and boards of a running sweep, log rows meeting task windows that arrive as a stream too.

State is what a key needs and no more: counts and the best entry of a team and
model, the best k teams of a model.  A batch leaves nothing behind but the
state's own changes, so disk follows the keys and not the batches; a run that
stops goes on from its checkpoint.  Keys are salted by the whole row, because a
model or team may have any share of the rows; reading merges the salts.

Rows without a team or model form keys of their own; rows without F1 are
counted but are never best; rows without a time take part and move no timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Parts that the rows of one key are dealt into.
SALTS = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "done long, failed long, best_f1 double, best_pipeline string"


class Progress(StatefulProcessor):
    """Done and failed entries and the best entry of a key; a key that stays silent for ``idle_ms`` of event time is handed out and forgotten."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("progress", PROGRESS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, failed, f1, pipeline = self.sums.get() if self.sums.exists() else (0, 0, None, None)
        last = None
        for part in rows:
            done += int((part["status"] == "done").sum())
            failed += int((part["status"] == "failed").sum())
            for value, name in part.loc[part["f1"].notna(), ["f1", "pipeline"]].drop_duplicates().itertuples(index=False):
                if f1 is None or (value, name or "") > (f1, pipeline or ""):
                    f1, pipeline = float(value), name
            newest = part["at_ms"].max()
            last = last if pd.isna(newest) else max(last or 0, int(newest))
        self.sums.update((done, failed, f1, pipeline))
        if self.idle_ms is not None and last is not None:
            at = last + self.idle_ms
            older = list(self.handle.listTimers())
            if not older or max(older) < at:
                for timer in older:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            values = self.sums.get()
            self.sums.clear()
            yield pd.DataFrame([(*key, *values)], columns=["slug", "model", "salt", *(c.split()[0] for c in PROGRESS.split(", "))])

    def close(self) -> None:
        pass


class Board(StatefulProcessor):
    """The k best names of a key.  A name that was pushed out comes back with a row that beats its old best, so no more than k are ever needed."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle) -> None:
        self.board = handle.getValueState("board", "slugs array<string>, values array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = dict(zip(*self.board.get())) if self.board.exists() else {}
        best = dict(before)
        for part in rows:
            for slug, f1 in part.dropna(subset=["slug", "f1"]).groupby("slug")["f1"].max().items():
                best[slug] = max(float(f1), best.get(slug, float("-inf")))
            best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[: self.k])
        if best != before:
            self.board.update((list(best), list(best.values())))
            yield pd.DataFrame({"model": key[0], "salt": key[1], "slug": list(best), "best_f1": list(best.values())})

    def close(self) -> None:
        pass


def _status(rows: DataFrame, salts: int) -> DataFrame:
    """The columns that count, with the time in milliseconds, which no time zone moves."""
    return _salted(rows.select("ts", "slug", "pipeline", "model", "status", "f1", F.unix_millis("ts").alias("at_ms")), salts)


def _salted(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))


def progress(rows: DataFrame, idle_s: int | None = None, late: str = "10 minutes", salts: int = SALTS) -> DataFrame:
    """An append stream of the parts of (slug, model) that fell silent; what is open stays in the state ``progress``.

    With ``idle_s`` rows later than ``late`` are dropped; without it nothing is
    dropped and nothing is closed.
    """
    timed = idle_s is not None
    rows = _status(rows, salts)
    keyed = (rows.withWatermark("ts", late) if timed else rows).groupBy("slug", "model", "salt")
    return keyed.transformWithStateInPandas(Progress(idle_s * 1000 if timed else None), f"slug string, model string, salt int, {PROGRESS}", "Append", "EventTime" if timed else "None")


def board(rows: DataFrame, k: int = 3, salts: int = SALTS) -> DataFrame:
    """An update stream of the boards that changed, by model and salt; the k best of each lie in the state ``board``."""
    keyed = _status(rows, salts).groupBy("model", "salt")
    return keyed.transformWithStateInPandas(Board(k), "model string, salt int, slug string, best_f1 double", "Update", "None")


@contextmanager
def _keyed_state(spark: SparkSession):
    """The settings of a run with keyed state; a started run keeps its own copy, the session gets its settings back."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.minBatchesToRetain": "2"}
    before = {c: spark.conf.get(c, None) for c in wanted}
    for c, v in wanted.items():
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def resume(stream: DataFrame, path: str, mode: str) -> None:
    """Takes up what has come since the run in ``path`` stopped; an append stream's rows go to files, an update stream's stay in the state."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True)
    writer = writer.format("parquet").option("path", f"{path}/out") if mode == "append" else writer.format("noop")
    with _keyed_state(stream.sparkSession):
        run = writer.start()
    run.awaitTermination()


def state(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """The keys and values of a run's state after its last batch."""
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{path}/state").select("key.*", "value.*")


def progress_now(spark: SparkSession, path: str, closed: str | None = None) -> DataFrame:
    """Closed and open parts of ``progress`` together: one row for each slug and model.  ``closed`` is the schema of the closed rows, where there can be any."""
    parts = state(spark, path, "progress")
    if closed:
        parts = parts.unionByName(spark.read.schema(closed).parquet(f"{path}/out"))
    best = F.max_by("best_pipeline", F.struct("best_f1", F.coalesce("best_pipeline", F.lit(""))))
    return parts.groupBy("slug", "model").agg(F.sum("done").alias("done"), F.sum("failed").alias("failed"), F.max("best_f1").alias("best_f1"), best.alias("best_pipeline"))


def board_now(spark: SparkSession, path: str, k: int = 3) -> DataFrame:
    """The k best teams of each model with their places, from the boards of all salts."""
    rows = state(spark, path, "board").select("model", F.explode(F.arrays_zip("slugs", "values")).alias("b"))
    best = rows.groupBy("model", F.col("b.slugs").alias("slug")).agg(F.max("b.values").alias("best_f1"))
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("best_f1"), "slug"))
    return best.select("slug", "model", "best_f1", place.alias("place")).where(F.col("place") <= k)


def attributed(rows: DataFrame, tasks: DataFrame, longest: str, late: str = "10 minutes", bucket_s: int = 3600, salts: int = SALTS) -> DataFrame:
    """Log rows with the task in whose window [started, ended) of their key they fall, both as streams.

    Either side may come first: each waits in the state until both watermarks
    have passed what could still meet it.  Rows and windows that come later
    than ``late`` are dropped.  No window may be longer than ``longest``, which
    bounds the state; one that is stops the run with an error.  A window without
    an end counts as ``longest``.  Rows of a hot key are dealt out by salts, a
    window stands in every salt of the time buckets that it touches.
    """
    most = F.col("started") + F.expr(f"INTERVAL {longest}")
    message = F.concat(F.lit(f"a window is longer than {longest}: task "), F.col("task_id").cast("string"))
    end = F.when(F.col("ended") > most, F.raise_error(message).cast("timestamp")).otherwise(F.coalesce("ended", most))
    bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_s)
    windows = tasks.withWatermark("started", late).select("task_id", "started", end.alias("ended"), F.col("key").alias("of"))
    windows = windows.where("ended > started").withColumn("in_bucket", F.explode(F.sequence(bucket("started"), bucket("ended")))).withColumn("in_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    log = _salted(rows, salts).withWatermark("ts", late).withColumn("bucket", bucket("ts"))
    meet = F.expr(f"api_key = of AND bucket = in_bucket AND salt = in_salt AND ts >= started AND ts < ended AND ts < started + INTERVAL {longest}")
    return log.join(windows, meet).select("task_id", "ts", "api_key", "prompt_tokens")
