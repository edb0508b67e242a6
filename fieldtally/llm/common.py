"""What the operators of this subpackage share: durable intermediate tables and bounded training samples."""

from __future__ import annotations

import tempfile
import warnings
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster
    that is an error, since executors could not read each other's files.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="spark-shared-")


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Tasks of a step at least, where a shuffle makes as many partitions.
LEAST_TASKS = 8


def gathered(df: DataFrame, rows: int, each: int) -> DataFrame:
    """In tasks of ``each`` rows or so, if the partitions are more than such tasks.

    A shuffle makes as many partitions as the session says, however few rows
    there are, and each of them costs a task with files and log entries of its own.
    """
    tasks = LEAST_TASKS + rows // each
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    modulus: int,
    held_out_remainder: int,
    per_class: int,
    most_bytes: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[str], list[int], list[int]]:
    """Whole texts, labels and the two class counts, of labelled rows outside the held-out fold.

    The sample is bounded: of each label the first ``per_class`` documents in
    the order of a hash of their id, and of these as many as have ``most_bytes``
    bytes together, one at least.  Texts of all lengths take part.  Rows without
    a label or a document are left out; of repeated labels of a document the
    larger holds, of several texts under one id that of the smallest hash.
    ``labels`` has (doc_id, label_col).
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label_col).cast("int").alias("label"))
        .where("i is not null and label in (0, 1)")
        .where(crc_remainder("i", modulus) != held_out_remainder)
        .groupBy("i")
        .agg(F.max("label").alias("label"))
    )
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("i"), "i").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(picked), "i")  # at most 2 * per_class rows
    texts = texts.groupBy("i", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one row per id
    texts = durable(texts)  # one scan; the lengths alone come first
    kept: list[int] = []
    for value in (0, 1):
        rows = texts.where(F.col("label") == value).orderBy(F.xxhash64("i"), "i").select("i", F.octet_length("text")).collect()
        whole = list(accumulate(r[1] for r in rows))
        kept += [r[0] for r in rows[: max(1, bisect_right(whole, most_bytes))]]
    rows = sorted((r["i"], r["text"], r["label"]) for r in texts.where(F.col("i").isin(kept)).collect()) if kept else []
    if len({r[2] for r in rows}) < 2:
        warnings.warn(f"no labelled texts of both classes for {label_col}: the score is one constant", stacklevel=2)
    return [r[1] for r in rows], [r[2] for r in rows], [sizes.get(0, 0), sizes.get(1, 0)]
