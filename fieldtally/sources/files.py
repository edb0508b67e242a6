"""Readers and writers of task, case, report, usage and prediction files, all as Spark reads and writes.

A document (a task, case, report or prediction) is a file of its own or, of many, a row (file name, text) of a packed table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = """id string, domain string, language string, source_text string, instruction string, schema string, tags array<string>, enriched_field_descriptions map<string,string>,
field_examples map<string, struct<value:string, tags:array<string>>>, judge string"""
RESULT_SCHEMA = "task_id string, tps double, gold_keys int, system_keys int, elapsed_s double, tokens struct<input:bigint, output:bigint, total:bigint, calls:bigint>, status string, error string"
REPORT_SCHEMA = f"""participant struct<team_name:string, institution:string>, config struct<model:string, pipeline:string, data_source:string>, metrics struct<precision:double, recall:double, f1:double>,
tasks array<struct<{', '.join(x.replace(' ', ':', 1) for x in RESULT_SCHEMA.split(', ') if not x.startswith(('tokens', 'output', 'total', 'calls'))) }>>"""
USAGE_SCHEMA = "ts timestamp, api_key string, model string, prompt_tokens bigint, completion_tokens bigint"
SIDECARS = r"[._-](review|audit|grounding)\.json$"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-files-')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


#: Documents that stand packed, as rows of a Parquet table: the name of a file and its text.
PACKED_SCHEMA = "file string, value string"


def write_packed(documents: DataFrame, path: str) -> None:
    """Documents (file, value) as rows of a few files a core; a million files of one document each would cost a listing and an opening apiece, and one file of all is written and read by one task."""
    documents.select("file", "value").write.mode("append").parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, however few files they came from."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _whole(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(value, file) of all documents below a folder: files of their own, and those that ``write_packed`` put together."""
    below = spark.read.option("recursiveFileLookup", "true")
    own = below.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    packed = below.option("pathGlobFilter", "part-*.parquet").schema(PACKED_SCHEMA).parquet(path).where("value is not null")
    return own.unionByName(packed)


def _field(name: str) -> Column:
    return F.get_json_object("value", f"$.{name}")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task files without their sidecars; free JSON parts stay texts."""
    rows = _whole(spark, path, "*.json").where(~F.col("file").rlike(SIDECARS) & _field("id").isNotNull())
    return rows.select(*[_field(n).alias(n) for n in ("id", "input_text", "instruction", "target_schema", "output")], F.from_json(_field("metadata"), "map<string,string>").alias("metadata"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case files whose schema is an object with properties."""
    rows = _whole(spark, path, "*.json").select(F.explode(F.array(F.from_json("value", CASE_SCHEMA))).alias("c")).select("c.*").where("id is not null")  # parsed once, not for each condition
    return rows.where((F.get_json_object("schema", "$.type") == "object") & F.get_json_object("schema", "$.properties").isNotNull())


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files with participant, configuration and metrics; ``slug`` is the file name before the first ``--``, else before ``__``.

    The name of a part that Spark wrote is that of its folder.
    """
    parts = F.split("file", "/")
    name = F.when(F.element_at(parts, -1).startswith("part-"), F.regexp_replace(F.element_at(parts, -2), "^[^=]*=", "")).otherwise(F.element_at(parts, -1))
    rows = _whole(spark, path, "*.json").select(F.explode(F.array(F.from_json("value", REPORT_SCHEMA))).alias("r"), name.alias("file"))  # parsed once, not for each condition
    name = F.regexp_replace("file", r"\.json$", "")
    slug = F.when(name.contains("--"), F.split_part(name, F.lit("--"), F.lit(1))).otherwise(F.split_part(name, F.lit("__"), F.lit(1)))
    return rows.where("r.participant is not null and r.config is not null and r.metrics is not null").select("r.*", "file", slug.alias("slug"))


def read_usage(spark: SparkSession, path: str, api_key: str | None = None) -> DataFrame:
    """Usage lines; malformed ones are skipped."""
    rows = spark.read.schema(USAGE_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("ts is not null")
    return rows if api_key is None else rows.where(F.col("api_key") == api_key)


#: The end of a file's name: its own, or that of a part that Spark wrote into a folder of that name.
_END = r"(?:\.json|/part-[^/]+\.json)$"


def read_predictions(spark: SparkSession, path: str, golden: DataFrame) -> DataFrame:
    """Predictions of direct runs (.../direct/<pipeline>/<run>/<task>.json) and mixed trials (.../mixed/<pipeline>/<run>/<task>/<step>.json).

    Folders may be named as Spark's writers name partitions
    (``pipeline=<pipeline>``).  Of mixed trials those count whose step begins
    with ``trial`` and that carry no error and a known extraction.  Only golden
    tasks stay.
    """
    rows = _whole(spark, path, "*.json")
    part = lambda pattern, i: F.regexp_extract("file", pattern, i)
    runs = r"/(?:pipeline=)?([^/]+)/(?:run=)?([^/]+)/(?:task_id=)?"
    direct, mixed = f"/direct{runs}([^/]+?){_END}", f"/mixed{runs}([^/]+)/(?:step=)?(trial[^/]*?){_END}"
    a = rows.where(F.col("file").rlike(direct)).select(F.lit("direct").alias("source"), *[part(direct, i + 1).alias(n) for i, n in enumerate(("pipeline", "run", "task_id"))], F.lit("").alias("step"), _field("output").alias("output"))
    known = _field("error").isNull() & _field("extraction").isin("strict", "salvaged")
    b = rows.where(F.col("file").rlike(mixed) & known).select(F.lit("mixed").alias("source"), *[part(mixed, i + 1).alias(n) for i, n in enumerate(("pipeline", "run", "task_id", "step"))], _field("output").alias("output"))
    return a.unionByName(b).where("output is not null").join(golden.select("task_id").distinct(), "task_id", "left_semi")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, task, gold, prediction) of complete folders <task>/{task,gold,pred|prediction}.json, or <task_id=...>/<name=...>/; ``pred`` goes first."""
    names = ["task", "gold", "pred", "prediction"]
    key = rf"/(?:task_id=)?([^/]+)/(?:name=)?({'|'.join(names)}){_END}"
    rows = _whole(spark, path, "*.json").withColumns({"task_id": F.regexp_extract("file", key, 1), "name": F.regexp_extract("file", key, 2)}).where("name <> ''")
    wide = rows.groupBy("task_id").pivot("name", names).agg(F.first("value"))
    return wide.select("task_id", "task", "gold", F.coalesce("pred", "prediction").alias("prediction")).where("task is not null and gold is not null and prediction is not null")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """A result table as CSV with a header, JSON lines or Parquet."""
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(path)
    return path


def write_predictions(predictions: DataFrame, path: str) -> DataFrame:
    """Predictions below pipeline and task, and the manifest of where each lies."""
    predictions.write.partitionBy("pipeline", "task_id").json(f"{path}/data")
    return predictions.select("pipeline", "task_id", "run", F.concat_ws("/", F.lit("data"), F.concat(F.lit("pipeline="), "pipeline"), F.concat(F.lit("task_id="), "task_id")).alias("file"))


def evaluation_reports(results: DataFrame, part_tasks: int = 1000) -> DataFrame:
    """Nested reports: metrics, timing and tokens of a run, and its tasks in parts of about ``part_tasks``.

    A run of any size becomes as many rows as it has parts, so no list grows
    with the run.
    """
    from ..operators.metrics import micro_metrics

    keys = ["run", "model", "pipeline"]
    heads = micro_metrics(results, keys, F.avg("elapsed_s").alias("avg_s"), F.max("elapsed_s").alias("max_s"), F.sum("tokens").alias("total_tokens")).withColumn("n_parts", F.ceil(F.col("n_tasks") / part_tasks))
    task = F.struct("task_id", "tps", "gold_keys", "system_keys", "elapsed_s")
    numbered = results.join(heads.select(*keys, "n_parts"), keys).withColumn("part", F.pmod(F.xxhash64("task_id"), F.col("n_parts")))
    parts = numbered.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(task)).alias("tasks"))
    return heads.join(parts, keys).select(
        "run", "part", "n_parts", F.struct("model", "pipeline").alias("config"), F.struct("precision", "recall", "f1").alias("metrics"), F.struct("avg_s", "max_s").alias("timing"), F.struct("total_tokens").alias("token_usage"), "tasks"
    )


def write_field_index(fields: DataFrame, path: str) -> DataFrame:
    """The field index as Parquet, read again."""
    fields.write.parquet(path)
    return fields.sparkSession.read.parquet(path)


def build_field_index(cases: DataFrame, path: str, embed=None, before: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The index of a set of cases (owner, schema): the vectors of their fields' texts, and a table of the cases.

    Every case's top-level fields get a row with type class, name, text and a
    unit vector; equal texts are embedded once.  The vectors are kept by the
    hash of their text, so that an index built with ``before``, the path of an
    earlier one, embeds only the texts that the earlier one lacks.
    """
    from ..functions import records
    from ..functions.sizes import meeting
    from ..operators import schemas

    own = cases.withColumn("fingerprint", F.sha1(records.canonical_json(F.col("schema"))))
    owners = write_field_index(own.select("owner", "fingerprint"), f"{path}/cases")
    fields = records.schema_fields(own, "fingerprint", "schema").where("depth = 0")
    texts = durable(fields.select("fingerprint", "position", "type_class", "name", schemas.field_text(F.col("name"), F.col("type_text"), F.col("description")).alias("text")))
    known = None if before is None else cases.sparkSession.read.parquet(f"{before}/vectors")
    kept = write_field_index(schemas.grown_vectors(known, texts, "text", embed or schemas.hashed_vectors), f"{path}/vectors")
    rows = owners.join(meeting(texts), "fingerprint").drop("fingerprint")  # before the vectors, which are wide
    return write_field_index(schemas.with_known_vectors(rows, "text", kept), f"{path}/fields"), owners
