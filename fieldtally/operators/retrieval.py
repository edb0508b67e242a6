"""Retrieval of cases for tasks: by schema, by field vectors, by words.

Field rows have ``owner``, ``position``, ``type_class``, ``name`` and ``vec``, a
unit vector.  Queries are a stated set of owners, ranked against all cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records, text
from ..sources.files import durable
from .fieldsearch import FieldSearch
from .lexical import LexicalIndex, lexical_ranked  # noqa: F401
from .ranking import numbered_within
from .schemas import field_tags


#: Cases of the highest scores that bound a query's best pair, and bands of squared norms.
FIRST_CASES, NORM_BANDS = 4, 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vec: Column) -> Column:
    """The vector as doubles, of length 1; a zero vector stays."""
    doubles = F.transform(vec, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda s: F.transform(doubles, lambda x: F.when(s > 0, x / s).otherwise(x))
    return F.get(F.transform(F.array(size), scaled), 0)  # under a name the length is made once, not for each number


def best(rows: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each group, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def by_fingerprint(tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """Tasks beside the cases of their fingerprint, a hot one spread: a case lies in one salt, a task in all, as many as there are shuffle partitions."""
    salts = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = tasks.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(cases.withColumn("__salt", F.pmod(F.xxhash64("case_id"), F.lit(salts)).cast("int")), ["fingerprint", "__salt"]).drop("__salt")


def same_schema(tasks: DataFrame, cases: DataFrame, min_count: int = 1) -> DataFrame:
    """(task_id, case_id, n) of equal fingerprints, for tasks with at least so many matches."""
    counts = cases.groupBy("fingerprint").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    wanted = tasks.select("task_id", "fingerprint").join(counts, "fingerprint")
    return by_fingerprint(wanted, cases.select("case_id", "fingerprint")).select("task_id", "case_id", "n")


def same_schema_ranked(tasks: DataFrame, cases: DataFrame, threshold: float = 0.6, k: int = 2) -> DataFrame:
    """Cases of a task's schema whose whole-task vector is near enough, the nearest first."""
    pairs = by_fingerprint(tasks.select("task_id", "fingerprint", "vec"), cases.select("case_id", "fingerprint", F.col("vec").alias("case_vec"))).where("task_id <> case_id")
    scored = pairs.select("task_id", "case_id", dot(F.col("vec"), F.col("case_vec")).alias("similarity")).where(F.col("similarity") >= threshold)
    return best(scored, ["task_id"], k, F.desc(F.round("similarity", 9)), "case_id")


def nth_same_schema(tasks: DataFrame, cases: DataFrame, n: int) -> DataFrame:
    """The n-th case of a task's schema in corpus order; the cases of a schema are numbered once for all its tasks."""
    nth = numbered_within(cases.select("fingerprint", "case_id"), ["fingerprint"], "place", "case_id").where(F.col("place") == n)
    return tasks.select("task_id", "fingerprint").join(nth, "fingerprint").select("task_id", "case_id")


def alignment(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """Per query, case and query field: the best similarity (at least 0) to a case field of the same class, and that field."""
    return FieldSearch(queries, cases).aligned()


def candidates(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """Per query and other case: the similarity of every query field in order (0 where there is none) and the norm as score."""
    return FieldSearch(queries, cases).candidates()


def first_cases(search: FieldSearch, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """The k candidates of the highest scores, and at least ``FIRST_CASES``, with their place; kept for later calls where nothing is excluded."""
    k = max(k, FIRST_CASES)
    if excluded is None and getattr(search, "first", (0, None))[0] >= k:
        return search.first[1]
    found = durable(best(search.tops(k, excluded), ["query"], k, F.desc("score"), "case_id"))
    if excluded is None:
        search.first = (k, found)
    return found


def independent_top(cands: DataFrame | FieldSearch, k: int = 2) -> DataFrame:
    """The cases of the highest scores."""
    if isinstance(cands, FieldSearch):
        return first_cases(cands, k).where(F.col("place") <= k)
    return best(cands, ["query"], k, F.desc("score"), "case_id")


def pair_score(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """|a + b| + |a - b|."""
    squares, product = norm_a * norm_a + norm_b * norm_b, 2 * dot(a, b)
    root = lambda x: F.sqrt(F.greatest(F.lit(0.0), x))
    return F.round(root(squares + product) + root(squares - product), 9)


def complementary_pairs(cands: DataFrame | FieldSearch) -> DataFrame:
    """Per query the pair of cases of the highest pair score; ties by the sum of scores, then the least sum of ids, then the lower ids.

    The squared pair score is at most four times the sum of the squared norms.
    The best partners of the highest-scoring cases give a bound; a case whose
    norm can't reach it with any partner goes.  The others meet in bands of
    their squared norm: each meets only the bands, from its own downwards, in
    which a partner's norm could still make up for what its own lacks.  A
    search makes its candidates anew for each of these steps, and they are
    never all there.
    """
    kept = _reaching_of(cands, first_cases(cands, FIRST_CASES)) if isinstance(cands, FieldSearch) else _reaching(cands)
    return _best_pairs(kept).select("query", "a", "b", "pair_score", "score_sum")


def _reaching(cands: DataFrame) -> DataFrame:
    """The candidates that can be in a best pair, with the ``bound`` of their query and its highest score."""
    own = durable(cands.select("query", "case_id", "vec", "score"))
    top = best(own, ["query"], FIRST_CASES, F.desc("score"), "case_id").select("query", F.col("case_id").alias("t_id"), F.col("vec").alias("t_vec"), F.col("score").alias("t_score"))
    met = own.join(top, "query").where("case_id <> t_id")
    bound = durable(met.groupBy("query").agg(F.max(pair_score(F.col("vec"), F.col("t_vec"), F.col("score"), F.col("t_score"))).alias("bound"), F.max("t_score").alias("t_score")))
    return own.join(bound, "query").where("4 * (score * score + t_score * t_score) >= bound * bound - 1e-6 * greatest(bound, 1)")


def _reaching_of(search: FieldSearch, first: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``_reaching`` for a search whose first cases are known."""
    first = first.where(F.col("place") <= FIRST_CASES)
    bound = durable(search.bounds(first, excluded).join(first.groupBy("query").agg(F.max("score").alias("t_score")), "query"))
    return search.within(bound, excluded).join(bound, "query")


def _best_pairs(kept: DataFrame) -> DataFrame:
    """The best pair of each query, with vectors and scores of both; of cases with one vector the first two by id stand for all."""
    kept = durable(best(kept, ["query", "vec", "score"], 2, "case_id").withColumn("lacks", F.col("bound") * F.col("bound") / 4 - 1e-6 * F.greatest("bound", F.lit(1.0)) - F.col("score") * F.col("score")))
    band = lambda square: F.floor(square * NORM_BANDS / F.greatest(F.col("t_score") * F.col("t_score"), F.lit(1e-12))).cast("int")
    square = F.col("score") * F.col("score")
    left = kept.select("query", "case_id", "vec", "score", "lacks", F.explode(F.sequence(F.least(band(F.greatest("lacks", F.lit(0.0))), band(square)), band(square))).alias("band"))
    other = kept.select("query", *[F.col(c).alias(f"b_{c}") for c in ("case_id", "vec", "score")], band(square).alias("band"))
    smaller = (F.col("b_score") < F.col("score")) | ((F.col("b_score") == F.col("score")) & (F.col("case_id") < F.col("b_case_id")))
    pairs = left.join(other, ["query", "band"]).where(smaller & (F.col("b_score") * F.col("b_score") >= F.col("lacks")))
    pairs = pairs.select("query", *[F.when(F.col("case_id") < F.col("b_case_id"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("case_id", "b_case_id"), ("vec", "b_vec"), ("score", "b_score"))], *[F.when(F.col("case_id") < F.col("b_case_id"), F.col(b)).otherwise(F.col(a)).alias(b) for a, b in (("case_id", "b_case_id"), ("vec", "b_vec"), ("score", "b_score"))])
    scored = pairs.select("query", F.col("case_id").alias("a"), F.col("b_case_id").alias("b"), pair_score(F.col("vec"), F.col("b_vec"), F.col("score"), F.col("b_score")).alias("pair_score"), F.round(F.col("score") + F.col("b_score"), 9).alias("score_sum"), F.col("vec").alias("a_vec"), "b_vec", F.col("score").alias("a_score"), "b_score")
    return best(scored, ["query"], 1, F.desc(F.round("pair_score", 7)), F.desc("score_sum"), F.col("a") + F.col("b"), "a").drop("place")


def diverse_top(cands: DataFrame | FieldSearch, k: int = 2, excluded: DataFrame | None = None) -> DataFrame:
    """The complementary pair first, then the rest by score; where no pair scores above 0, all by score.

    ``excluded`` has (query, case_id) rows that aren't candidates, of a search a few for each query.
    """
    if isinstance(cands, FieldSearch):
        rows = first_cases(cands, k, excluded)
        kept = _reaching_of(cands, rows, excluded)
    else:
        rows = cands if excluded is None else durable(remaining(cands, excluded))
        kept = _reaching(rows)
    member = lambda s: F.struct(F.col(s).alias("case_id"), F.col(f"{s}_vec").alias("vec"), F.col(f"{s}_score").alias("score"))
    pairs = durable(_best_pairs(kept).where("pair_score > 0").select("query", F.explode(F.array(member("a"), member("b"))).alias("m")).select("query", "m.*"))
    others = remaining(rows, pairs).select("query", "case_id", "vec", "score", F.lit(False).alias("in_pair"))
    return best(others.unionByName(pairs.withColumn("in_pair", F.lit(True))), ["query"], k, F.desc("in_pair"), F.desc("score"), "case_id")


def remaining(cands: DataFrame, selected: DataFrame) -> DataFrame:
    """Candidates that are not selected."""
    return cands.join(selected.select("query", "case_id"), ["query", "case_id"], "left_anti")


def selection_metrics(selected: DataFrame) -> DataFrame:
    """Score sum, fields covered and their share, mean and least best similarity of each query's selection."""
    selected = durable(selected)  # a few rows a query, made once
    fields = selected.select("query", "case_id", "score", F.posexplode("vec").alias("field", "similarity"))
    tops = fields.groupBy("query", "field").agg(F.max("similarity").alias("top"))
    cover = tops.groupBy("query").agg(F.count_if(F.col("top") > 0).alias("covered"), F.avg((F.col("top") > 0).cast("double")).alias("covered_share"), F.avg("top").alias("mean_top"), F.min("top").alias("least_top"))
    return selected.groupBy("query").agg(F.sum("score").alias("score_sum"), F.array_join(F.array_sort(F.collect_list("case_id")), ";").alias("cases")).join(cover, "query")


def selections_compared(default: DataFrame, independent: DataFrame) -> DataFrame:
    """Default against independent selection: the same cases or not, and what is gained or lost."""
    a = default.select("query", *[F.col(c).alias(f"a_{c}") for c in ("score_sum", "cases", "covered_share", "mean_top")])
    b = independent.select("query", *[F.col(c).alias(f"b_{c}") for c in ("score_sum", "cases", "covered_share", "mean_top")])
    return a.join(b, "query").select(
        "query", (F.col("a_cases") == F.col("b_cases")).alias("same_pair"), (F.col("b_score_sum") - F.col("a_score_sum")).alias("score_loss"),
        (F.col("a_covered_share") - F.col("b_covered_share")).alias("coverage_gain"), (F.col("a_mean_top") - F.col("b_mean_top")).alias("similarity_gain"),
    )


def schema_profiles(rows: DataFrame, schema_col: str) -> DataFrame:
    """(fingerprint, fields, names, tags, words) of every distinct schema: its exact form, the exact forms of its top-level fields, their names, tags and words, and the words of its description.

    Schemas are few against the rows that have them; each is walked once.
    """
    distinct = rows.select(fingerprint(schema_col).alias("fingerprint"), F.col(schema_col).alias("schema")).dropDuplicates(["fingerprint"])
    fields = records.schema_fields(distinct, "fingerprint", "schema").where("depth = 0")
    said = text.terms(F.concat_ws(" ", "name", "description"))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  an object's top-level fields
    own = fields.select("fingerprint", F.concat_ws("=", "name", F.sha1("own_form")).alias("field"), "name", field_tags().alias("t"), said.alias("w")).groupBy("fingerprint").agg(
        F.array_sort(F.collect_set("field")).alias("fields"), F.array_sort(F.collect_set("name")).alias("names"), every("t").alias("tags"), every("w").alias("words")
    )
    described = distinct.select("fingerprint", text.terms(F.coalesce(F.get_json_object("schema", "$.description"), F.lit(""))).alias("d"))
    return own.join(described, "fingerprint").withColumn("words", F.array_sort(F.array_union("words", "d"))).drop("d")


def case_tags(tags: str, examples: str, judge: str) -> Column:
    """A case's own tags, those of its field examples (a map of structs) and those of its judge (JSON by field)."""
    none = F.array().cast("array<string>")
    of = lambda found: F.flatten(F.transform(F.map_values(found), lambda x: F.coalesce(x["tags"], none)))
    judged = F.from_json(judge, "fields map<string, struct<tags: array<string>>>")["fields"]
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in (F.col(tags), of(F.col(examples)), of(judged))]))


def fingerprint(schema_col: str) -> Column:
    return F.sha1(records.canonical_json(F.col(schema_col)))


def profiles(rows: DataFrame, schema_col: str, said: Column, tags: Column | None = None) -> DataFrame:
    """Rows with the profile of their schema; ``said`` adds words to its terms, ``tags`` a row's own tags to the schema's."""
    own = rows.withColumns({"fingerprint": fingerprint(schema_col), "__terms": text.terms(said), "__tags": tags if tags is not None else F.array().cast("array<string>")})
    both = own.join(schema_profiles(rows, schema_col), "fingerprint")
    return both.withColumns({"terms": F.array_union("__terms", "words"), "tags": F.array_union("tags", "__tags")}).drop("__terms", "__tags", "words", schema_col)


def routed(tasks: DataFrame, schema: DataFrame, fields: DataFrame, lexical: Callable[[DataFrame], DataFrame], least: int = 2) -> DataFrame:
    """One selection per task: same-schema if it has enough cases, else fields, else lexical, else failed, with the route.

    Each route is made once and kept; ``lexical`` gets only the tasks that the
    others leave.
    """
    pick = lambda df, route: df.select("task_id", "case_id", "place").withColumn("route", F.lit(route))
    kept = durable(schema.select("task_id", "case_id", "place"))
    enough = kept.groupBy("task_id").count().where(F.col("count") >= least).select("task_id")
    first = pick(kept.join(enough, "task_id", "left_semi"), "same_schema")
    done = durable(first.unionByName(pick(fields.join(enough, "task_id", "left_anti"), "fields")))
    left = durable(tasks.select("task_id").join(done, "task_id", "left_anti"))
    third = durable(pick(lexical(left), "lexical"))
    failed = left.join(third, "task_id", "left_anti").select("task_id", F.lit(None).cast("long").alias("case_id"), F.lit(None).cast("int").alias("place"), F.lit("retrieval_failed").alias("route"))
    return done.unionByName(third).unionByName(failed)


def stratified_sample(rows: DataFrame, id_col: str, stratum: str, fraction: float, order: Column) -> DataFrame:
    """max(1, round-half-even(n * fraction)) rows of each stratum by a fixed order, so that samples of rising fractions are nested."""
    placed = numbered_within(rows.withColumn("__order", order), [stratum], "__at", "__order", id_col)
    counts = rows.groupBy(stratum).agg(F.count("*").alias("__n"))
    marked = placed.join(counts, stratum).where(F.col("__at") <= F.greatest(F.lit(1.0), F.bround(F.col("__n") * fraction, 0)))
    return marked.select(*rows.columns)
