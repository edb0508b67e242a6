"""Queries over field vectors, cases and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval
from ..sources.files import durable
from .registry import query
from .results import rounded
from .standins import table

FIELDS_SQL = """fields AS (SELECT vec_id // 5 AS owner, (vec_id % 5)::INT AS position, label % 3 AS type_class, 'f' || (vec_id % 5) AS name, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS vec FROM embeddings)"""
CANDS_SQL = f"""{FIELDS_SQL}, q AS (SELECT * FROM fields WHERE owner % 100 = 0), c AS (SELECT * FROM fields),
aligned AS (SELECT q.owner AS query, c.owner AS case_id, q.position AS field, max(round(greatest(0.0::DOUBLE, list_dot_product(q.vec, c.vec)), 9)) AS similarity, arg_min(c.name, {{'a': -round(greatest(0.0::DOUBLE, list_dot_product(q.vec, c.vec)), 9), 'b': c.name}}) AS case_field FROM q JOIN c ON q.type_class = c.type_class AND q.owner <> c.owner GROUP BY ALL),
cands AS (SELECT query, case_id, [coalesce(max(similarity) FILTER (field = 0), 0), coalesce(max(similarity) FILTER (field = 1), 0), coalesce(max(similarity) FILTER (field = 2), 0), coalesce(max(similarity) FILTER (field = 3), 0), coalesce(max(similarity) FILTER (field = 4), 0)] AS vec, round(sqrt(sum(similarity * similarity)), 9) AS score FROM aligned GROUP BY ALL)"""
PAIR = "round(sqrt(greatest(0, x.score ** 2 + y.score ** 2 + 2 * list_dot_product(x.vec, y.vec))) + sqrt(greatest(0, x.score ** 2 + y.score ** 2 - 2 * list_dot_product(x.vec, y.vec))), 9)"
BEST_SQL = f"""{CANDS_SQL}, pairs AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(pair_score, 7) DESC, score_sum DESC, a + b, a) AS rn FROM (SELECT x.query, x.case_id AS a, y.case_id AS b, {PAIR} AS pair_score, round(x.score + y.score, 9) AS score_sum FROM cands x JOIN cands y ON x.query = y.query AND x.case_id < y.case_id)),
ind AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, case_id) AS place FROM cands) WHERE place <= 2),
div AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.query ORDER BY (c.case_id = a OR c.case_id = b) DESC, score DESC, case_id) AS place FROM cands c LEFT JOIN (SELECT * FROM pairs WHERE rn = 1) p ON c.query = p.query) WHERE place <= 2)"""


def fields(spark, d):
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("owner"), (F.col("vec_id") % 5).cast("int").alias("position"), (F.col("label") % 3).alias("type_class"), F.concat(F.lit("f"), (F.col("vec_id") % 5).cast("string")).alias("name"), retrieval.unit(F.col("embedding")).alias("vec"))


#: A search takes every owner whose number is divisible by 100, against all others.
QUERIES = "owner % 100 = 0"


def aligned(rows):
    return retrieval.alignment(rows.where(QUERIES), rows).where("query <> case_id")


def search(spark, d):
    """The search of all queries, for what selects among their candidates."""
    rows = fields(spark, d)
    return retrieval.FieldSearch(rows.where(QUERIES), rows)


def cands(spark, d):
    """All candidates of every query."""
    return search(spark, d).candidates()


@query("j6_r4_alignment", f"WITH {CANDS_SQL} SELECT query, case_id, field, round(similarity, 6) AS similarity, case_field FROM aligned WHERE similarity > 0")
def _(spark, d):
    return rounded(aligned(fields(spark, d)).where("similarity > 0"))


@query("r4_candidates", f"WITH {CANDS_SQL} SELECT query, case_id, score FROM cands")
def _(spark, d):
    return cands(spark, d).select("query", "case_id", "score")


@query("r5_independent_top", f"WITH {BEST_SQL} SELECT query, case_id, place, round(score, 6) AS score FROM ind")
def _(spark, d):
    return rounded(retrieval.independent_top(search(spark, d)).select("query", "case_id", "place", "score"))


@query("j7_r6_pairs", f"WITH {BEST_SQL} SELECT query, a, b, round(pair_score, 6) AS pair_score, round(score_sum, 6) AS score_sum FROM pairs WHERE rn = 1")
def _(spark, d):
    return rounded(retrieval.complementary_pairs(search(spark, d)))


@query("r6_diverse_top", f"WITH {BEST_SQL} SELECT query, case_id, place FROM div")
def _(spark, d):
    return retrieval.diverse_top(search(spark, d)).select("query", "case_id", "place")


TOPS = """{n}t AS (SELECT query, f, max(vec[f]) AS top FROM {n}, (SELECT unnest(range(1, 6)) AS f) GROUP BY ALL),
{n}m AS (SELECT t.query, s.score_sum, s.cases, count_if(top > 0)::BIGINT AS covered, avg((top > 0)::INT) AS covered_share, avg(top) AS mean_top, min(top) AS least_top FROM {n}t t JOIN (SELECT query, sum(score) AS score_sum, string_agg(case_id::VARCHAR, ';' ORDER BY case_id) AS cases FROM {n} GROUP BY query) s ON t.query = s.query GROUP BY ALL)"""


@query("r9_selection_metrics", f"WITH {BEST_SQL}, {TOPS.format(n='div')} SELECT query, round(score_sum, 6) AS score_sum, cases, covered, round(covered_share, 6) AS covered_share, round(mean_top, 6) AS mean_top, round(least_top, 6) AS least_top FROM divm")
def _(spark, d):
    return rounded(retrieval.selection_metrics(retrieval.diverse_top(search(spark, d))))


@query("r10_selections_compared", f"WITH {BEST_SQL}, {TOPS.format(n='div')}, {TOPS.format(n='ind')} SELECT a.query, a.cases = b.cases AS same_pair, round(b.score_sum - a.score_sum, 6) + 0.0 AS score_loss, round(a.covered_share - b.covered_share, 6) + 0.0 AS coverage_gain, round(a.mean_top - b.mean_top, 6) + 0.0 AS similarity_gain FROM divm a JOIN indm b USING (query)")
def _(spark, d):
    rows = search(spark, d)
    metrics = [retrieval.selection_metrics(s) for s in (retrieval.diverse_top(rows), retrieval.independent_top(rows))]
    return rounded(retrieval.selections_compared(*metrics))


@query("s4_remaining", f"WITH {BEST_SQL} SELECT query, case_id FROM cands EXCEPT SELECT query, case_id FROM ind")
def _(spark, d):
    rows = search(spark, d)
    return rows.candidates(excluded=retrieval.independent_top(rows)).select("query", "case_id")


TASKS = "tasks AS (SELECT vec_id AS task_id, label AS fingerprint, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS vec FROM embeddings)"


def tasks(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("task_id"), F.col("label").alias("fingerprint"), retrieval.unit(F.col("embedding")).alias("vec"))
    return rows.where("task_id % 100 = 0"), rows.withColumnRenamed("task_id", "case_id")


@query("j5_same_schema", "SELECT a.vec_id AS task_id, b.vec_id AS case_id, count(*) OVER (PARTITION BY a.vec_id) AS n FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 QUALIFY n >= 2")
def _(spark, d):
    return retrieval.same_schema(*tasks(spark, d), min_count=2)


@query("r3_same_schema_ranked", f"WITH {TASKS}, s AS (SELECT a.task_id, b.task_id AS case_id, list_dot_product(a.vec, b.vec) AS similarity FROM tasks a JOIN tasks b USING (fingerprint) WHERE a.task_id % 100 = 0 AND a.task_id <> b.task_id) SELECT task_id, case_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY task_id ORDER BY round(similarity, 9) DESC, case_id) AS place FROM s WHERE similarity >= 0.2 QUALIFY place <= 3")
def _(spark, d):
    return rounded(retrieval.same_schema_ranked(*tasks(spark, d), threshold=0.2, k=3))


@query("w10_nth_same_schema", "SELECT a.vec_id AS task_id, b.vec_id AS case_id FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) = 3")
def _(spark, d):
    return retrieval.nth_same_schema(*tasks(spark, d), 3)


@query("w9_stratified_sample", """SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey * 2654435761) % 4294967296, p_partkey) <= greatest(1, round_even(count(*) OVER (PARTITION BY p_brand) * 0.15::DOUBLE, 0))""")
def _(spark, d):
    order = (F.col("p_partkey") * 2654435761) % 4294967296
    return retrieval.stratified_sample(table(spark, d, "part").select("p_brand", "p_partkey"), "p_partkey", "p_brand", 0.15, order)


@query("r6_excluded", f"WITH {BEST_SQL}, x AS (SELECT query, case_id FROM ind WHERE place = 1), left_ AS (SELECT * FROM cands ANTI JOIN x USING (query, case_id)), p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(pair_score, 7) DESC, score_sum DESC, a + b, a) AS rn FROM (SELECT x.query, x.case_id AS a, y.case_id AS b, {PAIR} AS pair_score, round(x.score + y.score, 9) AS score_sum FROM left_ x JOIN left_ y ON x.query = y.query AND x.case_id < y.case_id)) WHERE rn = 1 AND pair_score > 0) SELECT query, case_id, place FROM (SELECT c.query, c.case_id, row_number() OVER (PARTITION BY c.query ORDER BY coalesce(c.case_id = a OR c.case_id = b, false) DESC, score DESC, case_id) AS place FROM left_ c LEFT JOIN p2 p ON c.query = p.query) WHERE place <= 3")
def _(spark, d):
    """The best single case of each query is no candidate."""
    rows = search(spark, d)
    return retrieval.diverse_top(rows, 3, excluded=retrieval.independent_top(rows, 1)).select("query", "case_id", "place")


def diverse_for(spark, d, n: int):
    """The diverse selection of the first n owners against all: the retrieval that the bench times."""
    rows = fields(spark, d)
    return retrieval.diverse_top(retrieval.FieldSearch(rows.where(F.col("owner") < n), rows))


#: A row's schema by its number: a whole number that is required, and a text or a choice.
ROW_SCHEMA = """concat('{{"type":"object","required":["a', {0} % 5, '"],"properties":{{"a', {0} % 5, '":{{"type":"integer"}},"b', {0} % 7, '":', if({0} % 7 % 2 = 0, '{{"enum":["x","y"]}}', '{{"type":"string","description":"free words"}}'), '}}}}')"""
PROFILE_SQL = """profile AS (SELECT {id} AS id, {id} % 35 AS fingerprint, ['a' || ({id} % 5), 'b' || ({id} % 7)] AS names, list_distinct(list_concat(['numeric_normalization', CASE WHEN {id} % 7 % 2 = 0 THEN 'enum_classification' ELSE 'direct_string' END], {tags})) AS tags, {dom} AS domain, length(text) AS n_chars,
list_distinct(list_concat(list_filter(regexp_extract_all(lower({said}), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2), ['a' || ({id} % 5), 'b' || ({id} % 7)], CASE WHEN {id} % 7 % 2 = 0 THEN [] ELSE ['free', 'words'] END)) AS terms FROM {t})"""
TASK_PROFILE = "t" + PROFILE_SQL.format(id="item_id", tags="[]", dom="''", said="text || ' src' || (item_id % 20)", t="benchmark")
CASE_PROFILE = "c" + PROFILE_SQL.format(id="doc_id", tags="[lang]", dom="source", said="text || ' ' || doc_id || ' ' || source", t="documents")
LEX_SQL = f"""{TASK_PROFILE}, {CASE_PROFILE},
scored AS (SELECT t.id AS task_id, c.id AS case_id, c.n_chars, round(CASE WHEN t.fingerprint = c.fingerprint THEN 100 ELSE 0 END + 10 * len(list_intersect(t.names, c.names)) + 4 * len(list_intersect(t.tags, c.tags)) + 0.5::DOUBLE * least(len(list_intersect(t.terms, c.terms)), 12) + CASE WHEN list_contains(t.terms, lower(c.domain)) THEN 2 ELSE 0 END - least(c.n_chars / 10000.0::DOUBLE, 2), 9) AS score FROM tprofile t CROSS JOIN cprofile c)"""


def profiles(spark, d):
    """Benchmark items as tasks and documents as cases, each with a schema and its profile."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.expr(ROW_SCHEMA.format("item_id")).alias("schema"), F.concat(F.col("text"), F.lit(" src"), (F.col("item_id") % 20).cast("string")).alias("said"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.expr(ROW_SCHEMA.format("doc_id")).alias("schema"), F.col("source").alias("domain"), F.length("text").alias("n_chars"), "lang", F.concat_ws(" ", "text", F.col("doc_id").cast("string"), "source").alias("said"))
    return retrieval.profiles(items, "schema", F.col("said")).drop("said"), retrieval.profiles(docs, "schema", F.col("said"), F.array("lang")).drop("said", "lang")


@query("r2_lexical_ranked", f"WITH {LEX_SQL} SELECT task_id, case_id, round(score, 6) AS score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, case_id) AS place FROM scored WHERE score > 0 QUALIFY place <= 3")
def _(spark, d):
    return rounded(retrieval.lexical_ranked(*profiles(spark, d), k=3))


@query("r8_within_size", f"WITH {LEX_SQL} SELECT task_id, case_id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, case_id) AS place FROM scored WHERE score > 0 AND n_chars <= 1500 QUALIFY place <= 2")
def _(spark, d):
    return retrieval.lexical_ranked(*profiles(spark, d), k=2, largest=1500).select("task_id", "case_id", "place")


ROUTED_SQL = f"""{TASKS}, {LEX_SQL}, {CANDS_SQL.replace("owner % 100 = 0", "owner % 3 = 0 AND owner IN (SELECT item_id FROM benchmark)")}, wanted AS (SELECT item_id AS task_id FROM benchmark UNION ALL SELECT 100000),
sim AS (SELECT task_id, case_id, row_number() OVER (PARTITION BY task_id ORDER BY similarity DESC, case_id) AS place FROM (SELECT a.task_id, b.task_id AS case_id, round(list_dot_product(a.vec, b.vec), 9) AS similarity FROM tasks a JOIN tasks b USING (fingerprint) WHERE a.task_id IN (SELECT task_id FROM wanted) AND a.task_id <> b.task_id) WHERE similarity >= 0.35 QUALIFY place <= 2),
s AS (SELECT * FROM sim WHERE task_id IN (SELECT task_id FROM sim GROUP BY task_id HAVING count(*) >= 2)),
fld AS (SELECT query AS task_id, case_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, case_id) AS place FROM cands QUALIFY place <= 2),
lex AS (SELECT task_id, case_id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, case_id) AS place FROM scored WHERE score > 0 QUALIFY place <= 2)"""


@query("r7_routed", f"""WITH {ROUTED_SQL}, done AS (SELECT *, 'same_schema' AS route FROM s UNION ALL SELECT *, 'fields' FROM fld WHERE task_id NOT IN (SELECT task_id FROM s) UNION ALL SELECT *, 'lexical' FROM lex WHERE task_id NOT IN (SELECT task_id FROM s) AND task_id NOT IN (SELECT task_id FROM fld))
SELECT task_id, case_id, place, route FROM done UNION ALL SELECT task_id, NULL, NULL, 'retrieval_failed' FROM wanted WHERE task_id NOT IN (SELECT task_id FROM done)""")
def _(spark, d):
    """Each route serves some tasks: near enough cases of the schema, field vectors where a task has an index, words; one task finds nothing."""
    a, b = profiles(spark, d)
    wanted = a.select("task_id").unionByName(spark.range(100000, 100001).select(F.col("id").alias("task_id")))
    every = tasks(spark, d)[1]
    schema = retrieval.same_schema_ranked(every.withColumnRenamed("case_id", "task_id").join(wanted, "task_id", "left_semi"), every, threshold=0.35, k=2)
    rows = fields(spark, d)
    indexed = rows.where("owner % 3 = 0").join(wanted.select(F.col("task_id").alias("owner")), "owner", "left_semi")
    by_fields = retrieval.independent_top(retrieval.FieldSearch(indexed, rows)).withColumnRenamed("query", "task_id")
    return retrieval.routed(wanted, schema, by_fields, lambda left: retrieval.lexical_ranked(a.join(left, "task_id", "left_semi"), b, k=2))


@query("r1_profiles", f"WITH {TASK_PROFILE} SELECT id AS task_id, array_to_string(names, ',') AS names, array_to_string(list_sort(tags), ',') AS tags, 2::BIGINT AS n_fields, len(terms) AS n_terms, count(*) OVER (PARTITION BY fingerprint) AS n_same FROM tprofile")
def _(spark, d):
    rows = profiles(spark, d)[0]
    same = rows.groupBy("fingerprint").agg(F.count("*").alias("n_same"))
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return rows.join(same, "fingerprint").select("task_id", F.array_join("names", ",").alias("names"), F.array_join(F.array_sort("tags"), ",").alias("tags"), size("fields"), size("terms"), "n_same")


@query("r1_case_profiles", """SELECT doc_id AS case_id, 2 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_tags, array_to_string(list_sort(list_filter([CASE WHEN doc_id % 3 > 0 THEN 'shown' || (doc_id % 3) END, CASE WHEN doc_id % 2 = 0 THEN 'judged' END, lang], lambda x: x IS NOT NULL)), ',') AS own_tags, array_to_string(list_sort(['dose', 'told', 'kind' || (doc_id % 4), 'said']), ',') AS terms FROM documents""")
def _(spark, d):
    """Cases with a described schema, tagged field examples and a judge."""
    k = F.col("doc_id")
    schema = F.concat(F.lit('{"type":"object","description":"Told: kind'), (k % 4).cast("string"), F.lit('","properties":{"dose":{"type":"string"}}}'))
    shown = F.when(k % 3 > 0, F.array(F.concat(F.lit("shown"), (k % 3).cast("string"))))
    judge = F.when(k % 2 == 0, '{"fields":{"dose":{"tags":["judged"]}}}')
    rows = table(spark, d, "documents").select(k.alias("case_id"), schema.alias("schema"), F.array("lang").alias("own"), F.create_map(F.lit("dose"), F.struct(shown.alias("tags"))).alias("examples"), judge.alias("judge"))
    found = retrieval.profiles(rows.withColumn("every", retrieval.case_tags("own", "examples", "judge")), "schema", F.lit("said"), F.col("every"))
    of_case = F.array_join(F.array_sort("every"), ",")
    return found.select("case_id", F.size("tags").cast("int").alias("n_tags"), of_case.alias("own_tags"), F.array_join(F.array_sort("terms"), ",").alias("terms"))
