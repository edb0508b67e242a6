"""Queries over schemas, fields and whole records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records
from ..operators import metrics, schemas, scoring
from .registry import query
from .results import rounded, scores
from .standins import table
from .texts import BAG, GRAMS, NORM, PAIRS_SQL, WORDS, text_pairs

#: A part's schema depends on its size and type; so there are a few dozen schemas.
PART_SCHEMA = """concat('{"type":"object","required":["', if(p_size % 2 = 0, 'size","kind', 'kind","size'), '"],"properties":{"size":{"type":"integer","minimum":', p_size % 5, ',"description":"', p_partkey, '"},"kind":{"anyOf":[{"type":"string"},{"type":"null"}]},"brand":{"enum":["', p_type, '"]},"parts":{"type":"array","items":{"type":"object","properties":{"name":{"type":"string"}}}}}}')"""


def part_schemas(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", "p_type", F.expr(PART_SCHEMA).alias("schema")).withColumn("fingerprint", records.schema_fingerprint(F.col("schema")))


@query("p7_fingerprints", "SELECT p_size % 5 AS minimum, p_type, count(*) AS n, 1::BIGINT AS fingerprints FROM part GROUP BY ALL")
def _(spark, d):
    rows = part_schemas(spark, d)
    return rows.groupBy((F.col("p_size") % 5).alias("minimum"), "p_type").agg(F.count("*").alias("n"), F.countDistinct("fingerprint").alias("fingerprints"))


FIELD_ROWS = "f AS (SELECT * FROM (VALUES ('size', 0, true, 'numeric', false, true), ('kind', 0, true, 'string', true, true), ('brand', 0, false, 'enum', false, true), ('parts', 0, false, 'array[object]', false, true), ('parts[].name', 1, false, 'string', false, true)) t(path, depth, required, type_class, nullable, rigid))"


@query("p8_p13_schema_fields", f"WITH s AS (SELECT DISTINCT p_size % 5 AS m, p_type FROM part), {FIELD_ROWS} SELECT path, depth, required, type_class, nullable, rigid, count(*) AS n FROM s CROSS JOIN f GROUP BY ALL")
def _(spark, d):
    return records.schema_fields(part_schemas(spark, d), "fingerprint", "schema").groupBy("path", "depth", "required", "type_class", "nullable", "rigid").agg(F.count("*").alias("n"))


FIELD_TEXTS_SQL = """x AS (SELECT p_partkey, unnest([{'i': 0, 't': 'size (integer): ' || p_partkey}, {'i': 1, 't': 'kind (string|null)'}, {'i': 2, 't': 'brand (enum)'}, {'i': 3, 't': 'parts (array of object)'}]) AS f FROM part)"""


def part_fields(spark, d):
    """The top-level fields of every part's own schema."""
    own = part_schemas(spark, d).select(F.col("p_partkey").cast("string").alias("p_partkey"), "schema")
    rows = records.schema_fields(own, "p_partkey", "schema").where("depth = 0")
    return rows.withColumn("text", schemas.field_text(F.col("name"), F.col("type_text"), F.col("description")))


@query("p9_field_texts", f"WITH {FIELD_TEXTS_SQL} SELECT p_partkey::VARCHAR AS p_partkey, f.i::INT AS position, f.t AS text FROM x")
def _(spark, d):
    return part_fields(spark, d).select("p_partkey", "position", "text")


@query("p9_task_texts", f"WITH {FIELD_TEXTS_SQL} SELECT p_partkey::VARCHAR AS task_id, 'do it' || chr(10) || string_agg(f.t, chr(10) ORDER BY f.i) AS text FROM x GROUP BY p_partkey")
def _(spark, d):
    return schemas.task_text(part_fields(spark, d).withColumnRenamed("p_partkey", "task_id"), "task_id", F.lit("do it"))


TAGGED = " ".join(f"CASE WHEN list_has_any(w, {marks}) THEN '{tag}' END," for tag, marks in schemas.TAG_WORDS.items())


@query("p11_field_tags", f"""WITH r AS (SELECT p_partkey, ['fecha','year','verbatim','person','código','plain'][(p_partkey % 6) + 1] AS name, ['string','array','integer','boolean'][(p_size % 4) + 1] AS kind, p_size % 3 = 0 AS bounded, p_size % 5 = 0 AS nullable, p_size % 7 = 0 AS has_enum, ['string','object','enum'][(p_size // 4) % 3 + 1] AS item FROM part), x AS (SELECT *, [name, 'word'] AS w FROM r),
t AS (SELECT p_partkey, [{TAGGED} CASE WHEN nullable THEN 'grounded_null' END, CASE WHEN nullable THEN 'nullable' END, CASE WHEN has_enum THEN 'enum_classification' END, CASE WHEN kind = 'integer' THEN 'numeric_normalization' END, CASE WHEN kind = 'boolean' THEN 'boolean_inference' END, CASE WHEN kind = 'boolean' AND nullable THEN 'nullable_boolean' END, CASE WHEN kind = 'string' THEN 'direct_string' END, CASE WHEN bounded THEN 'bounded_score' END,
CASE WHEN kind = 'array' AND item <> 'object' THEN 'simple_array' END, CASE WHEN kind = 'array' AND item = 'enum' THEN 'enum_array' END, CASE WHEN kind = 'array' AND item = 'object' THEN 'complex_object_array' END, CASE WHEN kind = 'array' AND item = 'object' THEN 'nested_numeric_object_array' END, CASE WHEN kind = 'array' AND name = 'person' THEN 'entity_array' END] AS tags FROM x),
u AS (SELECT p_partkey, list_sort(list_filter(tags, lambda v: v IS NOT NULL)) AS tags FROM t) SELECT p_partkey, array_to_string(tags, ',') AS tags, list_has_any(tags, ['entity_array', 'enum_classification', 'complex_object_array']) AS direct FROM u""")
def _(spark, d):
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    z = F.col("p_size")
    item = pick(("string", "object", "enum"), F.floor(z / 4) % 3)
    tags = schemas.field_tags(
        name=pick(("fecha", "year", "verbatim", "person", "código", "plain"), F.col("p_partkey") % 6), description=F.lit("a word"), json_type=pick(("string", "array", "integer", "boolean"), z % 4), nullable=z % 5 == 0,
        enum=F.when(z % 7 == 0, F.array(F.lit("x"))), minimum=F.when(z % 3 == 0, 1.0), maximum=F.lit(None).cast("double"), item_type=item, item_enum=item == "enum", item_numbers=F.lit(True),
    )
    rows = table(spark, d, "part").select("p_partkey", tags.alias("t"))
    return rows.select("p_partkey", F.array_join("t", ",").alias("tags"), schemas.is_direct(F.col("t")).alias("direct"))


@query("p12_a3_coarse_types", f"""WITH l AS (SELECT o_orderkey AS task_id, 'm' || (o_orderkey % 2) AS run, ['count','when','tags','other','kind'][(o_orderkey % 5) + 1] AS path, 1 AS gold_keys, (o_orderkey % 3 > 0)::INT AS system_keys, (o_orderkey % 3 = 1)::INT::DOUBLE AS tps FROM orders),
c AS (SELECT *, CASE path WHEN 'count' THEN 'numeric' WHEN 'when' THEN 'temporal_string' WHEN 'tags' THEN 'array[string]' WHEN 'kind' THEN 'string' ELSE 'unknown_extra' END AS coarse_type FROM l)
SELECT *, {scores()} FROM (SELECT run, coarse_type, sum(tps) AS tps, sum(gold_keys)::BIGINT AS gold_keys, sum(system_keys)::BIGINT AS system_keys, count(*) AS n_tasks, count(DISTINCT CASE WHEN gold_keys > 0 THEN task_id END) AS gold_tasks, count(DISTINCT CASE WHEN system_keys > 0 THEN task_id END) AS system_tasks FROM c GROUP BY ALL)""")
def _(spark, d):
    k = F.col("o_orderkey")
    path = F.get(F.array(*map(F.lit, ("count", "when", "tags", "other", "kind"))), (k % 5).cast("int"))
    leaves = table(spark, d, "orders").select(k.alias("task_id"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("run"), path.alias("path"), F.lit(1).alias("gold_keys"), (k % 3 > 0).cast("int").alias("system_keys"), (k % 3 == 1).cast("double").alias("tps"))
    rules = [("count", "integer", None, None), ("when", "string", "date", None), ("tags", "array", None, "string"), ("kind", "string", None, None)]
    fields = leaves.select("path").distinct().select("path", *[F.create_map(*[F.lit(x) for r in rules for x in (r[0], r[i])])[F.col("path")].alias(n) for i, n in ((1, "json_type"), (2, "format"), (3, "item_type"))]).where("json_type is not null")
    typed = schemas.coarse_types(leaves, fields, [])
    side = lambda c: F.countDistinct(F.when(F.col(c) > 0, F.col("task_id"))).alias(c.replace("keys", "tasks"))
    return rounded(metrics.micro_metrics(typed, ["run", "coarse_type"], side("gold_keys"), side("system_keys")))


@query("p16_unwrapped", "SELECT o_orderkey AS task_id, o_orderstatus AS status, 'because ' || o_orderpriority AS reason FROM orders")
def _(spark, d):
    wrapped = F.to_json(F.struct(F.struct(F.concat(F.lit("because "), "o_orderpriority").alias("reasoning"), F.col("o_orderstatus").alias("value")).alias("status")))
    values, reasons = schemas.unwrapped(F.col("output"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), wrapped.alias("output"))
    return rows.select("task_id", values["status"].alias("status"), reasons["status"].alias("reason"))


@query("p17_kept_fields", "SELECT p_brand AS owner, p_name || '_' || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position FROM part WHERE p_size > 25")
def _(spark, d):
    fields = table(spark, d, "part").select(F.col("p_brand").alias("owner"), F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("position"), "p_size")
    return schemas.kept_fields(fields, fields.where("p_size > 25"), ["owner"]).select("owner", "name", "position")


@query("p16_deep_unwrapped", """SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 5 > 0 THEN '{"items":["' || o_orderstatus || '"],"status":"' || o_orderstatus || '"}' END AS output, CASE WHEN o_orderkey % 5 > 0 THEN 'because ' || o_orderpriority END AS reason, CASE WHEN o_orderkey % 5 > 0 THEN 'seen' END AS inner_reason, CASE WHEN o_orderkey % 5 = 0 THEN 'missing field: status' END AS error FROM orders""")
def _(spark, d):
    """Wrappers at all depths go, with what they reasoned by path; a record without a due field is an error row."""
    status, k = F.col("o_orderstatus"), F.col("o_orderkey")
    wrapped = lambda reason, value: F.struct(reason.alias("reasoning"), value.alias("value"))
    record = F.struct(F.when(k % 5 > 0, wrapped(F.concat(F.lit("because "), "o_orderpriority"), status)).alias("status"), F.array(wrapped(F.lit("seen"), status)).alias("items"))
    rows = table(spark, d, "orders").select(k.alias("task_id"), F.to_json(record).alias("output"))
    out = rows.select("task_id", schemas.unwrapped_records(F.col("output"), F.array(F.lit("status")), deep=True).alias("u"))
    return out.select("task_id", "u.output", F.col("u.reasonings")["status"].alias("reason"), F.col("u.reasonings")["items[0]"].alias("inner_reason"), "u.error")


@query("p16_selective_unwrapped", """SELECT o_orderkey AS task_id, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS output, 1 AS n_reasons FROM orders""")
def _(spark, d):
    """Only the fields that aren't answered directly carry a reasoning."""
    reasoned = F.struct(F.lit("so").alias("reasoning"), F.col("o_orderstatus").alias("value"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.to_json(F.struct(F.col("o_orderkey").alias("key"), reasoned.alias("status"))).alias("output"))
    out = rows.select("task_id", schemas.unwrapped_records(F.col("output"), F.array(F.lit("status"))).alias("u"))
    return out.select("task_id", "u.output", F.size("u.reasonings").alias("n_reasons"))


@query("p17_kept_cases", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'kind,size' ELSE 'size' END AS examples, CASE WHEN p_size % 2 = 0 THEN 'size,kind' ELSE 'size' END AS properties, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n_required FROM part""")
def _(spark, d):
    """The case side: examples and the reduced schema of the named fields."""
    names = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("size"), F.lit("kind"))).otherwise(F.array(F.lit("size"), F.lit("unknown")))
    examples = F.create_map(*[F.lit(x) for n in ("size", "kind", "brand") for x in (n, "value")])
    rows = part_schemas(spark, d).select("p_partkey", schemas.kept_schema(F.col("schema"), names).alias("schema"), schemas.kept_examples(examples, names).alias("examples"))
    return rows.select("p_partkey", F.array_join(F.array_sort(F.map_keys("examples")), ",").alias("examples"), F.array_join(F.json_object_keys(F.get_json_object("schema", "$.properties")), ",").alias("properties"), F.json_array_length(F.get_json_object("schema", "$.required")).alias("n_required"))


@query("p20_validation", """WITH f AS (SELECT event_id AS task_id, event_type AS kind, CASE WHEN event_id % 3 > 0 THEN upper(event_type[1:3]) END AS code, CASE WHEN event_id % 5 > 0 THEN props ELSE 'elsewhere' END AS quote, event_id % 7 = 0 AS flat FROM events)
SELECT task_id, 'code' AS path, 'required' AS error FROM f WHERE code IS NULL UNION ALL SELECT task_id, 'kind', 'enum' FROM f WHERE kind NOT IN ('click', 'view') UNION ALL SELECT task_id, 'code', 'pattern' FROM f WHERE code IS NOT NULL AND NOT regexp_matches(code, '^[A-P]+$')
UNION ALL SELECT task_id, 'kind', 'too long' FROM f WHERE length(kind) > 6 UNION ALL SELECT task_id, 'kind', 'too short' FROM f WHERE length(kind) < 5 UNION ALL SELECT task_id, 'quote', 'not in text' FROM f WHERE quote = 'elsewhere'
UNION ALL SELECT task_id, 'tags', 'shape' FROM f WHERE flat UNION ALL SELECT task_id, 'tags[1]', 'enum' FROM f WHERE NOT flat AND kind <> 'click' UNION ALL SELECT task_id, 'tags[1]', 'not in text' FROM f WHERE NOT flat AND quote = 'elsewhere' UNION ALL SELECT task_id, 'state.level', 'required' FROM f WHERE flat""")
def _(spark, d):
    k, kind = F.col("event_id"), F.col("event_type")
    quote = F.when(k % 5 > 0, F.col("props")).otherwise("elsewhere")
    flat = k % 7 == 0
    text_ = F.concat_ws(" ", F.lit("Said: "), F.upper("props"), F.upper(kind), F.lit(" fine"), F.when(k % 5 > 0, F.lit("none-click")))
    second = F.when(kind == "click", F.when(k % 5 > 0, "none-click").otherwise("none-click-else")).otherwise(F.when(k % 5 > 0, F.upper(kind)).otherwise("none-at-all"))
    leaf = lambda path, value, of: F.struct(F.lit(path).alias("path"), value.alias("value"), F.lit(of).alias("kind"))
    tags = F.when(flat, leaf("tags", F.lit("7"), "integer")).otherwise(leaf("tags[0]", F.lit("fine"), "string"))
    code = F.when(k % 3 > 0, F.upper(F.substring("event_type", 1, 3)))
    found = F.array(leaf("kind", kind, "string"), leaf("code", code, "string"), leaf("quote", quote, "string"), tags, F.when(~flat, leaf("tags[1]", second, "string")), F.when(~flat, leaf("state.level", F.lit("3"), "integer")))
    rows = table(spark, d, "events").select(k.alias("task_id"), text_.alias("text"), found.alias("l"))
    leaves = rows.select("task_id", F.explode(F.array_compact("l")).alias("x")).select("task_id", "x.*")
    spec = [("kind", True, "string", ["click", "view"], None, 5, 6), ("code", True, "string", None, "^[A-P]+$", None, None), ("quote", False, "string", None, None, None, None), ("tags", True, "array", None, None, None, None), ("tags[]", True, "string", ["fine", "none-click", "none-click-else"], None, None, None), ("state", False, "object", None, None, None, None), ("state.level", True, "integer", None, None, None, None)]
    fields = spark.createDataFrame(spec, "path string, required boolean, kind string, enum array<string>, pattern string, least_length int, most_length int")
    return schemas.validation_errors(leaves, fields, rows.select("task_id", "text"), rows)


@query("v3_semantic_fallback", f"WITH {PAIRS_SQL}, w AS (SELECT doc_id, list_distinct({WORDS.format('a')}) AS x, list_distinct({WORDS.format('b')}) AS y FROM pairs) SELECT doc_id, round(len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS similarity FROM w")
def _(spark, d):
    return rounded(schemas.pair_similarity(text_pairs(spark, d), "a", "b").select("doc_id", "similarity"))


LETTERS = "aeiou"
LETTER_SQL = "[" + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{x}', '')))::DOUBLE" for x in LETTERS) + "]"


def letter_vectors(texts):
    """A small embedding that SQL can follow: how often five letters occur."""
    import numpy as np

    return np.array([[float((t or "").count(x)) for x in LETTERS] for t in texts])


@query("v3_embedded", f"WITH {PAIRS_SQL}, v AS (SELECT doc_id, {LETTER_SQL.format('a')} AS x, {LETTER_SQL.format('b')} AS y FROM pairs) SELECT doc_id, round(CASE WHEN list_dot_product(x, x) * list_dot_product(y, y) > 0 THEN list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) ELSE 0 END, 6) AS similarity FROM v")
def _(spark, d):
    return rounded(schemas.pair_similarity(text_pairs(spark, d), "a", "b", embed=letter_vectors).select("doc_id", "similarity"))


@query("v9_hybrid", f"""WITH {PAIRS_SQL}, v AS (SELECT doc_id, {LETTER_SQL.format('a')} AS x, {LETTER_SQL.format('b')} AS y FROM pairs), c AS (SELECT doc_id, CASE WHEN list_dot_product(x, x) * list_dot_product(y, y) > 0 THEN list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) ELSE 0 END AS cosine FROM v),
n AS (SELECT doc_id, {NORM.format('a')} AS a, {NORM.format('b')} AS b FROM pairs), {BAG.format(n=1, a=WORDS.format('a'), b=WORDS.format('b'))}, {BAG.format(n=2, a=GRAMS.format('a'), b=GRAMS.format('b'))}
SELECT doc_id, round(0.6::DOUBLE * cosine + 0.4::DOUBLE * CASE WHEN a = b THEN 1 ELSE 0.45::DOUBLE * 2 * coalesce(bag1.shared, 0) / (len({WORDS.format('a')}) + len({WORDS.format('b')})) + 0.4::DOUBLE * 2 * coalesce(bag2.shared, 0) / (len({GRAMS.format('a')}) + len({GRAMS.format('b')})) END, 5) AS hybrid FROM n JOIN c USING (doc_id) LEFT JOIN bag1 USING (doc_id) LEFT JOIN bag2 USING (doc_id)""")
def _(spark, d):
    found = schemas.hybrid_similarity(text_pairs(spark, d), "a", "b", embed=letter_vectors)
    return found.select("doc_id", F.round("hybrid", 5).alias("hybrid"))


@query("v3_v9_u1_hybrid")
def _(spark, d):
    return rounded(schemas.hybrid_similarity(text_pairs(spark, d), "a", "b").select("doc_id", "similarity", "hybrid"))


@query("v5_list_scores", """WITH l AS (SELECT user_id, list(DISTINCT event_type) FILTER (event_id % 2 = 0) AS g, list(DISTINCT event_type) FILTER (event_id % 3 = 0) AS s FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN g IS NULL OR s IS NULL THEN (g IS NULL AND s IS NULL)::INT ELSE len(list_intersect(g, s))::DOUBLE / (len(g) + len(s) - len(list_intersect(g, s))) END, 6) AS score FROM l""")
def _(spark, d):
    side = lambda n: F.to_json(F.array_sort(F.collect_set(F.when(F.col("event_id") % n == 0, F.col("event_type")))))
    return rounded(table(spark, d, "events").groupBy("user_id").agg(side(2).alias("g"), side(3).alias("s")).select("user_id", scoring.list_scores(F.col("g"), F.col("s")).alias("score")))


WORD_SHARE = "len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"
ITEM_SQL = f"""w AS (SELECT o_orderkey AS task_id, list_distinct(regexp_extract_all(lower('order ' || o_orderpriority), '[a-z0-9]+')) AS g, list_distinct(regexp_extract_all(lower(CASE WHEN o_orderkey % 3 = 0 THEN 'order of long ago' ELSE 'order ' || o_orderpriority END), '[a-z0-9]+')) AS s, o_orderkey % 4 > 0 AS same FROM orders),
i AS (SELECT task_id, same, ({WORD_SHARE.format('g', 's')} + same::INT) / 2 AS item FROM w)"""


def item_records(spark, d):
    """Records with a list of one object: a free text and a label of an enum."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    name = F.concat(F.lit("order "), "o_orderpriority")
    item = lambda text_, label: F.array(F.struct(text_.alias("text"), label.alias("label")))
    gold, found = item(name, status), item(F.when(k % 3 == 0, "order of long ago").otherwise(name), F.when(k % 4 == 0, "Z").otherwise(status))
    rows = table(spark, d, "orders").select(k.alias("task_id"), gold.alias("g"), found.alias("s"), name.alias("note"), F.when(k % 3 == 0, "order of long ago").otherwise(name).alias("other"))
    return rows


ITEM_SCHEMA = '{"type":"object","properties":{"text":{"type":"string"},"label":{"enum":["F","O","P","Z"]}}}'


@query("v5_object_items", f"WITH {ITEM_SQL} SELECT task_id, round(item / (2 - item), 6) AS score FROM i")
def _(spark, d):
    """Items score by their own schema: a free text in part, a label by equality."""
    return rounded(item_records(spark, d).select("task_id", scoring.list_scores(F.to_json("g"), F.to_json("s"), ITEM_SCHEMA).alias("score")))


@query("v6_v7_partial_scores", f"WITH {ITEM_SQL}, x AS (SELECT task_id, item / (2 - item) AS list, 2 * item - same::INT AS note FROM i) SELECT task_id, round(list + note, 6) AS tps, round(list, 6) AS items_tps, round(note, 6) AS note_tps FROM x")
def _(spark, d):
    """Partial credit in lists of objects under a referenced item schema, and in a free text."""
    schema = '{"type":"object","properties":{"items":{"type":"array","items":{"$ref":"#/$defs/Item"}},"note":{"type":"string"}},"$defs":{"Item":' + ITEM_SCHEMA + "}}"
    record = lambda items, note: F.to_json(F.struct(F.col(items).alias("items"), F.col(note).alias("note")))
    rows = item_records(spark, d).select("task_id", record("g", "note").alias("gold"), record("s", "other").alias("system"), F.lit(schema).alias("schema"))
    scored = schemas.instance_scores(rows, "gold", "system", "schema")
    own = lambda name: F.filter("by_field", lambda f: f["field"] == name)[0]["tps"].alias(f"{name}_tps")
    return rounded(scored.select("task_id", "tps", own("items"), own("note")))


INSTANCE_SQL = """i AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 + (o_orderkey % 3 > 0)::INT + (o_orderkey % 2)::DOUBLE END AS tps, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 3 + (o_orderkey % 7 = 0)::INT END AS system_keys FROM orders)"""


def instances(spark, d):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    gold = F.struct(k.alias("key"), F.struct(status.alias("status")).alias("state"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    other = F.struct(k.alias("key"), F.struct(F.when(k % 3 == 0, "Z").otherwise(status).alias("status")).alias("state"), F.when(k % 2 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.when(k % 7 == 0, 1).alias("extra"))
    rows = table(spark, d, "orders").select(k.alias("task_id"), F.to_json(gold).alias("gold"), F.when(k % 9 == 0, "broken {").otherwise(F.to_json(other)).alias("system"))
    schema = '{"type":"object","properties":{"key":{"type":"integer"},"state":{"type":"object","properties":{"status":{"type":"string"}}},"tags":{"type":"array","items":{"type":"string"}}}}'
    return schemas.instance_scores(rows.withColumn("schema", F.lit(schema)), "gold", "system", "schema")


@query("v6_instance_scores", f"WITH {INSTANCE_SQL} SELECT task_id, tps::DOUBLE AS tps, 3 AS gold_keys, system_keys FROM i")
def _(spark, d):
    return instances(spark, d).select("task_id", "tps", "gold_keys", "system_keys")


@query("v7_field_scores", """SELECT o_orderkey AS task_id, 'tags' AS field, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_orderkey % 2 END::DOUBLE AS tps, 1 AS gold_keys, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END AS system_keys FROM orders""")
def _(spark, d):
    return instances(spark, d).select("task_id", F.explode("by_field").alias("f")).select("task_id", "f.*").where("field = 'tags'")


@query("p4_repaired", "SELECT event_id, 'é ' || event_type AS text FROM events")
def _(spark, d):
    raw = F.to_json(F.struct(F.concat(F.lit("\\u00e9 "), "event_type").alias("t")))
    return table(spark, d, "events").select("event_id", F.get_json_object(records.repair_strings(raw), "$.t").alias("text"))
