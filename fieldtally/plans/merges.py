"""Queries over repeated outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.sizes import small
from ..operators import consensus
from .registry import query
from .standins import table

TRIALS_SQL = """trials AS (SELECT conv_id AS task_id, turn AS trial, role AS grp, CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL WHEN (conv_id + turn) % 7 = 0 THEN '{"error":"x"}' ELSE '{"n":' || length(text) || '}' END AS output, (conv_id * turn) % 4 = 3 AS broken FROM conversations)"""


def trials(spark, d):
    k = F.col("conv_id") + F.col("turn")
    output = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, '{"error":"x"}').otherwise(F.concat(F.lit('{"n":'), F.length("text"), F.lit("}")))
    errors = F.when(F.col("conv_id") * F.col("turn") % 4 == 3, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("trial"), F.col("role").alias("group"), output.alias("output"), errors.alias("errors"))


@query("c1_first_valid", f"""WITH {TRIALS_SQL}, v AS (SELECT * FROM trials WHERE output IS NOT NULL AND NOT broken AND NOT contains(output, 'error')), b AS (SELECT task_id, arg_min(output, trial) AS output, min(trial) AS trial, count(*) AS n_valid FROM v GROUP BY task_id)
SELECT t.task_id, output, trial, coalesce(n_valid, 0) AS n_valid, CASE WHEN trial IS NULL THEN 'no valid trial' END AS error FROM (SELECT DISTINCT task_id FROM trials) t LEFT JOIN b USING (task_id)""")
def _(spark, d):
    rows = trials(spark, d)
    return consensus.first_valid(rows, rows)


VALUES_SQL = """vals AS (SELECT user_id AS task_id, 'f' || (event_id % 3) AS field, event_id % 6 AS trial, event_id // 6 AS item, CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '"' || event_type || '"' END AS value FROM events),
sup AS (SELECT task_id, field, value, count(DISTINCT trial) AS support, min([trial, item]) AS first FROM vals GROUP BY ALL),
vote AS (SELECT task_id, field, value, support FROM sup WHERE value <> 'null' QUALIFY row_number() OVER (PARTITION BY task_id, field ORDER BY support DESC, first, value) = 1)"""


def values(spark, d):
    e = F.col("event_id")
    value = F.when(e % 4 == 0, "null").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    return table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.concat(F.lit("f"), (e % 3).cast("string")).alias("field"), (e % 6).alias("trial"), F.floor(e / 6).alias("item"), value.alias("value"))


@query("c2_exact_vote", f"WITH {VALUES_SQL} SELECT * FROM vote")
def _(spark, d):
    return consensus.exact_vote(values(spark, d))


@query("c3_null_vote", f"""WITH {VALUES_SQL}, nulls AS (SELECT task_id, field, count(DISTINCT CASE WHEN value = 'null' THEN trial END) AS nulls FROM vals GROUP BY ALL)
SELECT task_id, field, CASE WHEN value IS NULL AND field = 'f2' THEN '""' WHEN (field <> 'f2' AND nulls > coalesce(support, 0)) OR value IS NULL THEN 'null' ELSE value END AS value, nulls, coalesce(support, 0) AS support FROM nulls LEFT JOIN vote USING (task_id, field)""")
def _(spark, d):
    rows = values(spark, d)
    fields = rows.select("field").distinct().select("field", (F.col("field") != "f2").alias("nullable"), F.lit('""').alias("empty_json"))
    return consensus.null_vote(rows, fields)


@query("c8_support_floors", f"""WITH {VALUES_SQL}, n AS (SELECT task_id, field, count(DISTINCT trial) AS n FROM vals GROUP BY ALL),
fl AS (SELECT task_id, field, unnest(list_distinct([2, ceil(n * 0.4::DOUBLE)::INT, ceil(n * 0.5::DOUBLE)::INT, ceil(n * 0.6::DOUBLE)::INT])) AS floor FROM n),
arr AS (SELECT task_id, field, floor, string_agg(value, ';' ORDER BY support DESC, first, value) AS items FROM sup JOIN fl USING (task_id, field) WHERE support >= floor GROUP BY ALL) SELECT task_id, field, items, min(floor) AS floor FROM arr GROUP BY ALL""")
def _(spark, d):
    return consensus.support_floors(values(spark, d)).withColumn("items", F.array_join("items", ";"))


@query("c13_field_scope", f"""WITH {VALUES_SQL}, tasks AS (SELECT t.task_id, f.field, n_trials, f.field <> 'f2' AS required FROM (SELECT task_id, count(DISTINCT trial) AS n_trials FROM vals GROUP BY ALL) t CROSS JOIN (SELECT DISTINCT field FROM vals) f),
per AS (SELECT task_id, field, trial, string_agg(value, chr(1) ORDER BY value) AS key FROM vals WHERE value <> 'null' GROUP BY ALL), seen AS (SELECT task_id, field, count(*) AS n, count(DISTINCT key) AS n_keys FROM per GROUP BY ALL)
SELECT task_id, field, CASE WHEN n IS NULL AND NOT required THEN 'skipped' WHEN n = n_trials AND n_keys = 1 THEN 'stable' ELSE 'disputed' END AS scope FROM tasks LEFT JOIN seen USING (task_id, field)""")
def _(spark, d):
    rows = values(spark, d)
    names = rows.select("field").distinct()
    tasks = rows.groupBy("task_id").agg(F.countDistinct("trial").alias("n_trials")).crossJoin(small(names)).withColumn("required", F.col("field") != "f2")
    return consensus.field_scope(rows.where("value <> 'null'"), tasks)


@query("c14_vote_table", f"""WITH {VALUES_SQL}, d AS (SELECT DISTINCT task_id, field, value, trial FROM vals), g AS (SELECT task_id, field, value, 'g' || (trial % 2) AS grp, count(*) AS n FROM d GROUP BY ALL)
SELECT task_id, field, value, sum(n)::BIGINT AS count, (SELECT string_agg(trial::VARCHAR, ',' ORDER BY trial) FROM d WHERE d.task_id = g.task_id AND d.field = g.field AND d.value = g.value) AS trials, string_agg(grp || '=' || n, ',' ORDER BY grp) AS groups FROM g GROUP BY task_id, field, value""")
def _(spark, d):
    rows = values(spark, d)
    groups = rows.select("task_id", "trial").distinct().withColumn("group", F.concat(F.lit("g"), (F.col("trial") % 2).cast("string")))
    return consensus.vote_table(rows, groups)


SPELLED_SQL = """spelled AS (SELECT user_id AS task_id, 'f' AS field, event_id % 6 AS trial, event_id // 6 AS item, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN upper(event_type) ELSE replace(event_type, 'i', 'í') || ' ' END AS value FROM events),
cand AS (SELECT task_id, field, value, count, row_number() OVER (PARTITION BY task_id, field ORDER BY count DESC, first, value) AS place FROM (SELECT task_id, field, trim(lower(strip_accents(value))) AS key, count(DISTINCT trial) AS count, arg_min(value, [trial, item]) AS value, min([trial, item]) AS first FROM spelled GROUP BY ALL))"""


def spelled(spark, d):
    e = F.col("event_id")
    value = F.when(e % 3 == 0, F.col("event_type")).when(e % 3 == 1, F.upper("event_type")).otherwise(F.concat(F.replace("event_type", F.lit("i"), F.lit("í")), F.lit(" ")))
    return table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.lit("f").alias("field"), (e % 6).alias("trial"), F.floor(e / 6).alias("item"), value.alias("value"))


@query("c15_merged_candidates", f"WITH {SPELLED_SQL} SELECT * FROM cand")
def _(spark, d):
    return consensus.merged_candidates(spelled(spark, d), text.normalized(F.col("value")))


@query("c16_reconstructed", f"""WITH {SPELLED_SQL}, verdicts AS (SELECT task_id, field, place + (task_id % 10 = 3)::INT AS place, CASE WHEN task_id % 7 = 0 THEN 'other' ELSE value END AS value, CASE WHEN task_id % 5 > 0 THEN place % 2 = 1 END AS include FROM cand)
SELECT task_id, field, place, CASE WHEN include AND c.value = v.value THEN c.value END AS value, CASE WHEN c.value IS NULL THEN 'unknown candidate' WHEN v.value IS NULL THEN 'missing' WHEN include IS NULL THEN 'not boolean' WHEN c.value <> v.value THEN 'value mismatch' END AS issue FROM cand c FULL OUTER JOIN verdicts v USING (task_id, field, place)""")
def _(spark, d):
    cands = consensus.merged_candidates(spelled(spark, d), text.normalized(F.col("value")))
    t = F.col("task_id")
    verdicts = cands.select("task_id", "field", (F.col("place") + (t % 10 == 3).cast("int")).alias("place"), F.when(t % 7 == 0, "other").otherwise(F.col("value")).alias("value"), F.when(t % 5 > 0, F.col("place") % 2 == 1).alias("include"))
    return consensus.reconstructed(cands, verdicts)


@query("c17_merged_judgement", f"WITH {VALUES_SQL}, j AS (SELECT task_id, field, '\"judged\"' AS value FROM vote WHERE task_id % 3 = 0) SELECT task_id, field, coalesce(j.value, v.value) AS value, CASE WHEN j.value IS NOT NULL THEN 'judge' ELSE 'stable' END AS source FROM (SELECT * FROM vote WHERE field <> 'f1') v FULL OUTER JOIN j USING (task_id, field)")
def _(spark, d):
    vote = consensus.exact_vote(values(spark, d))
    return consensus.merged_judgement(vote.where("field <> 'f1'"), vote.where("task_id % 3 = 0").withColumn("value", F.lit('"judged"')))


IDENTITY_SQL = f"""f AS (SELECT p_brand AS owner, p_type || '_' || p_partkey AS name, p_name AS description, CASE p_partkey % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'integer' ELSE 'string' END AS json_type, p_partkey % 3 = 0 AS required, p_partkey % 5 AS enum_size FROM (SELECT * REPLACE (CASE WHEN p_partkey % 7 = 0 THEN 'Mention' WHEN p_partkey % 7 = 1 THEN 'label' ELSE p_type END AS p_type, CASE WHEN p_partkey % 11 = 0 THEN 'as the source has it' ELSE '' END AS p_name) FROM part)),
s AS (SELECT *, (CASE WHEN required THEN 3 ELSE 0 END + CASE WHEN json_type = 'string' AND enum_size = 0 THEN 4 ELSE 0 END + CASE WHEN regexp_matches(lower(name), '{'|'.join(consensus.IDENTITY_NAMES)}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(description), '{'|'.join(consensus.IDENTITY_DESCRIPTIONS)}') THEN 2 ELSE 0 END
- CASE WHEN enum_size > 0 OR json_type = 'integer' THEN 4 ELSE 0 END - CASE WHEN regexp_matches(lower(name), '{'|'.join(consensus.ATTRIBUTE_NAMES)}') THEN 3 ELSE 0 END) AS score FROM f),
r AS (SELECT *, row_number() OVER w AS place, score - coalesce(lead(score) OVER w, 0) AS margin FROM s WINDOW w AS (PARTITION BY owner ORDER BY score DESC, name))"""


@query("c6_identity_fields", f"WITH {IDENTITY_SQL} SELECT owner, CASE WHEN score >= 8 THEN name END AS name, score, margin, CASE WHEN score < 8 THEN 'none' WHEN margin >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE place = 1")
def _(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "array").when(k % 4 == 1, "integer").otherwise("string")
    name = F.concat_ws("_", F.when(k % 7 == 0, "Mention").when(k % 7 == 1, "label").otherwise(F.col("p_type")), k.cast("string"))
    told = F.when(k % 11 == 0, "as the source has it").otherwise("")
    return consensus.identity_scores(table(spark, d, "part").select(F.col("p_brand").alias("owner"), name.alias("name"), told.alias("description"), kind.alias("json_type"), (k % 3 == 0).alias("required"), (k % 5).alias("enum_size")))


def turn_values(spark, d):
    """Turns as trials: a whole turn as a string field, all its sentences as items of an array."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("trial"), "text")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    head = rows.select("task_id", F.lit("head").alias("field"), "trial", F.lit(0).alias("item"), quoted(F.col("text")).alias("value"), F.lit(False).alias("is_array"))
    items = rows.select("task_id", F.lit("parts").alias("field"), "trial", F.posexplode(F.split("text", r"\. ")).alias("item", "v"))
    return head.unionByName(items.select("task_id", "field", "trial", "item", quoted(F.col("v")).alias("value"), F.lit(True).alias("is_array")))


@query("c4_c5_c7_c9_c10_clustered")
def _(spark, d):
    return consensus.clustered_consensus(turn_values(spark, d))


@query("c4_medoids", """WITH t AS (SELECT conv_id AS task_id, turn AS trial, upper(role) || repeat('!', turn % 2) AS value FROM conversations), n AS (SELECT DISTINCT task_id, trial, value FROM t)
SELECT task_id, 'head' AS field, '"' || value || '"' AS value, support, n_rows FROM (SELECT task_id, value, count(DISTINCT trial) AS support, min(trial) AS first, sum(count(*)) OVER (PARTITION BY task_id)::BIGINT AS n_rows FROM t GROUP BY task_id, value) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY support DESC, first, value) = 1""")
def _(spark, d):
    """Clusters of texts that are far from each other, so that each holds equal texts: the vote of SQL."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.lit("head").alias("field"), F.col("turn").alias("trial"), F.lit(0).alias("item"), F.concat(F.lit('"'), F.upper("role"), F.repeat(F.lit("!"), F.col("turn") % 2), F.lit('"')).alias("value"), F.lit(False).alias("is_array"))
    exact = consensus.Options(scalar_threshold=1.0, texts=lambda a, b: float(a == b))
    return consensus.clustered_consensus(rows, exact).withColumn("support", F.col("support").cast("long"))


@query("u3_other_similarity", f"WITH {VALUES_SQL} SELECT task_id, field, value, support FROM vote")
def _(spark, d):
    """Another similarity of texts in the consensus' options: equality, which makes it the exact vote."""
    exact = consensus.Options(scalar_threshold=1.0, texts=lambda a, b: float(a == b))
    found = consensus.clustered_consensus(values(spark, d).withColumn("is_array", F.lit(False)), exact)
    return found.select("task_id", "field", "value", F.col("support").cast("long").alias("support"))


#: A record of a turn: its role, its size, its text and the sentences of it.
RECORD_SCHEMA = """{"type":"object","required":["role"],"properties":{"role":{"enum":["user","assistant","system"]},"size":{"anyOf":[{"type":"integer"},{"type":"null"}]},"head":{"type":"string"},
"parts":{"type":"array","items":{"type":"object","required":["text"],"properties":{"text":{"type":"string"},"length":{"type":"integer"}}}},"shape":{"type":"object","properties":{"turn":{"type":"integer"}}}}}"""


def record_trials(spark, d, *fields):
    k, t = F.col("conv_id"), F.col("turn")
    size = F.when((k + t) % 3 > 0, F.length("text") % 4)
    part = F.transform(F.split("text", r"\. "), lambda x: F.struct(x.alias("text"), F.length(x).alias("length")))
    every = {"role": F.col("role"), "size": size, "head": F.col("text"), "parts": part, "shape": F.struct((t % 2).alias("turn"))}
    record = F.to_json(F.struct(*[every[f].alias(f) for f in fields]), {"ignoreNullFields": "false"})
    return table(spark, d, "conversations").select(k.alias("task_id"), t.alias("trial"), record.alias("output"), F.array().cast("array<string>").alias("errors"))


@query("c12_consensus_records")
def _(spark, d):
    return consensus.record_consensus(record_trials(spark, d, "role", "size", "head", "parts", "shape"), RECORD_SCHEMA)


@query("c11_c12_exact_records", """WITH t AS (SELECT conv_id AS task_id, turn AS trial, role, CASE WHEN (conv_id + turn) % 3 > 0 THEN length(text) % 4 END AS size, turn % 2 AS turn FROM conversations),
r AS (SELECT task_id, role FROM (SELECT task_id, role, count(DISTINCT trial) AS n, min(trial) AS first FROM t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC, first) = 1),
z AS (SELECT task_id, size, n FROM (SELECT task_id, size, count(DISTINCT trial) AS n, min(trial) AS first FROM t WHERE size IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC, first) = 1),
u AS (SELECT task_id, turn FROM (SELECT task_id, turn, count(DISTINCT trial) AS n, min(trial) AS first FROM t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC, first) = 1),
n AS (SELECT task_id, count(DISTINCT trial) AS n_trials, count(DISTINCT CASE WHEN size IS NULL THEN trial END) AS nulls FROM t GROUP BY task_id)
SELECT task_id, n_trials, nulls, '{"head":null,"parts":[],"role":"' || role || '","shape":{"turn":' || turn || '},"size":' || CASE WHEN size IS NULL OR nulls > n THEN 'null' ELSE size::VARCHAR END || '}' AS output FROM n JOIN r USING (task_id) JOIN u USING (task_id) LEFT JOIN z USING (task_id)""")
def _(spark, d):
    rows = record_trials(spark, d, "role", "size", "shape").dropDuplicates(["task_id", "trial"])
    found = consensus.record_consensus(rows, RECORD_SCHEMA)
    nulls = F.filter("fields", lambda f: f["path"] == "size")[0]["nulls"]
    return found.select("task_id", F.col("n_trials").cast("long").alias("n_trials"), nulls.cast("long").alias("nulls"), "output")


@query("c3_null_ties", f"""WITH {VALUES_SQL}, nulls AS (SELECT task_id, field, count(DISTINCT CASE WHEN value = 'null' THEN trial END) AS nulls FROM vals GROUP BY ALL)
SELECT task_id, field, CASE WHEN value IS NULL AND field = 'f2' THEN '""' WHEN (field <> 'f2' AND nulls >= coalesce(support, 0)) OR value IS NULL THEN 'null' ELSE value END AS value, nulls, coalesce(support, 0) AS support FROM nulls LEFT JOIN vote USING (task_id, field)""")
def _(spark, d):
    rows = values(spark, d)
    fields = rows.select("field").distinct().select("field", (F.col("field") != "f2").alias("nullable"), F.lit('""').alias("empty_json"))
    return consensus.null_vote(rows, fields, null_wins_ties=True)


@query("c14_vote_counters", """WITH p AS (SELECT conv_id AS task_id, 'f' || (turn % 2) AS field, turn AS trial, CASE (conv_id + turn) % 5 WHEN 0 THEN 'null' WHEN 1 THEN '[]' WHEN 2 THEN '["a"]' WHEN 3 THEN '{"a":1}' ELSE '"x"' END AS value, turn % 2 = 0 AS is_array FROM conversations),
n AS (SELECT task_id, count(DISTINCT trial) AS n FROM p GROUP BY task_id), k AS (SELECT *, CASE WHEN value = 'null' THEN 'null' WHEN NOT is_array THEN 'value' WHEN value = '[]' THEN 'empty' WHEN value[1:1] = '[' THEN 'non_empty' ELSE 'invalid' END AS kind FROM p)
SELECT task_id, field, count(DISTINCT CASE WHEN kind = 'null' THEN trial END) AS null_count, count(DISTINCT CASE WHEN kind = 'empty' THEN trial END) AS empty_count, count(DISTINCT CASE WHEN kind = 'non_empty' THEN trial END) AS non_empty_count,
count(DISTINCT CASE WHEN kind = 'value' THEN trial END) AS value_count, count(DISTINCT CASE WHEN kind = 'invalid' THEN trial END) AS invalid_count, any_value(n) - count(DISTINCT trial) AS missing_count FROM k JOIN n USING (task_id) GROUP BY task_id, field""")
def _(spark, d):
    k, t = F.col("conv_id"), F.col("turn")
    kinds = F.array(*map(F.lit, ("null", "[]", '["a"]', '{"a":1}', '"x"')))
    rows = table(spark, d, "conversations").select(k.alias("task_id"), F.concat(F.lit("f"), (t % 2).cast("string")).alias("field"), t.alias("trial"), F.get(kinds, ((k + t) % 5).cast("int")).alias("value"), (t % 2 == 0).alias("is_array"))
    return consensus.vote_counters(rows, rows)


@query("c16_rebuilt_fields", f"""WITH {SPELLED_SQL}, verdicts AS (SELECT task_id, field, place, CASE WHEN task_id % 7 = 0 THEN 'other' ELSE value END AS value, CASE WHEN task_id % 5 > 0 THEN place % 2 = 1 END AS include FROM cand WHERE task_id % 4 > 0 AND NOT (task_id % 3 = 0 AND place = 1)),
j AS (SELECT task_id, field, place, CASE WHEN include AND c.value = v.value THEN c.value END AS value, CASE WHEN v.value IS NULL THEN 'missing' WHEN include IS NULL THEN 'not boolean' WHEN c.value <> v.value THEN 'value mismatch' END AS issue FROM cand c LEFT JOIN verdicts v USING (task_id, field, place)),
n AS (SELECT task_id, field, count(*) AS n FROM verdicts GROUP BY ALL), o AS (SELECT task_id, field, count(*) AS own, coalesce(string_agg(value, ',' ORDER BY place), '') AS included, coalesce(string_agg(DISTINCT issue, ',' ORDER BY issue), '') AS issues FROM j GROUP BY ALL)
SELECT task_id, field, CASE WHEN n IS NULL THEN 'fallback ' || task_id ELSE included END AS value, CASE WHEN n IS NULL THEN 'fallback' ELSE 'verdict' END AS source, CASE WHEN n IS NULL THEN 'missing verdict' ELSE concat_ws(',', CASE WHEN n <> own THEN 'count mismatch' END, nullif(issues, '')) END AS issues FROM o LEFT JOIN n USING (task_id, field)""")
def _(spark, d):
    cands = consensus.merged_candidates(spelled(spark, d), text.normalized(F.col("value")))
    t = F.col("task_id")
    verdicts = cands.where("task_id % 4 > 0 and not (task_id % 3 = 0 and place = 1)").select("task_id", "field", "place", F.when(t % 7 == 0, "other").otherwise(F.col("value")).alias("value"), F.when(t % 5 > 0, F.col("place") % 2 == 1).alias("include"))
    other = cands.select("task_id", "field").distinct().withColumn("value", F.concat(F.lit("fallback "), F.col("task_id").cast("string")))
    return consensus.reconstructed_fields(cands, verdicts, other)


@query("c11_object_fields", f"""WITH {VALUES_SQL}, nested AS (SELECT * REPLACE (CASE WHEN field = 'f0' THEN field ELSE 'f0.' || field END AS field) FROM vals), n AS (SELECT task_id, count(DISTINCT trial) AS n FROM nested GROUP BY ALL),
kept AS (SELECT task_id, field FROM (SELECT task_id, field, count(DISTINCT trial) AS seen FROM nested GROUP BY ALL) JOIN n USING (task_id) WHERE NOT contains(field, '.') OR seen >= ceil(n * 0.4::DOUBLE))
SELECT task_id, field, count(*) AS n FROM nested JOIN kept USING (task_id, field) GROUP BY ALL""")
def _(spark, d):
    nested = values(spark, d).withColumn("field", F.when(F.col("field") == "f0", F.col("field")).otherwise(F.concat(F.lit("f0."), "field")))
    return consensus.present_fields(nested, 0.4).groupBy("task_id", "field").agg(F.count("*").alias("n"))


@query("v10_value_similarity", "SELECT o_orderkey AS task_id, round((CASE WHEN o_orderkey % 3 = o_orderkey % 2 THEN 1.1::DOUBLE ELSE 0 END + 1.2::DOUBLE) / 2.3::DOUBLE, 6) AS similarity FROM orders")
def _(spark, d):
    record = lambda n: F.to_json(F.struct((F.col("o_orderkey") % n).alias("k"), F.col("o_orderstatus").alias("s")))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), record(3).alias("a"), record(2).alias("b"))
    return rows.select("task_id", F.round(consensus.value_similarities(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("v10_schema_weights", """SELECT o_orderkey AS task_id, round((CASE WHEN o_orderkey % 3 = o_orderkey % 2 THEN 1.1::DOUBLE ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1.1::DOUBLE END + 0.9::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END) / CASE WHEN o_orderkey % 7 = 0 THEN 4.3::DOUBLE ELSE 3.1::DOUBLE END, 6) AS similarity FROM orders""")
def _(spark, d):
    """An enum weighs 1.1 though its values are texts, lists are matched item by item, a text on one side only counts against."""
    k = F.col("o_orderkey")
    schema = '{"type":"object","properties":{"k":{"type":"integer"},"s":{"enum":["F","O","P","Z"]},"t":{"type":"array","items":{"type":"string"}},"w":{"type":"string"}}}'
    a = F.to_json(F.struct((k % 3).alias("k"), F.col("o_orderstatus").alias("s"), F.array(F.lit("x")).alias("t"), F.when(k % 7 == 0, "alone").alias("w")))
    b = F.to_json(F.struct((k % 2).alias("k"), F.when(k % 5 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 2 == 0, F.array(F.lit("x"), F.lit("yyy"))).otherwise(F.array(F.lit("x"))).alias("t")))
    rows = table(spark, d, "orders").select(k.alias("task_id"), a.alias("a"), b.alias("b"))
    return rows.select("task_id", F.round(consensus.value_similarities(F.col("a"), F.col("b"), schema), 6).alias("similarity"))


ITEMS_SCHEMA = """{"type":"object","properties":{"parts":{"type":"array","items":{"type":"object","required":["text","kind"],"properties":{"text":{"type":"string"},"kind":{"enum":["a","b"]}}}}}}"""
ITEMS_SQL = """t AS (SELECT conv_id AS task_id, turn AS trial, upper(role) AS text, CASE WHEN turn % 3 = 0 THEN 'b' ELSE 'a' END AS kind FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) = 1), n AS (SELECT task_id, count(*) AS n, greatest(1, least(2, ceil(count(*) * 0.4::DOUBLE)::INT)) AS floor FROM t GROUP BY task_id)"""


def item_records(spark, d):
    """Turns as trials with one item each, its role and a kind; one row a turn."""
    rows = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    item = F.struct(F.upper("role").alias("text"), F.when(F.col("turn") % 3 == 0, "b").otherwise("a").alias("kind"))
    return rows.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("trial"), F.to_json(F.struct(F.array(item).alias("parts"))).alias("output"), F.array().cast("array<string>").alias("errors"))


def first_candidate(candidates, observed, near, within):
    """Another choice among arrays: that of the lowest support floor."""
    return candidates[0]


EQUAL = {"texts": lambda a, b: float(a == b), "pick": first_candidate, "identity_threshold": 1.0, "object_threshold": 1.0}


@query("u3_other_pick", f"WITH {ITEMS_SQL}, g AS (SELECT task_id, text, count(*) AS support, min(trial) AS first FROM t GROUP BY ALL), k AS (SELECT task_id, text, kind FROM (SELECT task_id, text, kind, count(*) AS n, min(trial) AS first FROM t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_id, text ORDER BY n DESC, first) = 1) SELECT task_id, '{{\"parts\":[' || coalesce(string_agg('{{\"kind\":\"' || kind || '\",\"text\":\"' || text || '\"}}', ',' ORDER BY support DESC, first) FILTER (support >= floor), '') || ']}}' AS output FROM g JOIN k USING (task_id, text) JOIN n USING (task_id) GROUP BY task_id")
def _(spark, d):
    """Items meet by the field that identifies them, their kinds are voted on, and a chosen rule picks the array."""
    return consensus.record_consensus(item_records(spark, d), ITEMS_SCHEMA, consensus.Options(**EQUAL)).select("task_id", "output")


@query("u3_other_identity", f"WITH {ITEMS_SQL}, g AS (SELECT task_id, text, kind, count(*) AS support, min(trial) AS first FROM t GROUP BY ALL) SELECT task_id, '{{\"parts\":[' || coalesce(string_agg('{{\"kind\":\"' || kind || '\",\"text\":\"' || text || '\"}}', ',' ORDER BY support DESC, first) FILTER (support >= floor), '') || ']}}' AS output FROM g JOIN n USING (task_id) GROUP BY task_id")
def _(spark, d):
    """Another rule of identity, here none: items meet only if they are equal as a whole."""
    return consensus.record_consensus(item_records(spark, d), ITEMS_SCHEMA, consensus.Options(**EQUAL, identity=lambda node, root: None)).select("task_id", "output")
