"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import licenses


def licenses_sql() -> str:
    """The license digest: every rule on every whole text, without gates, keywords and pieces; placed and suppressed by joins."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ",\n".join(f"({p}, {quoted(label)}, {quoted(x)})" for p, label, _, x in licenses.rules())
    phrases = " ".join(f"WHEN {' AND '.join(f'ws[i + {j}] = {quoted(w)}' for j, w in enumerate(phrase.split(), 1))} THEN {quoted(label)}" for phrase, label in licenses.PHRASES.items())
    return f"""WITH rules(priority, label, pattern) AS (VALUES {rules}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM d),
n AS (SELECT doc_id, ws, CASE WHEN len(ws) = 0 THEN '' ELSE ' ' || array_to_string(ws, '  ') || ' ' END AS normal FROM w),
base AS (SELECT * FROM (SELECT doc_id, i, CASE {phrases} END AS label FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM n)) WHERE label IS NOT NULL),
m AS (SELECT doc_id, priority, label, regexp_extract_all(normal, pattern) AS found, regexp_split_to_array(normal, pattern) AS parts FROM n JOIN rules ON regexp_matches(normal, pattern)),
k AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM m),
s AS (SELECT doc_id, priority, label, length(found[k]) AS size, list_sum(list_transform(parts[1:k], lambda x: length(x))) + list_sum(list_transform(found[1:k], lambda x: length(x))) AS stop FROM k),
kept AS (SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.stop - b.size <= a.stop - a.size AND b.stop >= a.stop AND (b.priority > a.priority OR (b.priority = a.priority AND b.size > a.size)))),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM kept) GROUP BY doc_id),
p AS (SELECT doc_id, max(priority) AS priority FROM kept GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
greatest(coalesce(priority / 100.0::DOUBLE, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN p ON p.doc_id = w.doc_id"""


def resampling_sql() -> str:
    """The resampling digest: every distinct run of words hashed byte by byte, counted and weighed by joins."""
    grams = lambda t, key: f"""SELECT {key}, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS gram FROM {t}"""
    words = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"""
    return f"""WITH crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, {words} AS ws FROM documents), e AS (SELECT {words} AS ws FROM benchmark),
dg AS (SELECT doc_id, gram, count(*) AS n FROM ({grams('d', 'doc_id')}) GROUP BY ALL), eg AS (SELECT gram, count(*) AS n FROM ({grams('e', '0 AS one')}) GROUP BY gram),
distinct_grams AS (SELECT gram, list_transform(range(strlen(gram)), lambda i: ('0x' || hex(gram)[2 * i + 1:2 * i + 2])::BIGINT) AS bytes FROM (SELECT gram FROM dg UNION SELECT gram FROM eg)),
hashed AS (SELECT gram, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM distinct_grams, crc_table),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dg JOIN hashed USING (gram) GROUP BY bucket), t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM eg JOIN hashed USING (gram) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM dg JOIN hashed USING (gram) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w ON w.doc_id = d.doc_id)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (5 * able) // 100 THEN place END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM r)"""


def negatives_sql() -> str:
    """The hard negatives: every anchor against every row."""
    ok = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE {ok}),
p AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor, other, score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT pos.anchor AS anchor_id, pos.other AS positive_id, row_number() OVER (PARTITION BY pos.anchor, pos.other ORDER BY p.score DESC, p.other)::INT AS rank, p.other AS negative_id, pos.score AS positive_score, p.score AS negative_score
FROM pos JOIN p ON p.anchor = pos.anchor AND NOT same AND 80 * pos.score <= 100 * p.score AND p.score <= pos.score QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": licenses_sql(), "op11_resampling": resampling_sql(), "op12_hard_negatives": negatives_sql()}
