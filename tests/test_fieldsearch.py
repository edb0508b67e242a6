"""The search by field vectors, in blocks, against plain joins of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import fieldsearch, retrieval

SCHEMA = "owner long, position int, type_class int, name string, vec array<double>"


def plain_alignment(queries, cases):
    left = queries.select(F.col("owner").alias("query"), F.col("position").alias("field"), "type_class", "vec")
    right = cases.select(F.col("owner").alias("case_id"), F.col("name").alias("case_field"), "type_class", F.col("vec").alias("case_vec"))
    pairs = left.join(right, "type_class").select("query", "case_id", "field", "case_field", F.round(F.greatest(F.lit(0.0), retrieval.dot(F.col("vec"), F.col("case_vec"))), 9).alias("similarity"))
    return pairs.groupBy("query", "case_id", "field").agg(F.max("similarity").alias("similarity"), F.min_by("case_field", F.struct(-F.col("similarity"), F.col("case_field"))).alias("case_field")).where("case_id is not null")


def plain_candidates(aligned, queries):
    every = queries.groupBy(F.col("owner").alias("query")).agg(F.array_sort(F.collect_set("position")).alias("positions"))
    found = aligned.where("query <> case_id").groupBy("query", "case_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "similarity"))).alias("m"))
    vec = F.transform("positions", lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0)))
    return found.join(every, "query").select("query", "case_id", vec.alias("vec")).withColumn("score", F.round(F.sqrt(retrieval.dot(F.col("vec"), F.col("vec"))), 9))


def rows_of(df, *columns):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect()), key=repr)


def field_rows(n, seed=3):
    """Owners of one to four fields; the last ones have a vector that is null, has nulls, another length or none, no class, no name, or a position twice."""
    rng = random.Random(seed)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = [(o, p, rng.randrange(3), f"f{rng.randrange(3)}", unit([rng.gauss(0.1, 1) for _ in range(6)])) for o in range(n) for p in range(rng.randrange(1, 5))]
    rows += [(o + 1000, p, t, m, v) for o in range(0, n, 40) for p, t, m, v in rng.sample([r[1:] for r in rows], 2)]  # equal vectors under other names
    for o in (5000, 5010, 5020):
        rows += [(o, 0, 0, "z", None), (o + 1, 0, 0, "y", [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (o + 2, 1, 1, "x", [1.0, 0.0]), (o + 3, 1, 1, "w", []), (o + 4, 2, None, "v", [1.0] + [0.0] * 5), (o + 5, 2, 2, None, [0.0, 1.0] + [0.0] * 4)]
        rows += [(o + 6, 1, 0, "b", [0.6, 0.8] + [0.0] * 4), (o + 6, 1, 0, "a", [0.8, 0.6] + [0.0] * 4), (o + 6, 1, 2, "c", [0.0, 1.0] + [0.0] * 4), (None, 0, 0, "n", [1.0] + [0.0] * 5)]
    return rows


@pytest.fixture(scope="module")
def fields(spark):
    rows = spark.createDataFrame(field_rows(700), SCHEMA)
    return rows.where("owner % 4 = 0 or owner > 5000").cache(), rows.cache()


@pytest.fixture(params=["one cell", "many cells"])
def search(fields, request, monkeypatch):
    if request.param == "many cells":
        monkeypatch.setattr(fieldsearch, "CELL_PAIRS", 100_000)
        monkeypatch.setattr(fieldsearch, "QUERY_FIELDS", 150)
    found = retrieval.FieldSearch(*fields)
    assert (found.query_blocks * found.case_blocks > 4) == (request.param == "many cells")
    return found


def test_alignment_equals_all_pairs(fields, search):
    columns = ("query", "case_id", "field", "similarity", "case_field")
    assert rows_of(search.aligned(), *columns) == rows_of(plain_alignment(*fields), *columns)
    plan = search.aligned()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # pairs are neither joined nor grouped by Spark


def test_selections_equal_those_of_all_candidates(spark, fields, search):
    plain = plain_candidates(plain_alignment(*fields), fields[0]).cache()
    columns = ("query", "case_id", "vec", "score")
    assert rows_of(search.candidates(), *columns) == rows_of(plain, *columns)
    placed = ("query", "case_id", "place", "score")
    for k in (1, 2, 6):
        assert rows_of(retrieval.independent_top(search, k), *placed) == rows_of(retrieval.independent_top(plain, k), *placed)
    pair = ("query", "a", "b", "pair_score", "score_sum")
    assert rows_of(retrieval.complementary_pairs(search), *pair) == rows_of(retrieval.complementary_pairs(plain), *pair)
    out = retrieval.independent_top(plain, 2).where("query % 3 < 2").select("query", "case_id").cache()
    for k, excluded in ((2, None), (5, None), (3, out)):
        assert rows_of(retrieval.diverse_top(search, k, excluded), *placed) == rows_of(retrieval.diverse_top(plain, k, excluded), *placed)
    assert rows_of(search.candidates(excluded=out), *columns) == rows_of(retrieval.remaining(plain, out), *columns)


def test_owners_of_any_type(spark):
    rows = spark.createDataFrame([(f"o{i % 3}", i, "t", f"f{i}", [1.0, float(i)]) for i in range(6)], "owner string, position int, type_class string, name string, vec array<double>")
    found = retrieval.FieldSearch(rows.where("owner = 'o1'"), rows)
    assert rows_of(found.aligned(), "query", "case_id", "field", "similarity", "case_field")[0] == ("o1", "o0", 1, 4.0, "f3")
    assert rows_of(retrieval.independent_top(found), "query", "case_id", "place") == [("o1", "o0", 2), ("o1", "o2", 1)]


def test_halves_round_as_in_spark(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.random(1000), (rng.integers(0, 10**9, 1000) + 0.5) / 1e9, [0.0, 2.5e-9, 1.2345678905, 4e7 + 0.1]])
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select(F.round("x", 9).alias("r"))
    assert [r.r for r in rows.collect()] == fieldsearch.rounded9(values.copy(), 1e-5).tolist()


def test_cases_in_small_batches():
    """The fields of an owner may lie in two batches, and chunks and groups be any size."""
    rng = random.Random(7)
    rows = [(0, s, o, p, rng.randrange(2), f"f{p}", [rng.gauss(0, 1) for _ in range(3)], None) for s in (0, 2) for o in range(40) for p in range(3) if s or o % 2]
    rows.sort(key=lambda r: (r[1], r[2], r[4], r[5]))
    types = pa.schema([("cell", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("position", pa.int32()), ("type_class", pa.int32()), ("name", pa.string()), ("vec", pa.list_(pa.float64())), ("more", pa.null())])
    table = pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    def found(size):
        out = fieldsearch._cells(iter(table.to_batches(max_chunksize=size)), fieldsearch._All)
        return sorted((r for a in out for r in zip(*[x.to_pylist() for x in a])), key=lambda r: r[:2])

    whole = found(1000)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fieldsearch, "CASES", 4)
        patch.setattr(fieldsearch, "QUERIES", 3)
        for size in (1, 7, 50):
            assert found(size) == whole
