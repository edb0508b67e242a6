"""The pipeline stage by stage, against plain versions."""

import corpus_pipeline
import __spark_entry__
from fieldtally.llm import quality, secrets, toxicity
from fieldtally.llm.queries import queries

from .test_near import least


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas().set_index("doc_id")
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            scores = toxicity.train_toxicity(docs, labels).scores(before.text.tolist())
            want = set(before.index[scores < toxicity.THRESHOLD])
            assert 0 < len(want) < len(before)
        elif name == "quality":
            model = quality.train_quality(docs, labels)
            want = {i for i, t in before.text.items() if model.score(t) >= quality.THRESHOLD}
            assert 0 < len(want) < len(before)
        elif name == "near_duplicates":
            names, _ = least(list(before.text.items()))
            want = {i for i in names if names[i] == i}
            assert len(want) < len(before)
        else:
            want = set(before.index)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
            got = after.toPandas().set_index("doc_id")
            assert set(got.index) == want and got.index.is_unique
            if name == "secrets":
                assert all(got.text[i] == secrets.redacted(before.text[i]) and got.n_chars[i] == len(got.text[i]) for i in want)
                assert (got.text != before.text.reindex(got.index)).any()
            else:
                assert all(got.text[i] == before.text[i] for i in want)
        else:
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == want
        docs = after


def test_registered(spark):
    names = __spark_entry__.queries()
    assert set(queries()) | {"pipeline"} <= set(names)
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)}


def test_stages_take_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, ids shared by other texts, clashing columns, empty tables."""
    sf_dir = "/root/testdata/sf0.001"
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "same text of some words here"), (3, "same text of some words here"), (4, "Same text of  some words here"), (5, "one text under five that is not alone"), (5, "another text under five that is quite different"), (None, "no id at all"), (None, None), (6, long)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept long, kept_key string, row string, component string, key binary, i long, label int, b string"
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, "k", "r", "c", b"", 1, 1, "b") for i, t in rows], schema)
    for docs in (odd, odd.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            found = out.toPandas()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            if name == "near_duplicates" and len(found):
                ids = sorted(found.doc_id.dropna().astype(int))
                assert ids == [1, 3, 5, 5, 6] and found.doc_id.isna().sum() == 2
            if name == "packing":
                assert len(found) == 0 if docs is not odd else set(found.doc_id.dropna()) == {1, 2, 3, 4, 5, 6}


def test_run_reads_and_writes_the_shared_folder(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r[0] for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count() and ids <= {r[0] for r in docs.select("doc_id").collect()}
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
