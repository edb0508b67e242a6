"""Jobs over schemas and records: field texts, tags, coarse types, projections, validation, embeddings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.sizes import small, small_batches

#: Words in a field's name or description that give it a tag.
TAG_WORDS = {
    "date_normalization": ["date", "fecha", "year", "año", "ano"],
    "long_verbatim_evidence": ["verbatim", "source", "evidence", "fragment", "fragmento", "span", "texto", "evidencia"],
    "sentinel_pattern": ["sentinel", "marker", "code", "codigo", "código", "registry", "registro"],
}
ENTITY_WORDS = ["entity", "entities", "entidad", "entidades", "person", "persona", "organization", "organizacion", "organización"]
#: Fields with one of these tags are answered directly, all others with a reasoning.
DIRECT_TAGS = ["entity_array", "enum_classification", "complex_object_array"]


def field_text(name: Column, type_text: Column, description: Column) -> Column:
    """What stands for a field in an embedding: its name, its type in words and its description."""
    head = F.concat(name, F.lit(" ("), type_text, F.lit(")"))
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(head, F.lit(": "), F.trim(description))).otherwise(head)


def task_text(fields: DataFrame, key: str, instruction: Column) -> DataFrame:
    """One text per task: its instruction and its fields in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n")
    return fields.groupBy(key).agg(F.concat_ws("\n", F.first(instruction), lines).alias("text"))


def field_tags(**columns: Column) -> Column:
    """Sorted tags of a field row of ``records.schema_fields``; ``columns`` stand in for columns of other names."""
    of = lambda name: columns.get(name, F.col(name))
    kind, nullable, has_enum = of("json_type"), F.coalesce(of("nullable"), F.lit(False)), of("enum").isNotNull()
    words = text.terms(F.concat_ws(" ", of("name"), of("description")))
    is_array, item = kind == "array", F.coalesce(of("item_type"), F.lit(""))
    rules = {
        "grounded_null": nullable, "nullable": nullable, "enum_classification": has_enum, "numeric_normalization": kind.isin("integer", "number"), "boolean_inference": kind == "boolean",
        "nullable_boolean": (kind == "boolean") & nullable, "direct_string": kind == "string", "bounded_score": of("minimum").isNotNull() | of("maximum").isNotNull(),
        **{tag: F.arrays_overlap(words, F.array(*map(F.lit, marks))) for tag, marks in TAG_WORDS.items()},
        "simple_array": is_array & (item != "object"), "enum_array": is_array & of("item_enum"), "complex_object_array": is_array & (item == "object"),
        "nested_numeric_object_array": is_array & (item == "object") & of("item_numbers"), "entity_array": is_array & (item != "") & F.arrays_overlap(words, F.array(*map(F.lit, ENTITY_WORDS))),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(rule, tag) for tag, rule in rules.items()])))


def is_direct(tags: Column) -> Column:
    """Whether a field of these tags is answered without a reasoning."""
    return F.arrays_overlap(tags, F.array(*map(F.lit, DIRECT_TAGS)))


def coarse_types(leaves: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves with a coarse type by their schema's field of that path; a path without one is unknown_extra."""
    kind, fmt = F.col("json_type"), F.coalesce("format", F.lit(""))
    coarse = (
        F.when(kind.isNull(), "unknown_extra").when(kind.isin("integer", "number"), "numeric").when(fmt.isin("date", "date-time", "time"), "temporal_string")
        .when(kind == "array", F.concat(F.lit("array["), F.coalesce("item_type", F.lit("any")), F.lit("]"))).otherwise(kind)
    )
    return leaves.join(fields.select(*keys, "path", "json_type", "format", "item_type"), [*keys, "path"], "left").withColumn("coarse_type", coarse).drop("json_type", "format", "item_type")


def kept_fields(fields: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The fields that are named, renumbered by what is left."""
    from pyspark.sql import Window

    rows = fields.join(kept.select(*keys, "name"), [*keys, "name"], "left_semi")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("position")) - 1)


def kept_examples(examples: Column, names: Column) -> Column:
    """The examples of the fields that are named; the schema's side is ``kept_fields`` and ``kept_schema``."""
    return F.map_filter(examples, lambda k, v: F.array_contains(names, k))


def kept_schema(schema: Column, names: Column) -> Column:
    """A schema's JSON with the named properties only, in its own order, and what of them is required."""

    @F.pandas_udf("string")
    def reduce(schemas: pd.Series, kept: pd.Series) -> pd.Series:
        out = []
        for text_, wanted in zip(schemas, kept):
            node = json.loads(text_)
            node["properties"] = {k: v for k, v in node.get("properties", {}).items() if k in set(wanted)}
            if "required" in node:
                node["required"] = [k for k in node["required"] if k in node["properties"]]
            out.append(json.dumps(node, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return reduce(schema, names)


def unwrapped(output: Column) -> tuple[Column, Column]:
    """(values, reasonings) of a record whose fields are {reasoning, value}, as maps of texts."""
    entries = F.from_json(output, "map<string, struct<reasoning:string, value:string>>")
    return F.transform_values(entries, lambda k, v: v["value"]), F.transform_values(entries, lambda k, v: v["reasoning"])


def unwrap_value(value, reasonings: dict[str, str], path: str = "", deep: bool = False):
    """The value without its {reasoning, value} wrappers; what they reasoned goes to ``reasonings`` by path."""
    if isinstance(value, dict) and set(value) == {"reasoning", "value"}:
        reasonings[path] = value["reasoning"]
        value = value["value"]
    if deep and isinstance(value, dict):
        return {k: unwrap_value(v, reasonings, f"{path}.{k}" if path else k, True) for k, v in value.items()}
    if deep and isinstance(value, list):
        return [unwrap_value(v, reasonings, f"{path}[{i}]", True) for i, v in enumerate(value)]
    return value


def unwrapped_records(output: Column, fields: Column, deep: bool = False) -> Column:
    """A struct (output, reasonings, error) of a wrapped record.

    ``fields`` names the top-level fields that a reasoning goes with: all, or
    those that aren't answered directly.  One that is missing, or that has no
    wrapper, is an error; so is a record that doesn't parse.  ``deep`` unwraps
    what is nested too.
    """

    @F.pandas_udf("output string, reasonings map<string,string>, error string")
    def unwrap(outputs: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for text_, wanted in zip(outputs, names):
            try:
                record = json.loads(text_)
                absent = [n for n in wanted if n not in record]
                bare = [n for n in wanted if n in record and not (isinstance(record[n], dict) and "value" in record[n] and "reasoning" in record[n])]
            except (TypeError, ValueError):
                rows.append((None, None, "no record"))
                continue
            if absent or bare:
                rows.append((None, None, f"missing field: {absent[0]}" if absent else f"no reasoning: {bare[0]}"))
                continue
            told: dict[str, str] = {}
            plain = {k: unwrap_value(v, told, k, deep) if k in set(wanted) or deep else v for k, v in record.items()}
            rows.append((json.dumps(plain, ensure_ascii=False, sort_keys=True, separators=(",", ":")), told, None))
        return pd.DataFrame(rows, columns=["output", "reasonings", "error"])

    return unwrap(output, fields)


def validation_errors(leaves: DataFrame, fields: DataFrame, texts: DataFrame, records: DataFrame) -> DataFrame:
    """(task_id, path, error) rows: required missing or null, enum, length and pattern rules, wrong shapes, texts that aren't in the source.

    ``leaves`` has (task_id, path, value, kind) with lists walked item by item
    (``tags[0]``), also nulls; ``fields`` (path, required, kind, enum, pattern,
    least_length, most_length) of one schema, items of lists under ``tags[]``,
    the kind null where the schema allows several; ``texts`` (task_id, text);
    ``records`` all task ids, also of records without leaves.  A null is no
    object and no list, and belongs to an enum only if that lists it.  Every
    text leaf that the schema knows must stand in the source, but for case,
    form and spaces; a task's texts are looked for in one pass over its source.
    """
    needed = records.select("task_id").crossJoin(small(fields.where("required and not contains(path, '[]')").select("path")))
    present = leaves.where("value is not null").select("task_id", F.regexp_replace("path", r"\[\d+\].*$", "").alias("path"))
    # An object is there if anything of it is.
    above = present.select("task_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda i: F.array_join(F.slice(F.split("path", r"\."), 1, i), "."))).alias("path")).distinct()
    missing = needed.join(above, ["task_id", "path"], "left_anti").withColumn("error", F.lit("required"))
    general = F.regexp_replace("path", r"\[\d+\]", "[]")
    ruled = leaves.withColumn("rule", general).join(fields.withColumnRenamed("path", "rule").withColumnRenamed("kind", "due"), "rule")
    is_text, composite = F.coalesce(F.col("kind") == "string", F.lit(False)) & F.col("value").isNotNull(), F.coalesce(F.col("due").isin("object", "array"), F.lit(False))
    listed = F.exists("enum", lambda x: x.eqNullSafe(F.col("value")))
    checks = F.array_compact(F.array(
        F.when(composite, "shape"),  # a leaf where an object or a list is due
        F.when(~composite & F.col("enum").isNotNull() & ~listed, "enum"),
        F.when(~composite & is_text & (F.length("value") < F.col("least_length")), "too short"),
        F.when(~composite & is_text & (F.length("value") > F.col("most_length")), "too long"),
        F.when(~composite & is_text & F.col("pattern").isNotNull() & ~F.rlike("value", F.col("pattern")), "pattern"),
    ))
    broken = ruled.select("task_id", "path", F.explode(checks).alias("error"))
    said = ruled.where(is_text & ~composite & (F.col("value") != "")).groupBy("task_id").agg(F.collect_list("path").alias("paths"), F.collect_list("value").alias("values"))  # a record's leaves
    marked = said.join(texts, "task_id").select("task_id", F.explode(F.arrays_zip("paths", text.stands_in("values", "text").alias("there"))).alias("x"))
    loose = marked.where("not x.there").select("task_id", F.col("x.paths").alias("path"), F.lit("not in text").alias("error"))
    return missing.unionByName(broken).unionByName(loose)


def hashed_vectors(texts: list[str | None], size: int = 256) -> np.ndarray:
    """Unit vectors of hashed character trigrams; an empty text has the zero vector."""
    out = np.zeros((len(texts), size), np.float64)
    for i, t in enumerate(texts):
        codes = np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if t else np.empty(0, np.uint64)
        if len(codes) > 2:
            h = (codes[:-2] * np.uint64(0x9E3779B1) ^ codes[1:-1] * np.uint64(0x85EBCA77) ^ codes[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
            out[i] = np.bincount((h >> np.uint64(33)).astype(np.int64) % size, np.where(h >> np.uint64(63), 1.0, -1.0), size)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def vectors_by_key(keyed: DataFrame, embed=hashed_vectors) -> DataFrame:
    """(__key, vec) of every distinct key of (__key, __text)."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"__key": batch["__key"], "vec": list(embed(batch["__text"].tolist()))})

    distinct = keyed.groupBy("__key").agg(F.any_value(F.coalesce("__text", F.lit(""))).alias("__text"))
    return distinct.mapInPandas(vectors, "__key string, vec array<double>")


def embedded(rows: DataFrame, text_col: str, embed=hashed_vectors, known: DataFrame | None = None) -> DataFrame:
    """Rows with ``vec``: each distinct text is embedded once and joined back by its hash.

    ``embed`` maps a list of texts to unit vectors; a model takes the place of
    the default, which needs none.  ``known`` has (__key, vec) of texts that
    were embedded before; only the others are embedded.
    """
    keyed = rows.withColumn("__key", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    wanted = keyed.select("__key", F.col(text_col).alias("__text"))
    if known is None:
        vecs = vectors_by_key(wanted, embed)
    else:
        vecs = known.hint("merge").join(wanted.select("__key").distinct(), "__key", "left_semi").unionByName(vectors_by_key(wanted.join(known.select("__key").hint("merge"), "__key", "left_anti"), embed))
    return keyed.join(vecs.hint("merge"), "__key").drop("__key")


#: A text of more rows than this is a frequent one; so many frequent texts at most are broadcast with their vectors.
HOT_ROWS, MOST_HOT = 10_000, 1_000


def with_known_vectors(rows: DataFrame, text_col: str, known: DataFrame) -> DataFrame:
    """Rows with ``vec`` out of (__key, vec), which holds all their texts.

    The most frequent texts' vectors, a bounded number, are broadcast, so that
    no task gets all rows of one text; the others meet by a shuffle, whatever
    the size of the vectors' files promises: vectors are far larger in memory.
    """
    from ..sources.files import durable  # the readers use this module

    keyed = rows.withColumn("__key", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    hot = durable(keyed.groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "__key").limit(MOST_HOT).select("__key"))
    near = known.join(F.broadcast(hot), "__key", "left_semi")
    frequent = keyed.join(F.broadcast(near), "__key")
    others = keyed.join(F.broadcast(hot), "__key", "left_anti").join(known.hint("merge"), "__key")
    return frequent.unionByName(others).drop("__key")


def grown_vectors(known: DataFrame | None, rows: DataFrame, text_col: str, embed=hashed_vectors) -> DataFrame:
    """(__key, vec) of an index that grows: what is known and the vectors of the rows' texts that aren't."""
    keyed = rows.select(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("__key"), F.col(text_col).alias("__text"))
    if known is None:
        return vectors_by_key(keyed, embed)
    return known.unionByName(vectors_by_key(keyed.join(known.select("__key").hint("merge"), "__key", "left_anti"), embed))


def pair_similarity(pairs: DataFrame, a: str, b: str, embed=None) -> DataFrame:
    """Pairs with ``similarity``: the cosine of their embeddings, at least 0, or without an embedder their Jaccard.

    Both columns' distinct texts are embedded together, once each.
    """
    if embed is None:
        return pairs.withColumn("similarity", text.jaccard(text.word_set(F.col(a)), text.word_set(F.col(b))))
    from ..sources.files import durable  # the readers use this module

    with small_batches(pairs.sparkSession):
        keyed = durable(pairs.withColumns({f"__k{c}": F.sha2(F.coalesce(c, F.lit("")), 256) for c in (a, b)}))
        sides = keyed.select(F.explode(F.array(*[F.struct(F.col(f"__k{c}").alias("__key"), F.col(c).alias("__text")) for c in (a, b)])).alias("x")).select("x.*")
        vecs = durable(vectors_by_key(sides, embed))
    both = keyed
    for c in (a, b):
        both = both.join(vecs.select(F.col("__key").alias(f"__k{c}"), F.col("vec").alias(f"__v{c}")), f"__k{c}")
    return both.withColumn("similarity", F.greatest(F.lit(0.0), text.cosine(F.col(f"__v{a}"), F.col(f"__v{b}")))).select(*pairs.columns, "similarity")


def hybrid_similarity(pairs: DataFrame, a: str, b: str, embed=hashed_vectors) -> DataFrame:
    """0.6 of the embeddings' and 0.4 of the lexical similarity, within 0 and 1.

    The lexical part is made where the pairs lie, so that their vectors meet
    rows without texts.
    """
    lexical = text.lexical_similarity(text.normalized(F.col(a)), text.normalized(F.col(b)))
    rows = pair_similarity(pairs.withColumn("__lexical", lexical), a, b, embed)
    return rows.withColumn("hybrid", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.6 * F.col("similarity") + 0.4 * F.col("__lexical")))).drop("__lexical")


def instance_scores(rows: DataFrame, gold: str, system: str, schema: str, semantic=None) -> DataFrame:
    """Rows with ``tps``, ``gold_keys``, ``system_keys`` and these by top-level field, of two JSON records under a schema.

    Lists are matched item by item under their item schema, whatever is nested
    in them; free texts score by ``semantic``, if given, and words.  A system
    record that doesn't parse scores 0, an empty gold record by emptiness.
    """
    from .scoring import RecordScorer

    @F.pandas_udf("tps double, gold_keys int, system_keys int, by_field array<struct<field:string,tps:double,gold_keys:int,system_keys:int>>")
    def score(golds: pd.Series, systems: pd.Series, schemas: pd.Series) -> pd.DataFrame:
        scorers: dict[str, RecordScorer] = {}
        out = []
        for g, s, sc in zip(golds, systems, schemas):
            if sc not in scorers:
                try:
                    scorers[sc] = RecordScorer(json.loads(sc), semantic)
                except (TypeError, ValueError):
                    scorers[sc] = RecordScorer({}, semantic)
            try:
                parsed = json.loads(g)
            except (TypeError, ValueError):
                out.append((None, None, None, None))
                continue
            try:
                fields = scorers[sc].record(parsed, json.loads(s))
            except (TypeError, ValueError):
                fields = scorers[sc].record(parsed, {})
            sums = [sum(f[k] for f in fields.values()) for k in range(3)]
            out.append((float(sums[0]) if sums[1] else float(not sums[2]), sums[1], sums[2], [{"field": n, "tps": float(t), "gold_keys": p, "system_keys": q} for n, (t, p, q) in fields.items()]))
        return pd.DataFrame(out, columns=["tps", "gold_keys", "system_keys", "by_field"])

    return rows.withColumn("__s", score(F.col(gold), F.col(system), F.col(schema))).select(*rows.columns, "__s.*")
