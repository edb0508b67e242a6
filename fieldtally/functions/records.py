"""JSON records: canonical form, leaves, schema fields; Arrow-vectorized helpers around small pure functions."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DEPTH = 16
RIGID_FORMATS = ("date", "date-time", "time")


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _each(texts: pd.Series, f) -> pd.Series:
    """f over parsed JSON; null where there is none or it doesn't parse."""

    def one(t):
        if t is None:
            return None
        try:
            return f(json.loads(t))
        except ValueError:
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def canonical_json(text: Column) -> Column:
    """Sorted keys, no spaces; integers and floats stay apart."""
    return F.pandas_udf(lambda s: _each(s, canonical), "string")(text)


def flatten(value, expand_lists: bool = False, parent: str = "") -> list[tuple[str, object]]:
    """(path, value) of the leaves.  Without ``expand_lists`` a list is a leaf; an empty object has none."""
    out: list[tuple[str, object]] = []
    if isinstance(value, dict):
        for key, inner in value.items():
            out += flatten(inner, expand_lists, f"{parent}.{key}" if parent else key)
    elif isinstance(value, list) and expand_lists:
        for i, inner in enumerate(value):
            out += flatten(inner, expand_lists, f"{parent}[{i}]")
    else:
        out.append((parent, value))
    return out


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "integer", float: "number", list: "array", dict: "object"}[type(value)]


def leaves(text: Column, expand_lists: bool = False) -> Column:
    """array<struct<path, value_json, kind>> of a JSON record."""

    @F.pandas_udf("array<struct<path:string,value_json:string,kind:string>>")
    def walk(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda v: [{"path": p, "value_json": canonical(x), "kind": kind(x)} for p, x in flatten(v, expand_lists)])

    return walk(text)


def repaired(value):
    """Strings in NFC with literal \\uXXXX escapes decoded, but for controls and surrogates."""
    if isinstance(value, dict):
        return {k: repaired(v) for k, v in value.items()}
    if isinstance(value, list):
        return [repaired(v) for v in value]
    if not isinstance(value, str):
        return value
    out, rest = "", value
    while (i := rest.find("\\u")) >= 0:
        code = rest[i + 2 : i + 6]
        ok = len(code) == 4 and all(c in "0123456789abcdefABCDEF" for c in code)
        char = chr(int(code, 16)) if ok else ""
        if not ok or 0xD800 <= ord(char) <= 0xDFFF or unicodedata.category(char) == "Cc":
            out, rest = out + rest[: i + 2], rest[i + 2 :]
        else:
            out, rest = out + rest[:i] + char, rest[i + 6 :]
    return unicodedata.normalize("NFC", out + rest)


def repair_strings(text: Column) -> Column:
    return F.pandas_udf(lambda s: _each(s, lambda v: json.dumps(repaired(v), ensure_ascii=False)), "string")(text)


def resolve(schema: dict, root: dict, depth: int = 0) -> dict:
    """The schema that a reference names."""
    while isinstance(schema, dict) and "$ref" in schema and depth < MOST_DEPTH:
        found = root
        for part in filter(None, schema["$ref"].removeprefix("#").split("/")):
            found = found.get(part, {}) if isinstance(found, dict) else {}
        schema, depth = found, depth + 1
    return schema if isinstance(schema, dict) else {}


def opened(schema: dict, root: dict) -> tuple[dict, bool]:
    """(the only non-null option of a nullable union or the schema itself, whether null is allowed)."""
    schema = resolve(schema, root)
    options = [resolve(o, root) for o in schema.get("anyOf", [])]
    kinds = schema.get("type")
    nullable = any(o.get("type") == "null" for o in options) or isinstance(kinds, list) and "null" in kinds
    rest = [o for o in options if o.get("type") != "null"]
    return (rest[0] if len(rest) == 1 else schema), nullable


def is_rigid(node: dict) -> bool:
    """Whether a value scores by equality only: all but plain strings, which a nullable union isn't."""
    if "enum" in node or node.get("type") != "string":
        return True
    return node.get("format") in RIGID_FORMATS


def coerce_nulls(value, schema: dict, root: dict | None = None, depth: int = 0):
    """Strings that say null become null where the schema allows null."""
    root = schema if root is None else root
    node, nullable = opened(schema, root)
    if isinstance(value, str):
        return None if nullable and value.strip().lower() == "null" else value
    if depth < MOST_DEPTH and isinstance(value, dict):
        fields = node.get("properties", {})
        return {k: coerce_nulls(v, fields[k], root, depth + 1) if k in fields else v for k, v in value.items()}
    if depth < MOST_DEPTH and isinstance(value, list) and isinstance(node.get("items"), dict):
        return [coerce_nulls(v, node["items"], root, depth + 1) for v in value]
    return value


def coerced_json(text: Column, schema: Column) -> Column:
    """The record with null strings coerced by its own schema; null if either doesn't parse."""

    @F.pandas_udf("string")
    def coerce(texts: pd.Series, schemas: pd.Series) -> pd.Series:
        parsed: dict[str, dict] = {}
        out = []
        for t, s in zip(texts, schemas):
            try:
                node = parsed.setdefault(s, json.loads(s)) if s not in parsed else parsed[s]
                out.append(json.dumps(coerce_nulls(json.loads(t), node), ensure_ascii=False))
            except (TypeError, ValueError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return coerce(text, schema)


def normal_schema(node):
    """A schema with blank descriptions and sorted lists of types, enums and required names."""
    if isinstance(node, dict):
        out = {}
        for k, v in node.items():
            if k == "description" and isinstance(v, str):
                out[k] = ""
            elif k in ("required", "enum", "type") and isinstance(v, list):
                out[k] = sorted(v, key=canonical)
            else:
                out[k] = normal_schema(v)
        return out
    return [normal_schema(v) for v in node] if isinstance(node, list) else node


def schema_fingerprint(schema: Column) -> Column:
    """sha1 of the normal form; schemas that differ in wording and order only have the same."""
    return F.pandas_udf(lambda s: _each(s, lambda v: hashlib.sha1(canonical(normal_schema(v)).encode()).hexdigest()), "string")(schema)


FIELDS = (
    "path string, name string, depth int, position int, required boolean, json_type string, nullable boolean, enum array<string>, minimum double, maximum double, description string, "
    "type_class string, type_text string, rigid boolean, item_type string, item_enum boolean, item_numbers boolean, own_form string"
)


def json_kind(node: dict) -> str:
    """The declared type, of a list of types the only one besides null; ``enum`` or ``any`` where none is declared."""
    declared = node.get("type")
    if isinstance(declared, list):
        rest = [k for k in declared if k != "null"]
        declared = rest[0] if len(rest) == 1 else None
    return declared if isinstance(declared, str) else "enum" if "enum" in node else "any"


def type_class(raw: dict, root: dict, depth: int = 0) -> str:
    """What values a field can be compared with: all enums alike, all numbers alike, arrays by their items; null or not doesn't matter."""
    node = opened(raw, root)[0]
    found = json_kind(node)
    if "enum" in node:
        return "enum"
    if found == "array":
        inner = node.get("items")
        return f"array[{type_class(inner, root, depth + 1) if isinstance(inner, dict) and depth < MOST_DEPTH else 'any'}]"
    return "numeric" if found in ("integer", "number") else found if found in ("string", "boolean", "object") else "any"


def type_text(raw: dict, root: dict, depth: int = 0) -> str:
    """The type as a reader would say it."""
    node, nullable = opened(raw, root)
    if "enum" in node:
        said = f"enum[{raw['$ref'].rsplit('/', 1)[-1]}]" if isinstance(raw.get("$ref"), str) else "enum"
    else:
        said, inner = json_kind(node), node.get("items")
        if said == "array" and isinstance(inner, dict) and depth < MOST_DEPTH:
            said = f"array of {type_text(inner, root, depth + 1)}"
    return f"{said}|null" if nullable else said


def fields(schema: dict) -> list[dict]:
    """Every field of a schema; one beyond MOST_DEPTH levels (a recursive one) raises ValueError."""
    out: list[dict] = []

    def walk(node: dict, prefix: str, depth: int) -> None:
        if depth > MOST_DEPTH:
            raise ValueError("the schema is nested too deeply")
        node = opened(node, schema)[0]
        for position, (name, raw) in enumerate(node.get("properties", {}).items()):
            inner, nullable = opened(raw, schema)
            path = f"{prefix}.{name}" if prefix else name
            json_type = json_kind(inner)
            item = opened(inner["items"], schema)[0] if json_type == "array" and isinstance(inner.get("items"), dict) else {}
            numbers = [json_kind(opened(c, schema)[0]) in ("integer", "number") for c in item.get("properties", {}).values() if isinstance(c, dict)]
            out.append({
                "path": path, "name": name, "depth": depth, "position": position, "required": name in node.get("required", []), "json_type": json_type, "nullable": nullable,
                "enum": [canonical(v) for v in inner["enum"]] if "enum" in inner else None, "minimum": inner.get("minimum"), "maximum": inner.get("maximum"),
                "description": raw.get("description") or inner.get("description") or "", "type_class": type_class(raw, schema), "type_text": type_text(raw, schema), "rigid": depth > 0 or is_rigid(resolve(raw, schema)),
                "item_type": json_kind(item) if item else None, "item_enum": "enum" in item, "item_numbers": any(numbers),
                "own_form": canonical({"required": name in node.get("required", []), "schema": raw}) if depth == 0 else None,
            })
            if json_type == "object":
                walk(inner, path, depth + 1)
            elif json_type == "array" and isinstance(inner.get("items"), dict) and opened(inner["items"], schema)[0].get("type") == "object":
                walk(inner["items"], f"{path}[]", depth + 1)

    walk(schema, "", 0)
    return out


def schema_fields(schemas: DataFrame, key: str, schema_col: str) -> DataFrame:
    """One row per field of every distinct schema, and the schemas that can't be walked with a null path."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[schema_col]):
                try:
                    rows += [{key: k} | f for f in fields(json.loads(text))]
                except (TypeError, ValueError, AttributeError):
                    rows.append({key: k} | dict.fromkeys(names))
            yield pd.DataFrame(rows, columns=[key, *names], dtype=object)

    distinct = schemas.select(key, schema_col).dropDuplicates([key])
    return distinct.mapInPandas(explode, f"{key} string, {FIELDS}")


def first_json(text: str | None) -> tuple[str | None, str]:
    """(the record in a response, how it was found): the whole text, else the first complete object or list in it."""
    if not text:
        return None, "empty"
    try:
        return canonical(json.loads(text)), "strict"
    except ValueError:
        decoder = json.JSONDecoder()
        for i, c in enumerate(text):
            if c in "{[":
                try:
                    return canonical(decoder.raw_decode(text, i)[0]), "salvaged"
                except ValueError:
                    continue
    return None, "invalid"


def response_json(text: Column) -> Column:
    """A struct (output, status) of a raw response."""

    @F.pandas_udf("output string, status string")
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_json(t) for t in texts], columns=["output", "status"])

    return find(text)
