"""Validation: identity, dangling references, placement, documents against schemas."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows of a key but the first.

    The first of each key is found by an aggregate, so a key with most of the rows is not one window.
    """
    first = rows.groupBy(*keys).agg(F.min(order).alias("first_"), F.count("*").alias("n_")).where("n_ > 1")
    return rows.join(first, keys).where(F.col(order) > F.col("first_")).drop("first_", "n_")


def dangling(rows: DataFrame, column: str, refs: DataFrame) -> DataFrame:
    """Rows whose reference names nothing."""
    return rows.join(refs.select(F.col("ref").alias("ref_")), F.col(column) == F.col("ref_"), "left_anti")


def dangling_fields(entities: DataFrame, fields: list[str]) -> DataFrame:
    """(ref, field, target) of every reference field of entities that names nothing."""
    out = None
    for f in fields:
        lost = dangling(entities.where(F.col(f).isNotNull()), f, entities.select("ref")).select("ref", F.lit(f).alias("field"), F.col(f).alias("target"))
        out = lost if out is None else out.unionByName(lost)
    return out


def exactly_one(*columns: Column) -> Column:
    """Whether exactly one of the columns is set."""
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0)) == 1


def multi_owned(paths: DataFrame) -> DataFrame:
    """(path, n) of paths that several owners declare."""
    return paths.groupBy("path").agg(F.count_distinct("owner").alias("n")).where("n > 1")


#: Component types that need a deployable, and those that need an importable artifact.
DEPLOYABLE_TYPES = ["service", "worker", "job", "web-app", "static-site", "infrastructure"]
IMPORTABLE_TYPES = ["library", "contract-library", "cli"]


def artifact_types(entities: DataFrame, units: DataFrame) -> DataFrame:
    """(ref, severity) of components whose type their artifacts don't bear out; one may have both severities."""
    j = entities.join(units.select("root", "deployable", "importable"), entities["source_path"] == units["root"], "left")
    t = F.col("component_type")
    runs, loads = F.coalesce("deployable", F.lit(False)), F.coalesce("importable", F.lit(False))
    error = (t.isin(*DEPLOYABLE_TYPES) & ~runs) | (t.isin(*IMPORTABLE_TYPES) & ~loads)
    both = F.array_compact(F.array(F.when(error, "error"), F.when(t.isin(*IMPORTABLE_TYPES) & runs & ~loads, "warning")))
    return j.select("ref", F.explode(both).alias("severity"))


#: Keys that a descriptor may not carry, at any depth outside `extensions`.
PROHIBITED = """
status owner owners lifecycle maturity uid etag uuid annotations labels createdAt updatedAt created modified
relations dependsOn depends_on runtime secrets
""".split()


def prohibited(doc: Any, at: str = "") -> list[str]:
    """Pointers to keys of a document that it may not carry."""
    if isinstance(doc, list):
        return [x for i, v in enumerate(doc) for x in prohibited(v, f"{at}/{i}")]
    if not isinstance(doc, dict):
        return []
    return [x for k, v in doc.items() if k != "extensions" for x in ([f"{at}/{k}"] if k in PROHIBITED else []) + prohibited(v, f"{at}/{k}")]


def untrimmed(doc: Any, at: str = "") -> list[str]:
    """Pointers to strings with white space around them; lists are not entered."""
    if isinstance(doc, str):
        return [at] if doc != doc.strip() else []
    return [x for k, v in doc.items() for x in untrimmed(v, f"{at}/{k}")] if isinstance(doc, dict) else []


TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return (isinstance(value, int) and not isinstance(value, bool)) or (isinstance(value, float) and value.is_integer())
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, TYPES[kind]) and not (kind != "boolean" and isinstance(value, bool))


def schema_violations(doc: Any, schema: dict, root: dict | None = None, at: str = "", following: tuple = ()) -> list[dict]:
    """Where a document breaks a schema of the supported subset: pointer, keyword, message.

    References that lead back to themselves at one place of the document are a violation (keyword `$ref`).
    """
    root = schema if root is None else root
    out: list[dict] = []
    bad = lambda keyword, message: out.append({"instance_path": at, "keyword": keyword, "message": message})
    if schema.get("$ref") in following:
        bad("$ref", f"reference {schema['$ref']} leads back to itself")
        return out
    if "$ref" in schema:
        target: Any = root
        for part in schema["$ref"].removeprefix("#").strip("/").split("/"):
            target = target[part] if part else target
        out += schema_violations(doc, target, root, at, (*following, schema["$ref"]))
    kinds = schema.get("type")
    if kinds and not any(_is(doc, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        bad("type", f"must be {kinds if isinstance(kinds, str) else ' or '.join(kinds)}")
        return out
    if "const" in schema and doc != schema["const"]:
        bad("const", f"must be {json.dumps(schema['const'])}")
    if "enum" in schema and doc not in schema["enum"]:
        bad("enum", "must be one of the listed values")
    if isinstance(doc, str):
        if "pattern" in schema and not re.search(schema["pattern"], doc):
            bad("pattern", f"must match {schema['pattern']}")
        if len(doc) < schema.get("minLength", 0):
            bad("minLength", f"must have {schema['minLength']} characters at least")
        if "maxLength" in schema and len(doc) > schema["maxLength"]:
            bad("maxLength", f"must have {schema['maxLength']} characters at most")
    if _is(doc, "number"):
        if "minimum" in schema and doc < schema["minimum"]:
            bad("minimum", f"must be {schema['minimum']} at least")
        if "maximum" in schema and doc > schema["maximum"]:
            bad("maximum", f"must be {schema['maximum']} at most")
    if isinstance(doc, list):
        if len(doc) < schema.get("minItems", 0):
            bad("minItems", f"must have {schema['minItems']} items at least")
        if "maxItems" in schema and len(doc) > schema["maxItems"]:
            bad("maxItems", f"must have {schema['maxItems']} items at most")
        if schema.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in doc}) < len(doc):
            bad("uniqueItems", "must not repeat an item")
        if "items" in schema:
            for i, x in enumerate(doc):
                out += schema_violations(x, schema["items"], root, f"{at}/{i}")
    if isinstance(doc, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in doc:
                bad("required", f"must have {name}")
        for k, v in doc.items():
            if k in known:
                out += schema_violations(v, known[k], root, f"{at}/{k}")
            elif schema.get("additionalProperties") is False:
                bad("additionalProperties", f"must not have {k}")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += schema_violations(v, schema["additionalProperties"], root, f"{at}/{k}")
    for s in schema.get("allOf", []):
        out += schema_violations(doc, s, root, at, following)
    if "anyOf" in schema and all(schema_violations(doc, s, root, at, following) for s in schema["anyOf"]):
        bad("anyOf", "must match one of several forms")
    if "oneOf" in schema and (n := sum(not schema_violations(doc, s, root, at, following) for s in schema["oneOf"])) != 1:
        bad("oneOf", f"must match exactly one of several forms, matches {n}")
    if "not" in schema and not schema_violations(doc, schema["not"], root, at, following):
        bad("not", "must not match a refused form")
    return out


def validate_json(rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """rows with `violations` of a JSON text column (an array of structs)."""
    import pandas as pd

    def check(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(schema_violations(json.loads(t), schema))
            except (TypeError, ValueError) as x:
                out.append([{"instance_path": "", "keyword": "json", "message": str(x)}])
        return pd.Series(out, dtype=object)

    run = F.pandas_udf(check, "array<struct<instance_path:string,keyword:string,message:string>>", F.PandasUDFType.SCALAR)
    return rows.withColumn("violations", run(column))


def summary(violations: Column, n: int = 8) -> Column:
    """The first n violations as one text."""
    return F.array_join(F.slice(F.transform(violations, lambda v: F.concat(v["instance_path"], F.lit(" "), v["message"])), 1, n), "; ")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
