"""What people write about a system: descriptors, journeys, observation sets, reviewed overrides; files to rows, checks as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import owns_path, parent_path
from ..functions.text import secret_form
from ..plans.settle import settle
from . import parsers

DESCRIPTOR = "line int, kind string, name string, description string, type string, system string, domain string, provider string, contract string, docs array<string>, constraints array<string>, runbooks array<string>"
JOURNEY = "id string, description string, components array<string>"
OBSERVATION = "set string, environment string, captured_at string, max_age_days int, bundle string, supersedes string, id string, subject string, key string, value_json string"
OVERRIDE = "n int, fact string, subject string, target string, contract string, reason string, review_when string, evidence_path string, evidence_sha256 string"


def _read(files: DataFrame, parser: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refusals) of files (path, text); settled, so that no text is read again for each check of its rows."""
    found = settle(parsers.rows(files.select("path", "text"), parser, schema).drop("text"))
    return found.where("error is null").drop("error", "error_line"), found.where("error is not null").select("path", F.col("error_line").alias("line"), F.col("error").alias("message"))


def descriptors(files: DataFrame, namespace: str = "default") -> tuple[DataFrame, DataFrame]:
    """(entities, refusals): a row a descriptor, with its ref; a component's source is the directory of its file."""
    rows, refused = _read(files, "descriptors", DESCRIPTOR)
    named = rows.where("kind is not null and name is not null")
    ref = F.concat(F.lower("kind"), F.lit(f":{namespace}/"), "name")
    return named.withColumn("ref", ref).withColumn("source_path", F.when(F.col("kind") == "Component", parent_path(F.col("path")))), refused


def placements(entities: DataFrame, namespace: str = "default") -> DataFrame:
    """partOf edges (type, source_ref, target_ref, prov): a component to its system, else its domain; a system to its domain; a resource to its system."""
    to = lambda kind, c: F.concat(F.lit(f"{kind}:{namespace}/"), F.col(c))
    target = (
        F.when((F.col("kind").isin("Component", "Resource")) & F.col("system").isNotNull(), to("system", "system"))
        .when(F.col("kind").isin("Component", "System") & F.col("domain").isNotNull(), to("domain", "domain"))
    )
    return entities.select(F.lit("partOf").alias("type"), F.col("ref").alias("source_ref"), target.alias("target_ref"), F.col("path").alias("prov")).where("target_ref is not null")


def providers(entities: DataFrame) -> DataFrame:
    """(ref, provider, contract, prov) of API descriptors."""
    return entities.where("kind = 'API' and provider is not null").select("ref", "provider", "contract", F.col("path").alias("prov"))


def misplaced(entities: DataFrame, component_file: str, central: dict[str, str]) -> DataFrame:
    """(ref, path, kind) of components that are not in a file of the given name, and of others that are not in the file of their kind."""
    base = F.element_at(F.split("path", "/"), -1)
    home = F.element_at(F.create_map(*[F.lit(x) for pair in central.items() for x in pair]), F.col("kind")) if central else F.lit(None)
    ok = F.when(F.col("kind") == "Component", base == component_file).otherwise(F.col("path") == home)
    return entities.where(~F.coalesce(ok, F.lit(False))).select("ref", "path", "kind")


def journeys(files: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journeys, unknown): unknown has (id, ref) of components that no descriptor names."""
    rows, _ = _read(files, "journeys", JOURNEY)
    rows = rows.select("id", "description", "components", "path")
    named = rows.select("id", F.explode("components").alias("ref")).distinct()
    return rows, named.join(refs.select("ref").distinct(), "ref", "left_anti").select("id", "ref")


def observations(files: DataFrame, refs: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, problems): problems has (path, set, key, problem) of unknown subjects, repeated keys, absent bundles and secrets."""
    rows, _ = _read(files, "observations", OBSERVATION)
    lost = rows.join(refs.select(F.col("ref").alias("subject")).distinct(), "subject", "left_anti").select("path", "set", "key", F.lit("unresolved-subject").alias("problem"))
    again = rows.groupBy("path", "set", "key").agg(F.count("*").alias("n")).where("n > 1").select("path", "set", "key", F.lit("repeated-key").alias("problem"))
    absent = rows.select("path", "set", F.col("bundle")).distinct().join(inputs.select(F.col("path").alias("bundle")).distinct(), "bundle", "left_anti").select("path", "set", F.lit(None).cast("string").alias("key"), F.lit("absent-bundle").alias("problem"))
    secret = rows.where(secret_form(F.col("value_json")).isNotNull()).select("path", "set", "key", F.lit("secret").alias("problem"))
    return rows, lost.unionByName(again).unionByName(absent).unionByName(secret)


def fact_rows(facts: DataFrame) -> DataFrame:
    """Observed facts as rows for elections: (subject, key, value_json, evidence_class, confidence, observed_at, ord)."""
    return facts.select("subject", "key", "value_json", F.lit("OBSERVED_RUNTIME").alias("evidence_class"), F.lit("deterministic").alias("confidence"), F.col("captured_at").alias("observed_at"), F.xxhash64("path", "set", "id", "key").alias("ord"))


def overrides(files: DataFrame, entities: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overrides, problems): evidence is verified against inputs (path, sha256) and must lie with its subject, its target or its contract."""
    rows, _ = _read(files, "overrides", OVERRIDE)
    root = entities.select("ref", parent_path(F.col("path")).alias("root"))
    j = rows.join(inputs.select(F.col("path").alias("evidence_path"), F.col("sha256").alias("now")), "evidence_path", "left")
    j = j.join(root.select(F.col("ref").alias("subject"), F.col("root").alias("subject_root")), "subject", "left").join(root.select(F.col("ref").alias("target"), F.col("root").alias("target_root")), "target", "left")
    inside = F.coalesce(F.col("evidence_path") == F.col("contract"), F.lit(False)) | F.coalesce(owns_path(F.col("subject_root"), F.col("evidence_path")), F.lit(False)) | F.coalesce(owns_path(F.col("target_root"), F.col("evidence_path")), F.lit(False))
    problem = F.when(F.col("subject_root").isNull(), "unresolved-subject").when(F.col("now").isNull(), "absent-evidence").when(F.col("now") != F.col("evidence_sha256"), "changed-evidence").when(~inside, "outside-scope")
    seen = j.withColumn("problem", problem)
    bad = seen.where("problem is not null").select("path", "n", "evidence_path", "problem")
    twice = rows.groupBy("path", "n", "evidence_path").agg(F.count("*").alias("c")).where("c > 1").select("path", "n", "evidence_path", F.lit("repeated-evidence").alias("problem"))
    problems = bad.unionByName(twice)
    kept = rows.select("path", "n", "fact", "subject", "target", "contract", "reason", "review_when").distinct()
    return kept.join(problems.select("path", "n").distinct(), ["path", "n"], "left_anti"), problems
