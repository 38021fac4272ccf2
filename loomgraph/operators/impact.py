"""What a change touches: path kinds, affected components with reasons, recommended checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import top
from .own import longest_owner

#: Names that say what a file is.
DOCUMENT = r"\.(md|mdx|adoc|rst|txt)$"
MIGRATION = r"(^|/)(migrations?|alembic/versions)/"
WORKFLOW = r"\.github/workflows/"


def classify(files: DataFrame, contracts: DataFrame, docs: DataFrame, migrations: DataFrame | None, inputs: DataFrame | Column, resources: DataFrame | None = None) -> DataFrame:
    """files (path) with `kind` by the first that holds: contract, documentation, resource, verification, input; else null.

    inputs are paths, or what says of each file by itself whether it is one, where several files share a path.
    """
    flag = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    j = files.join(flag(contracts, "c_"), "path", "left").join(flag(docs, "d_"), "path", "left")
    j = j.withColumn("i_", inputs) if isinstance(inputs, Column) else j.join(flag(inputs, "i_"), "path", "left")
    j = j.join(flag(resources, "r_"), "path", "left") if resources is not None else j.withColumn("r_", F.lit(None).cast("boolean"))
    j = longest_owner(j, migrations) if migrations is not None else j.withColumn("owner", F.lit(None).cast("string"))
    p = F.col("path")
    kind = (
        F.when(F.col("c_"), "contract").when(F.col("d_") | p.rlike(DOCUMENT), "documentation").when(F.col("owner").isNotNull() | p.rlike(MIGRATION) | F.col("r_"), "resource")
        .when(p.rlike(r"\.ya?ml$") & p.rlike(WORKFLOW), "verification").when(F.col("i_"), "input")
    )
    return j.withColumn("kind", kind).drop("c_", "d_", "i_", "r_", "owner")


def migration_hits(files: DataFrame, declared: DataFrame, detected: DataFrame) -> DataFrame:
    """files with `migration_dir` and `made_by`: the longest declared directory, else the longest detected one."""
    a = longest_owner(files, declared).withColumnRenamed("owner", "declared_")
    b = longest_owner(a, detected).withColumnRenamed("owner", "detected_")
    return b.withColumn("migration_dir", F.coalesce("declared_", "detected_")).withColumn("made_by", F.when(F.col("declared_").isNotNull(), "declared").when(F.col("detected_").isNotNull(), "detected")).drop("declared_", "detected_")


def affected(rows: DataFrame) -> DataFrame:
    """(ref, reasons) from (ref, reason): distinct reasons in order."""
    return rows.groupBy("ref").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))


def hop_reasons(distances: DataFrame, through: bool = True) -> DataFrame:
    """(ref, reason) of dependents: how many hops, and through which node where it is more than one."""
    hops = F.when(F.col("distance") == 1, "1 hop").otherwise(F.concat(F.col("distance").cast("string"), F.lit(" hops")))
    if through:
        hops = F.when(F.col("distance") == 1, hops).otherwise(F.concat(hops, F.lit(", through "), "next"))
    return distances.where("distance > 0").select("ref", hops.alias("reason"))


def resource_users(relations: DataFrame, changed: DataFrame) -> DataFrame:
    """Components bound to exactly the changed resources."""
    r = relations.where("type = 'usesResource'").join(changed, relations["target_ref"] == changed["ref"]).select("source_ref", "target_ref")
    return r.select(F.col("source_ref").alias("ref"), F.concat(F.lit("uses "), "target_ref").alias("reason"))


def contract_users(relations: DataFrame, changed: DataFrame) -> DataFrame:
    """Providers and consumers of the changed APIs."""
    r = relations.where("type in ('providesApi', 'consumesApi')").join(changed, relations["target_ref"] == changed["ref"]).select("type", "source_ref", "target_ref")
    verb = F.when(F.col("type") == "providesApi", "provides ").otherwise("consumes ")
    return r.select(F.col("source_ref").alias("ref"), F.concat(verb, F.split_part("target_ref", F.lit("/"), F.lit(2))).alias("reason"))


def document_users(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """Owners of changed documents: docs (ref, path), changed (path)."""
    return docs.join(changed, "path").select("ref", F.concat(F.lit("documented by "), "path").alias("reason"))


def config_users(verification: DataFrame, changed: DataFrame) -> DataFrame:
    """Components whose checks are configured by changed paths."""
    rows = verification.select("component_refs", F.explode("config_paths").alias("path")).join(changed, "path")
    return rows.select(F.explode("component_refs").alias("ref"), F.concat(F.lit("checked by "), "path").alias("reason"))


def first_degree(relations: DataFrame, refs: DataFrame) -> DataFrame:
    """Components one runtime call or schedule away from refs."""
    r = relations.where("type in ('runtimeCalls', 'runtimeCalledBy', 'schedules', 'scheduledBy')")
    return r.join(refs, r["source_ref"] == refs["ref"]).select(F.col("target_ref").alias("ref"), F.concat("type", F.lit(" "), "source_ref").alias("reason"))


def recommended(ranked: DataFrame, gates: DataFrame, n: int) -> DataFrame:
    """The first n checks, gates after all others, with the total."""
    both = ranked.select("check_id", "rank", F.lit(0).alias("gate")).unionByName(gates.select("check_id", F.lit(None).cast("int").alias("rank"), F.lit(1).alias("gate")))
    return top(both, ["gate", "rank", "check_id"], n)


def related(rows: DataFrame, refs: DataFrame, column: str = "components") -> DataFrame:
    """Journeys or other rows with a list of refs that share one with refs."""
    hit = rows.select("id", F.explode(column).alias("ref")).join(refs, "ref", "left_semi").select("id").distinct()
    return rows.join(hit, "id", "left_semi")


def will_be_stale(changed: DataFrame, inputs: DataFrame) -> bool:
    """Whether a change touches an input of the graph."""
    return not changed.join(inputs, "path", "left_semi").isEmpty()
