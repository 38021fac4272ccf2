"""The relation set: identity, inverses, merging, checks, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import kind_of
from ..functions.values import canonical_attrs

#: Relation types, their inverses, and the kinds they join.
TYPES = [
    ("partOf", "hasPart", ["component>system", "component>domain", "system>domain", "resource>system"]),
    ("providesApi", "apiProvidedBy", ["component>api"]),
    ("consumesApi", "apiConsumedBy", ["component>api"]),
    ("buildDependsOn", "buildDependencyOf", ["component>component"]),
    ("testDependsOn", "testDependencyOf", ["component>component"]),
    ("runtimeCalls", "runtimeCalledBy", ["component>component"]),
    ("usesResource", "resourceUsedBy", ["component>resource"]),
    ("schedules", "scheduledBy", ["component>component"]),
]
#: Attributes that each type may carry.
ATTRIBUTES = {
    "partOf": [], "providesApi": [], "consumesApi": ["via"], "buildDependsOn": ["via", "package"], "testDependsOn": ["via", "package"],
    "runtimeCalls": ["transport", "contractRef", "deliverySemantics"], "usesResource": ["via", "client"], "schedules": ["via", "route"],
}
#: Transports of runtime calls.
TRANSPORTS = ["http", "service-binding", "signed-http", "grpc", "queue", "in-process"]


IDENTITY = ["type", "source_ref", "target_ref", "attrs_key"]


def inverses(spark: SparkSession) -> DataFrame:
    """(type, inverse) in both directions; a fixed table of 16 rows."""
    rows = [(a, b) for a, b, _ in TYPES] + [(b, a) for a, b, _ in TYPES]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("inverse")) for a, b in rows])))


def identity(relations: DataFrame) -> DataFrame:
    """relations with attrs_key and identity (without `via`)."""
    key = canonical_attrs(F.col("attrs"))
    return relations.withColumn("attrs_key", key).withColumn("identity", F.concat_ws("|", "type", "source_ref", "target_ref", key))


def with_inverses(relations: DataFrame) -> DataFrame:
    """Each edge and its inverse."""
    table = F.broadcast(inverses(relations.sparkSession))  # fixed table
    swap = {"source_ref": "target_ref", "target_ref": "source_ref", "type": "inverse"}
    turned = relations.join(table, "type").select(*[F.col(swap.get(c, c)).alias(c) for c in relations.columns])
    return relations.unionByName(turned)


def missing_inverses(relations: DataFrame) -> DataFrame:
    """Edges whose inverse is not in the set."""
    table = F.broadcast(inverses(relations.sparkSession))  # fixed table
    wanted = relations.join(table, "type")
    there = relations.select(F.col("type").alias("t"), F.col("source_ref").alias("s"), F.col("target_ref").alias("d"))
    return wanted.join(there, (F.col("inverse") == F.col("t")) & (F.col("target_ref") == F.col("s")) & (F.col("source_ref") == F.col("d")), "left_anti").select("type", "source_ref", "target_ref")


def merge(edges: DataFrame) -> DataFrame:
    """One row an identity from edges (type, source_ref, target_ref, attrs_key, via, evidence_class, prov).

    Routes unite; provenance is counted (n_prov) and its ids are rows of `merged_provenance`, as an identity may have any
    number of them. The class is kept for a single edge; merged ones have their one class, else REVIEWED_OVERRIDE if it is
    among them, else DERIVED.
    """
    once = edges.groupBy(*IDENTITY, "prov").agg(F.collect_set("via").alias("via"), F.collect_set("evidence_class").alias("classes"), F.count("*").alias("n"))
    unite = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    g = once.groupBy(*IDENTITY).agg(unite("via"), unite("classes"), F.count("prov").alias("n_prov"), F.sum("n").alias("n"))
    cls = F.when(F.size("classes") == 1, F.element_at("classes", 1)).when(F.array_contains("classes", "REVIEWED_OVERRIDE"), "REVIEWED_OVERRIDE").otherwise("DERIVED")
    return g.select(*IDENTITY, "via", "n_prov", "n", cls.alias("evidence_class"))


def merged_provenance(edges: DataFrame) -> DataFrame:
    """(type, source_ref, target_ref, attrs_key, prov): the provenance of every identity, once each."""
    return edges.select(*IDENTITY, "prov").where("prov is not null").distinct()


def violations(relations: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(type, source_ref, target_ref, problem) of edges of unknown types, wrong kinds, or unresolved ends."""
    pairs = F.create_map(*[x for t, inv, ks in TYPES for x in (F.lit(t), F.array(*[F.lit(k) for k in ks]), F.lit(inv), F.array(*[F.lit(">".join(reversed(k.split(">")))) for k in ks]))])
    allowed = F.try_element_at(pairs, F.col("type"))
    pair = F.concat(kind_of(F.col("source_ref")), F.lit(">"), kind_of(F.col("target_ref")))
    problem = F.when(allowed.isNull(), "unknown-type").when(~F.array_contains(allowed, pair), "kind-pair")
    found = relations.withColumn("problem", problem).where("problem is not null").select("type", "source_ref", "target_ref", "problem")
    if refs is None:
        return found
    known = refs.select(F.col("ref").alias("known_ref")).distinct()
    for end in ("source_ref", "target_ref"):
        lost = relations.join(known, F.col(end) == F.col("known_ref"), "left_anti").select("type", "source_ref", "target_ref", F.lit(f"unresolved-{end[:6]}").alias("problem"))
        found = found.unionByName(lost)
    return found


def attribute_violations(relations: DataFrame) -> DataFrame:
    """Attributes that a type or its inverse may not carry, bad transports, and calls without a contract."""
    turned = {a: b for a, b, _ in TYPES}
    both = [(t, names) for of, names in ATTRIBUTES.items() for t in (of, turned[of])]
    table = F.create_map(*[x for t, names in both for x in (F.lit(t), F.array(*[F.lit(n) for n in names]).cast("array<string>"))])
    allowed = F.coalesce(F.try_element_at(table, F.col("type")), F.array().cast("array<string>"))
    odd = F.array_except(F.map_keys("attrs"), allowed)
    call = F.col("type") == "runtimeCalls"
    out = relations.select("type", "source_ref", "target_ref", F.explode(F.array_compact(F.concat(
        F.transform(odd, lambda k: F.concat(F.lit("attribute:"), k)),
        F.array(F.when(call & ~F.coalesce(F.col("attrs")["transport"].isin(*TRANSPORTS), F.lit(False)), F.lit("transport"))),
        F.array(F.when(call & F.col("attrs")["contractRef"].isNull(), F.lit("contract-ref"))),
    ))).alias("problem"))
    return out


def contract_duplicates(relations: DataFrame) -> DataFrame:
    """relations with `dropped`: whether it is a runtime call for a contract that the source already consumes."""
    consumed = relations.where("type = 'consumesApi'").select(F.col("source_ref").alias("s"), F.col("target_ref").alias("api")).distinct()
    hit = (F.col("type") == "runtimeCalls") & (F.col("source_ref") == F.col("s")) & (F.col("attrs")["contractRef"] == F.col("api"))
    return relations.join(consumed, hit, "left").withColumn("dropped", F.col("s").isNotNull()).drop("s", "api")


def drop_contract_duplicates(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by `contract_duplicates`."""
    told = contract_duplicates(relations)
    return told.where("not dropped").drop("dropped"), told.where("dropped").drop("dropped")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(type, source_ref, target_ref, side): edges in both, in the left or in the right set only."""
    cols = ["type", "source_ref", "target_ref"]
    a, b = left.select(*cols).distinct().withColumn("l", F.lit(1)), right.select(*cols).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("shared")
    return a.join(b, cols, "full_outer").select(*cols, side.alias("side"))
