"""Audits: classes of facts, orphans, contradictions between documents and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_name


def classify(notes: DataFrame) -> DataFrame:
    """(fact, class, why) from (fact, ord, cls, why): the first note's class, then a fold in order.

    A conflict or an open question always takes over, so that the last of them decides; CONFIRMED takes over from DERIVED
    only; the rest leave the class. why is of the first four notes that have one, which a limit by fact finds before the
    exchange: no list of all notes of a fact is made.
    """
    place = F.struct("ord", "cls", "why")
    takes = F.col("cls").isin("CONFLICT", "UNRESOLVED")
    g = notes.groupBy("fact").agg(F.min(place).alias("first"), F.max(F.when(takes, place)).alias("last"), F.bool_or(F.col("cls") == "CONFIRMED").alias("confirmed"))
    kept = F.when((F.col("first.cls") == "DERIVED") & F.col("confirmed"), "CONFIRMED").otherwise(F.col("first.cls"))
    heads = notes.where("why is not null").withColumn("n", F.row_number().over(Window.partitionBy("fact").orderBy("ord", "cls", "why"))).where("n <= 4")
    why = heads.groupBy("fact").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "why"))), lambda x: x["why"]).alias("why"))
    out = g.join(why, "fact", "left")
    return out.select("fact", F.coalesce("last.cls", kept).alias("class"), F.coalesce("why", F.array().cast("array<string>")).alias("why"))


def fact_notes(facts: DataFrame) -> DataFrame:
    """Notes of assertions (subject, key, ord, status, evidence_class)."""
    cls = F.when(F.col("evidence_class") == "OBSERVED_RUNTIME", "OBSERVED").when(F.col("status").isin("unresolved", "candidate"), "UNRESOLVED").otherwise("DERIVED")
    return facts.select(F.concat_ws(" ", "subject", "key").alias("fact"), "ord", cls.alias("cls"), F.col("evidence_class").alias("why"))


def conflict_notes(elections: DataFrame, after: int = 1 << 40) -> DataFrame:
    """Notes of conflicts, which come after those of assertions: settled ones are known, others are conflicts."""
    settled = F.col("conflict_status").isin("resolved", "accepted")
    return elections.where("conflict_status is not null").select(F.concat_ws(" ", "subject", "key").alias("fact"), F.lit(after).alias("ord"), F.when(settled, "DERIVED").otherwise("CONFLICT").alias("cls"), F.col("conflict_kind").alias("why"))


def counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.count("*").alias("n"))


def orphans(documents: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Documents that nothing refers to."""
    return documents.join(linked.select(key).distinct(), key, "left_anti")


def unverified(components: DataFrame, checks: DataFrame) -> DataFrame:
    """Components (ref) without a check."""
    return components.join(checks.select(F.explode("component_refs").alias("ref")).distinct(), "ref", "left_anti")


def undocumented(components: DataFrame) -> DataFrame:
    return components.where(F.coalesce(F.size("docs"), F.lit(0)) <= 0)


#: How a document names a port, and how it denies a component.
PORT = r"(?i)\bport\s*([0-9]{4,5})\b"
NEGATED = r"(?i)\b(?:there (?:is|are)|we have)\s+no\s+([a-z][a-z0-9-]{2,30})\b"


def port_claims(documents: DataFrame, key: str) -> DataFrame:
    """(key, port) of each port that a text names."""
    return documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PORT), F.lit(1)))).alias("port"))


def port_contradictions(claims: DataFrame, links: DataFrame, ports: DataFrame, key: str) -> DataFrame:
    """Claims of documents linked (key, ref) to a component whose port fact differs; unlinked claims have no ref."""
    j = claims.join(links, key, "left").join(ports.select("ref", F.col("port").alias("fact")), "ref", "left")
    verdict = F.when(F.col("ref").isNull(), "unlinked").when(F.col("fact") != F.col("port"), "mismatch")
    return j.withColumn("verdict", verdict).where("verdict is not null").select(key, "ref", "port", "fact", "verdict")


def negated_components(documents: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, claim, ref) where a text denies a component (name, ref) that exists; names match in their normal form."""
    said = documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NEGATED), F.lit(1)))).alias("claim"))
    known = names.select(normalise_name(F.col("name")).alias("plain"), "ref")
    return said.withColumn("plain", normalise_name(F.col("claim"))).join(known, "plain").select(key, "claim", "ref")


def unclassified(dependencies: DataFrame, externals: DataFrame, internal: DataFrame, sample: int = 40) -> DataFrame:
    """The first dependencies (component, name) that are no unit's name, of components without any external."""
    left = dependencies.join(externals.select("component").distinct(), "component", "left_anti").join(internal.select("name").distinct(), "name", "left_anti")
    return left.distinct().orderBy("component", "name").limit(sample)


def reviewed(lists: dict[str, DataFrame]) -> DataFrame:
    """(kind, item) of all lists that await a review."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), F.col(df.columns[0]).cast("string").alias("item")) for k, df in lists.items()])


def document_candidates(files: DataFrame, depth: int = 3, cap: int = 200) -> DataFrame:
    """Documents near the root, at most cap."""
    p: Column = F.col("path")
    return files.where(p.rlike(r"\.(md|mdx|adoc|rst|txt)$") & (F.size(F.split(p, "/")) <= depth)).orderBy("path").limit(cap)


#: What a value of the compiling machine looks like. Host paths count where they begin a value.
MACHINE = [
    ("absolute Windows path", r"^(?:/[A-Za-z]:\\|\\\\)"),
    ("absolute host path", r"^(?:/home/|/Users/|/root/|/var/folders/|/private/tmp/|/opt/)"),
    ("process identity", r"\bprocess\.pid\b"),
    ("escaped path", r"\bnode_modules/\.\."),
]
TIMESTAMP = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z)\b"
#: Fields of free text, which a repository's author wrote; they are masked before the scan.
FREE_TEXT = """
description semantics detail reason reviewWhen command role notes rationale value locator summary provenance title reviewer
collectedAt
""".split()


def machine_values(rows: DataFrame, columns: list[str], allowed: DataFrame) -> DataFrame:
    """(column, value, kind) of values of the machine, and of timestamps that no observation allows.

    Only structural columns are looked at: those named like a field of free text are left out.
    """
    out = None
    for c in (c for c in columns if c not in FREE_TEXT):
        hits = F.array_compact(F.array(*[F.when(F.col(c).rlike(p), F.struct(F.col(c).alias("value"), F.lit(why).alias("kind"))) for why, p in MACHINE]))
        stamps = F.transform(F.regexp_extract_all(c, F.lit(TIMESTAMP), F.lit(1)), lambda v: F.struct(v.alias("value"), F.lit("timestamp").alias("kind")))
        found = rows.select(F.lit(c).alias("column"), F.explode(F.concat(hits, stamps)).alias("f")).select("column", "f.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select(F.lit("").alias("column"), F.lit("").alias("value"), F.lit("").alias("kind")).where("false")
    return out.distinct().join(allowed.select(F.col("captured_at").alias("value")).distinct(), "value", "left_anti").select("column", "value", "kind")
