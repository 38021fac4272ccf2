"""Context queries: resolving a needle, budgeted sections, neighbours, review commitments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, canonical_path, contract_covers, join_path, looks_like_ref, parent_path
from .own import longest_owner

#: Rows a section shows unless the caller says otherwise.
BUDGETS = {"relations": 40, "events": 20, "externals": 15, "capabilities": 10, "verification": 12, "journeys": 10, "conflicts": 20, "assertions": 25, "provenance": 20, "contracts": 10}


def resolve(needles: DataFrame, entities: DataFrame, docs: DataFrame, owners: DataFrame, contracts: DataFrame) -> DataFrame:
    """needles with `ref` and `how`, by precedence: ref, doc, owner below the root, contract's API, root owner.

    entities (ref), docs (path, ref, ord: first wins), owners (root, ref), contracts (ref, api_ref). What looks like a ref
    and is none resolves to nothing.
    """
    n = needles.select("needle").distinct().withColumn("is_ref", looks_like_ref(F.col("needle"))).withColumn("path", canonical_path(F.col("needle")))
    by_ref = n.join(entities.select(F.col("ref").alias("ref")), n["needle"] == F.col("ref")).select("needle", "ref", F.lit(1).alias("prio"), F.lit("ref").alias("how"))
    files = n.where("not is_ref and path is not null")
    first = docs.groupBy("path").agg(F.min_by("ref", "ord").alias("ref"))
    by_doc = files.join(first, "path").select("needle", "ref", F.lit(2).alias("prio"), F.lit("doc").alias("how"))
    own = longest_owner(files, owners.select("root")).join(owners.select(F.col("root").alias("owner"), "ref"), "owner")
    by_owner = own.select("needle", "ref", F.when(F.col("owner") == ".", 5).otherwise(3).alias("prio"), F.when(F.col("owner") == ".", "root-owner").otherwise("owner").alias("how"))
    c = covering_contract(files, contracts).where("api_ref is not null")
    by_contract = c.select("needle", F.col("api_ref").alias("ref"), F.lit(4).alias("prio"), F.lit("contract").alias("how"))
    hits = by_ref.unionByName(by_doc).unionByName(by_owner).unionByName(by_contract)
    best = hits.groupBy("needle").agg(F.min_by(F.struct("ref", "how"), F.struct("prio", "ref")).alias("b")).select("needle", "b.ref", "b.how")
    return needles.join(best, "needle", "left")


def covering_contract(files: DataFrame, contracts: DataFrame, path: str = "path") -> DataFrame:
    """files with `contract_ref` and `api_ref` of the longest contract that covers their path.

    Candidates come from a hash join on what a covering contract can be: an ancestor, or a file beside it by stem.
    """
    p = F.col(path)
    keys = files.select(p.alias("p_")).distinct().select("p_", F.explode(F.array_distinct(F.concat(ancestors(F.col("p_")), _stems(F.col("p_"))))).alias("ref_"))
    c = contracts.select(F.col("ref").alias("ref_"), "api_ref")
    hit = keys.join(c, "ref_").where(contract_covers(F.col("ref_"), F.col("p_")))
    best = hit.groupBy("p_").agg(F.max_by(F.struct("ref_", "api_ref"), F.struct(F.length("ref_"), "ref_")).alias("b"))
    return files.join(best.select("p_", F.col("b.ref_").alias("contract_ref"), F.col("b.api_ref").alias("api_ref")), files[path] == F.col("p_"), "left").drop("p_")


def _stems(p: Column) -> Column:
    """Paths beside p that are its name up to one of its dots."""
    parts = F.split(base_name(p), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: join_path(parent_path(p), F.array_join(F.slice(parts, F.lit(1), i), ".")))


def section(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key with `total` and `truncated`; a hub is counted and cut before its rows meet."""
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = rows.withColumn("position", place).where(F.col("position") <= n).withColumn("position", F.col("position").cast("int"))
    return first.join(totals, key).withColumn("truncated", F.col("total") > n)


def relations_of(relations: DataFrame, subjects: DataFrame) -> DataFrame:
    """Edges at subjects (ref): (ref, type, other, direction). An edge shows at both of its ends."""
    out = relations.join(subjects, relations["source_ref"] == subjects["ref"]).select("ref", "type", F.col("target_ref").alias("other"), F.lit("out").alias("direction"))
    into = relations.join(subjects, relations["target_ref"] == subjects["ref"]).select("ref", "type", F.col("source_ref").alias("other"), F.lit("in").alias("direction"))
    return out.unionByName(into)


def neighbours(relations: DataFrame, subjects: DataFrame) -> DataFrame:
    """(ref, other): distinct targets of each subject, itself left out."""
    return relations.join(subjects, relations["source_ref"] == subjects["ref"]).where("target_ref <> ref").select("ref", F.col("target_ref").alias("other")).distinct()


def commitments(overrides: DataFrame, elections: DataFrame, acceptances: DataFrame) -> DataFrame:
    """(source, subject, review_when) of all that was settled by review; it is not narrowed to a subject."""
    pick = lambda df, name: df.where("review_when is not null").select(F.lit(name).alias("source"), "subject", "review_when")
    return pick(overrides, "override").unionByName(pick(elections, "election")).unionByName(pick(acceptances, "acceptance"))


def event_owners(interfaces: DataFrame, contract_owner: DataFrame, subjects: DataFrame) -> DataFrame:
    """(ref, pattern) of events that a subject produces, consumes or owns through the contract."""
    j = interfaces.join(contract_owner, "contract_ref", "left")
    ends = F.array_compact(F.array_union(F.array_union("producers", "consumers"), F.array("owner_ref")))
    return j.select("pattern", F.explode(ends).alias("ref")).join(subjects, "ref").select("ref", "pattern").distinct()


def collected_provenance(sections: list[DataFrame]) -> DataFrame:
    """Distinct provenance ids of sections (ref, prov_ids); capabilities are not passed in."""
    out = sections[0].select("ref", "prov_ids")
    for s in sections[1:]:
        out = out.unionByName(s.select("ref", "prov_ids"))
    return out.select("ref", F.explode("prov_ids").alias("prov_id")).distinct()


def truncations(sections: dict[str, DataFrame]) -> DataFrame:
    """(ref, section, shown, total) of sections that were cut."""
    out = None
    for name, df in sections.items():
        cut = df.where("truncated").groupBy("ref").agg(F.count("*").alias("shown"), F.max("total").alias("total")).select("ref", F.lit(name).alias("section"), "shown", "total")
        out = cut if out is None else out.unionByName(cut)
    return out


def markdown(title: str, sections: dict[str, list[str]]) -> str:
    """A context as Markdown: a heading and a list for each section that has rows."""
    out = [f"# {title}"]
    for name, rows in sections.items():
        if rows:
            out += ["", f"## {name}", "", *[f"- {r}" for r in rows]]
    return "\n".join(out) + "\n"
