"""Context of one subject, assembled from the sections of a graph, and the other questions a user asks of a graph.

A graph is a dict of DataFrames (see GRAPH for the columns that are read; missing sections count as empty). A context is
rows (section, position, item, total, truncated): item is a JSON text, position its place in the section.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import secret_form
from ..operators import closure, context, impact, provenance, relations

#: Sections of a graph and the columns that contexts read.
GRAPH = {
    "entities": "ref string, kind string, name string, description string, source_path string, docs array<string>, constraints array<string>, runbooks array<string>, prov_ids array<string>",
    "relations": "type string, source_ref string, target_ref string, evidence_class string, prov_ids array<string>",
    "events": "pattern string, producers array<string>, consumers array<string>, contract_ref string, resolution string, prov_ids array<string>",
    "externals": "component string, name string, role string, mechanism string, evidence_class string, prov_ids array<string>",
    "capabilities": "component string, name string, evidence_class string", "contracts": "ref string, api_ref string, prov_ids array<string>",
    "verification": "id string, tier string, command string, component_refs array<string>, config_paths array<string>, prov_ids array<string>",
    "journeys": "id string, description string, components array<string>, prov_ids array<string>",
    "conflicts": "subject string, key string, kind string, status string, prov_ids array<string>, review_when string",
    "assertions": "id string, subject string, key string, value string, evidence_class string, status string, prov_ids array<string>, review_when string",
    "provenance": "id string, class string, path string, extractor string", "gates": "id string, tier string, command string",
    "diagnostics": "severity string, code string, subject string, message string, accepted boolean, review_when string", "inputs": "path string, sha256 string",
}


def whole(spark: SparkSession, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The graph with all sections and columns of GRAPH; what is missing is empty or null."""
    out = {}
    for name, schema in GRAPH.items():
        df = graph[name] if name in graph else spark.createDataFrame([], schema)
        fields = [c.split(" ") for c in schema.split(", ")]
        out[name] = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])
    return out


def resolve(g: dict[str, DataFrame], needle: str) -> str:
    """The ref that a ref, a linked document, a path or a contract file stands for; raises where nothing does."""
    e = g["entities"]
    linked = F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("docs", "constraints", "runbooks")])).alias("path")
    docs = e.select("ref", linked).select("ref", "path", F.col("ref").alias("ord"))
    owners = e.where("source_path is not null").select(F.col("source_path").alias("root"), "ref")
    contracts = g["contracts"].where("api_ref is not null").select("ref", "api_ref")
    one = e.sparkSession.range(0, 1, 1, 1).select(F.lit(needle).alias("needle"))
    found = context.resolve(one, e.select("ref"), docs, owners, contracts).first()
    if found is None or found.ref is None:
        raise KeyError(f"no entity resolves for {needle!r}")
    return found.ref


def _section(name: str, rows: DataFrame, order: list[str], item: list[str], number: str | None = None) -> DataFrame:
    """Rows (section, place, item) of one section of one subject; place orders them: a number, then up to three texts."""
    keys = [F.col(c).cast("string") for c in order] + [F.lit(None).cast("string")] * (3 - len(order))
    first = (F.col(number) if number else F.lit(0)).cast("long")
    place = F.struct(first.alias("n"), *[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("place")
    return rows.select(F.lit(name).alias("section"), place, F.to_json(F.struct(*item)).alias("item"))


def _within(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(section, position, item, total, truncated): the first rows of each section.

    Sections with a budget are cut before their rows meet; the others are short by their nature (the ends of one subject).
    """
    totals = rows.groupBy("section").agg(F.count("*").alias("total"))  # one row a section
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("section"))
    capped = F.col("section").isin(*limits)
    w = Window.partitionBy("section").orderBy("place", "item")
    short = rows.where(capped).withColumn("position", F.row_number().over(w)).where(F.col("position") <= max(limits.values())).where(F.col("position") <= limit)
    rest = rows.where(~capped).withColumn("position", F.row_number().over(w))
    out = short.unionByName(rest).join(totals, "section")
    return out.select("section", "position", "item", "total", F.coalesce(capped & (F.col("total") > limit), F.lit(False)).alias("truncated"))


def query(spark: SparkSession, graph: dict[str, DataFrame], needle: str, budget: dict[str, int] | None = None) -> DataFrame:
    """The context of what a needle stands for: every section within its budget, and a row of `truncated` for each that was cut."""
    limits = context.BUDGETS | (budget or {})
    g = whole(spark, graph)
    ref = resolve(g, needle)
    me = F.lit(ref)
    r = g["relations"]
    entity = g["entities"].where(F.col("ref") == me)
    is_api = ref.startswith("api:")
    mine = r.where((F.col("source_ref") == me) | (F.col("target_ref") == me)).withColumn("direction", F.when(F.col("source_ref") == me, "out").otherwise("in")).withColumn("other", F.when(F.col("source_ref") == me, F.col("target_ref")).otherwise(F.col("source_ref")))
    ends = lambda of, here, there: r.where((F.col("type") == of) & (F.col(here) == me)).select(F.col(there).alias("ref")).distinct()
    provided = spark.range(0, 1, 1, 1).select(me.alias("ref")) if is_api else ends("providesApi", "source_ref", "target_ref")
    consumed = ends("consumesApi", "source_ref", "target_ref")
    consumers, providers = (ends(of, "target_ref", "source_ref") for of in ("consumesApi", "providesApi"))
    apis = provided.select("ref", F.lit("provided").alias("role")).unionByName(consumed.select("ref", F.lit("consumed").alias("role")))
    if is_api:
        apis = apis.unionByName(consumers.select("ref", F.lit("consumer").alias("role"))).unionByName(providers.select("ref", F.lit("provider").alias("role")))
    owner_of = context.longest_owner(g["contracts"].select(F.col("ref").alias("contract_ref")).distinct(), g["entities"].where("source_path is not null").select(F.col("source_path").alias("root")), "contract_ref")
    owned = owner_of.join(entity.select(F.col("source_path").alias("owner"), F.col("ref").alias("owner_ref")), "owner").select("contract_ref", "owner_ref")
    events = g["events"].join(owned, "contract_ref", "left").where(F.array_contains("producers", me) | F.array_contains("consumers", me) | F.col("owner_ref").isNotNull())
    scope = entity.select("ref")
    if is_api:
        scope = scope.unionByName(consumers).unionByName(providers).distinct()
    reverse = closure.reverse_edges(r)
    ranked = closure.checks_for_change(g["verification"].select("id", "tier", "component_refs"), reverse, scope)
    checks = ranked.select(F.col("check_id").alias("id"), "rank").join(g["verification"], "id")
    journeys = g["journeys"].where(F.array_contains("components", me))
    peers = journeys.select(F.explode("components").alias("ref")).where(F.col("ref") != me).distinct()
    contracts = g["contracts"].join(apis.where("role in ('provided', 'consumed')").select(F.col("ref").alias("api_ref")).distinct(), "api_ref", "left_semi")
    conflicts, assertions = g["conflicts"].where(F.col("subject") == me), g["assertions"].where(F.col("subject") == me)
    used = context.collected_provenance([x.select(me.alias("ref"), F.coalesce("prov_ids", F.array().cast("array<string>")).alias("prov_ids")) for x in (entity, mine, events, g["externals"].where(F.col("component") == me), checks, journeys, contracts, conflicts, assertions)])
    prov = g["provenance"].join(used.select(F.col("prov_id").alias("id")), "id", "left_semi")
    neighbours = context.neighbours(r, entity.select("ref")).select(F.col("other").alias("ref")).join(g["entities"].select("ref", "kind", "name", "description"), "ref", "left")
    linked = entity.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("paths")) for k in ("docs", "constraints", "runbooks")]))).select(F.col("pos"), "col.kind", F.explode(F.coalesce("col.paths", F.array().cast("array<string>"))).alias("path"))
    commitments = context.commitments(g["assertions"], g["conflicts"].where("status <> 'unresolved'"), g["diagnostics"].where("accepted"))
    parts = [
        _section("placement", mine.where("type in ('partOf', 'hasPart')").select("other").distinct(), ["other"], ["other"]),
        _section("relations", mine, ["type", "direction", "other"], ["type", "direction", "other", "evidence_class", "prov_ids"]),
        _section("neighbours", neighbours, ["ref"], ["ref", "kind", "name", "description"]),
        _section("apis", apis.join(g["contracts"].select(F.col("api_ref").alias("ref"), F.col("ref").alias("contract")), "ref", "left"), ["role", "ref"], ["role", "ref", "contract"]),
        _section("events", events, ["pattern"], ["pattern", "producers", "consumers", "resolution", "contract_ref"]),
        _section("resources", mine.where("type = 'usesResource'").select("direction", "other").distinct(), ["direction", "other"], ["direction", "other"]),
        _section("externals", g["externals"].where(F.col("component") == me), ["name", "role"], ["name", "role", "mechanism", "evidence_class"]),
        _section("capabilities", g["capabilities"].where(F.col("component") == me), ["name"], ["name", "evidence_class"]),
        _section("constraints", linked, ["path"], ["kind", "path"], "pos"),
        _section("verification", checks, ["id"], ["id", "tier", "command", "config_paths"], "rank"),
        _section("journeys", journeys, ["id"], ["id", "description", "components"]),
        _section("journey_peers", peers, ["ref"], ["ref"]),
        _section("contracts", contracts, ["ref"], ["ref", "api_ref"]),
        _section("conflicts", conflicts, ["key"], ["key", "kind", "status"]),
        _section("assertions", assertions, ["key", "value"], ["id", "key", "value", "evidence_class", "status"]),
        _section("provenance", prov, ["path", "id"], ["id", "class", "path", "extractor"]),
        _section("gates", g["gates"], ["id"], ["id", "tier", "command"]),
        _section("review_commitments", commitments, ["source", "subject", "review_when"], ["source", "subject", "review_when"]),
    ]
    parts.append(_section("entity", entity, ["ref"], ["ref", "kind", "name", "description", "source_path"]))
    return _within(reduce(DataFrame.unionByName, parts), limits)


def cut_sections(found: DataFrame) -> DataFrame:
    """(section, shown, total) of the sections of a context that were cut."""
    return found.where("truncated").groupBy("section").agg(F.count("*").alias("shown"), F.max("total").alias("total"))


def assert_no_secrets(found: DataFrame, column: str = "item") -> None:
    """Raise where a text that is to be published holds the form of a secret."""
    hit = found.select(secret_form(F.col(column)).alias("form")).where("form is not null").first()
    if hit:
        raise ValueError(f"the result holds a secret ({hit.form})")


def markdown(found: DataFrame, title: str, most_rows: int = 10_000) -> str:
    """A context as Markdown; raises where it has more than `most_rows` rows, which a caller may cut by budgets."""
    rows = found.orderBy("section", "position").limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"the context has more than {most_rows} rows")
    sections: dict[str, list[str]] = {}
    for r in rows:
        sections.setdefault(r.section, []).append(r.item)
    return context.markdown(title, sections)


def impact_of(spark: SparkSession, graph: dict[str, DataFrame], changed: DataFrame, most: int = 25) -> dict[str, DataFrame]:
    """What changed paths (path) touch: kinds of files, affected components with reasons, recommended checks."""
    g = whole(spark, graph)
    e = g["entities"]
    linked = e.select("ref", F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("docs", "constraints", "runbooks")])).alias("path"))
    kinds = impact.classify(changed, g["contracts"].select(F.col("ref").alias("path")), linked.select("path"), None, g["inputs"].select("path"))
    own = context.longest_owner(changed, e.where("source_path is not null").select(F.col("source_path").alias("root"))).join(e.select(F.col("source_path").alias("owner"), "ref"), "owner").select("ref", F.concat(F.lit("owns "), "path").alias("reason"))
    covered = context.covering_contract(changed, g["contracts"].where("api_ref is not null").select("ref", "api_ref")).where("api_ref is not null").select(F.col("api_ref").alias("ref")).distinct()
    touched = own.unionByName(impact.document_users(linked, changed)).unionByName(impact.config_users(g["verification"].where("config_paths is not null"), changed)).unionByName(impact.contract_users(g["relations"], covered))
    seeds = touched.select("ref").distinct()
    reverse = closure.reverse_edges(g["relations"])
    distance = closure.dependent_distance(reverse, seeds)
    reasons = touched.unionByName(impact.hop_reasons(distance)).unionByName(impact.first_degree(g["relations"], seeds))
    ranked = closure.checks_for_change(g["verification"].select("id", "tier", "component_refs"), reverse, seeds)
    return {"paths": kinds, "affected": impact.affected(reasons), "checks": impact.recommended(ranked, g["gates"].select(F.col("id").alias("check_id")), most)}


def check_fresh(graph: dict[str, DataFrame], inputs: DataFrame) -> DataFrame:
    """(path, change) of inputs (path, sha256) that differ from those the graph was made of; no row means it is fresh."""
    old, new = graph["inputs"].select("path", F.col("sha256").alias("was")), inputs.select("path", F.col("sha256").alias("now"))
    j = old.join(new, "path", "full_outer")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "changed")
    return j.select("path", change.alias("change")).where("change is not null")


def strict_gate(graph: dict[str, DataFrame]) -> DataFrame:
    """Warnings that no one accepted: each fails the strict gate."""
    d = graph["diagnostics"]
    accepted = F.coalesce("accepted", F.lit(False)) if "accepted" in d.columns else F.lit(False)
    return d.where((F.col("severity") == "warning") & ~accepted).select("code", "subject", "message")


def stats(graph: dict[str, DataFrame]) -> DataFrame:
    """(section, n): rows of every section of a graph."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n") for name, df in sorted(graph.items())])


def pin(graph: dict[str, DataFrame], pins: DataFrame) -> DataFrame:
    """pins (path, sha256) with the status of each against the inputs of the graph."""
    return provenance.pin_status(pins, graph["inputs"].select("path", "sha256"))


def relation_order(r: DataFrame) -> DataFrame:
    """The relation set with `ord`, its total order: type, source, target, attributes."""
    keys = [c for c in ("type", "source_ref", "target_ref", "attrs_key") if c in r.columns]
    return closure._placed(r, keys).withColumn("ord", F.col("place") + 1).drop("place")


def all_edges(placed: DataFrame, apis: DataFrame, extracted: DataFrame, overrides: DataFrame) -> DataFrame:
    """The union of the four sources of edges (type, source_ref, target_ref, attrs, via, prov), merged, with their inverses.

    placed and overrides are (type, source_ref, target_ref, prov), apis (ref, provider, prov) of API descriptors.
    """
    none, cols = F.lit(None).cast("string"), ["type", "source_ref", "target_ref", "attrs", "via", "evidence_class", "prov"]
    bare = F.expr("cast(map() as map<string,string>)")
    given = lambda df, cls: df.select("type", "source_ref", "target_ref", bare.alias("attrs"), none.alias("via"), F.lit(cls).alias("evidence_class"), "prov")
    provides = apis.select(F.lit("providesApi").alias("type"), F.col("provider").alias("source_ref"), F.col("ref").alias("target_ref"), "prov")
    edges = given(placed, "AUTHORED").unionByName(given(provides, "AUTHORED")).unionByName(extracted.select(*cols)).unionByName(given(overrides, "REVIEWED_OVERRIDE"))
    return relations.with_inverses(relations.merge(relations.identity(edges)))
