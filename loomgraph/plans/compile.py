"""From a checkout to graph sections: discover units, read what is written about them, extract, elect, integrate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import parent_path
from ..functions.text import redact_command
from ..operators import contracts, crates, edge, elect, events, extract, imports, indexes, modules, own, relations
from ..sources import authored, parsers
from ..sources import files as source
from ..sources.snapshot import Unstable, capture, differences, stable_inputs
from .cache import Store, cached
from .context import all_edges
from .settle import settle


@dataclass(frozen=True)
class Catalog:
    """Where people write about the system, and what they declare of it in code."""

    component_file: str = "component.yaml"
    folder: str = "catalog"  # descriptors of all other kinds, journeys.yaml, config.yaml, observations/
    rules: list[tuple[int, str, str, list[str]]] = field(default_factory=list)  # (ord, id, key_pattern, elect)
    externals: list[tuple[str, str, str, str]] = field(default_factory=list)  # (pattern, name, mechanism, role)
    capabilities: list[tuple[str, str]] = field(default_factory=list)  # (name, pattern)
    event_contracts: list[tuple[str, str, str]] = field(default_factory=list)  # (path, format, consumer); the first is that of subjects in source
    event_prefixes: list[str] = field(default_factory=list)


def discover(files: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Eligible units (root, deployable, importable, present, explicit) by their marker files and explicit roots."""
    m = extract.markers(files).select("root", "shape", F.lit(False).alias("explicit"))
    if explicit is not None:
        m = m.unionByName(explicit.select("root", F.lit("explicit").alias("shape"), F.lit(True).alias("explicit")))
    return own.shape_flags(m).where("eligible")


def _names(files: DataFrame, ending: str, parser: str, schema: str, kind: str) -> DataFrame:
    """(name, unit, ord) that manifests of one technology give their units."""
    return parsers.rows(files.where(F.col("path").rlike(ending)), parser, schema).where(F.col("kind") == kind).select("name", "unit", F.col("path").alias("ord"))


def module_edges(files: DataFrame, texts: DataFrame, units: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges (type, source, target, via, package) of JavaScript imports between units, static and dynamic, and of packages by name.

    files: (unit, path, text, is_test); texts: (path, text) of the whole checkout, for its configurations; packages: (name, unit, ord).
    """
    said = texts.where(F.col("path").rlike(r"(^|/)[tj]sconfig[^/]*\.json$")).select("path", "text")
    parsed = parsers.rows(said, "compiler_config", "extends array<string>, base_url string, paths map<string,array<string>>").where("error is null")
    every = imports.inherited(parsed.select("path", "extends", "base_url", "paths"), packages.select("name", F.col("unit").alias("root")))
    # of a directory, tsconfig.json comes before jsconfig.json; other names are there to be inherited
    main = every.where(F.col("path").rlike(r"(^|/)[tj]sconfig\.json$")).withColumn("dir", parent_path(F.col("path")))
    configs = settle(main.groupBy("dir").agg(F.max_by(F.struct("path", "base_url", "paths", "paths_base"), "path").alias("c")).select("c.*"))
    manifests = texts.where(F.col("path").rlike(r"(^|/)package\.json$")).select("path", "text")
    subpaths = parsers.rows(manifests, "package_imports", "pattern string, ord int, target string").where("pattern is not null")
    subpaths = settle(subpaths.select(parent_path(F.col("path")).alias("dir"), "pattern", "ord", "target"))
    static = settle(modules.js_imports(files).select("unit", "path", "is_test", "specifier"))
    resolved = modules.resolve(modules.routes(static, configs, None, subpaths), texts)
    dynamic = settle(modules.patterns(files))
    loaded = modules.resolve_patterns(dynamic, texts, configs, None, subpaths).select("path", "specifier", "file", F.lit("dynamic-import").alias("via"))
    found = modules.edges(static.unionByName(dynamic.drop("kind")), resolved.unionByName(loaded), units)
    by_file = found.select("type", "source", "target", "via", F.lit(None).cast("string").alias("package"))
    named = static.select("unit", "is_test", modules.package_of(F.col("specifier")).alias("name")).where("name is not null")
    return by_file.unionByName(extract.named_imports(named, packages, "source-import", refuse=False))


def _extracted(files: DataFrame, texts: DataFrame, units: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, checks, ambiguous names) of all manifests and imports of files (unit, path, text, is_test)."""
    node_edges, node_checks = extract.node(files, manifests)
    go_edges, go_checks = extract.go(files)
    said = crates.manifests(texts)
    linked = settle(crates.resolve(said))
    rust_imports, rust_torn = crates.imports(files, linked, said)
    rust_ambiguous = linked.where("ambiguous").select("unit", F.col("key").alias("name")).unionByName(crates.shared_names(said)).unionByName(rust_torn).distinct()
    python_edges, python_ambiguous = extract.python(files)
    packages = settle(manifests.where("kind = 'name'").select("name", "unit", F.col("path").alias("ord")))
    projects = _names(files, r"(^|/)pyproject\.toml$", "pyproject", "kind string, name string", "name")
    projects = projects.withColumn("name", F.regexp_replace(F.lower("name"), "[-.]+", "_"))
    edges = [
        node_edges, go_edges, crates.edges(linked), python_edges, module_edges(files, texts, units, packages), rust_imports,
        extract.source_imports(files, projects, "python"),
    ]
    checks = node_checks.unionByName(go_checks).unionByName(crates.checks(said))
    return reduce(DataFrame.unionByName, edges), checks, rust_ambiguous.unionByName(python_ambiguous)


def compile_checkout(spark: SparkSession, root: str, ignored: DataFrame | None = None, namespace: str = "default", catalog: Catalog | None = None) -> dict[str, DataFrame]:
    """Sections of the graph of a checkout (see `plans.context.GRAPH`), and its units, operations and inputs.

    A unit is the component whose descriptor lies in its root, else a component named after its path. All is made of one snapshot:
    a checkout that changes while it is read is read once more, and then refused.
    """
    return compile_inputs(spark, stable_inputs(spark, root, ignored)[0], namespace, catalog or Catalog())


def compile_cached(spark: SparkSession, root: str, store: Store, ignored: DataFrame | None = None, namespace: str = "default", catalog: Catalog | None = None) -> tuple[dict[str, DataFrame], bool]:
    """The same from a store of compiled graphs, and whether it was there; an unchanged checkout is listed and not compiled."""
    catalog = catalog or Catalog()
    listing = capture(spark, root, ignored)

    def make() -> dict[str, DataFrame]:
        inputs, after = stable_inputs(spark, root, ignored)
        if not differences(listing, after).isEmpty():
            raise Unstable("the checkout changed after it was listed; try again once edits have settled")
        return compile_inputs(spark, inputs, namespace, catalog)

    return cached(store, listing, make, f"{namespace} {catalog!r}")


def compile_inputs(spark: SparkSession, inputs: DataFrame, namespace: str, catalog: Catalog) -> dict[str, DataFrame]:
    """Sections of the graph of settled inputs (path, length, sha256, text, is_utf8)."""
    texts = inputs.where("is_utf8")
    units = settle(discover(inputs))
    here = F.col("path").startswith(f"{catalog.folder}/")
    special = F.col("path").rlike(rf"^{catalog.folder}/(journeys\.yaml$|config\.yaml$|observations/)")
    yaml = F.col("path").rlike(r"\.ya?ml$")
    entities, refused = authored.descriptors(texts.where(yaml & ((F.element_at(F.split("path", "/"), -1) == catalog.component_file) | (here & ~special))), namespace)
    entities = settle(entities)
    described = entities.where("kind = 'Component'").select(F.col("source_path").alias("root"), F.col("ref").alias("described"))
    derived = F.concat(F.lit(f"component:{namespace}/"), F.when(F.col("root") == ".", "root").otherwise(F.replace("root", F.lit("/"), F.lit("-"))))
    known = settle(units.join(described, "root", "left").select(F.col("root").alias("unit"), F.coalesce("described", derived).alias("ref")))
    mine = own.longest_owner(texts, units).where("owner is not null").select(F.col("owner").alias("unit"), "path", "text", F.col("path").rlike(source.TEST).alias("is_test"))
    files = settle(mine)

    def named(df: DataFrame, unit: str, ref: str) -> DataFrame:
        """df with the ref of a unit in place of the unit."""
        of = known.select(F.col("unit").alias(unit), F.col("ref").alias(f"{ref}_"))
        return df.join(of, unit).withColumn(ref, F.col(f"{ref}_")).drop(f"{ref}_", *([unit] if unit != ref else []))

    manifests = settle(extract.packages(files).drop("text"))
    edges, checks, ambiguous = _extracted(files, texts, units, manifests)
    edges = settle(edges)
    graph_checks, _ = extract.task_graph(files, known, texts, manifests)
    ci = settle(extract.workflow_checks(texts, units, manifests.where("kind = 'name'").select("name", "unit").distinct()))
    whole_unit = units.where("root = '.'").select(F.col("root").alias("unit"))
    scoped = ci.where("unit <> '.'").unionByName(ci.join(whole_unit, "unit", "left_semi"))
    gates = ci.join(scoped.select("id"), "id", "left_anti").select("id", "tier", redact_command(F.col("command")).alias("command"))
    checks = checks.unionByName(graph_checks.select("id", "unit", "tier", "command")).unionByName(scoped)
    attrs = F.map_filter(F.create_map(F.lit("via"), "via", F.lit("package"), "package"), lambda _, v: v.isNotNull())
    found = named(named(edges.withColumn("prov", F.col("source")), "source", "source_ref"), "target", "target_ref")
    found = found.select("type", "source_ref", "target_ref", attrs.alias("attrs"), "via", F.lit("DERIVED").alias("evidence_class"), "prov")
    apis = authored.providers(entities)
    roots = known.select("unit", F.col("ref").alias("provider"))
    uses = contracts.consumers(contracts.reference_sites(files), apis.where("contract is not null").join(roots, "provider").select(F.col("contract").alias("ref"), F.col("unit").alias("provider")))
    via = contracts.labelled(uses).join(apis.select(F.col("contract").alias("ref"), F.col("ref").alias("api")), "ref")
    consumed = named(via, "unit", "source_ref").select(F.lit("consumesApi").alias("type"), "source_ref", F.col("api").alias("target_ref"), F.create_map(F.lit("via"), "via").alias("attrs"), "via", F.lit("DERIVED").alias("evidence_class"), F.col("ref").alias("prov"))
    platform = settle(edge.declared(files))
    called, unbound = edge.service_calls(platform)
    scheduled, unscheduled = edge.schedules(platform, files)
    datasets = entities.where("kind = 'Resource' and type = 'logical-dataset'").select("ref", "name")
    stored, ambiguous_buckets = extract.bucket_uses(files, datasets)

    def linked(df: DataFrame, kind: str, target: str, prov: str, **attr: Column) -> DataFrame:
        """Edges of df (source, target as a unit or a ref) with attributes."""
        of = named(df, "source", "source_ref")
        of = named(of, "target", "target_ref") if target == "target" else of.withColumn("target_ref", F.col(target))
        attrs = F.create_map(*[x for name, value in attr.items() for x in (F.lit(name), value)])
        return of.select(F.lit(kind).alias("type"), "source_ref", "target_ref", attrs.alias("attrs"), F.coalesce(attr.get("via", F.lit("service-binding"))).alias("via"), F.lit("DERIVED").alias("evidence_class"), F.col(prov).alias("prov"))

    second = linked(called, "runtimeCalls", "target", "contract_ref", transport=F.lit("service-binding"), contractRef=F.col("contract_ref"))
    second = second.unionByName(linked(scheduled, "schedules", "target", "path", via=F.lit("declared-trigger-target"), route=F.col("route")))
    second = second.unionByName(linked(stored.withColumnRenamed("unit", "source"), "usesResource", "resource", "path", via=F.lit("bucket-literal")))
    config = texts.where(F.col("path") == f"{catalog.folder}/config.yaml")
    reviewed, override_problems = authored.overrides(config, entities, inputs)
    over = reviewed.where("fact like 'relation:%'").select(F.substring("fact", 10, 100).alias("type"), F.col("subject").alias("source_ref"), F.col("target").alias("target_ref"), F.lit("override").alias("prov"))
    related = settle(all_edges(authored.placements(entities, namespace), apis, found.unionByName(consumed).unionByName(second), over))
    refs = entities.select("ref").unionByName(known.select("ref")).distinct()
    observed, observation_problems = authored.observations(texts.where(F.col("path").rlike(rf"^{catalog.folder}/observations/.*\.ya?ml$")), refs, inputs)
    claimed = extract.port_facts(files).select("unit", F.lit("component.port").alias("key"), F.col("port").alias("value_json")).unionByName(edge.facts(platform))
    derived_facts = named(claimed, "unit", "subject").select(
        "subject", "key", "value_json", F.lit("DERIVED").alias("evidence_class"), F.lit("deterministic").alias("confidence"), F.lit(None).cast("string").alias("observed_at"), F.xxhash64("subject", "key", "value_json").alias("ord")
    )
    facts = settle(authored.fact_rows(observed).unionByName(derived_facts))
    rules = spark.createDataFrame(catalog.rules, "ord int, id string, key_pattern string, elect array<string>")
    elections = settle(elect.elect(facts, rules))
    assertions = elect.statuses(facts, elections)
    journeys, unknown = authored.journeys(texts.where(F.col("path") == f"{catalog.folder}/journeys.yaml"), refs)
    verification = indexes.shadow_checks(indexes.merge_checks(named(checks.withColumn("ord", F.col("id")), "unit", "component_ref").select("id", "ord", "component_ref", "tier", "command")))
    contract = catalog.event_contracts[0][0] if catalog.event_contracts else None
    shown = events.roles(files, edges.select(F.col("source").alias("src"), F.col("target").alias("dst")), catalog.event_prefixes).select("unit", "pattern", "role").distinct()
    roles = named(shown, "unit", "component").select("pattern", "role", "component", F.lit(contract).cast("string").alias("contract_ref"), F.lit(-1).cast("long").alias("ord"))
    declared = spark.createDataFrame([(n, *c) for n, c in enumerate(catalog.event_contracts)], "ord long, path string, format string, consumer string")
    listed, absent_catalogs = events.catalog(texts, declared)
    roles = settle(roles.unionByName(listed.select("pattern", "role", "component", "contract_ref", "ord")))
    plausible, odd = indexes.split_plausible(roles, catalog.event_prefixes)
    interfaces = indexes.event_interfaces(indexes.fold_roles(plausible))
    if contract:
        event_index, event_problems = events.checked(settle(interfaces), inputs)
    else:  # without a contract nothing can be checked against it
        event_index = indexes.resolve_events(interfaces)
        event_problems = event_index.where("false").select(*[F.lit("").alias(c) for c in ("severity", "code", "subject", "message")])
    deps = manifests.where("kind = 'dependencies'").select("unit", "name")
    said = lambda df, code, subject, message, severity="warning": df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(subject).alias("subject"), F.col(message).cast("string").alias("message"))
    broken = contracts.syntax_problems(entities.where("kind = 'API' and contract is not null").select(F.col("contract").alias("path"), "type").join(texts.select("path", "text"), "path"))
    diagnostics = [
        said(refused, "DESCRIPTOR", "path", "message", "error"), said(named(ambiguous, "unit", "subject"), "NAME_AMBIGUOUS", "subject", "name"), said(unknown, "JOURNEY_REF", "id", "ref", "error"), said(broken, "CONTRACT_SYNTAX", "path", "problem", "error"),
        said(observation_problems, "OBSERVATION", "set", "problem", "error"), said(override_problems, "OVERRIDE", "path", "problem", "error"),
        said(odd, "EVENT_IMPLAUSIBLE", "pattern", "component"), said(absent_catalogs.withColumn("problem", F.lit("resolves to no file")), "PATH_UNRESOLVED", "path", "problem", "error"),
        event_problems.select("severity", "code", "subject", "message"), said(named(unbound, "unit", "subject"), "SERVICE_BINDING_UNRESOLVED", "subject", "service"),
        said(named(unscheduled, "unit", "subject"), "SCHEDULE_UNRESOLVED", "subject", "route"), said(named(ambiguous_buckets, "unit", "subject"), "BINDING_AMBIGUOUS", "subject", "bucket"),
    ]
    empty = F.array().cast("array<string>")
    undescribed = known.join(entities.select("ref"), "ref", "left_anti").select("ref", F.lit("Component").alias("kind"), F.element_at(F.split("ref", "/"), -1).alias("name"), F.lit(None).cast("string").alias("description"), F.col("unit").alias("source_path"), empty.alias("docs"), empty.alias("constraints"), empty.alias("runbooks"))
    out = {
        "inputs": inputs.select("path", "length", "sha256", "is_utf8"), "units": units, "relations": related, "verification": verification, "operations": extract.operations(files), "journeys": journeys,
        "entities": entities.select("ref", "kind", "name", "description", "source_path", "docs", "constraints", "runbooks").unionByName(undescribed),
        "events": event_index, "contracts": apis.where("contract is not null").select(F.col("contract").alias("ref"), F.col("ref").alias("api_ref")),
        "assertions": assertions.select(F.col("ord").cast("string").alias("id"), "subject", "key", F.col("value_json").alias("value"), "evidence_class", "status"),
        "conflicts": elections.where("conflict_status is not null").select("subject", "key", F.col("conflict_kind").alias("kind"), F.col("conflict_status").alias("status")),
        "gates": gates, "diagnostics": reduce(DataFrame.unionByName, diagnostics).distinct(),
    }
    if catalog.externals:
        out["externals"] = named(extract.externals(deps, catalog.externals), "unit", "component")
    if catalog.capabilities:
        out["capabilities"] = named(extract.capabilities(files, catalog.capabilities), "unit", "component")
    return out
