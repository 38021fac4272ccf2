"""Retrieval systems to compare contexts with: a search of the working tree, a look at the touched units, the whole graph.

All give facts in one vocabulary, (scenario, fact), so that one score serves for all. What every scenario gets is given once,
as common facts, and never multiplied by the scenarios.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, join_path, normal_path, parent_path
from ..plans.settle import settle
from ..sources import parsers
from .closure import reachable_pairs
from .own import longest_owner

# Labels of the two ends of relations, kinds of files, and what shows checks, events and resources.
RELATION_FACTS = {
    "usesResource": ("uses", "usedBy"), "resourceUsedBy": ("usedBy", "uses"), "providesApi": ("provides", "provider"), "apiProvidedBy": ("provider", "provides"),
    "consumesApi": ("consumes", "consumer"), "apiConsumedBy": ("consumer", "consumes"),
}
SOURCE = r"\.(?:[cm]?[jt]sx?|go|rs|py)$"
MANIFEST = r"(?:^|/)(?:package.json|Cargo.toml|pyproject.toml|go.mod|setup.cfg|setup.py|requirements[^/]*\.txt)$"
CHECK = r"(?i)(?:test|lint|typecheck|check|clippy|vet|pytest|ruff|mypy|unittest)"
QUOTED = r"[\"'`]([^\"'`\n]+)[\"'`]"
JS_IMPORT = r"(?:\bfrom\s*|\bimport\s*(?:\(\s*)?|\brequire\s*\(\s*)[\"']([^\"']+)[\"']"
PY_IMPORT = r"(?m)^\s*(?:from|import)\s+([\w.]+)"
RUST_USE = r"\b(?:use|extern\s+crate)\s+(\w+)|\b(\w+)::"
RUST_MODULE = r"\bmod\s+(\w+)\s*[;{]"
LOCAL_PATH = r"(?:path\s*=|file:|link:)\s*[\"']?([^\"'\s,}]+)"
SERVICE = r"\bservice\s+(\w+)\s*\{"
EVENT_LINE = r"(?i)subject|event|topic|publish|subscribe"
EVENT = r"^[a-z][\w-]*(?:\.[\w-]+){2,}$"
SQL_USE = r"postgres(?:ql)?(?:\+[\w]+)?://|sql\.Open\(\"postgres\"|\b(?:pg|psycopg|asyncpg|sqlx|diesel)\b"
STORE_NAME = r"(?:bucket|queue_name)\s*=\s*[\"']([^\"']+)[\"']"


def labelled(kind: str | Column, value: Column) -> Column:
    """A fact in the vocabulary of the scores: a reference is its own fact."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(kind == "ref", value).otherwise(F.concat(kind, F.lit(":"), value))


def relation_facts(relations: DataFrame) -> DataFrame:
    """(ref, fact) of what each end of relations (type, source_ref, target_ref) knows by it: the other end, and how it stands to it."""
    labels = F.create_map(*[x for t, (a, b) in RELATION_FACTS.items() for x in (F.lit(t), F.array(F.lit(a), F.lit(b)))])
    label = F.try_element_at(labels, F.col("type"))
    ends = F.array(F.struct(F.col("source_ref").alias("ref"), F.col("target_ref").alias("other"), F.get(label, 0).alias("label")), F.struct(F.col("target_ref").alias("ref"), F.col("source_ref").alias("other"), F.get(label, 1).alias("label")))
    e = relations.select(F.explode(ends).alias("e")).select("e.*")
    both = F.array_compact(F.array(F.col("other"), F.when(F.col("label").isNotNull(), labelled(F.col("label"), F.col("other")))))
    return e.select("ref", F.explode(both).alias("fact")).distinct()


def _linked(entities: DataFrame) -> DataFrame:
    """(ref, kind, path) of the documents of entities."""
    out = [entities.select("ref", F.lit(kind).alias("kind"), F.explode(column).alias("path")) for kind, column in (("doc", "docs"), ("constraint", "constraints"), ("runbook", "runbooks"))]
    return reduce(DataFrame.unionByName, out)


def entity_facts(g: dict[str, DataFrame]) -> DataFrame:
    """(ref, fact) of all that a graph (see `plans.context.GRAPH`) says of each entity."""
    e = g["entities"]
    sides = F.explode(F.array_union(F.coalesce("producers", F.array().cast("array<string>")), F.coalesce("consumers", F.array().cast("array<string>")))).alias("ref")
    out = [
        e.select("ref", F.col("ref").alias("fact")), e.where("kind = 'API'").select("ref", labelled("provides", F.col("ref")).alias("fact")), relation_facts(g["relations"]),
        g["events"].select(sides, labelled("event", F.col("pattern")).alias("fact")), g["externals"].select(F.col("component").alias("ref"), labelled("external", F.col("name")).alias("fact")),
        g["verification"].select(F.explode("component_refs").alias("ref"), labelled("verify", F.col("command")).alias("fact")), g["conflicts"].select(F.col("subject").alias("ref"), labelled("conflict", F.col("key")).alias("fact")),
        _linked(e).select("ref", labelled(F.col("kind"), F.col("path")).alias("fact")),
    ]
    return reduce(DataFrame.unionByName, out).distinct()


def repository_documents(g: dict[str, DataFrame]) -> DataFrame:
    """(fact) of all documents of entities and all files that configure checks."""
    docs = g["entities"].select(F.explode("docs").alias("path"))
    configs = g["verification"].where("config_paths is not null").select(F.explode("config_paths").alias("path"))
    return docs.unionByName(configs).select(labelled("doc", F.col("path")).alias("fact")).distinct()


def targeted(g: dict[str, DataFrame], touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, common) of touched units (scenario, ref), of what lies under their roots, and of all documents."""
    e = g["entities"].select("ref", "source_path")
    seeds = touched.select("scenario", "ref").distinct().join(e, "ref", "left")
    roots = seeds.where("source_path is not null").select("scenario", F.col("source_path").alias("root")).distinct()
    up = e.where("source_path is not null").select("ref", "source_path", F.explode(ancestors(F.col("source_path"))).alias("root"))
    near = up.where("root <> '.' or source_path = '.'").join(roots, "root").select("scenario", "ref")
    of = seeds.select("scenario", "ref").unionByName(near).distinct()
    return of.join(entity_facts(g), "ref").select("scenario", "fact").distinct(), repository_documents(g)


def inventory(g: dict[str, DataFrame]) -> DataFrame:
    """(fact) of the whole graph: how large it is, rather than what anybody would look up."""
    more = g["capabilities"].select(labelled("capability", F.col("name")).alias("fact"))
    checks = g["verification"].select(labelled("verify", F.col("command")).alias("fact"))
    events = g["events"].select(labelled("event", F.col("pattern")).alias("fact"))
    return reduce(DataFrame.unionByName, [entity_facts(g).select("fact"), more, checks, events, repository_documents(g)]).distinct()


def scored(truth: DataFrame, facts: DataFrame | None, common: DataFrame | None, scenarios: DataFrame) -> DataFrame:
    """n_truth, n_retrieved, n_hit, recall, precision, noise of each scenario, for own facts (scenario, fact) and common ones (fact)."""
    t = truth.select("scenario", "fact").distinct()
    own = facts.select("scenario", "fact").distinct() if facts is not None else t.where("false")
    every = common.select("fact").distinct() if common is not None else t.where("false").select("fact")
    extra = own.join(every, "fact", "left_anti")
    hit = t.join(own, ["scenario", "fact"], "left_semi").unionByName(t.join(every, "fact", "left_semi").select("scenario", "fact")).distinct()
    n = lambda df, name: df.groupBy("scenario").agg(F.count("*").alias(name))
    j = scenarios.select("scenario").distinct()
    for df, name in ((t, "n_truth"), (extra, "n_extra"), (hit, "n_hit")):
        j = j.join(n(df, name), "scenario", "left")
    size = every.agg(F.count("*")).scalar()
    j = j.na.fill(0, ["n_truth", "n_extra", "n_hit"]).withColumn("n_retrieved", F.col("n_extra") + size)
    recall = F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("n_hit") / F.col("n_truth"))
    precision = F.when(F.col("n_retrieved") == 0, 1.0).otherwise(F.col("n_hit") / F.col("n_retrieved"))
    return j.select("scenario", "n_truth", "n_retrieved", "n_hit", F.round(recall, 4).alias("recall"), F.round(precision, 4).alias("precision"), F.round(1 - precision, 4).alias("noise"))


# -- search of the working tree


def slug(name: Column) -> Column:
    split = F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1-$2"))
    return F.regexp_replace(F.regexp_replace(split, "[^a-z0-9]+", "-"), "^-|-$", "")


def _quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))


def owned(files: DataFrame, components: DataFrame) -> DataFrame:
    """files (path, ...) with `ref` of the component that lists them among its documents, else of the deepest that holds them."""
    order = F.struct(F.negate(F.length("root")), "ref")
    listed = components.select("ref", "root", F.explode("docs").alias("path")).groupBy("path").agg(F.min_by("ref", order).alias("listed"))
    roots = components.groupBy(F.col("root").alias("owner")).agg(F.min("ref").alias("held"))
    return longest_owner(files, components).join(roots, "owner", "left").join(listed, "path", "left").withColumn("ref", F.coalesce("listed", "held")).drop("owner", "held", "listed")


def unit_names(files: DataFrame, components: DataFrame) -> DataFrame:
    """(ref, name) by which manifests and modules of owned files (ref, path, text) say that a component can be imported."""
    at_root = files.join(components.select("ref", "root"), "ref")
    named = lambda file, parser, schema, kind: parsers.rows(at_root.where(F.col("path") == join_path(F.col("root"), F.lit(file))).select("ref", "text"), parser, schema).where(F.col("kind") == kind).select("ref", "name")
    crates = named("Cargo.toml", "cargo", "kind string, name string, value string", "package")
    projects = files.where(F.col("path").rlike(r"(^|/)pyproject\.toml$")).select("ref", "text")
    rel = F.when(F.col("root") == ".", F.col("path")).otherwise(F.substring(F.col("path"), F.length("root") + 2, F.length("path")))
    module = F.regexp_extract(rel, r"^(?:src/)?(\w+)/(?:__init__|__main__)\.py$", 1)
    out = [
        named("package.json", "package_json", "kind string, name string, value string", "name"), crates, crates.withColumn("name", F.replace("name", F.lit("-"), F.lit("_"))), named("go.mod", "go_mod", "kind string, name string", "module"),
        parsers.rows(projects, "pyproject", "kind string, name string").where("kind = 'name'").select("ref", "name"), at_root.select("ref", module.alias("name")).where("name <> ''"),
    ]
    return reduce(DataFrame.unionByName, out).where("name is not null").distinct()


def imported(files: DataFrame) -> DataFrame:
    """(ref, path, name) of what source files (ref, path, text) import, by the form of their language."""
    path, text = F.col("path"), F.col("text")
    every = lambda form, group=1: F.regexp_extract_all(text, F.lit(form), F.lit(group))
    rust = F.array_except(F.filter(F.concat(every(RUST_USE, 1), every(RUST_USE, 2)), lambda n: n != ""), every(RUST_MODULE))
    found = F.when(path.rlike(r"\.[cm]?[jt]sx?$"), every(JS_IMPORT)).when(path.endswith(".go"), _quoted(text)).when(path.endswith(".rs"), rust).when(path.endswith(".py"), every(PY_IMPORT))
    return files.select("ref", "path", F.explode(F.array_distinct(found)).alias("name"))


def links(files: DataFrame, components: DataFrame, names: DataFrame, contracts: DataFrame) -> DataFrame:
    """(src, dst) both ways, of owned files (ref, path, text) that name another component, a contract or a route.

    What several components share (a contract, a route) is a node between them, so no pairs of them are made.
    """
    reading = files.where(F.col("path").rlike(SOURCE) | F.col("path").rlike(MANIFEST))
    used = imported(reading)
    parts = F.split("name", "(?=[/.])")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ""))
    stems = files.where(F.col("path").endswith(".py")).select("ref", F.regexp_extract("path", r"/([^/]+)\.py$", 1).alias("stem")).where("stem <> ''").distinct()
    plain = used.select("ref", "path", "name", F.substring_index("name", ".", 1).alias("stem"))
    own_module = plain.where(F.col("path").endswith(".py")).join(stems, ["ref", "stem"], "left_semi").select("ref", "path", "name")
    outside = used.join(own_module, ["ref", "path", "name"], "left_anti")
    to = names.select(F.col("ref").alias("dst"), "name").distinct()
    by_import = outside.select(F.col("ref").alias("src"), F.explode(begins).alias("name")).distinct().join(to, "name").select("src", "dst")
    tokens = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w@/.-]+"), F.lit(0)))).alias("name")
    by_mention = files.where(F.col("path").rlike(MANIFEST)).select(F.col("ref").alias("src"), tokens).distinct().join(to, "name").select("src", "dst")
    local = files.where(F.col("path").rlike(MANIFEST)).select("ref", "path", F.explode(F.regexp_extract_all("text", F.lit(LOCAL_PATH), F.lit(1))).alias("name"))
    places = used.where(F.col("name").startswith(".")).unionByName(local)
    places = places.select(F.col("ref").alias("src"), normal_path(join_path(parent_path(F.col("path")), F.col("name"))).alias("path")).where("path is not null").distinct()
    by_path = owned(places, components).where("ref is not null").select("src", F.col("ref").alias("dst"))
    shared = contracts.select(F.col("ref").alias("src"), F.concat(F.lit("contract:"), "file").alias("dst"))
    path = F.when(F.col("q").rlike("^https?://"), F.regexp_extract("q", r"^https?://[^/?#]*(/[^?#]*)", 1)).when(F.col("q").startswith("/"), F.col("q"))
    literal = files.where(F.col("path").rlike(SOURCE) | F.col("path").endswith(".toml")).select("ref", F.explode(_quoted(F.col("text"))).alias("q")).select("ref", path.alias("p"))
    routed = files.select("ref", F.regexp_extract("path", r"/app(/api/.*)/route\.[jt]s$", 1).alias("p"))
    route = literal.unionByName(routed).where("p is not null and p not in ('', '/')").select(F.col("ref").alias("src"), F.concat(F.lit("route:"), "p").alias("dst"))
    one = reduce(DataFrame.unionByName, [by_import, by_mention, by_path, shared, route]).where("src <> dst").distinct()
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def contract_users(files: DataFrame, owned_files: DataFrame) -> DataFrame:
    """(file, api, ref, role) of components that read a contract (their text names its path) or provide it (they register or route it).

    files: (path, text) of all; owned_files: (ref, path, text).
    """
    proto = files.where(F.col("path").endswith(".proto")).select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("text", F.lit(SERVICE), F.lit(1))).alias("service"))
    proto = proto.select("file", F.concat(F.lit("api:default/"), slug(F.col("service"))).alias("api"), "service")
    documents = files.where(F.col("text").rlike(r"(?m)^openapi:\s"))
    titled = parsers.rows(documents.select("path", "text"), "contract_outline", "openapi string, asyncapi string, title string").where("title is not null")
    stem = F.regexp_replace(slug(F.col("title")), "-api$", "")
    titled = titled.select(F.col("path").alias("file"), F.concat(F.lit("api:default/"), stem, F.lit("-api")).alias("api")).distinct()
    routes = parsers.rows(documents.select("path", "text"), "openapi", "method string, route string").where("route is not null").select(F.col("path").alias("file"), "route").distinct()
    apis = proto.select("file", "api").unionByName(titled).distinct()
    segments = F.split("t", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "/"))
    tokens = owned_files.select("ref", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w@/.-]+"), F.lit(0)))).alias("t"))
    keys = tokens.where(F.contains("t", F.lit("."))).select("ref", F.explode(ends).alias("file")).join(apis.select("file").distinct(), "file", "left_semi")
    readers = keys.distinct().select("file", "ref", F.lit("reader").alias("role"))
    source = owned_files.where(F.col("path").rlike(SOURCE))
    words = source.select("ref", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"Register(\w+)Server"), F.lit(1)))).alias("service"))
    registered = words.join(proto.select("file", "service"), "service").select("file", "ref")
    literal = source.select("ref", F.explode(F.array_distinct(_quoted(F.col("text")))).alias("route"))
    by_file = source.select("ref", F.regexp_extract("path", r"/app(/.*)/route\.ts$", 1).alias("route")).where("route <> ''")
    routed = literal.unionByName(by_file).distinct().join(routes, "route").select("file", "ref")
    providers = registered.unionByName(routed).distinct().withColumn("role", F.lit("provider"))
    return apis.join(readers.unionByName(providers), "file").distinct()


def checks(files: DataFrame, names: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, common) of owned files (ref, path, text): (ref, command) of each component, and (command) of the repository."""
    m = parsers.rows(files.where(F.col("path").rlike(r"(^|/)package\.json$")), "package_json", "kind string, name string, value string")
    scripts = m.where(F.col("kind") == "scripts").where(F.col("name").rlike(CHECK)).select("ref", F.col("value").alias("command"))
    tasks = parsers.rows(every.where("path = 'turbo.json'").select("path", "text"), "task_graph", "task string").where("task is not null").where(F.col("task").rlike(CHECK)).select("task")
    packages = m.where("kind = 'name'").select("ref", "name").distinct()
    declared = tasks.agg(F.collect_set("task")).scalar()  # of one file
    turbo = packages.select("ref", "name", F.explode(declared).alias("task")).select("ref", F.concat(F.lit("turbo run "), "task", F.lit(" --filter="), "name").alias("command"))
    go = files.where(F.col("path").rlike(r"(^|/)go\.mod$")).select("ref", F.explode(F.array(F.lit("go test ./..."), F.lit("go vet ./..."))).alias("command"))
    crates = parsers.rows(files.where(F.col("path").rlike(r"(^|/)Cargo\.toml$")), "cargo", "kind string, name string, value string").where("kind = 'package'")
    cargo = crates.select("ref", F.explode(F.array(F.concat(F.lit("cargo test -p "), "name"), F.concat(F.lit("cargo clippy -p "), "name"))).alias("command"))
    shown = files.select("ref", F.col("path").endswith(".py").alias("py"), *[F.col("text").rlike(rf"\b{t}\b").alias(t) for t in ("pytest", "ruff", "mypy", "unittest")])
    tools = shown.groupBy("ref").agg(F.bool_or("py").alias("py"), *[F.bool_or(t).alias(t) for t in ("pytest", "ruff", "mypy", "unittest")]).where("py")
    locks = every.where(F.col("path").rlike(r"(?:uv|poetry)\.lock$")).select(parent_path(F.col("path")).alias("root"), F.col("path").endswith("uv.lock").alias("uv")).groupBy("root").agg(F.bool_or("uv").alias("uv"))
    nearest = longest_owner(files.select("ref", "path"), locks).where("owner is not null").groupBy("ref").agg(F.max_by("owner", F.length("owner")).alias("root")).join(locks, "root")
    prefix = F.when(F.col("uv"), "uv run ").when(F.col("uv").isNotNull(), "poetry run ").otherwise("")
    of_tool = [F.when(F.col(t), F.concat(prefix, F.lit("ruff check" if t == "ruff" else t))) for t in ("pytest", "ruff", "mypy")]
    plain = F.when(F.col("unittest") & ~F.col("pytest"), F.lit("python -m unittest discover"))
    python = tools.join(nearest, "ref", "left").select("ref", F.explode(F.array_compact(F.array(*of_tool, plain))).alias("command"))
    steps = parsers.rows(every.where(F.col("path").rlike(r"^\.github/workflows/.*\.ya?ml$")).select("path", "text"), "workflow", "job string, step int, name string, run string, dir string").where("run is not null")
    lines = steps.select("dir", F.explode(F.transform(F.split("run", "\n"), lambda x: F.trim(x))).alias("command")).where(F.col("command").rlike(CHECK)).distinct()
    token = F.explode_outer(F.regexp_extract_all("command", F.lit(r"[\w@/.-]+"), F.lit(0))).alias("name")
    said = lines.where("dir is null or dir = '.'").select("command", token).join(names, "name", "left").groupBy("command").agg(F.collect_set("ref").alias("refs"))
    named = said.select(F.explode("refs").alias("ref"), "command")
    common = said.where(F.size("refs") == 0).where(~F.col("command").rlike(r"--filter|\bcd\b|\$\{\{")).select("command")
    own = [scripts, turbo, go, cargo, python, named]
    return reduce(DataFrame.unionByName, own).where("command is not null").distinct(), common


def search(files: DataFrame, components: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, common, reached) of a search of files (path, text) from touched paths or refs (scenario, touch).

    components: (ref, name, root, docs) alone are known of what people wrote; nothing else of the graph is read. From a touched
    component the search goes on to all that names it or is named by it, until nothing new is reached.
    """
    every = settle(owned(files, components))
    mine = every.where("ref is not null")
    names = settle(unit_names(mine, components))
    users = settle(contract_users(every.select("path", "text"), mine))
    touches = touched.select("scenario", F.regexp_replace(F.regexp_replace("touch", r"^\./", ""), "/$", "").alias("touch"))
    by_ref = touches.join(components.select(F.col("ref").alias("touch")), "touch", "left_semi").select("scenario", F.col("touch").alias("node"))
    by_path = owned(touches.select("scenario", F.col("touch").alias("path")), components).where("ref is not null").select("scenario", F.col("ref").alias("node"))
    by_contract = touches.select("scenario", F.concat(F.lit("contract:"), "touch").alias("node")).join(users.select(F.concat(F.lit("contract:"), "file").alias("node")), "node", "left_semi")
    seeds = by_ref.unionByName(by_path).unionByName(by_contract.select("scenario", "node")).distinct()
    pairs = reachable_pairs(links(mine, components, names, users), seeds.select(F.col("scenario").alias("seed"), "node"))
    reached = settle(pairs.join(components.select(F.col("ref").alias("node")), "node", "left_semi").select(F.col("seed").alias("scenario"), F.col("node").alias("ref")))
    path, text = F.col("path"), F.col("text")
    kind = F.when(F.element_at(F.split("path", "/"), -1).rlike("(?i)constraint"), "constraint").when(path.rlike("(?i)runbook"), "runbook").otherwise("doc")
    documents = mine.where(path.rlike(r"\.(md|rst|txt)$")).select("ref", labelled(kind, path).alias("fact"))
    lines = mine.where(path.rlike(SOURCE)).select("ref", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(EVENT_LINE))
    events = lines.select("ref", F.explode(_quoted(F.col("line"))).alias("q")).where(F.col("q").rlike(EVENT)).select("ref", labelled("event", F.col("q")).alias("fact"))
    of = lambda file, parser, schema, kinds: parsers.rows(mine.where(path.rlike(file)).select("ref", "text"), parser, schema).where(F.col("kind").rlike(kinds)).select("ref", "name")
    needs = of(r"(^|/)package\.json$", "package_json", "kind string, name string", "ependencies$").unionByName(of(r"(^|/)Cargo\.toml$", "cargo", "kind string, name string", "dependencies$"))
    needs = needs.unionByName(of(r"(^|/)go\.mod$", "go_mod", "kind string, name string", "^require$")).unionByName(of(r"(^|/)pyproject\.toml$", "pyproject", "kind string, name string", "dependency$"))
    externals = needs.join(names.select("name").distinct(), "name", "left_anti").select("ref", labelled("external", F.col("name")).alias("fact"))
    commands, everywhere = checks(mine, names, every)
    named = components.select("ref", "name")
    resource = lambda found: found.select("ref", F.explode(F.array(F.col("to"), labelled("uses", F.col("to")))).alias("fact"))
    sql = mine.where(text.rlike(SQL_USE) | path.rlike(r"/migrations/.*\.sql$")).select("ref").distinct().join(named, "ref").select("ref", F.concat(F.lit("resource:default/"), "name", F.lit("-postgres")).alias("to"))
    redis = mine.where(text.rlike(r"(?i)\bredis\b")).select("ref").distinct().join(named, "ref").select("ref", F.concat(F.lit("resource:default/"), "name", F.lit("-redis")).alias("to"))
    stores = mine.select("ref", F.explode(F.regexp_extract_all("text", F.lit(STORE_NAME), F.lit(1))).alias("s")).select("ref", F.concat(F.lit("resource:default/"), slug(F.col("s"))).alias("to"))
    own = [mine.select("ref", F.col("ref").alias("fact")), documents, events, externals, commands.select("ref", labelled("verify", F.col("command")).alias("fact")), resource(sql), resource(redis), resource(stores)]
    facts = reached.join(reduce(DataFrame.unionByName, [*own, components.select("ref", F.col("ref").alias("fact"))]).distinct(), "ref").select("scenario", "fact")
    used = _contract_facts(users, reached, touches)
    return facts.unionByName(used).distinct(), everywhere.select(labelled("verify", F.col("command")).alias("fact")), reached


def _contract_facts(users: DataFrame, reached: DataFrame, touches: DataFrame) -> DataFrame:
    """(scenario, fact) of contracts that are touched, or whose users are reached."""
    flags = users.groupBy("file", "api", "ref").agg(F.bool_or(F.col("role") == "provider").alias("provides"), F.bool_or(F.col("role") == "reader").alias("reads"))
    near = reached.join(flags, "ref").select("scenario", "file", "api", "provides", (F.col("reads") & ~F.col("provides")).alias("consumes"))
    hand = touches.join(users.select(F.col("file").alias("touch"), "api").distinct(), "touch").select("scenario", F.col("touch").alias("file"), "api", F.lit(True).alias("provides"), F.lit(False).alias("consumes"))
    known = near.unionByName(hand).groupBy("scenario", "file", "api").agg(F.bool_or("provides").alias("provides"), F.bool_or("consumes").alias("consumes"))
    of = F.array_compact(F.array(F.col("api"), F.when(F.col("provides"), labelled("provides", F.col("api"))), F.when(F.col("consumes"), labelled("consumes", F.col("api")))))
    role = F.when(F.col("provides"), labelled("provider", F.col("ref"))).otherwise(labelled("consumer", F.col("ref")))
    sides = known.select("scenario", "file", "api").join(flags.select("file", "api", role.alias("fact")), ["file", "api"]).select("scenario", "fact")
    return known.select("scenario", F.explode(of).alias("fact")).unionByName(sides)
