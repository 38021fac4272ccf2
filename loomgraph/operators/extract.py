"""Technology extractors: manifests, contracts, CI and source text of a checkout to edges, facts, checks and roles.

All take `files` (unit, path, text, is_test) and emit rows; names are resolved by joins, never by the order of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, join_path, normal_path, parent_path
from ..functions.text import distribution_name, script_tier, task_tier, workflow_tier
from ..plans.settle import settle
from ..sources import parsers
from .events import source_files
from .own import longest_owner, nearest_config, unique_names

#: Files that mark a unit, and what they make of it.
MARKERS = [
    (r"(^|/)package\.json$", "node", "importable"), (r"(^|/)go\.mod$", "go", "both"), (r"(^|/)Cargo\.toml$", "rust", "both"), (r"(^|/)pyproject\.toml$", "python", "importable"),
    (r"(^|/)Dockerfile$", "dockerfile", "deployable"), (r"(^|/)wrangler\.(toml|jsonc?)$", "wrangler", "deployable"),
    (r"(^|/)(fly\.toml|app\.yaml|render\.yaml|railway\.json|vercel\.json|netlify\.toml|heroku\.yml|Procfile|service\.yaml|serverless\.ya?ml|ansible\.cfg)$", "deploy-config", "deployable"),
    (r"(^|/)(k8s/deployment\.yaml|chart/Chart\.yaml)$", "deploy-config", "deployable"),
]


def markers(files: DataFrame) -> DataFrame:
    """(root, path, adapter, shape) of marker files."""
    table = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("adapter"), F.lit(s).alias("shape")) for p, a, s in MARKERS])
    top = F.regexp_replace("path", r"(^|/)(?:(?:k8s|chart)/)?[^/]*$", "")  # files of k8s and chart mark the directory above
    nested = F.col("path").rlike(r"(^|/)(k8s/deployment\.yaml|chart/Chart\.yaml)$")
    root = F.when(nested, F.when(top == "", ".").otherwise(top)).when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    return files.select("path", root.alias("root"), F.explode(table).alias("m")).where(F.rlike(F.col("path"), F.col("m.pattern"))).select("root", "path", "m.adapter", "m.shape")


def _edges(deps: DataFrame, names: DataFrame, via: str, refuse: bool) -> tuple[DataFrame, DataFrame]:
    """(edges, ambiguous names) of deps (unit, name, is_test) by names (name, unit, ord)."""
    owned = unique_names(names.withColumnRenamed("unit", "target"), unit="target", refuse=refuse)
    hit = deps.join(owned, "name")
    edges = hit.where("target is not null and target <> unit").select(F.when(F.col("is_test"), "testDependsOn").otherwise("buildDependsOn").alias("type"), F.col("unit").alias("source"), "target", F.lit(via).alias("via"), F.col("name").alias("package")).distinct()
    return edges, hit.where(F.col("ambiguous") & F.lit(refuse)).select("unit", "name").distinct()


def packages(files: DataFrame) -> DataFrame:
    """Rows (kind, name, value) of the package manifests among files."""
    return parsers.rows(files.where(F.col("path").rlike(r"(^|/)package\.json$")), "package_json", "kind string, name string, value string")


def node(files: DataFrame, manifests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, checks) of package manifests (see `packages`); of equal names the first unit wins."""
    m = packages(files) if manifests is None else manifests
    names = m.where("kind = 'name'").select("name", "unit", F.col("path").alias("ord"))
    deps = m.where("kind like '%ependencies'").select("unit", "name", (F.col("kind") == "devDependencies").alias("is_test"))
    scripts = m.where("kind = 'scripts'").select(F.concat("unit", F.lit(":"), "name").alias("id"), "unit", script_tier(F.col("name")).alias("tier"), F.col("value").alias("command")).where("tier is not null")
    return _edges(deps, names, "npm-manifest", refuse=False)[0], scripts


def go(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, checks) of Go modules; every module has a test and a vet check."""
    m = parsers.rows(files.where(F.col("path").rlike(r"(^|/)go\.mod$")), "go_mod", "kind string, name string")
    mods = m.where("kind = 'module'")
    edges = _edges(m.where("kind = 'require'").select("unit", "name", F.lit(False).alias("is_test")), mods.select("name", "unit", F.col("path").alias("ord")), "go-module", refuse=False)[0]
    both = F.array(F.struct(F.lit("go-test").alias("n"), F.lit("unit").alias("tier"), F.lit("go test ./...").alias("command")), F.struct(F.lit("go-vet").alias("n"), F.lit("static").alias("tier"), F.lit("go vet ./...").alias("command")))
    checks = mods.select("unit", F.explode(both).alias("c")).select(F.concat("unit", F.lit(":"), "c.n").alias("id"), "unit", "c.tier", "c.command")
    return edges, checks


def python(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, ambiguous names) of Python projects by distribution name; a name of several projects is refused."""
    m = parsers.rows(files.where(F.col("path").rlike(r"(^|/)pyproject\.toml$")), "pyproject", "kind string, name string")
    names = m.where("kind = 'name'").select(distribution_name(F.col("name")).alias("name"), "unit", F.col("path").alias("ord"))
    deps = m.where("kind in ('dependency', 'test-dependency')").select("unit", "name", (F.col("kind") == "test-dependency").alias("is_test"))
    return _edges(deps, names, "python-manifest", refuse=True)


def source_imports(files: DataFrame, names: DataFrame, language: str) -> DataFrame:
    """Edges of imports in source text by names (name, unit, ord): js or python; a test edge where only tests import."""
    ends, parser, via = {"js": (r"\.(m?[jt]sx?)$", "js_imports", "source-import"), "python": (r"\.py$", "python_imports", "python-import")}[language]
    found = parsers.rows(files.where(F.col("path").rlike(ends)), parser, "name string")
    name: Column = {"js": F.regexp_extract("name", "^(@[^/]+/[^/]+|[^./][^/]*)", 1), "python": F.col("name")}[language]
    return named_imports(found.where("name is not null").select("unit", name.alias("name"), "is_test"), names, via, refuse=language != "js")


def named_imports(uses: DataFrame, names: DataFrame, via: str, refuse: bool) -> DataFrame:
    """Edges of uses (unit, name, is_test) of names (name, unit, ord); a unit's own names shadow those of others."""
    g = uses.where("name <> ''").groupBy("unit", "name").agg(F.bool_and("is_test").alias("is_test"))
    own = names.select("unit", "name").distinct()
    return _edges(g.join(own, ["unit", "name"], "left_anti"), names, via, refuse=refuse)[0]


def operations(files: DataFrame) -> DataFrame:
    """(path, kind, service, method, route) of API contracts."""
    o = parsers.rows(files.where(F.col("path").rlike(r"(?i)(openapi|swagger)[^/]*\.(ya?ml|json)$")), "openapi", "method string, route string, operation string")
    p = parsers.rows(files.where(F.col("path").rlike(r"\.proto$")), "protobuf", "service string, method string, request string, streaming boolean")
    g = parsers.rows(files.where(F.col("path").rlike(r"\.(graphql|gql)$")), "graphql", "kind string, name string")
    none = F.lit(None).cast("string")
    out = o.where("method is not null").select("path", F.lit("openapi").alias("kind"), none.alias("service"), "method", "route")
    out = out.unionByName(p.where("method is not null").select("path", F.lit("protobuf").alias("kind"), "service", "method", none.alias("route")))
    return out.unionByName(g.where("kind in ('query', 'mutation', 'subscription')").select("path", F.lit("graphql").alias("kind"), F.col("kind").alias("service"), F.col("name").alias("method"), none.alias("route")))


# What may stand before a command, options that take a value, and the tiers of programs.
_SEP = "\x1f"
CI_BEFORE = "^(?:env\x1f|[A-Za-z_][A-Za-z0-9_]*=[^\x1f]*\x1f|(?:uv|poetry)\x1frun\x1f|(?:npx|bunx)\x1f|python(?:3(?:[.][0-9]+)?)?\x1f-m\x1f)+"
CI_OPTIONS = "(?:(?:--filter|-F|--prefix|--dir|--cwd|-C|--workspace|-w)\x1f[^\x1f]*\x1f|-[^\x1f]*\x1f)*+"
CI_MANAGER = "^(?:npm|pnpm|yarn|bun)\x1f"
CI_VALUES = "--filter|-F|-C|--directory|--cwd|-t|--target|--targets|--projects|--configuration|-c|--parallel|--concurrency|--cache-dir|--output-logs"
CI_PROGRAMS = [
    (["pytest", "unittest", "vitest", "jest", "mocha", "ava"], None, "unit"), (["playwright", "cypress"], ["test", "run"], "e2e"), (["eslint", "mypy", "golangci-lint"], None, "static"), (["ruff", "biome"], ["check", "lint"], "static"),
    (["go", "cargo", "dotnet"], ["test"], "unit"), (["go", "cargo", "dotnet"], ["vet", "clippy"], "static"), (["go", "cargo", "dotnet"], ["build"], "build"),
]


def ci_commands(commands: DataFrame) -> DataFrame:
    """commands (command, words, dir) with `tiers`, `filters` (names of packages), `args`, `script` and `at` (a directory option).

    Environments, runners and package managers in front of a program are taken off; a script's tier is that of its file name.
    """
    joined = F.concat(F.array_join("words", _SEP), F.lit(_SEP))
    wrapped = f"{CI_MANAGER}({CI_OPTIONS})(?:(?:exec|dlx)\x1f|(?=(?:turbo|nx)\x1f))"
    c = commands.withColumn("line", F.regexp_replace(joined, CI_BEFORE, "")).withColumn("chosen", F.lit(""))
    for _ in range(2):  # a runner within a runner
        c = c.withColumns({"chosen": F.concat("chosen", F.regexp_extract("line", wrapped, 1)), "line": F.regexp_replace(F.regexp_replace("line", wrapped, ""), CI_BEFORE, "")})
    managed = f"{CI_MANAGER}({CI_OPTIONS})(?:run\x1f)?([^\x1f]*)\x1f(.*)$"
    exe, rest = F.substring_index("line", _SEP, 1), F.expr(f"substring(line, locate('{_SEP}', line) + 1)")
    c = c.withColumns({"exe": exe, "rest": rest, "managed": F.col("line").rlike(managed)}).withColumn("first", F.substring_index("rest", _SEP, 1))
    c = settle(c)  # else every expression below would hold all of the above
    body = F.regexp_replace("rest", "(?:^|(?<=\x1f))--\x1f.*$", "")
    plain = F.regexp_replace(body, f"(?:^|(?<=\x1f))(?:(?:{CI_VALUES})\x1f[^\x1f]*\x1f|-[^\x1f]*\x1f)", "")
    tokens = F.filter(F.split(plain, _SEP), lambda t: (t != "") & ~F.contains(t, F.lit("=")))
    later = F.flatten(F.transform(F.slice(tokens, 2, 1000), lambda t: F.split(t, ",")))
    targets = F.flatten(F.transform(F.regexp_extract_all(body, F.lit("(?:^|(?<=\x1f))(?:-t|--targets?)(?:=|\x1f)([^\x1f]*)\x1f"), F.lit(1)), lambda t: F.split(t, ",")))
    pair = F.split(F.get(tokens, 1), ":")
    nx = F.when(F.get(tokens, 0) == "run", F.array(F.get(pair, 1))).otherwise(F.concat(later, targets))
    tasks = F.when(F.col("exe") == "nx", nx).when(F.col("exe") == "turbo", F.filter(tokens, lambda t: t != "run")).when(F.col("exe").isin("make", "just"), tokens)
    interpreter = F.col("exe").isin("bash", "sh", "node") | F.col("exe").rlike(r"^python(3([.]\d+)?)?$")
    script = F.when(~F.col("managed"), F.when(interpreter, F.col("first")).when(F.contains("exe", F.lit("/")), F.col("exe")))
    stem = F.regexp_replace(F.element_at(F.split(script, "/"), -1), r"(?<=.)\.[^.]*$", "")
    one = F.when(F.col("managed"), workflow_tier(F.regexp_extract("line", managed, 2))).when((F.col("exe") == "node") & F.contains(F.concat(F.lit(_SEP), "rest"), F.lit(f"{_SEP}--test{_SEP}")), "unit")
    for names, firsts, tier in CI_PROGRAMS:
        one = one.when(F.col("exe").isin(*names) & (F.col("first").isin(*firsts) if firsts else F.lit(True)), tier)
    one = one.when(F.col("exe") == "tsc", F.when(F.contains("rest", F.lit("--noEmit")), "static").otherwise("build")).otherwise(workflow_tier(stem))
    tiers = F.array_distinct(F.array_compact(F.when(tasks.isNotNull(), F.transform(tasks, lambda t: workflow_tier(t))).otherwise(F.array(one))))
    every = F.concat("chosen", F.when(F.col("managed"), F.concat(F.regexp_extract("line", managed, 1), F.regexp_extract("line", managed, 3))).otherwise(F.col("rest")))
    filters = F.regexp_extract_all(every, F.lit("(?:^|(?<=\x1f))(?:--filter|-F|--workspace|-w|--projects?)(?:=|\x1f)([^\x1f]*)\x1f"), F.lit(1))
    project = F.when((F.col("exe") == "nx") & (F.get(tokens, 0) == "run"), F.array(F.get(pair, 0))).otherwise(F.array().cast("array<string>"))
    run = F.when(F.contains("exe", F.lit("/")), F.array("exe")).otherwise(F.array().cast("array<string>"))  # a script names a path by itself
    paths = F.when(tasks.isNotNull(), F.array().cast("array<string>")).otherwise(F.concat(run, F.filter(F.transform(F.split(every, _SEP), lambda t: F.when(t.startswith("-"), F.regexp_extract(t, "^-[^=]*=(.*)$", 1)).otherwise(t)), lambda t: t != "")))
    at = F.regexp_extract(body, "(?:^|(?<=\x1f))(?:--cwd|-C|--directory)(?:=|\x1f)([^\x1f]*)\x1f", 1)
    named = F.flatten(F.transform(F.concat(filters, project), lambda f: F.split(f, ",")))
    placed = F.when(F.col("exe").isin("make", "turbo") & (at != ""), at)
    wanted = F.when(~F.coalesce(one.isNotNull() & F.col("exe").isin("node") & F.contains("rest", F.lit("--test")), F.lit(False)), script)
    kept = [*commands.columns, tiers.alias("tiers"), named.alias("filters"), paths.alias("args"), wanted.alias("script"), placed.alias("at")]
    return settle(c.select(*kept)).where(F.size("tiers") > 0)


def workflow_checks(files: DataFrame, units: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """(id, unit, tier, command) of CI commands among files (path, text); unit `.` where a command has no unit as its scope: a gate.

    A command belongs to the deepest unit (root) over its directory, to units whose package (name, unit) it selects, and to units over
    a path that it is given. Without units its directory is its unit. A script counts only if it is a file of the checkout.
    """
    w = parsers.rows(files.where(F.col("path").rlike(r"\.github/workflows/[^/]+\.ya?ml$")).select("path", "text"), "workflow", "job string, step int, name string, run string, dir string").where("run is not null").drop("text")
    c = parsers.rows(w.drop("error", "error_line"), "shell", "n int, command string, words array<string>", text="run").where("command is not null")
    ident = F.concat_ws(":", F.lit("ci"), F.regexp_extract("path", "([^/]+)$", 1), "job", F.col("step").cast("string"), F.col("n").cast("string"))
    said = ci_commands(c.select(ident.alias("id"), F.coalesce(normal_path(F.col("dir")), F.lit(".")).alias("dir"), "command", "words"))
    script = normal_path(join_path(F.col("dir"), F.col("script")))
    there = files.select(F.col("path").alias("file")).distinct()
    real = said.withColumn("file", script).join(there.withColumn("there", F.lit(True)), "file", "left").where("script is null or there")
    at = F.when(F.col("at").isNull(), F.col("dir")).otherwise(normal_path(join_path(F.col("dir"), F.col("at"))))
    one = real.select("id", "command", at.alias("at"), "filters", "args", "tiers")
    rows = one.select("id", "command", "at", "filters", "args", F.size("tiers").alias("n_tiers"), F.explode("tiers").alias("tier"))
    told = rows.select(F.when(F.col("n_tiers") > 1, F.concat_ws(":", "id", "tier")).otherwise(F.col("id")).alias("id"), "id", "tier", "command", "at").toDF("check", "id", "tier", "command", "at")
    if units is None:
        return told.select(F.col("check").alias("id"), F.col("at").alias("unit"), "tier", "command")
    own = longest_owner(one.select("id", "at"), units, "at").where("owner is not null and at <> '.'").select("id", F.col("owner").alias("unit"))
    literal = F.explode(F.filter("args", lambda a: ~a.rlike(r"[$`]") & ~a.startswith("/"))).alias("arg")
    given = one.select("id", "at", literal).select("id", normal_path(join_path(F.col("at"), F.regexp_replace("arg", r"/[*?].*$", ""))).alias("p")).where("p is not null and p <> '.'")
    over = given.select("id", F.explode(ancestors(F.col("p"))).alias("unit")).where("unit <> '.'").join(units.select(F.col("root").alias("unit")).distinct(), "unit", "left_semi")
    scope = own.unionByName(over.select("id", "unit"))
    if packages is not None:
        scope = scope.unionByName(one.select("id", F.explode("filters").alias("name")).join(packages.select("name", "unit"), "name").select("id", "unit"))
    return told.join(scope.distinct(), "id", "left").select(F.col("check").alias("id"), F.coalesce("unit", F.lit(".")).alias("unit"), "tier", "command")


def capabilities(files: DataFrame, declared: list[tuple[str, str]]) -> DataFrame:
    """(unit, name) of declared capabilities (name, pattern) that a unit's source shows."""
    hit = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in declared]))
    return files.where(~F.col("is_test")).select("unit", F.explode(hit).alias("name")).distinct()


# What states a port, and routes of health checks.
PORT = r"ListenAndServe\(\s*\":(\d{2,5})\"|\bPORT\s*=\s*\"?(\d{2,5})\"?|\bport:\s*(\d{2,5})\b"
HEALTH = r"[\"'`](/(?:healthz|health|livez|readyz|ready|ping|status))[\"'`]"


def port_facts(files: DataFrame) -> DataFrame:
    """(unit, port) where the source files of a unit state exactly one port; the first of a file counts."""
    group = lambda n: F.regexp_extract("text", PORT, n)
    ports = source_files(files).select("unit", F.concat(group(1), group(2), group(3)).alias("port")).where("port <> ''")
    return ports.groupBy("unit").agg(F.min("port").alias("port"), F.max("port").alias("other")).where("port = other").select("unit", "port")


def health_routes(files: DataFrame) -> DataFrame:
    """(unit, route, path) of health routes in source; the first of a file counts, and the first file of a route."""
    found = source_files(files).select("unit", "path", F.regexp_extract("text", HEALTH, 1).alias("route")).where("route <> ''")
    return found.groupBy("unit", "route").agg(F.min("path").alias("path"))


def client_resources(deps: DataFrame, clients: list[tuple[str, str]], resources: DataFrame) -> DataFrame:
    """usesResource edges (unit, resource, client): a unit's dependency is a client of a type of which exactly one resource exists."""
    kind = F.lit(None).cast("string")
    for pattern, t in reversed(clients):
        kind = F.when(F.col("name").rlike(pattern), t).otherwise(kind)
    one = resources.groupBy("type").agg(F.count("*").alias("n"), F.min("ref").alias("resource")).where("n = 1")
    return deps.withColumn("type", kind).where("type is not null").join(one, "type").select("unit", "resource", F.col("name").alias("client")).distinct()


# What names the discovery of an identity provider, and what shows a request for a token.
DISCOVERY = r"(?i)(\.well-known/openid-configuration|jwks_uri|token_endpoint|/oidc/token|oauth2?/token)"
TOKEN_REQUEST = r"(?i)(grant_?type|client_?id|client_?secret|jwks|authoriz|id_?token|access_?token|userinfo|refresh_?token)"


def oidc_clients(files: DataFrame, apis: list[tuple[str, str, str]]) -> DataFrame:
    """(unit, api, path): the first source file of a unit that names the discovery of an API and shows a request for a token.

    apis are authored (ref, unit of the provider, discovery path); a provider is no client of its own API.
    """
    shown = source_files(files).where(F.col("text").rlike(TOKEN_REQUEST))
    named = F.col("text").rlike(DISCOVERY)
    hit = [F.when((named | F.contains("text", F.lit(path))) & (F.col("unit") != provider), F.lit(ref)) for ref, provider, path in apis]
    return shown.select("unit", "path", F.explode(F.array_compact(F.array(*hit))).alias("api")).groupBy("unit", "api").agg(F.min("path").alias("path"))


# Files that hold bucket names, the names, and what shows the use of a store.
STORE_SOURCE = r"\.(ts|tsx|js|jsx|mts|cts|go|py|rb|java|kt|rs)$"
BUCKET = r"[\"'`]([a-z][a-z0-9-]{4,60})[\"'`]"
STORE = r"(?i)(@aws-sdk/client-s3|aws-sdk-s3|aws_sdk_s3|minio|google\.cloud\.storage|boto3|\bS3\b|bucket|Bucket|BlobService|createBucket)"


def _substrings(text: Column, lengths: Column) -> Column:
    """All parts of a text of the given lengths."""
    fit = F.filter(lengths, lambda n: n <= F.length(text))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(fit, of)))


def contained_names(literals: DataFrame, names: DataFrame) -> DataFrame:
    """(literal, name) of distinct literals and names of which one contains the other's first word (before a `-`).

    Both ways are hash joins: a text is exploded into its parts of those lengths that first words have.
    """
    first = lambda c: F.substring_index(c, "-", 1)
    lit = literals.select("literal").distinct().withColumn("word", first("literal"))
    nam = names.select("name").distinct().withColumn("word", first("name"))

    def within(whole: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
        lengths = parts.agg(F.collect_set(F.length("word"))).scalar()
        keys = whole.select(text, lengths.alias("lengths")).select(text, F.explode(_substrings(F.col(text), F.col("lengths"))).alias("word"))
        return keys.join(parts.select(part, "word"), "word").select("literal", "name")

    return within(lit, "literal", nam, "name").unionByName(within(nam, "name", lit, "literal")).distinct()


def bucket_uses(files: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uses, ambiguous): uses (unit, resource, bucket, path) of literals that exactly one dataset (ref, name) answers to.

    Only source that shows the use of a store counts. A literal that several datasets answer to is ambiguous (unit, path, bucket, n);
    of several literals of a unit for one dataset the first by file and name counts.
    """
    path = F.col("path")
    source = source_files(files).where(path.rlike(STORE_SOURCE) & F.col("text").rlike(STORE))
    found = source.select("unit", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(BUCKET), F.lit(1)))).alias("bucket"))
    pairs = contained_names(found.select(F.col("bucket").alias("literal")), datasets).join(datasets, "name")
    matches = pairs.groupBy(F.col("literal").alias("bucket")).agg(F.count("*").alias("n"), F.min("ref").alias("resource"))
    hit = found.join(matches, "bucket")
    first = F.min(F.struct("path", "bucket")).alias("f")
    uses = hit.where("n = 1").groupBy("unit", "resource").agg(first).select("unit", "resource", "f.bucket", "f.path")
    return uses, hit.where("n > 1").select("unit", "path", "bucket", "n")


def database_uses(migrations: DataFrame, connections: DataFrame) -> DataFrame:
    """(unit, resource): units that hold a resource's migrations and also connect to one."""
    return migrations.join(connections.select("unit").distinct(), "unit", "left_semi").select("unit", "resource").distinct()


def externals(deps: DataFrame, matchers: list[tuple[str, str, str, str]]) -> DataFrame:
    """(unit, name, role, mechanism) of dependencies that declared matchers (pattern, name, mechanism, role) know, in order of name."""
    out = F.array_compact(F.array(*[F.when(F.col("name").rlike(p), F.struct(F.lit(n).alias("external"), F.lit(r).alias("role"), F.lit(m).alias("mechanism"))) for p, n, m, r in sorted(matchers, key=lambda x: x[1])]))
    return deps.select("unit", F.explode(out).alias("e")).select("unit", F.col("e.external").alias("name"), "e.role", "e.mechanism").distinct()


def requirements_met(wanted: DataFrame, tasks: DataFrame) -> DataFrame:
    """wanted (subject, key, installs) with `verdict`: provided where a playbook task installs it, else absent."""
    have = tasks.where(F.col("module").rlike(r"(^|\.)(apt|dnf|yum|package|pip|npm|service|systemd)$")).select(F.col("name").alias("installs"), F.lit(True).alias("has")).distinct()
    return wanted.join(have, "installs", "left").withColumn("verdict", F.when(F.col("has"), "provided").otherwise("absent")).drop("has")


def workspace_roots(files: DataFrame) -> DataFrame:
    """(root): directories right under a base of the workspace file that hold a package manifest."""
    bases = parsers.rows(files.where(F.col("path") == "pnpm-workspace.yaml"), "workspace_bases", "base string").select("base").where("base is not null").distinct()
    manifests = files.where(F.col("path").rlike(r"/package\.json$")).select(F.regexp_replace("path", "/package\\.json$", "").alias("root"))
    return manifests.withColumn("base", parent_path(F.col("root"))).join(bases, "base", "left_semi").select("root").distinct()


def task_graph(files: DataFrame, refs: DataFrame, configs: DataFrame | None = None, manifests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(checks, untiered): checks (id, unit, tier, command, config_path) of tasks of the nearest task graph that a unit's package has as scripts.

    refs are (unit, ref); configs (path, text) are looked for among files unless given. Tasks without a tier are returned apart: they may be ordinary scripts.
    """
    configs = (files if configs is None else configs).where(F.col("path").rlike(r"(^|/)turbo\.json$"))
    tasks = parsers.rows(configs.select("path", "text"), "task_graph", "task string").where("task is not null").select(parent_path(F.col("path")).alias("config_dir"), F.col("path").alias("config_path"), "task")
    m = packages(files) if manifests is None else manifests
    scripts = m.where("kind = 'scripts'").select("unit", F.col("name").alias("task")).distinct()
    names = m.where("kind = 'name'").groupBy("unit").agg(F.min("name").alias("package"))
    near = nearest_config(scripts.select("unit").distinct(), tasks.select(F.col("config_dir").alias("dir")).distinct(), "unit")
    j = scripts.join(near, "unit").join(tasks, ["config_dir", "task"]).join(names, "unit", "left").join(refs, "unit").withColumn("tier", task_tier(F.col("task")))
    target = F.coalesce("package", F.concat(F.lit("./"), "unit"))
    checks = j.where("tier is not null").select(F.concat(F.lit("tg:"), "ref", F.lit(":"), "task").alias("id"), "unit", "tier", F.concat(F.lit("turbo run "), "task", F.lit(" --filter="), target).alias("command"), "config_path")
    return checks, j.where("tier is null").select("unit", "task")
