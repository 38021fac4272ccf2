"""Contracts: who consumes them, which one covers a path, and coverage of contract files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle, stored
from .context import covering_contract

#: Names of build configuration files, endings of code, and of documentation.
BUILD_CONFIG = (
    r"(^|/)(package\.json|go\.mod|buf\.gen\.yaml|buf\.yaml|buf\.work\.yaml|codegen\.yaml|codegen\.yml|openapi-ts\.config\.ts|openapi-ts\.config\.js"
    r"|oapi-codegen\.yaml|oapi-codegen\.yml|turbo\.json|Makefile|justfile|Taskfile\.yml|build\.gradle|build\.gradle\.kts|pom\.xml)$"
)
CODE = r"\.(ts|tsx|js|jsx|mts|cts|mjs|cjs|go|py|rb|java|kt|rs|ex|exs|cs|php|swift|gradle|proto|graphql|sql)$"
DOCUMENTATION = r"\.(md|mdx|txt|adoc|rst)$|(^|/)docs/"
#: By which runs texts and contracts meet: how far apart they begin in a text, their length, the least length of the contracts
#: that may use them (step + length - 1, so that one lies in the contract wherever that begins), and that of those too long.
GRAMS = ((24, 24, 95, None), (12, 12, 47, 95), (6, 12, 17, 95), (6, 6, 11, 17), (3, 9, 11, 17), (3, 6, 8, 11), (3, 5, 7, 11), (3, 3, 5, 11))


def reference_sites(files: DataFrame) -> DataFrame:
    """Files (path) that can make their unit a consumer: code and build configuration, never documentation."""
    p = F.col("path")
    return files.where(~p.rlike(DOCUMENTATION) & (p.rlike(CODE) | p.rlike(BUILD_CONFIG)))


def _rare_runs(refs: DataFrame, step: int, gram: int) -> DataFrame:
    """(ref, step, gram, run, n) of contracts: for each place a contract can have against the runs of a text, its rarest run there, with n uses.

    A run of a text begins every `step` characters, so that wherever a contract lies in it, the runs at one residue of
    the contract's starts are whole. What many contracts share (their directory) is passed over for what few have.
    """
    starts = F.sequence(F.lit(1), F.char_length("ref") - gram + 1)
    runs = refs.select("ref", F.posexplode(F.transform(starts, lambda i: F.xxhash64(F.substring("ref", i, F.lit(gram))))).alias("at", "run"))
    counted = runs.join(runs.groupBy("run").agg(F.count("*").alias("n")), "run")
    rarest = counted.groupBy("ref", (F.col("at") % step).alias("residue")).agg(F.min(F.struct("n", "at", "run")).alias("x"))
    return rarest.select("ref", F.lit(step).alias("step"), F.lit(gram).alias("gram"), "x.run", "x.n")


def _keys(refs: DataFrame, used: list) -> DataFrame:
    """(ref, step, gram, run) of contracts, by the kind of runs that each shares least with others, the widest step of several.

    Short runs are few (a thousand of three digits), so that with more contracts ever more of them share each.
    """
    runs = reduce(DataFrame.unionByName, [_rare_runs(refs.where(on), step, gram) for step, gram, on in used])
    shared = runs.groupBy("ref", "step", "gram").agg(F.avg("n").alias("n"))
    best = shared.groupBy("ref").agg(F.min_by(F.struct("step", "gram"), F.struct("n", -F.col("step"), "gram")).alias("x")).select("ref", "x.*")
    return runs.join(best, ["ref", "step", "gram"]).select("ref", "step", "gram", "run").distinct()


def candidates(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct (unit, path, ref) of files whose text has a run of the contract's rarest; a superset of containment.

    Contracts shorter than the least of GRAMS have no runs. Texts are read and dealt once, in the lengths that are used.
    """
    size = F.char_length("ref")
    bounds = [(step, gram, (size >= low) & (size < above) if above else size >= low) for step, gram, low, above in GRAMS]
    there = refs.agg(*[F.bool_or(on) for _, _, on in bounds]).first()
    used = [kind for kind, on in zip(bounds, there, strict=True) if on]
    if not used:
        return files.select("unit", "path").limit(0).crossJoin(refs.select("ref").limit(0))
    keyed = stored(_keys(refs, used))
    chosen = sorted((x.step, x.gram) for x in keyed.select("step", "gram").distinct().collect())
    cuts = [F.transform(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{gram}}})).{{{step}}}"), F.lit(1)), lambda x: F.xxhash64(x)) for step, gram in chosen]
    texts = files.select("unit", "path", F.explode(F.array_distinct(F.concat(*cuts))).alias("run"))
    return texts.join(keyed, "run").select("unit", "path", "ref").distinct()


def consumers(files: DataFrame, contracts: DataFrame) -> DataFrame:
    """(ref, unit, path, label) of files (unit, path, text) of other units whose text contains a contract path.

    Take `reference_sites` of all files first, so that a document that quotes a contract makes no edge.

    The substring join is a hash join: texts are cut into runs in one pass over their characters for each kind of runs, and meet the runs that
    contracts are known by (see `_rare_runs`) by their hashes; whole containment is checked after. The runs of contracts
    are stored, so that Catalyst can look texts up in them where they are few. Only what is shorter than any path with an
    ending is compared directly.
    """
    known = settle(contracts.select("ref", "provider").distinct())
    pairs = candidates(files, known.select("ref").distinct()).join(known, "ref").where("unit <> provider").select("unit", "path", "ref").distinct()
    out = pairs.join(files.select("unit", "path", "text"), ["unit", "path"]).where(F.contains("text", F.col("ref"))).select("ref", "unit", "path").distinct()
    tiny = settle(known.where(F.char_length("ref") < GRAMS[-1][2])).coalesce(1)  # each task of texts reads them once
    if not tiny.isEmpty():
        out = out.unionByName(files.join(tiny, F.contains("text", F.col("ref")) & (F.col("unit") != F.col("provider"))).select("ref", "unit", "path").distinct())
    return out.withColumn("label", F.when(F.col("path").rlike(BUILD_CONFIG), "codegen").otherwise("source-reference"))


def labelled(uses: DataFrame) -> DataFrame:
    """(ref, unit, via): codegen if any of the unit's files that refer to the contract is a build configuration."""
    return uses.groupBy("ref", "unit").agg(F.when(F.bool_or(F.col("label") == "codegen"), "codegen").otherwise("source-reference").alias("via"))


def lookup(files: DataFrame, contracts: DataFrame) -> DataFrame:
    return covering_contract(files, contracts)


def claims(contracts: DataFrame, found: DataFrame) -> DataFrame:
    """(ref, verdict): contracts that several APIs claim, and contract files that none does."""
    n = contracts.groupBy("ref").agg(F.count_distinct("api_ref").alias("n"))
    shared = n.where("n > 1").select("ref", F.lit("shared").alias("verdict"))
    return shared.unionByName(found.select("ref").distinct().join(n, "ref", "left_anti").select("ref", F.lit("unclaimed").alias("verdict")))


#: What marks a protobuf file, its services, and a GraphQL schema.
PROTO_SYNTAX, PROTO_SERVICE, GRAPHQL_TYPE = r"(?m)^\s*(syntax|edition)\s*=", r"(?m)^\s*service\s+[A-Za-z0-9_]+", r"(type|schema|interface|input|enum|scalar)\s+[A-Za-z_]"


def syntax_problems(files: DataFrame) -> DataFrame:
    """(path, problem): the first fault of each contract file (path, type, text) by the form that its type asks for."""
    from ..sources import parsers

    outline = "openapi string, asyncapi string, title string, paths boolean, channels boolean, components boolean"
    c = F.col
    read = parsers.rows(files.where(c("type").isin("openapi", "asyncapi")), "contract_outline", outline)
    openapi = (
        F.when(c("openapi").isNull(), "missing 'openapi' version field").when(~c("openapi").rlike(r"^3\.[01]"), F.concat(F.lit("openapi must be 3.0 or 3.1, got "), "openapi")).when(~c("paths"), "missing 'paths' object")
        .when(~c("components"), "missing 'components' object").when(c("title").isNull(), "missing 'info.title'")
    )
    asyncapi = F.when(c("asyncapi").isNull(), "missing 'asyncapi' field").when(~c("channels"), "missing 'channels' object")
    parsed = read.select("path", F.coalesce(c("error"), F.when(c("type") == "openapi", openapi).otherwise(asyncapi)).alias("problem"))
    proto = F.when(~c("text").rlike(PROTO_SYNTAX), "missing syntax or edition declaration").when(~c("text").rlike(PROTO_SERVICE), "no service definitions found")
    graphql = F.when(~c("text").rlike(GRAPHQL_TYPE), "no GraphQL type definitions found")
    plain = files.where(~c("type").isin("openapi", "asyncapi", "oidc"))
    known = F.when(c("type") == "protobuf", proto).when(c("type").isin("graphql", "graphql-sdl"), graphql).otherwise(F.concat(F.lit("unsupported contract type "), "type"))
    return parsed.unionByName(plain.select("path", known.alias("problem"))).where("problem is not null")


def without_discovery(providers: DataFrame, operations: DataFrame, discovery: str = "/.well-known/openid-configuration") -> DataFrame:
    """Providers (ref, unit) of OIDC whose unit serves no route (unit, route) that holds the discovery path."""
    serves = operations.where(F.contains("route", F.lit(discovery))).select("unit").distinct()
    return providers.join(serves, "unit", "left_anti").select("ref")
