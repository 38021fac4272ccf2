"""Event subjects in source: literals and constants of units that a unit can see, roles by hints, declared catalogs.

A file that publishes or consumes anywhere has that role for every subject it shows: literals, and names of constants that
its unit can see, which are those of the unit itself and of all units it depends on, directly or not. Which units see which
is worked out for all units at once, for those pairs alone in which one has a role and the other has a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import reachable_pairs
from .own import prefix_scan

# Files of source, tests among them, the forms of subjects and of constants, and what shows a role.
SOURCE = r"\.(ts|tsx|js|jsx|mts|cts|mjs|cjs|go|py|rb|java|kt|rs|ex|exs|cs|php)$"
DECLARING = r"\.(ts|tsx|js|jsx|mts|cts|mjs|cjs|go|py|rb|java|kt|rs|ex|exs|cs|php|swift|scala|sh)$"
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/"
TEST_FILE = r"\.(test|spec)\."
TEST_ENDING = r"_test\.[a-z]+$"
SUBJECT = r"[\"'`]([a-z][a-z0-9_-]*(?:\.[a-z0-9_-]+)+(?:[.*>])?|[a-z][a-z0-9_-]*(?:\.[a-z0-9_-]+)+\.(?:\*|>))[\"'`]"
DECLARED = r"\b([A-Za-z_$][\w$]*)\b\s*(?::\s*string\s*)?=\s*[\"'`]([a-z][a-z0-9_-]*(?:\.[a-z0-9_-]+){2,}(?:[.*>])?)[\"'`]"
DECLARED_SUBJECT = r"\b([A-Z][A-Z0-9_]*_SUBJECT)\b\s*[=:]\s*[\"'`]([a-z][a-z0-9_-]*(?:\.[a-z0-9_-]+){2,}(?:[.*>])?)[\"'`]"
NAME = r"\b([A-Za-z_$][\w$]*)\b"
PUBLISHES = r"\b(publish|emit|enqueue|produce|outbox|Publish\(|Emit\()"
CONSUMES = r"\b(subscribe|consume|onMessage|handler|WithFilterSubject|FilterSubjects|busloop|subscriber|ProcessBatch|dlq|DLQ|ack|Nak\()"


def _begins(pattern: Column, prefixes: list[str] | None) -> Column:
    found = F.lit(not prefixes)
    for p in prefixes or []:
        found = found | pattern.startswith(p)
    return found


def source_files(files: DataFrame) -> DataFrame:
    """Those of files (path, and is_test where known) that are source and no tests."""
    path = F.col("path")
    plain = files.where(path.rlike(DECLARING) & ~path.rlike(TEST_PATH) & ~path.rlike(TEST_FILE) & ~path.rlike(TEST_ENDING))
    return plain.where(~F.col("is_test")) if "is_test" in files.columns else plain


def constants(files: DataFrame) -> DataFrame:
    """(unit, name, pattern, path, place) of the constants that source files (unit, path, text) declare, tests left out."""
    source = source_files(files)

    def of(form: str, turn: int) -> DataFrame:
        names, patterns = (F.regexp_extract_all("text", F.lit(form), F.lit(g)) for g in (1, 2))
        shown = F.posexplode(F.arrays_zip(names.alias("name"), patterns.alias("pattern"))).alias("at", "c")
        found = source.select("unit", "path", shown)
        return found.select("unit", "c.name", "c.pattern", "path", F.struct(F.lit(turn).alias("turn"), "at").alias("place"))

    return of(DECLARED, 0).unionByName(of(DECLARED_SUBJECT, 1))


def seen_constants(wanted: DataFrame, declared: DataFrame, depends: DataFrame) -> DataFrame:
    """(unit, name, pattern): what each wanted (unit, name) stands for, by declared (see `constants`) and depends (src, dst).

    A later declaration replaces an earlier one: those of the unit itself come first, then those of the units it sees in order
    of their roots; within a unit they come by path and place.
    """
    last = declared.groupBy("unit", "name").agg(F.max_by("pattern", F.struct("path", "place")).alias("pattern"))
    units = wanted.select(F.col("unit").alias("node")).distinct()
    holders = last.select(F.col("unit").alias("node")).distinct()
    pairs = reachable_pairs(depends, units).join(holders, "node", "left_semi")
    named = wanted.select("unit", "name").distinct().join(last.select("name").distinct(), "name", "left_semi")
    candidates = named.join(pairs.select(F.col("seed").alias("unit"), F.col("node").alias("holder")), "unit")
    hit = candidates.join(last.select(F.col("unit").alias("holder"), "name", "pattern"), ["holder", "name"])
    order = F.struct((F.col("holder") != F.col("unit")).alias("other"), "holder")
    return hit.groupBy("unit", "name").agg(F.max_by("pattern", order).alias("pattern"))


def roles(files: DataFrame, depends: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """(unit, path, pattern, role) of subjects in files (unit, path, text) whose text publishes or consumes.

    depends (src, dst) are dependencies between units; with prefixes, only subjects that begin with one of them count.
    """
    path, text = F.col("path"), F.col("text")
    source = files.where(path.rlike(SOURCE) & ~path.rlike(TEST_PATH) & ~path.rlike(TEST_FILE))
    shown = source.select("unit", "path", "text", text.rlike(PUBLISHES).alias("producer"), text.rlike(CONSUMES).alias("consumer"))
    shown = shown.where("producer or consumer")
    roled = ["unit", "path", "producer", "consumer"]
    literal = shown.select(*roled, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(SUBJECT), F.lit(1)))).alias("pattern"))
    names = shown.select(*roled, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(1)))).alias("name"))
    declared = constants(files)
    names = names.join(declared.select("name").distinct(), "name", "left_semi")
    through = names.join(seen_constants(names, declared, depends), ["unit", "name"]).select(*roled, "pattern")
    found = literal.unionByName(through).where(_begins(F.col("pattern"), prefixes)).distinct()
    as_role = F.explode(F.array_compact(F.array(F.when(F.col("producer"), "producer"), F.when(F.col("consumer"), "consumer"))))
    return found.select("unit", "path", "pattern", as_role.alias("role"))


def catalog(files: DataFrame, catalogs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roles, unresolved) of declared event catalogs (ord, path, format, consumer).

    A catalog is a file, a directory or a module prefix. One of format `code` names the subjects in its source files, any other
    is a JSON object whose keys are subjects; its consumer consumes all of them. roles are (pattern, role, component,
    contract_ref, ord); a path that no file answers to is unresolved (path).
    """
    there = prefix_scan(files, catalogs.select(F.col("path").alias("prefix")), "path", "prefix")
    held = catalogs.select("ord", F.col("path").alias("prefix"), "format", "consumer").join(there, "prefix").join(files.select("path", "text").distinct(), "path")
    code = F.when((F.col("format") == "code") & F.col("path").rlike(SOURCE), F.regexp_extract_all("text", F.lit(SUBJECT), F.lit(1)))
    keys = F.when((F.col("format") != "code") & (F.col("path") == F.col("prefix")), F.map_keys(F.from_json("text", "map<string,string>")))
    subjects = F.explode(F.array_distinct(F.coalesce(code, keys))).alias("pattern")
    found = held.select(subjects, F.lit("consumer").alias("role"), F.col("consumer").alias("component"), F.col("prefix").alias("contract_ref"), "ord")
    unresolved = catalogs.select("path").distinct().join(there.select(F.col("prefix").alias("path")), "path", "left_anti")
    return found.where("pattern is not null").distinct(), unresolved


def checked(interfaces: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, diagnostics) of interfaces (pattern, producers, consumers, contract_ref).

    A pattern whose contract is not among files (path), as a file or a directory, is an error and no event. One that nobody
    produces is an event without resolution, and a warning.
    """
    from ..functions.paths import ancestors

    wanted = interfaces.select(F.col("contract_ref").alias("there")).where("there is not null").distinct()
    there = files.select(F.explode(ancestors(F.col("path"))).alias("there")).join(wanted, "there", "left_semi").distinct()
    known = interfaces.join(there, F.col("contract_ref") == F.col("there"), "left").withColumn("known", F.col("there").isNotNull()).drop("there")
    resolution = F.when(F.size("producers") > 0, "resolved").otherwise("unresolved").alias("resolution")
    events = known.where("known").select("pattern", "producers", "consumers", "contract_ref", resolution)
    code = F.when(~F.col("known"), "EVENT_CONTRACT").when(F.size("producers") == 0, "EVENT_UNRESOLVED")
    problems = known.select(
        F.when(F.col("known"), "warning").otherwise("error").alias("severity"), code.alias("code"), F.col("pattern").alias("subject"),
        F.when(F.col("known"), F.concat_ws(", ", "consumers")).otherwise(F.coalesce("contract_ref", F.lit("none"))).alias("message"),
    )
    return events, problems.where("code is not null")
