"""Edge manifests in two passes: what each declares, then which units its services and schedules call.

A name or a route has an owner only where exactly one unit stands first; a tie is an ambiguity and is told, not guessed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import join_path
from ..functions.text import route_of_file
from ..sources import parsers
from .events import source_files

# Names of the manifest in the order in which they are looked for, places of generated clients, directories of routes.
MANIFESTS = ["wrangler.toml", "wrangler.json", "wrangler.jsonc"]
GENERATED = ["/gen/", ".gen.", "/generated/"]
ROUTE_DIRS = ["src/app", "app", "src/pages", "pages"]
TARGET = r"^https?://[^/]+(/[^\s]*)$"


def declared(files: DataFrame) -> DataFrame:
    """(unit, path, kind, name, value) of the first edge manifest in the root of each unit, of files (unit, path, text)."""
    order = F.array(*[join_path(F.col("unit"), F.lit(n)) for n in MANIFESTS])
    found = files.withColumn("turn", F.array_position(order, F.col("path"))).where("turn > 0")
    first = found.groupBy("unit").agg(F.min_by(F.struct("path", "text"), "turn").alias("m")).select("unit", "m.path", "m.text")
    rows = parsers.rows(first, "edge_platform", "kind string, name string, value string")
    return rows.where("kind is not null").select("unit", "path", "kind", "name", "value")


def facts(manifest: DataFrame) -> DataFrame:
    """(unit, key, value_json) that manifests (see `declared`) claim: one claim a key, however many rows it has."""
    binding = ~F.col("kind").isin("name", "cron", "var")
    route = F.regexp_extract("value", TARGET, 1)
    texts = lambda on, value: F.array_sort(F.collect_set(F.when(on, value)))
    crons = F.array_sort(F.collect_list(F.when(F.col("kind") == "cron", F.col("value"))))
    g = manifest.groupBy("unit").agg(
        texts(binding & (F.col("name") != ""), F.col("name")).alias("names"), texts(binding, F.col("kind")).alias("kinds"), crons.alias("crons"), texts((F.col("kind") == "var") & (route != ""), route).alias("targets"),
    )
    json = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    some = F.size("crons") > 0
    pairs = [
        ("binding.declared", json("names")), ("binding.kind", json("kinds")), ("schedule.cron", F.when(some, F.concat(F.lit('"'), F.array_join("crons", ","), F.lit('"')))), ("schedule.enabled", F.when(some, F.lit("true"))), ("schedule.target", json("targets")),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value_json")) for k, v in pairs])
    return g.select("unit", F.explode(rows).alias("f")).select("unit", "f.*").where("value_json is not null")


def service_calls(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, unresolved): calls (source, target, contract_ref) of services that a unit's platform name answers to; unresolved
    (unit, service, path). Of units of one name the last by root counts."""
    names = manifest.where("kind = 'name'").groupBy(F.col("value").alias("service")).agg(F.max("unit").alias("target"))
    wanted = manifest.where("kind = 'service-binding'").select("unit", "path", F.col("value").alias("service")).distinct().join(names, "service", "left")
    calls = wanted.where("target is not null").select(F.col("unit").alias("source"), "target", F.col("path").alias("contract_ref")).distinct()
    return calls, wanted.where("target is null").select("unit", "service", "path")


def file_routes(files: DataFrame) -> DataFrame:
    """(unit, path, route) of files (unit, path) that are routes by their place."""
    of = []
    for base in ROUTE_DIRS:
        at = F.concat(join_path(F.col("unit"), F.lit(base)), F.lit("/"))
        rel = F.when(F.startswith("path", at), F.substring(F.col("path"), F.length(at) + 1, F.length("path")))
        of.append(files.select("unit", "path", route_of_file(F.lit(base), rel).alias("route")))
    return reduce(DataFrame.unionByName, of).where("route is not null")


def schedules(manifest: DataFrame, files: DataFrame, generated: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): edges (source, target, route, path) from units to the owners of the routes that their variables name.

    A route by the place of a file comes before a literal in source, and that before one in a generated client; of the units that
    stand first there must be one. Of a unit the first file that holds the literal counts.
    """
    wanted = manifest.where("kind = 'var'").select("unit", "path", F.regexp_extract("value", TARGET, 1).alias("route")).where("route <> ''").distinct()
    routes = wanted.select("route").distinct()
    served = file_routes(files).join(routes, "route").groupBy("route", F.col("unit").alias("owner")).agg(F.min("path").alias("file"))
    literal = F.regexp_extract_all("text", F.lit("[\"'`](/[^\"'`\\s]*)(?=[\"'`])"), F.lit(1))
    shown = source_files(files).select(F.col("unit").alias("owner"), "path", F.explode(F.array_distinct(literal)).alias("route")).join(routes, "route")
    named = shown.groupBy("route", "owner").agg(F.min("path").alias("file")).join(served.select("route", "owner"), ["route", "owner"], "left_anti")
    made = reduce(lambda a, b: a | b, [F.contains("file", F.lit(p)) for p in generated or GENERATED])
    owners = served.withColumn("score", F.lit(2)).unionByName(named.withColumn("score", F.when(made, 0).otherwise(1)))
    met = wanted.join(owners, "route", "left").withColumn("score", F.when(F.col("owner") != F.col("unit"), F.col("score")))
    best = met.groupBy("unit", "path", "route").agg(F.max("score").alias("best"), F.max(F.struct("score", "owner", "file")).alias("top"))
    first = met.join(best.select("unit", "path", "route", "best"), ["unit", "path", "route"]).where("score = best").groupBy("unit", "path", "route").agg(F.count("*").alias("n"))
    j = best.join(first, ["unit", "path", "route"], "left")
    edges = j.where("n = 1").select(F.col("unit").alias("source"), F.col("top.owner").alias("target"), "route", F.col("top.file").alias("path"))
    return edges, j.where("n is null or n > 1").select("unit", "route", "path")
