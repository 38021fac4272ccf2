"""Crates: which crate of the checkout a dependency ends at, and the edges of manifests and of imports.

A dependency names its crate by a path, by the table of its workspace (the nearest manifest above that has one), or by a
patch or replacement of its own manifest or of its workspace's. Each way is a hash join that gives rows (dependency,
directory); two different crates at the ends refuse the name. Ends are compared by least and greatest, so that a
dependency is one small aggregate however many ways lead to it, and no group is held in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import join_path, normal_path, parent_path
from ..functions.text import rust_ident
from ..plans.settle import settle
from ..sources import parsers
from .own import longest_owner

LINKS = "kind string, key string, name string, place string, inherits boolean"
#: What tells a dependency apart: a manifest may say the same key again for another platform.
DEPENDENCY = ("unit", "kind", "key", "name", "place", "inherits")


def manifests(files: DataFrame) -> DataFrame:
    """(dir, kind, key, name, place, inherits) of what the crate manifests among files (path, text) say; settled.

    kind: package, workspace, build, test (dependencies), shared (a dependency in the table of a workspace), redirect.
    """
    found = parsers.rows(files.where(F.col("path").rlike(r"(^|/)Cargo\.toml$")).select("path", "text"), "crate_links", LINKS)
    return settle(found.where("kind is not null").select(parent_path(F.col("path")).alias("dir"), "kind", "key", "name", "place", "inherits"))


def inside(directory: Column, place: Column) -> Column:
    """The directory that a relative place means; null where it leads out of the checkout."""
    return F.when(~place.startswith("/") & ~F.contains(place, F.lit("\\")), normal_path(join_path(directory, place)))


def resolve(said: DataFrame) -> DataFrame:
    """(unit, kind, key, name, target, crate, ambiguous) of the dependencies that lead to a crate, or to several.

    A path that leads out of the checkout ends nowhere, whatever else there is; a redirect that does so counts for nothing.
    """
    packages = said.where("kind = 'package'").select(F.col("dir").alias("to"), F.col("name").alias("crate"))
    spaces = said.where("kind = 'workspace'").select(F.col("dir").alias("root"))
    homes = longest_owner(packages.select(F.col("to").alias("unit")), spaces, "unit").withColumnRenamed("owner", "space")
    dependencies = said.where("kind in ('build', 'test')").withColumnRenamed("dir", "unit").join(homes, "unit")
    shared = said.where("kind = 'shared' and place is not null").select(F.col("dir").alias("space"), F.col("key").alias("entry"), inside(F.col("dir"), F.col("place")).alias("to")).distinct()
    redirects = said.where("kind = 'redirect'").select(F.col("dir").alias("base"), rust_ident(F.col("name")).alias("ident"), inside(F.col("dir"), F.col("place")).alias("to")).where("to is not null").distinct()
    by_path = dependencies.where("place is not null").select(*DEPENDENCY, inside(F.col("unit"), F.col("place")).alias("to"), F.lit("path").alias("way"))
    inherited = dependencies.where("inherits and space is not null").withColumn("entry", F.explode(F.array_distinct(F.array("key", "name"))))
    by_table = inherited.join(shared, ["space", "entry"]).select(*DEPENDENCY, "to", F.lit("table").alias("way"))
    based = dependencies.withColumn("base", F.explode(F.array_distinct(F.array_compact(F.array("unit", "space"))))).withColumn("ident", rust_ident(F.col("name")))
    by_redirect = based.join(redirects, ["base", "ident"]).select(*DEPENDENCY, "to", F.lit("redirect").alias("way"))
    ends = by_path.unionByName(by_table).unionByName(by_redirect).join(packages.withColumn("known", F.lit(True)), "to", "left")
    at, table = F.when(F.col("known"), F.col("to")), F.when(F.col("way") == "table", F.col("to"))
    g = ends.groupBy(*DEPENDENCY).agg(
        F.bool_or(F.col("to").isNull()).alias("escapes"), F.min(at).alias("target"), F.max(at).alias("other"), F.max_by("crate", at).alias("crate"), (F.min(table) != F.max(table)).alias("torn")
    )
    torn = F.coalesce("torn", F.lit(False)) | F.coalesce(F.col("target") != F.col("other"), F.lit(False))
    out = g.where("not escapes").withColumn("ambiguous", torn).where("ambiguous or target is not null")
    return out.select("unit", "kind", "key", "name", F.when(~torn, F.col("target")).alias("target"), F.when(~torn, F.nullif("crate", F.lit(""))).alias("crate"), "ambiguous")


def _typed(build: Column) -> Column:
    return F.when(build, "buildDependsOn").otherwise("testDependsOn").alias("type")


def edges(resolved: DataFrame) -> DataFrame:
    """(type, source, target, via, package) of manifests; a test edge where only tests need the crate."""
    hit = resolved.where("target is not null and target <> unit")
    rank = F.struct(F.col("kind") != "build", "key")
    g = hit.groupBy("unit", "target").agg(F.bool_or(F.col("kind") == "build").alias("build"), F.max("crate").alias("crate"), F.min_by("name", rank).alias("name"))
    return g.select(_typed(F.col("build")), F.col("unit").alias("source"), "target", F.lit("cargo-manifest").alias("via"), F.coalesce("crate", "name").alias("package"))


def imports(files: DataFrame, resolved: DataFrame, said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, ambiguous (unit, name)) of the crates that source files (unit, path, text) use.

    Only what the manifest names makes an edge: a module and a crate that was left out look the same. An identifier of
    several dependencies, or of no dependency and several crates of the checkout, is ambiguous.
    """
    uses = parsers.rows(files.where(F.col("path").rlike(r"\.rs$")).select("unit", "text"), "rust_idents", "name string")
    uses = settle(uses.where("name is not null").select("unit", F.col("name").alias("ident")).distinct())
    other = F.when(F.col("target") != F.col("unit"), F.col("target"))
    known = resolved.groupBy("unit", rust_ident(F.col("key")).alias("ident")).agg(
        F.bool_or("ambiguous").alias("torn"), F.min(other).alias("target"), F.max(other).alias("last"), F.bool_or(F.col("kind") == "build").alias("build"),
        F.max_by(F.coalesce("crate", "name"), other).alias("package"),
    )
    found = uses.join(known, ["unit", "ident"], "left")
    torn = F.coalesce(F.col("torn") | (F.col("target") != F.col("last")), F.col("torn"), F.lit(False))
    made = found.where(~torn & F.col("target").isNotNull()).select(_typed(F.col("build")), F.col("unit").alias("source"), "target", F.lit("source-import").alias("via"), "package")
    crates = said.where("kind = 'package'").select(rust_ident(F.col("name")).alias("ident"), "dir")
    sharing = crates.groupBy("ident").agg(F.count("*").alias("n")).where("n > 1")
    mine = crates.select(F.col("dir").alias("unit"), "ident").withColumn("own", F.lit(1))
    loose = found.where(~torn & F.col("target").isNull()).join(sharing, "ident").join(mine, ["unit", "ident"], "left").where("n - coalesce(own, 0) > 1")
    return made, found.where(torn).select("unit", F.col("ident").alias("name")).unionByName(loose.select("unit", F.col("ident").alias("name")))


def shared_names(said: DataFrame) -> DataFrame:
    """(unit, name) of crates whose name another crate has too."""
    packages = said.where("kind = 'package' and name <> ''").select(F.col("dir").alias("unit"), "name")
    return packages.join(packages.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "name").select("unit", "name")


def checks(said: DataFrame) -> DataFrame:
    """(id, unit, tier, command) of each crate with a name that a shell takes as it is."""
    each = F.array(*[F.struct(F.lit(f"cargo-{n}").alias("n"), F.lit(tier).alias("tier"), F.lit(f"cargo {n} -p ").alias("command")) for n, tier in (("test", "unit"), ("clippy", "static"))])
    named = said.where("kind = 'package'").where(F.col("name").rlike("^[A-Za-z0-9_-]+$")).select("dir", "name", F.explode(each).alias("c"))
    return named.select(F.concat("dir", F.lit(":"), "c.n").alias("id"), F.col("dir").alias("unit"), "c.tier", F.concat("c.command", "name").alias("command"))
