"""Ownership: the longest-prefix join and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, depth, glob_to_regex, in_generated_dir, join_path


def longest_owner(files: DataFrame, owners: DataFrame, path: str = "path", root: str = "root", ord_: str | None = None) -> DataFrame:
    """files with `owner`, the deepest owner of each path (first of equals by ord_); null where none owns it.

    Every path is exploded into the owners it can have, so that the prefix join becomes a hash join.
    """
    key = owners.groupBy(F.col(root).alias("root_")).agg(F.min(F.col(ord_) if ord_ else F.lit(0)).alias("ord_"))
    up = files.select(F.col(path).alias("path_")).distinct().withColumn("root_", F.explode(ancestors(F.col("path_"))))
    best = up.join(key, "root_").groupBy("path_").agg(F.max_by("root_", F.struct(depth(F.col("root_")), -F.col("ord_"))).alias("owner"))
    return files.join(best, files[path] == best["path_"], "left").drop("path_")


def nearest_config(files: DataFrame, configs: DataFrame, path: str = "path", directory: str = "dir") -> DataFrame:
    """files with `config_dir`, the nearest directory above that holds a config."""
    return longest_owner(files, configs.select(F.col(directory).alias("root")), path, "root").withColumnRenamed("owner", "config_dir")


def unit_files(files: DataFrame, units: DataFrame, path: str = "path") -> DataFrame:
    """(unit, path) of the files of each unit, without those of units nested in it."""
    return longest_owner(files, units, path).where("owner is not null").select(F.col("owner").alias("unit"), path)


def prefix_scan(files: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """(prefix, path) of files that are the prefix, lie under it, or are the module `prefix.*`."""
    p = F.col(path)
    stem = F.regexp_replace(p, r"\.[^./]*$", "")
    keys = F.array_distinct(F.concat(ancestors(p), F.array(stem)))
    return files.select(path).withColumn(prefix, F.explode(keys)).join(prefixes.select(prefix).distinct(), prefix).select(prefix, path).distinct()


def list_dir(files: DataFrame, path: str = "path") -> DataFrame:
    """(parent, children) of every directory; directories end with a slash."""
    segs = F.split(F.col(path), "/")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(segs)),
        lambda i: F.struct(
            F.when(i == 1, ".").otherwise(F.array_join(F.slice(segs, F.lit(1), i - 1), "/")).alias("parent"),
            F.concat(F.element_at(segs, i), F.when(i < F.size(segs), "/").otherwise("")).alias("child"),
        ),
    )
    return files.select(F.explode(steps).alias("s")).groupBy("s.parent").agg(F.array_sort(F.collect_set("s.child")).alias("children"))


def visible(files: DataFrame, ignored: DataFrame | None = None, path: str = "path", generated: list[str] | None = None) -> DataFrame:
    """files without those in generated directories and without ignored paths (exact, or any path under one)."""
    kept = files.where(~in_generated_dir(F.col(path), generated))
    if ignored is None:
        return kept
    up = kept.select(F.col(path).alias("path_"), F.explode(ancestors(F.col(path))).alias("ignored_"))
    hit = up.join(ignored.select(F.col("path").alias("ignored_")).distinct(), "ignored_", "left_semi").select(F.col("path_").alias(path)).distinct()
    return kept.join(hit, path, "left_anti")


def expand_glob(files: DataFrame, glob: str, path: str = "path") -> DataFrame:
    return files.where(F.col(path).rlike(glob_to_regex(glob)))


def candidate_roots(*sources: DataFrame) -> DataFrame:
    """One row a root of all sources (root, explicit)."""
    out = sources[0].select("root", "explicit")
    for s in sources[1:]:
        out = out.unionByName(s.select("root", "explicit"))
    return out.groupBy("root").agg(F.bool_or("explicit").alias("explicit"))


def shape_flags(markers: DataFrame) -> DataFrame:
    """deployable, importable, present, eligible of each root from its markers (root, shape, explicit)."""
    has = lambda *s: F.bool_or(F.col("shape").isin(*s))
    out = markers.groupBy("root").agg(
        has("both", "deployable").alias("deployable"), has("both", "importable").alias("importable"), has("both", "deployable", "importable", "present").alias("present"), F.bool_or("explicit").alias("explicit")
    )
    return out.withColumn("eligible", F.col("deployable") | F.col("importable") | F.col("explicit"))


def not_units(units: DataFrame, excluded: list[str]) -> DataFrame:
    """units without the roots that are, or lie under, an excluded one; explicit roots stay."""
    hit: Column = F.lit(False)
    for x in excluded:
        hit = hit | (F.col("root") == x) | F.col("root").startswith(f"{x}/")
    return units.where(~hit | F.col("explicit"))


def unique_names(names: DataFrame, name: str = "name", unit: str = "unit", ord_: str = "ord", refuse: bool = True) -> DataFrame:
    """(name, unit, ambiguous): the unit of a name. Where several claim it, none has it if refuse, else the first."""
    out = names.groupBy(name).agg(F.count_distinct(unit).alias("n"), F.min_by(unit, ord_).alias("first"))
    return out.select(name, F.when((F.col("n") == 1) | F.lit(not refuse), F.col("first")).alias(unit), (F.col("n") > 1).alias("ambiguous"))


def workspace_members(dirs: DataFrame, include: list[str], exclude: list[str], path: str = "path") -> DataFrame:
    """Directories that match a member pattern and no excluding one."""
    inside = F.lit(False)
    for g in include:
        inside = inside | F.col(path).rlike(glob_to_regex(g.rstrip("/")))
    for g in exclude:
        inside = inside & ~F.col(path).rlike(glob_to_regex(g.rstrip("/").lstrip("!")))
    return dirs.where(inside)


def matched_components(components: DataFrame, units: DataFrame) -> DataFrame:
    """(root, n_components, n_units, verdict) of component descriptors and units joined on root."""
    c = components.groupBy("root").agg(F.count("*").alias("n_components"))
    u = units.groupBy("root").agg(F.count("*").alias("n_units"))
    both = c.join(u, "root", "full_outer").select("root", F.coalesce("n_components", F.lit(0)).alias("n_components"), F.coalesce("n_units", F.lit(0)).alias("n_units"))
    verdict = F.when(F.col("n_units") == 0, "orphan").when(F.col("n_components") == 0, "undescribed").when(F.col("n_components") > 1, "shared").otherwise("matched")
    return both.withColumn("verdict", verdict)


#: Conventional files of a unit.
RUNBOOKS = ["RUNBOOK.md", "OPERATIONS.md", "ONCALL.md"]


def unit_documents(units: DataFrame, files: DataFrame, candidates: dict[str, list[str]], declared: DataFrame | None = None) -> DataFrame:
    """(root, kind, path) of the conventional files of units (root) that exist, and of what descriptors declare (root, kind, path)."""
    names = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, ns in candidates.items() for n in ns])
    wanted = units.select("root", F.explode(names).alias("c")).select("root", "c.kind", join_path(F.col("root"), F.col("c.name")).alias("path"))
    there = wanted.join(files.select("path").distinct(), "path", "left_semi").select("root", "kind", "path")
    return (there if declared is None else there.unionByName(declared.select("root", "kind", "path"))).distinct()
