"""Section indexes: events, externals, capabilities, checks and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import event_plausible, redact_command


def event_interfaces(roles: DataFrame) -> DataFrame:
    """One row a pattern from (pattern, role, component, contract_ref, ord): producers, consumers, the last contract."""
    side = lambda r: F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("component"))))
    last = F.max_by("contract_ref", F.when(F.col("contract_ref").isNotNull(), F.col("ord")))
    return roles.groupBy("pattern").agg(side("producer").alias("producers"), side("consumer").alias("consumers"), last.alias("contract_ref"))


def split_plausible(roles: DataFrame, prefixes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    ok = event_plausible(F.col("pattern"), prefixes)
    return roles.where(ok), roles.where(~ok)


def fold_families(events: DataFrame, families: DataFrame) -> DataFrame:
    """events with `family`: the first declared `prefix*` or `prefix>` (by ord) that their pattern starts with.

    A pattern that is a family itself (`x.*`, `x.>`) is never folded into another. Families become prefixes; each pattern is exploded into its own prefixes that are as long as some family, so that
    the prefix join is a hash join.
    """
    pre = families.select(F.col("family"), F.col("ord").alias("f_ord"), F.regexp_replace("family", r"[*>]$", "").alias("prefix")).where("prefix <> ''")  # a family
    lengths = F.broadcast(pre.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths")))  # one row
    plain = events.where(~F.col("pattern").rlike(r"\.[*>]$")).select("pattern").distinct()
    keys = plain.crossJoin(lengths).select("pattern", F.explode(F.filter("lengths", lambda n: n <= F.length("pattern"))).alias("n"))
    hit = keys.select("pattern", F.substring("pattern", F.lit(1), F.col("n")).alias("prefix")).join(pre, "prefix")
    best = hit.groupBy("pattern").agg(F.min_by("family", "f_ord").alias("family"))
    return events.join(best, "pattern", "left")


def fold_roles(roles: DataFrame) -> DataFrame:
    """roles (pattern, ord, ...) with the pattern of their family, where a family `x.*` or `x.>` is among the patterns.

    Families count in order of their first row; interfaces of the result are those of the folded patterns.
    """
    families = roles.where(F.col("pattern").rlike(r"\.[*>]$")).groupBy(F.col("pattern").alias("family")).agg(F.min("ord").alias("ord"))
    folded = fold_families(roles, families)
    return folded.withColumn("pattern", F.coalesce("family", "pattern")).drop("family")


def resolve_events(interfaces: DataFrame) -> DataFrame:
    """interfaces with `resolution`: resolved where someone produces it."""
    return interfaces.withColumn("resolution", F.when(F.size("producers") > 0, "resolved").otherwise("unresolved"))


def first_wins(rows: DataFrame, keys: list[str], ord_: str = "ord", prov: str = "prov") -> DataFrame:
    """One row a key: the fields of the first row, the provenance of all."""
    rest = [c for c in rows.columns if c not in (*keys, ord_, prov)]
    g = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), ord_).alias("f"), F.array_sort(F.collect_set(prov)).alias(prov))
    return g.select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest], prov)


def merge_checks(checks: DataFrame) -> DataFrame:
    """One row an id from (id, ord, component_ref, tier, command): first fields, all components, command made safe."""
    g = checks.groupBy("id").agg(F.min_by(F.struct("tier", "command"), "ord").alias("f"), F.array_sort(F.collect_set("component_ref")).alias("component_refs"))
    return g.select("id", "component_refs", F.col("f.tier").alias("tier"), redact_command(F.col("f.command")).alias("command"))


def shadow_checks(checks: DataFrame) -> DataFrame:
    """checks without scripts that a task-graph check (`tg:`) covers for one of their (component, tier)."""
    rows = checks.select("id", "tier", F.explode("component_refs").alias("ref"))
    covered = rows.where(F.col("id").startswith("tg:")).select("ref", "tier").distinct()
    loose = rows.where(~F.col("id").startswith("tg:") & ~F.col("id").startswith("ci:"))
    gone = loose.join(covered, ["ref", "tier"], "left_semi").select("id").distinct()
    return checks.join(gone, "id", "left_anti")


def merge_derived(partials: DataFrame, key: str, ord_: str = "ord", sets: tuple[str, ...] = (), lists: tuple[str, ...] = (), maps: tuple[str, ...] = (), scalars: tuple[str, ...] = ()) -> DataFrame:
    """One row a key from what each extractor derived of it, in order: sets united, lists joined, maps overlaid, the last scalar.

    A row is the whole finding of one extractor, so a key has as many rows as there are extractors. Sets come out sorted; a
    later entry of a map replaces an earlier one; a field that no row has is null.
    """

    def placed(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(F.col(ord_).alias("o"), F.col(name).alias("x")))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
        return F.transform(rows, lambda r: r["x"])

    def overlaid(rows: Column) -> Column:
        first = F.element_at(rows, 1)
        return F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), first, lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m))

    aggregates = [placed(name).alias(name) for name in (*sets, *lists, *maps)] + [F.max_by(name, F.when(F.col(name).isNotNull(), F.col(ord_))).alias(name) for name in scalars]
    g = partials.groupBy(key).agg(*aggregates)
    some = lambda name, x: F.when(F.size(name) > 0, x).alias(name)
    return g.select(
        key, *[some(n, F.array_sort(F.array_distinct(F.flatten(n)))) for n in sets], *[some(n, F.flatten(n)) for n in lists],
        *[some(n, overlaid(F.col(n))) for n in maps], *scalars,
    )
