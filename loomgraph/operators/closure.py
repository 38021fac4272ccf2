"""Graph closures: reachability, reverse dependencies, tiered scope, distances, checks for a change.

The joins of a level are merges: a broadcast takes some 67 MB of the driver however small it is, at each level anew.
Loops advance a frontier against what was visited, settle each level, and stop when the frontier is empty. Order never
depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settle import settle

#: Rows that one task may put in order; more are put in order over range partitions.
ONE_TASK = 100_000


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth) of all nodes that seeds (node) reach over edges (src, dst), seeds included at 0."""
    edges = settle(edges.select("src", "dst").distinct())
    frontier = settle(seeds.select("node").distinct())
    seen, depth = frontier.withColumn("depth", F.lit(0)), 0
    while not frontier.isEmpty():
        depth += 1
        step = edges.join(frontier.hint("merge"), edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = settle(step.join(seen.hint("merge"), "node", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % 8 == 0:
            seen = settle(seen)
    return seen


def reachable_pairs(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) of all nodes that each seed reaches over edges (src, dst), its own included.

    seeds: (seed, node) of the nodes that a seed begins with, or (node) where each is a seed of its own.
    """
    edges = settle(edges.select("src", "dst").distinct())
    frontier = settle(seeds.select("seed" if "seed" in seeds.columns else F.col("node").alias("seed"), "node").distinct())
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges.hint("merge"), F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = settle(step.join(seen.hint("merge"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = settle(seen)
    return seen


def reverse_edges(relations: DataFrame) -> DataFrame:
    """(dependency, dependent, unit_only) from both spellings of build and test dependencies."""
    down = F.col("type").isin("buildDependsOn", "testDependsOn")
    kept = relations.where(down | F.col("type").isin("buildDependencyOf", "testDependencyOf"))
    return kept.select(
        F.when(down, F.col("target_ref")).otherwise(F.col("source_ref")).alias("dependency"),
        F.when(down, F.col("source_ref")).otherwise(F.col("target_ref")).alias("dependent"),
        F.col("type").startswith("test").alias("unit_only"),
    ).distinct()


def search(reverse: DataFrame, seeds: DataFrame, routes: bool = True) -> DataFrame:
    """(ref, unit_only, distance, seed, next) of seeds and all their dependents, by one breadth-first search from all seeds.

    unit_only where every route has a test edge. A level holds the nodes that are reached for the first time and those
    reached for the first time without a test edge, so each node is in two levels at most. Of several nodes that reach
    one first, the one earliest in the search wins (with routes); places in it grow by (place of the parent, ref).
    """
    edges = settle(reverse.groupBy("dependency", "dependent").agg(F.bool_and("unit_only").alias("test")))
    none = F.lit(None).cast("string")
    start = seeds.select("ref").distinct().select("ref", F.lit(True).alias("build"), F.lit(True).alias("first"), F.lit(0).alias("distance"), F.col("ref").alias("seed"), none.alias("next"), F.lit(0).cast("long").alias("parent"))
    level, n, depth = settle(start), 1, 0
    seen, old = level, level.select("ref", "build")
    while True:
        n = level.count()
        if not n:
            break
        depth += 1
        placed = _in_order(level, ["parent", "ref"], n) if routes else level.withColumn("place", F.lit(0).cast("long"))
        step = edges.join(placed.hint("merge"), edges["dependency"] == placed["ref"]).select("dependent", (F.col("build") & ~F.col("test")).alias("build"), "first", "seed", F.col("ref").alias("next"), "place")
        earliest = F.min_by(F.struct("seed", "next", "place"), F.when(F.col("first"), F.struct("place", "next"))).alias("p")
        best = step.groupBy("dependent").agg(F.bool_or("build").alias("build"), earliest)
        known = old.groupBy(F.col("ref").alias("known")).agg(F.bool_or("build").alias("known_build"))
        fresh = best.join(known.hint("merge"), F.col("dependent") == F.col("known"), "left").where("known is null or (build and not known_build)")
        level = settle(fresh.select(
            F.col("dependent").alias("ref"), "build", F.col("known").isNull().alias("first"), F.lit(depth).alias("distance"), "p.seed", "p.next", F.coalesce("p.place", F.lit(0)).alias("parent"),
        ))
        seen, old = seen.unionByName(level), old.unionByName(level.select("ref", "build"))
        if depth % 8 == 0:
            old = settle(old.groupBy("ref").agg(F.bool_or("build").alias("build")))
    found = F.min_by(F.struct("distance", "seed", "next"), F.when(F.col("first"), F.col("distance"))).alias("x")
    return seen.groupBy("ref").agg((~F.bool_or("build")).alias("unit_only"), found).select("ref", "unit_only", "x.distance", "x.seed", "x.next")


def dependent_scope(reverse: DataFrame, seeds: DataFrame) -> DataFrame:
    """(ref, unit_only) of seeds and all dependents; unit_only where every route has a test edge."""
    return search(reverse, seeds, routes=False).select("ref", "unit_only")


def dependent_distance(reverse: DataFrame, seeds: DataFrame) -> DataFrame:
    """(ref, distance, seed, next) by breadth-first search from all seeds at once (see `search`)."""
    return search(reverse, seeds).select("ref", "distance", "seed", "next")


def _in_order(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df of n rows with `place`, which grows in the given order: without gaps up to ONE_TASK rows, else with gaps between range partitions."""
    if n <= ONE_TASK:
        return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    return settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `place`, its number in the given order: in one task up to ONE_TASK rows, else counted over range partitions."""
    n = df.count()
    if n <= ONE_TASK:
        return _in_order(df, order, n)
    sorted_ = _in_order(df, order, n).withColumnRenamed("place", "mid")
    part = F.shiftright("mid", 33)
    sizes = settle(sorted_.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min("mid").alias("first_mid")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("p", "first_mid", before.alias("before"))  # one row a partition
    placed = sorted_.join(offsets, part == F.col("p")).withColumn("place", F.col("before") + F.col("mid") - F.col("first_mid"))
    return settle(placed.drop("mid", "p", "first_mid", "before", "n"))


def checks_for_change(verification: DataFrame, reverse: DataFrame, seeds: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(check_id, tier, rank) of checks (id, tier, component_refs) for a change of seeds (ref).

    A check counts if one of its components is in scope with all tiers, or the check is a unit check. Own checks have
    rank 0, others 1 + the least distance of their components in scope.
    """
    reach = search(reverse, seeds, routes=False).select("ref", "unit_only", "distance")
    mine = (own if own is not None else seeds).select(F.col("ref").alias("own_ref")).distinct()
    rows = verification.select("id", "tier", F.explode("component_refs").alias("ref"))
    hit = rows.join(reach.hint("merge"), "ref", "left").join(mine.hint("merge"), F.col("ref") == F.col("own_ref"), "left")
    g = hit.groupBy("id", "tier").agg(
        F.bool_or(F.col("unit_only").isNotNull() & (~F.col("unit_only") | (F.col("tier") == "unit"))).alias("counts"),
        F.bool_or(F.col("own_ref").isNotNull()).alias("own"), F.min(F.when(F.col("unit_only").isNotNull(), F.col("distance"))).alias("distance"),
    )
    return g.where("counts").select(F.col("id").alias("check_id"), "tier", F.when(F.col("own"), 0).otherwise(1 + F.col("distance")).cast("int").alias("rank"))


def top(ranked: DataFrame, order: list, n: int, total: str = "total") -> DataFrame:
    """The first n rows in an order with their ordinal (from 1) and the number of all rows; only n rows meet in one task."""
    counted = ranked.agg(F.count("*").alias(total))
    first = ranked.orderBy(*order).limit(n)
    return first.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)).cast("int")).crossJoin(F.broadcast(counted))  # one row


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds and what is one edge away from them, in either direction."""
    out = edges.join(seeds, edges["src"] == seeds["node"]).select(F.col("dst").alias("node"))
    into = edges.join(seeds, edges["dst"] == seeds["node"]).select(F.col("src").alias("node"))
    return seeds.select("node").unionByName(out).unionByName(into).distinct()


def undirected_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth) of all that seeds reach when edges go both ways."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reachable(both, seeds)
