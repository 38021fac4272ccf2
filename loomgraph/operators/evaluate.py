"""Retrieval metrics, gates and paired selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settle import settle


def retrieval(truth: DataFrame, retrieved: DataFrame, scenarios: DataFrame) -> DataFrame:
    """recall, precision, noise of each scenario from fact sets (scenario, fact). Without truth recall is 1; without results noise is 0."""
    t, r = truth.select("scenario", "fact").distinct().withColumn("t", F.lit(1)), retrieved.select("scenario", "fact").distinct().withColumn("r", F.lit(1))
    n = t.join(r, ["scenario", "fact"], "full_outer").groupBy("scenario").agg(F.count("t").alias("n_truth"), F.count("r").alias("n_retrieved"), F.count(F.when(F.col("t").isNotNull() & F.col("r").isNotNull(), 1)).alias("n_hit"))
    j = scenarios.join(n, "scenario", "left").na.fill(0, ["n_truth", "n_retrieved", "n_hit"])
    recall = F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("n_hit") / F.col("n_truth"))
    precision = F.when(F.col("n_retrieved") == 0, 1.0).otherwise(F.col("n_hit") / F.col("n_retrieved"))
    return j.select("scenario", "n_truth", "n_retrieved", "n_hit", F.round(recall, 4).alias("recall"), F.round(precision, 4).alias("precision"), F.round(1 - precision, 4).alias("noise"))


def summary(metrics: DataFrame, by: str) -> DataFrame:
    """Scenario means and micro-recall of each corpus, and of all (corpus null)."""
    return metrics.rollup(by).agg(F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("noise"), 4).alias("noise"), F.round(F.sum("n_hit") / F.sum("n_truth"), 4).alias("micro_recall"))


def gate(metrics: DataFrame, thresholds: list[tuple[str, str, float]]) -> DataFrame:
    """(corpus, metric, value, bound, passed) of each metric against `>=` or `<=` a bound."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(op).alias("op"), F.lit(float(b)).alias("bound"), F.col(m).cast("double").alias("value")) for m, op, b in thresholds])
    x = metrics.select("corpus", F.explode(rows).alias("x")).select("corpus", "x.*")
    return x.select("corpus", "metric", "value", "bound", F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")).alias("passed"))


def weighted(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted mean of each group; unmeasured values (null) count nowhere."""
    measured = F.col(value).isNotNull()
    return rows.groupBy(*by).agg(F.round(F.sum(F.when(measured, F.col(value) * F.col(weight))) / F.sum(F.when(measured, F.col(weight))), 4).alias(value))


def campaign(attempts: DataFrame, by: str, value: str) -> DataFrame:
    """n, median (the upper of two middles) and p95 (ceil index) of each group, exact and without gathering a group.

    Values are counted first; the distinct ones are range partitioned, and running counts are those of the partitions
    before plus those within, so that a group is spread over as many tasks as its values take.
    """
    c = attempts.groupBy(by, value).agg(F.count("*").alias("c"))
    placed = settle(c.repartitionByRange(by, value).withColumn("part", F.spark_partition_id()))
    sums = settle(placed.groupBy(by, "part").agg(F.sum("c").alias("s")))  # one row a group and partition
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(by, "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy(by)).alias("n"))
    run = placed.join(offsets, [by, "part"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(by, "part").orderBy(value)))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    return run.groupBy(by).agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.ceil(F.col("n") * 0.95) - 1).alias("p95"))


def paired(attempts: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Per family: mean difference of success and cost over pairs of (task, repeat), and the Hoeffding half-width."""
    b = attempts.where(F.col("arm") == baseline).select("family", "task", "repeat", F.col("success").alias("s0"), F.col("cost").alias("c0"))
    c = attempts.where(F.col("arm") == candidate).select("family", "task", "repeat", F.col("success").alias("s1"), F.col("cost").alias("c1"))
    g = b.join(c, ["family", "task", "repeat"]).groupBy("family").agg(F.count("*").alias("n"), F.avg(F.col("s1") - F.col("s0")).alias("gain"), (1 - F.sum("c1") / F.sum("c0")).alias("saving"))
    half = F.sqrt(F.lit(2 * math.log(2 / 0.05)) / F.col("n"))
    return g.select("family", "n", F.round("gain", 4).alias("gain"), F.round(half, 4).alias("half_width"), F.round("saving", 4).alias("saving"), ((F.col("gain") + half >= 0) & (F.col("saving") >= 0.2)).alias("adopt"))


def selectivity(selected: DataFrame, closure: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, n_selected, irrelevant): the share of selected checks (scenario, check) outside the closure; 0 where none is selected."""
    inside = closure.select("scenario", "check").distinct().withColumn("in_", F.lit(1))
    n = selected.select("scenario", "check").distinct().join(inside, ["scenario", "check"], "left").groupBy("scenario").agg(F.count("*").alias("n_selected"), F.count("in_").alias("n_in"))
    j = scenarios.join(n, "scenario", "left").na.fill(0, ["n_selected", "n_in"])
    return j.select("scenario", "n_selected", F.round(F.when(F.col("n_selected") == 0, 0.0).otherwise(1 - F.col("n_in") / F.col("n_selected")), 4).alias("irrelevant"))


#: Fixed value: facts that a whole repository must have on average for its reduction to count as measured.
SIZE_FLOOR = 100


def reduction(sizes: DataFrame, by: str, floor: int = SIZE_FLOOR) -> DataFrame:
    """(by, full_size, reduction) of scenarios (by, n_retrieved, n_full): null below the floor, which is no failure."""
    g = sizes.groupBy(by).agg(F.round(F.avg("n_full")).cast("long").alias("full_size"), F.sum("n_retrieved").alias("r"), F.sum("n_full").alias("f"))
    return g.select(by, "full_size", F.when(F.col("full_size") >= floor, F.round(1 - F.col("r") / F.col("f"), 4)).alias("reduction"))
