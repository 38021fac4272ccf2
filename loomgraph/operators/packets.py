"""Context packets: records, budgeted pages, deltas; session results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_id(kind: Column, subject: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.array(kind, subject, key)), 256), 1, 24)


def record_version(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 24)


def put(records: DataFrame, order: str = "ord") -> DataFrame:
    """One row an id: the last put wins."""
    rest = [c for c in records.columns if c != "id"]
    return records.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def page(records: DataFrame, packet: str, order: list, cost: str, limit: int, offset: int = 0) -> DataFrame:
    """Records of each packet from an offset on, as long as their costs fit the limit; it stops at the first that doesn't.

    A packet is one window: the records of one request.
    """
    w = Window.partitionBy(packet).orderBy(*order)
    r = records.withColumn("position", F.row_number().over(w).cast("int")).where(F.col("position") > offset)
    spent = r.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # costs are not negative, so the running sum passes the limit once
    return spent.where(F.col("used") <= limit)


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) between acknowledged records and current ones (id, version, critical)."""
    o = old.select("id", F.col("version").alias("old_version"))
    n = new.select("id", F.col("version").alias("new_version"), "critical")
    j = o.join(n, "id", "full_outer")
    change = F.when(F.col("new_version").isNull(), "retraction").when(F.col("old_version").isNull(), "new").when(F.col("old_version") != F.col("new_version"), "changed").when(F.col("critical"), "critical")
    return j.withColumn("change", change).where("change is not null").select("id", "change")


def merge_results(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest results by (check_id, command, cwd, runner): incoming ones win."""
    both = previous.withColumn("age_", F.lit(1)).unionByName(incoming.withColumn("age_", F.lit(0)))
    keys = ["check_id", "command", "cwd", "runner"]
    rest = [c for c in previous.columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("age_", -F.col("ord"))).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def valid_results(results: DataFrame, checks: DataFrame, graph_hash: str) -> DataFrame:
    """Results bound to this graph, of exactly a known check and command, whose exit code agrees with their status."""
    known = checks.select(F.col("id").alias("check_id"), "command").distinct()
    agree = ((F.col("status") == "passed") & (F.col("exit_code") == 0)) | ((F.col("status") == "failed") & (F.col("exit_code") != 0))
    return results.where((F.col("graph_hash") == graph_hash) & agree).join(known, ["check_id", "command"], "left_semi")


def packet_id(graph_hash: Column, request: Column, budget: Column) -> Column:
    """Identity of a packet: the graph it is of, what was asked, and the budget."""
    return F.substring(F.sha2(F.to_json(F.array(graph_hash, request, budget.cast("string"))), 256), 1, 24)


def stale_packets(packets: DataFrame, graph_hash: str, observations: DataFrame, now: Column) -> DataFrame:
    """packets (id, graph_hash) with `stale` (of another graph) and the ids of observation sets that are older than they may be."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("captured_at")) / 86400)
    old = observations.where(age > F.col("max_age_days")).agg(F.array_sort(F.collect_set("id")).alias("stale_observations"))  # one row
    return packets.withColumn("stale", F.col("graph_hash") != graph_hash).crossJoin(F.broadcast(old))
