"""Observation facts as a stream: an extension beside the batch operators.

Facts arrive with the time at which they were captured. Per (subject, key, environment) and window the newest fact is
kept; facts older than the watermark are late, as a newer capture has superseded them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(facts: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """(window, subject, key, environment, value_json, captured_at, n) from streamed facts; works on batches as well."""
    keys = [F.window("captured_at", window), "subject", "key", "environment"]
    g = facts.withWatermark("captured_at", late).groupBy(*keys)
    return g.agg(F.max_by("value_json", "captured_at").alias("value_json"), F.max("captured_at").alias("captured_at"), F.count("*").alias("n"))


def distinct_facts(facts: DataFrame, late: str = "1 day") -> DataFrame:
    """Facts without repeats of (subject, key, environment, value) within the watermark."""
    return facts.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["subject", "key", "environment", "value_json"])
