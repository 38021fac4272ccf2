"""Hashes, canonical values and ages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def canonical_attrs(attrs: Column, leave_out: tuple[str, ...] = ("via",)) -> Column:
    """Attributes of a relation as `key=json` parts in order of key, joined by a pipe."""
    entries = F.array_sort(F.map_entries(F.map_filter(attrs, lambda k, v: v.isNotNull() & ~k.isin(*leave_out))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.lit('"'), e["value"], F.lit('"'))), "|")


def stable_json(m: Column) -> Column:
    """JSON text of a string map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def age_days(now: Column, at: Column) -> Column:
    """Whole days between two times; null if the time can't be read."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)


def stale(now: Column, at: Column, max_days: Column) -> Column:
    age = age_days(now, at)
    return age.isNull() | (age > max_days)


def input_hash(inputs: DataFrame, by: str, key: str, digest: str) -> DataFrame:
    """One hash a group from its (key, digest) rows, each part led by its length.

    Rows are hashed in order of key within 65,536 parts by the hash of the key, then the parts in order; so no more than a
    part meets in one row, and hashes of parts do not change with those of others.
    """
    part = F.concat(F.lpad(F.length(key).cast("string"), 8, "0"), F.col(key), F.lpad(F.length(digest).cast("string"), 8, "0"), F.col(digest))
    rows = inputs.select(by, F.substring(F.sha2(F.col(key), 256), 1, 4).alias("part"), F.struct(F.col(key).alias("k"), part.alias("p")).alias("s"))
    together = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]), ""), 256)
    parts = rows.groupBy(by, "part").agg(together.alias("h")).select(by, F.struct(F.col("part").alias("k"), F.concat("part", "h").alias("p")).alias("s"))
    return parts.groupBy(by).agg(together.alias("input_hash"))
