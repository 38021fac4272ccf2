"""Provenance: order, pointers, evidence pins; assembly and comparison of graph documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .closure import _placed


def numbered(rows: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """rows with `ord`, their number in the given order."""
    return _placed(rows, order).withColumn("ord", F.col("place") + first).drop("place")


def ordered(records: DataFrame) -> DataFrame:
    """records (path, extractor, subjects) with `ord` from 1 in order of path, extractor and first subject."""
    keyed = records.withColumn("first_subject", F.array_min("subjects"))
    return numbered(keyed, ["path", "extractor", "first_subject"]).drop("first_subject")


def pointers(subjects: DataFrame, sections: DataFrame) -> DataFrame:
    """subjects (prefix, key) with `pointer` `/section/index` from sections (prefix, key, section, index); null dangles."""
    p = sections.select("prefix", "key", F.concat(F.lit("/"), F.col("section"), F.lit("/"), F.col("index").cast("string")).alias("pointer"))
    return subjects.join(p, ["prefix", "key"], "left")


def pin_status(pins: DataFrame, inputs: DataFrame) -> DataFrame:
    """pins (path, sha256) with `status`: CURRENT, STALE or MISSING."""
    now = inputs.select("path", F.col("sha256").alias("now_"))
    s = F.when(F.col("now_").isNull(), "MISSING").when(F.col("now_") == F.col("sha256"), "CURRENT").otherwise("STALE")
    return pins.join(now, "path", "left").withColumn("status", s).drop("now_")


def extractors(records: DataFrame) -> DataFrame:
    return records.select("extractor", "version").distinct()


def conflict_evidence(conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    """conflicts (subject, key) with `prov_ids`: all provenance of their facts, repeats kept, in order."""
    e = facts.groupBy("subject", "key").agg(F.array_sort(F.flatten(F.collect_list("prov_ids"))).alias("prov_ids"))
    return conflicts.join(e, ["subject", "key"], "left")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two sections hold the same rows, each as often."""
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def latest(rows: DataFrame, keys: list[str], order: list, keep: int = 1) -> DataFrame:
    """The newest rows of each key."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn_") <= keep).drop("rn_")


#: Classes of a provenance record.
CLASSES = ["declared", "observed", "derived", "reviewed"]


def records(raw: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of raw (class, path, extractor, subject): one record a (class, path, extractor) with its hash and subjects.

    Problems are unknown classes and paths that are no input; a record without a subject is dropped.
    """
    j = raw.join(inputs.select("path", F.col("sha256").alias("content_hash")), "path", "left")
    problem = F.when(~F.col("class").isin(*CLASSES), "unknown-class").when(F.col("content_hash").isNull(), "no-input")
    j = j.withColumn("problem", problem)
    slug = F.regexp_replace(F.lower("extractor"), "[^a-z0-9]+", "-")
    good = j.where("problem is null and subject is not null").groupBy("class", "path", slug.alias("extractor")).agg(F.first("content_hash").alias("content_hash"), F.array_sort(F.collect_set("subject")).alias("subjects"))
    return good, j.where("problem is not null").select("class", "path", "problem").distinct()


def rebound(raw: DataFrame, final: DataFrame) -> DataFrame:
    """raw records whose pending subject (`rel:pending`) becomes the final key (path, subject) of their path."""
    keys = final.select("path", F.col("subject").alias("final_subject"))
    j = raw.join(keys, "path", "left")
    return j.withColumn("subject", F.when(F.col("subject") == "rel:pending", F.col("final_subject")).otherwise(F.col("subject"))).drop("final_subject").distinct()
