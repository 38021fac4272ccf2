"""Normative documents: level-2 sections of Markdown with fence state, slugs and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugify


def sections(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, heading, sha256, lines) of each level-2 section, trailing blank lines dropped.

    Lines of fenced blocks are no headings; repeated slugs get `-1`, `-2`, ... in order. A document is one window: its own
    lines, never those of others.
    """
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    inside = Window.partitionBy(key).orderBy("n")
    fence = F.col("line").rlike(r"^\s{0,3}(```|~~~)")
    opened = lines.withColumn("fences", F.sum(fence.cast("int")).over(inside))
    closed = (F.col("fences") % 2 == 0) & ~fence
    level2, level1 = closed & F.col("line").rlike(r"^## +\S"), closed & F.col("line").rlike(r"^# +\S")
    marked = opened.withColumn("part", F.sum((level2 | level1).cast("int")).over(inside)).withColumn("heading", F.when(level2, F.trim(F.regexp_replace("line", r"^## +|\s+#+\s*$", ""))))
    g = marked.groupBy(key, "part").agg(F.max("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows")).where("heading is not null")
    body = F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), r"\s+\z", "")
    out = g.select(key, "part", "heading", F.sha2(body, 256).alias("sha256"), (F.size(F.split(body, "\n"))).alias("lines"), slugify(F.col("heading")).alias("slug"))
    again = F.row_number().over(Window.partitionBy(key, "slug").orderBy("part")) - 1
    return out.withColumn("k", again).select(key, F.when(F.col("k") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("k").cast("string"))).alias("section"), "heading", "sha256", "lines")
