"""Intermediate results in the shared folder of the session (`spark.checkpoint.dir`).

Both forms end the lineage there, so that a lost executor costs nothing. `settle` makes a checkpoint, which is quick and
suits the small levels of a search. `stored` writes a Parquet table, of which Catalyst knows the size when it chooses
joins; `release` deletes such tables when no later step reads them.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of the session; a new local one only where none is set and all runs in one process."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='settled-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: The largest measured side of a join that is broadcast, in bytes, where the user allows no less.
BROADCAST = 1 << 20


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: `10MB`, `256k`, `-1`."""
    n, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(n) << 10 * " kmgtp".index(unit or " ")


def measured_joins(spark: SparkSession) -> None:
    """Let Spark broadcast a side of a join by the size that its shuffle has measured, not by that of the files it comes from.

    A row of a small file may be exploded, or written or read as a text of any length, which no estimate sees. Both sides
    are dealt by then, so a broadcast saves a sort only, and takes up to 67 MB of the driver for each join: sides beyond
    BROADCAST are merged. A smaller setting of the user is kept.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, str(min(_bytes(spark.conf.get(static)), BROADCAST)))
    spark.conf.set(static, "-1")


def settle(df: DataFrame) -> DataFrame:
    """Write a checkpoint of df to the shared folder and go on from there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write df to a table of its own in the shared folder and go on from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*dfs: DataFrame | None) -> None:
    """Delete stored tables; what was read from them must not be used any more."""
    for df in dfs:
        path = getattr(df, "stored_at", None) if df is not None else None
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
