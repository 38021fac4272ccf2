"""Checkouts as DataFrames: files through the binary-file source, status records, changed paths, graph tables."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import in_generated_dir
from ..operators.own import visible


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file under root, relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_relative(F.col("path"), root).alias("path"), "length")


def _relative(path: Column, root: str) -> Column:
    base = root.removeprefix("file://").rstrip("/")
    plain = F.url_decode(F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:(//[^/]*)?", ""), r"\+", "%2B"))
    return F.substring(plain, F.instr(plain, base) + len(base) + 1, F.length(plain))


def remote(root: str) -> bool:
    """Whether a root is in a store that only Spark reads."""
    return "://" in root and not root.startswith("file://")


def inputs(spark: SparkSession, root: str, ignored: DataFrame | None = None, generated: list[str] | None = None) -> DataFrame:
    """(path, length, sha256, text, is_utf8) of the files that count: not generated, not ignored, no links.

    text is null where the bytes are not UTF-8; a byte-order mark is dropped. Hidden files count, but in a store that only Spark
    reads, whose file source leaves out names that begin with a dot or an underscore.
    """
    if remote(root):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        files = files.select(_relative(F.col("path"), root).alias("path"), "length", "content").where(~in_generated_dir(F.col("path"), generated))
    else:
        from .snapshot import Checkout

        spark.dataSource.register(Checkout)
        read = spark.read.format("checkout").option("content", "true")
        files = (read if generated is None else read.option("generated", ",".join(generated))).load(root).where("kind = 'file'")
    if ignored is not None:
        files = visible(files, ignored)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.regexp_replace(text, "^\\uFEFF", "").alias("text"), text.isNotNull().alias("is_utf8"))


def unreadable(files: DataFrame) -> DataFrame:
    """Diagnostics of files that are no UTF-8 text."""
    return files.where(~F.col("is_utf8")).select(F.lit("error").alias("severity"), F.lit("INPUT_NOT_UTF8").alias("code"), "path")


def probes(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates (path) with `exists` and `is_dir`."""
    here = files.select("path", F.lit(True).alias("f_")).distinct()
    dirs = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("path"), "path").toDF("path", "of").where("path <> of").select("path", F.lit(True).alias("d_")).distinct()
    j = candidates.join(here, "path", "left").join(dirs, "path", "left")
    return j.select(*candidates.columns, (F.col("f_").isNotNull() | F.col("d_").isNotNull()).alias("exists"), F.col("d_").isNotNull().alias("is_dir"))


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(key, path): the first candidate (key, ord, path) of each key that exists."""
    hit = candidates.join(files.select("path").distinct(), "path", "left_semi")
    return hit.groupBy("key").agg(F.min_by("path", "ord").alias("path"))


TEST = r"(^|/)(tests?|__tests__|spec)/|(\.|_|^|/)(test|spec)[._]|_test\.[a-z]+$"


def source_files(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files of the given extensions with `is_test`."""
    ends = "|".join(e.lstrip(".") for e in extensions)
    return files.where(F.col("path").rlike(rf"\.({ends})$")).withColumn("is_test", F.col("path").rlike(TEST))


def migration_dirs(files: DataFrame, deepest: int = 5) -> DataFrame:
    """Directories named like migrations that hold SQL or Python files, at most `deepest` levels down."""
    d = F.regexp_extract("path", r"^(.*(?:^|/)(?:migrations?|alembic/versions))/[^/]+\.(?:sql|py|ts|js|go)$", 1)
    return files.select(d.alias("dir")).where("dir <> ''").where(F.size(F.split("dir", "/")) <= deepest).distinct()


def parse_status(raw: str) -> list[tuple[str, str, str | None]]:
    """(xy, path, from) records of a NUL-separated status listing; renames and copies take two fields."""
    fields, out = iter(raw.split("\0")), []
    for f in fields:
        if len(f) > 3:
            xy = f[:2]
            out.append((xy, f[3:], next(fields, None) if xy[0] in "RC" else None))
    return out


def status(spark: SparkSession, root: str) -> DataFrame:
    """(xy, path, from) of a git checkout, ignored files included."""
    raw = subprocess.run(["git", "-C", root, "status", "--porcelain", "-z", "--ignored"], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame(parse_status(raw), "xy string, path string, from string")


def ignored_paths(records: DataFrame) -> DataFrame:
    return records.where("xy = '!!'").select(F.regexp_replace("path", "/$", "").alias("path"))


def dirty_paths(records: DataFrame) -> DataFrame:
    return records.where("xy <> '!!'").select("path")


def changed_paths(spark: SparkSession, root: str, revision: str) -> DataFrame | None:
    """Paths that differ from a revision; None where git can't tell, which is not the same as no path."""
    run = subprocess.run(["git", "-C", root, "diff", "--name-only", "-z", revision], capture_output=True, text=True)
    return spark.createDataFrame([(p,) for p in run.stdout.split("\0") if p], "path string") if run.returncode == 0 else None


def write_graph(sections: dict[str, DataFrame], base: str, version: str) -> str:
    """Write each section under a version of its own; readers go by `latest`, which is written last."""
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{base}/version={version}/{name}")
    spark = next(iter(sections.values())).sparkSession
    spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").json(f"{base}/latest")
    return version


def read_graph(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    version = spark.read.schema("version string").json(f"{base}/latest").first()[0]
    return {n: spark.read.parquet(f"{base}/version={version}/{n}") for n in names}


def export_document(sections: dict[str, DataFrame], most_rows: int = 1_000_000) -> str:
    """A bounded graph as one canonical JSON document: keys in order, two spaces, a newline at the end."""
    out = {}
    for name, df in sections.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows; export tables instead")
        out[name] = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in rows]
    return json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"
