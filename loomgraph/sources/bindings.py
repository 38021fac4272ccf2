"""Deterministic projections of the driver's tables into the graph model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import canonical_path
from ..plans.settle import measured_joins

NAMESPACE = "tpch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    measured_joins(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys over all tasks of the session: a small file is one task, however long the texts are that its rows are written to."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def ref(kind: str, key: str | Column) -> Column:
    """Reference of a row: `kind:namespace/stem-key`."""
    stem = {"domain": "region", "system": "nation", "api": "order", "resource": "customer"}
    k, _, s = kind.partition("/")
    return F.concat(F.lit(f"{k}:{NAMESPACE}/{s or stem[k]}-"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, kind) of all regions, nations, suppliers, parts, orders and customers."""
    parts = [
        ("region", ref("domain", "r_regionkey")), ("nation", ref("system", "n_nationkey")), ("supplier", ref("component/supplier", "s_suppkey")),
        ("part", ref("component/part", "p_partkey")), ("orders", ref("api", "o_orderkey")), ("customer", ref("resource", "c_custkey")),
    ]
    out = None
    for name, r in parts:
        df = table(spark, sf_dir, name).select(r.alias("ref"))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("kind", F.split_part("ref", F.lit(":"), F.lit(1)))


def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partOf edges: nation to region, supplier to nation."""
    n = table(spark, sf_dir, "nation").select(F.lit("partOf").alias("type"), ref("system", "n_nationkey").alias("source_ref"), ref("domain", "n_regionkey").alias("target_ref"))
    s = table(spark, sf_dir, "supplier").select(F.lit("partOf").alias("type"), ref("component/supplier", "s_suppkey").alias("source_ref"), ref("system", "s_nationkey").alias("target_ref"))
    return n.unionByName(s)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part p depends on part p div 2 to build, and on p div 3 to test where p is a multiple of 5; no edge to itself."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p"))
    half, third = F.floor(F.col("p") / 2).cast("long"), F.floor(F.col("p") / 3).cast("long")
    build = p.where("p >= 1").select(F.lit("buildDependsOn").alias("type"), ref("component/part", "p").alias("source_ref"), ref("component/part", half).alias("target_ref"))
    test = p.where("p >= 1 and p % 5 = 0").select(F.lit("testDependsOn").alias("type"), ref("component/part", "p").alias("source_ref"), ref("component/part", third).alias("target_ref"))
    return build.unionByName(test)


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check a part: (id, tier, component_refs, command)."""
    tier = F.element_at(F.array(F.lit("unit"), F.lit("static"), F.lit("integration")), (F.col("p_size") % 3 + 1).cast("int"))
    r = ref("component/part", "p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), tier.alias("tier"), r.alias("r"), "p_name")
    return rows.select(F.concat(F.lit("part-"), "k", F.lit(":"), "tier").alias("id"), "tier", F.array("r").alias("component_refs"), F.concat(F.lit("make "), "tier", F.lit(" TOKEN="), "k", F.lit(" "), "p_name").alias("command"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of events: see the columns of operators.elect."""
    e = table(spark, sf_dir, "events")
    cls = F.element_at(F.array(*[F.lit(x) for x in ("AUTHORED", "DERIVED", "OBSERVED_RUNTIME", "REVIEWED_OVERRIDE")]), (F.col("event_id") % 4 + 1).cast("int"))
    items = F.when(F.col("event_type") == "view", F.transform(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 4), lambda i: i.cast("string")))
    value = F.coalesce(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), F.floor(F.col("value") / 50).cast("string"))
    return e.select(
        F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("subject"),
        F.concat("event_type", F.lit(".d"), (F.dayofmonth("ts") % 5).cast("string")).alias("key"), value.alias("value_json"), items.alias("list"), cls.alias("evidence_class"),
        F.when(F.col("event_id") % 7 == 0, "candidate").otherwise("deterministic").alias("confidence"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("observed_at"),
        F.concat(F.col("user_id").cast("string"), F.lit("@"), F.to_date("ts").cast("string")).alias("obs_id"), F.array(F.col("event_id") % 10).alias("prov_ids"),
    )


#: Rules of the bound facts: ord, id, pattern over `subject key`, classes they elect, what a stale election becomes.
RULES = [
    (1, "clicks", "click", ["OBSERVED_RUNTIME"], "conflict"),
    (2, "clicks-d0", r"click\.d0", ["OBSERVED_RUNTIME", "DERIVED"], None),
    (3, "purchases", "purchase", ["REVIEWED_OVERRIDE"], None),
    (4, "signups", "signup", ["AUTHORED", "DERIVED"], "unresolved"),
]


def rules(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(o).alias("ord"), F.lit(i).alias("id"), F.lit(p).alias("key_pattern"), F.array(*[F.lit(x) for x in e]).alias("elect"), F.lit(d).cast("string").alias("degrade_on_stale")) for o, i, p, e, d in RULES]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def observation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set a user and day; each supersedes the one of the day before that the user has."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u"), F.to_date("ts").alias("d"), "ts").groupBy("u", "d").agg(F.max("ts").alias("captured_at"))
    before = F.lag("d").over(Window.partitionBy("u").orderBy("d"))
    ident = lambda d: F.concat("u", F.lit("@"), d.cast("string"))
    return e.select(ident(F.col("d")).alias("id"), F.lit("production").alias("environment"), "captured_at", ident(before).alias("supersedes"), (F.day("d") % 3 * 10 + 2).cast("long").alias("max_age_days"))


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path): host and path of each page's address, query and fragment dropped."""
    raw = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", canonical_path(raw).alias("path"))
