"""Mixing sources to target weights by systematic sampling.

Each source has a target in words; a document's expected copies are target / source size, the same for all documents
of a source. Documents are put in order of size within their source, the expected copies are summed along that order,
one random offset is added per source, and a document is emitted once for each integer that its part of the sum
crosses. As neighbours in that order are of nearly one size, the words taken follow the target closely.

The order is global but never gathered: rows are range partitioned over (source, size, id, text hash), so that a source
with a third of all rows is spread like any other, written once, and ranks are partition offsets plus places. Only counts
of (partition, source) meet. Ranks don't depend on where the partitions are cut, so reruns agree.

Defined cases: null and wordless texts have size 0, and are taken 0 words; they take part in the order and may be
emitted, which adds nothing. A null source is a source of its own, after all others. Ties of source and size go by
doc_id (null last), then by the hash of the text; repeated rows are sampled one by one, any order of them giving the same
rows. Extra columns are left alone, whatever their names. A very long text counts as any other. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words

#: Weights by place in the order of sources, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take in all, as a share of all words there are.
SHARE = 1.5
#: A source gives at most so many times its words.
MOST = 2.0
SEED = 17


def offset(source: Column, seed: int = SEED) -> Column:
    """A number of [0, 1) drawn by the seed and the source."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))), 256)
    return F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n, source_size, target from one row (source, n, source_size) a source.

    Sources are filled by weight; those that would pass their cap get the cap. In order of cap / weight the capped ones
    come first, so one running sum finds where the filling stops.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    first = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = first.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = (
        caps.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("wanted", F.lit(share) * F.sum("source_size").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("open_weight"))
    )
    # the level of the first source that stays under its cap; beyond the last one all are capped
    free = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    return sums.withColumn("free", free["level"]).select("source", "n", "source_size", F.when(F.col("free").isNull() | (F.col("free") * F.col("weight") >= F.col("cap")), F.col("cap")).otherwise(F.col("free") * F.col("weight")).alias("target"))


def sample(docs: DataFrame, text: str = "text", seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document; with keep, these columns and `copies`.

    The columns to keep travel as one struct, so that their names clash with none of those above.
    """
    whole = [F.struct(*[F.col(c) for c in keep]).alias("whole")] if keep else []
    sized = docs.select("doc_id", "source", F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("hash"), *whole).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last(), F.col("hash").asc(), F.col("tie").asc()]
    # a larger source's rows differ in size and id, so ranges split it
    placed = stored(sized.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash", "tie").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    parts = placed.groupBy(part.alias("part"), "source").agg(F.min("place").alias("first"), F.count("*").alias("m"), F.sum("size").alias("s"))
    parts = stored(parts)  # at most partitions + sources rows
    goals = targets(parts.groupBy("source").agg(F.sum("m").alias("n"), F.sum("s").alias("source_size")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).select("part", F.col("source").alias("of"), "first", "before")
    starts = starts.join(goals, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    starts = starts.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("offset", offset(F.col("of"), seed))
    starts = stored(starts)  # of known size, so that Catalyst chooses the join
    joined = placed.withColumn("part_", part).join(starts, (F.col("part_") == F.col("part")) & F.col("source").eqNullSafe(F.col("of")))
    rank = F.col("before") + F.col("place") - F.col("first")
    copies = F.floor(F.col("offset") + (rank + 1) * F.col("rate")) - F.floor(F.col("offset") + rank * F.col("rate"))
    found = joined.withColumn("copies", copies)
    if keep:
        return found.select("whole", "copies")
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return sample(docs).select("doc_id", "size", "source_size", "target", "taken")


def resample(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with each row as many times as it is emitted; the columns stay as they are."""
    found = sample(docs, seed=seed, keep=docs.columns)
    return found.select("whole", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("whole.*")


def oracle(seed: int = SEED) -> str:
    """DuckDB SQL with the rows of mix() over documents."""
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"""
with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select source, source_size, {weights}[((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int]::double as weight, {MOST} * source_size::double as cap from s),
r as (select *, coalesce(sum(cap) over before, 0) as capped, sum(weight) over () - coalesce(sum(weight) over before, 0) as open_weight, {SHARE} * sum(source_size) over () as wanted
    from w window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, (wanted - capped) / open_weight as level from r),
g as (select arg_min(level, cap / weight) as free from f where level * weight < cap),
t as (select source, source_size, case when free is null or free * weight >= cap then cap else free * weight end as target,
    ('0x' || substr(sha256('{seed}:' || coalesce('s' || source, 'n')), 1, 8))::bigint::double / 4294967296.0 as off from f, g),
k as (select d.doc_id, d.size, t.source_size, t.target, t.off, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
    row_number() over (partition by d.source order by d.size, d.doc_id nulls last) - 1 as rank from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(off + (rank + 1) * rate) - floor(off + rank * rate)) * size)::bigint as taken from k"""
