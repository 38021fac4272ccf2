"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with built-in functions only.

A text is cut into paragraphs: its lines, and lines of more than BLOCK words every BLOCK words. The set of their 64-bit
digests is put into a sketch of three tables; in each table a digest falls into one cell, which holds a count, the xor of
its digests and the xor of their check values. Sketches of one size subtract cell by cell; what both texts share
cancels. A cell that holds one digest gives it away, and taking it out of its other cells may free more; peeling goes
round the three tables, as a digest sits in only one cell of a table and so is taken out once. If cells are left over,
the pair is tried again with twice the cells and other hashes, until the whole difference is known.

How many cells a pair needs is estimated first, from the digests that lie in one sixteenth of all values.

Cells are rows, spread over the cluster by document; building, subtracting and all rounds of peeling of an attempt are
one stage after one exchange of the digests (about a tenth of the text). Only pairs that failed are tried again.

Documents are put in order by range partitions, which are written as a bucketed table, one bucket a partition: so the
next document is in the same bucket, without another exchange of texts, but for one document a bucket that is joined by
the number of its partition.

The fingerprint that is returned has a fixed number of cells, so two of them show how far texts of some 20 differing
paragraphs are apart and no more; likeness comes from sketches of their own size, and `recovered` returns the digests.
Paragraphs of long lines are cut by count, so that a word put in shifts the cuts that follow in that line.

Defined cases: null and empty texts have no paragraphs and an empty sketch; two of these are alike (1.0). Repeated
paragraphs of a text count once. Documents go by descending id, rows of one id by the hash of their text, null ids
last; a single document is its own next one. A very long text is one row, with one cell for each few paragraphs. Other
columns are not looked at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settle import folder
from .common import release, settle, stored

BLOCK = 16
TABLES = 3
#: Cells of each table of the sketch that is returned.
CELLS = 8
#: First try: cells of each table for each paragraph that is estimated to differ, and some more.
SHARE, LEAST = 0.5, 4
#: The estimate looks at one of so many digests.
SAMPLED = 16
ROUNDS = 15
MOST_TRIES = 16
#: Text that one task works on, about.
TASK_BYTES = 16 << 20
LOWEST = -(2**63)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"([^ \n]++(?: ++[^ \n]++){0," + str(BLOCK - 1) + r"}+ *+)", "$1\n")
    return F.array_remove(F.split(cut, "\n"), "")


def digests(text: Column) -> Column:
    """The set of paragraph digests of a text."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def cell(digest: Column, table: Column | int, width: Column, seed: int) -> Column:
    """The cell of a digest in one of the tables, counted over all tables."""
    table = F.lit(table) if isinstance(table, int) else table
    return (F.pmod(F.xxhash64(digest, table, F.lit(seed)), width.cast("long")) + table * width).cast("int")


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-7)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def sketch(rows: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Cells (by, cell, n, digest, check) from rows (by, width, digest, sign)."""
    spread = rows.select(*by, "width", "digest", "sign", F.explode(F.array(*[F.lit(t) for t in range(TABLES)])).alias("t"))
    return spread.select(*by, "width", cell(F.col("digest"), F.col("t"), F.col("width"), seed).alias("cell"), F.col("sign").alias("n"), "digest", check(F.col("digest")).alias("check")).groupBy(*by, "width", "cell").agg(*_sums())


def _sums() -> list[Column]:
    return [F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check")]


def peel(cells: DataFrame, seed: int, rounds: int = ROUNDS, keep: bool = False) -> DataFrame:
    """Cells after so many rounds. Cell -1 of a pair counts the digests found, its digest is their xor.

    With keep, each digest found stays a row of its own (cell -1), n telling the side.
    """
    by = ["pair", "width", "cell", *(["found"] if keep else [])]
    cells = cells.withColumn("found", F.lit(None).cast("long")) if keep else cells
    for r in range(rounds):
        t = r % TABLES
        inside = (F.col("cell") >= t * F.col("width")) & (F.col("cell") < (t + 1) * F.col("width"))
        alone = inside & (F.abs("n") == 1) & (check(F.col("digest")) == F.col("check")) & (cell(F.col("digest"), t, F.col("width"), seed) == F.col("cell"))
        some = [F.col("found")] if keep else []
        state = F.struct("cell", "n", "digest", "check", *some)

        def moved_to(at: Column, n: Column, found: Column) -> Column:
            return F.struct(at.cast("int").alias("cell"), n.cast("long").alias("n"), F.col("digest").alias("digest"), F.col("check").alias("check"), *([found.cast("long").alias("found")] if keep else []))

        out = [moved_to(F.lit(-1), F.col("n") if keep else F.lit(1), F.col("digest"))]
        out += [moved_to(cell(F.col("digest"), u, F.col("width"), seed), -F.col("n"), F.lit(None)) for u in range(TABLES) if u != t]
        moved = cells.select("pair", "width", F.explode(F.when(alone, F.array(*out)).otherwise(F.array(state))).alias("c"))
        cells = moved.select("pair", "width", "c.*").groupBy(*by).agg(*_sums()).where("n <> 0 or digest <> 0 or check <> 0")
    return cells


def apart(a: Column | str, b: Column | str) -> Column:
    """A number of digests in one set only that is seldom too low, from a sixteenth of all values."""
    some = lambda c: F.filter(c, lambda x: x.bitwiseAND(F.lit(SAMPLED - 1)) == 0)
    of = lambda x, y: F.size(F.array_except(some(x), some(y)))
    seen = F.lit(SAMPLED) * (of(a, b) + of(b, a))
    return F.least(F.size(a) + F.size(b), F.ceil(seen + 3 * F.sqrt(SAMPLED * seen) + 2 * SAMPLED).cast("int"))


def _sketches(pairs: DataFrame, parts: int, attempt: int) -> DataFrame:
    """Cells of the differences of pairs (pair, width, a, b); width: cells of each table at the first attempt."""
    width = (F.col("width") * 2**attempt).cast("int")
    signed = F.concat(F.transform("a", lambda x: F.struct(x.alias("digest"), F.lit(1).alias("sign"))), F.transform("b", lambda x: F.struct(x.alias("digest"), F.lit(-1).alias("sign"))))
    rows = pairs.repartition(parts, "pair").select("pair", width.alias("width"), F.explode(signed).alias("s")).select("pair", "width", "s.*")
    return sketch(rows, ["pair"], attempt)


def sized(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("width", (F.ceil(apart("a", "b") * F.lit(SHARE)) + LEAST).cast("int"))


def differences(pairs: DataFrame, parts: int) -> DataFrame:
    """pair and d, the number of paragraphs in one text only, from stored pairs (pair, width, a, b) of digest sets."""
    todo, done = pairs, None
    for attempt in range(MOST_TRIES):
        left = peel(_sketches(todo, parts, attempt), attempt)
        found = settle(left.groupBy("pair").agg(F.max("cell").alias("open"), F.sum(F.when(F.col("cell") == -1, F.col("n"))).alias("d")))
        here = found.where("open = -1").select("pair", "d")
        done = here if done is None else done.unionByName(here)
        failed = stored(found.where("open >= 0").select("pair"))
        if failed.isEmpty():
            return done
        todo = pairs.join(failed, "pair", "left_semi")
    rest = todo.select("pair", (F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))).cast("long").alias("d"))
    return rest if done is None else done.unionByName(rest)  # what no sketch peels is told apart by the sets themselves


def recovered(pairs: DataFrame, parts: int = 8) -> DataFrame:
    """(pair, digest, side) of every paragraph digest in one text only (side 1: in a, -1: in b), from pairs (pair, a, b)."""
    todo = stored(sized(pairs))
    whole, done = todo, None
    for attempt in range(MOST_TRIES):
        left = stored(peel(_sketches(todo, parts, attempt), attempt, keep=True))
        failed = stored(left.where("cell >= 0").select("pair").distinct())
        here = left.where("cell = -1").join(failed, "pair", "left_anti").select("pair", F.col("found").alias("digest"), F.col("n").cast("int").alias("side"))
        done = here if done is None else done.unionByName(here)
        if failed.isEmpty():
            return done
        todo = whole.join(failed, "pair", "left_semi")

    def only(x: str, y: str, side: int) -> Column:
        return F.transform(F.array_except(x, y), lambda d: F.struct(d.alias("digest"), F.lit(side).alias("side")))

    sides = F.concat(only("a", "b", 1), only("b", "a", -1))
    rest = todo.select("pair", F.explode(sides).alias("s")).select("pair", "s.*")
    return rest if done is None else done.unionByName(rest)


def in_order(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int, str]:
    """A bucketed table (part, place, doc_id, body) of the documents in order, its number of buckets, and its name.

    place grows along the order; its high bits are the part, and all rows of a part are in one bucket.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), body.alias("body"), F.monotonically_increasing_id().alias("tie"))
    total = base.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    parts = max(1, -(-total // TASK_BYTES))
    order = [F.col("key").desc(), F.xxhash64("body"), F.col("tie")]  # equal rows are split too, as any order of them will do
    placed = base.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "body", F.monotonically_increasing_id().alias("place"))
    name, path = f"in_order_{uuid.uuid4().hex}", f"{folder(spark)}/stored-{uuid.uuid4().hex}"
    out = placed.withColumn("part", F.shiftright("place", 33).cast("int")).write.bucketBy(min(parts, 10_000), "part").format("parquet").option("path", path)
    try:
        out.option("compression", "zstd").saveAsTable(name)
    except BaseException:
        spark.sql(f"drop table if exists {name}")
        raise
    found = spark.table(name)
    found.stored_at = path
    return found, parts, name


def versions(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """Stored rows (row, doc_id, n_chars, edited_sha256, own, edited, next) and the number of partitions to use."""
    placed, parts, name = in_order(docs, text)
    try:
        return _versions(placed), parts
    finally:
        docs.sparkSession.sql(f"drop table {name}")
        release(placed)


def _versions(placed: DataFrame) -> DataFrame:
    first = placed.where(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    there = stored(first.select("part"))  # one row a part
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    heads = stored(there.select(F.col("part").alias("of_part"), after.alias("part")).join(first.select("part", F.col("body").alias("first_body")), "part").select(F.col("of_part").alias("part"), "first_body", digests(F.col("first_body")).alias("first_own")))
    w = Window.partitionBy("part").orderBy("place")
    led = placed.withColumn("own", digests(F.col("body"))).withColumns({"next_body": F.lead("body").over(w), "next": F.lead("own").over(w)})
    led = led.join(heads.withColumnRenamed("part", "of_part"), (F.col("part") == F.col("of_part")) & F.col("next_body").isNull(), "left")
    n = F.char_length("body")
    half = F.floor(n / 2).cast("int")
    next_body = F.coalesce("next_body", "first_body")
    edited = F.concat(F.substring("body", F.lit(1), n - half), F.substring(next_body, F.lit(1), half))
    done = led.select(F.col("place").alias("row"), "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited_body"), "own", F.coalesce("next", "first_own").alias("next"))
    out = stored(done.select("row", "doc_id", "n_chars", F.sha2("edited_body", 256).alias("edited_sha256"), "own", digests(F.col("edited_body")).alias("edited"), "next"))
    release(there, heads)
    return out


def _coded(digits: Column) -> Column:
    """Hexadecimal digits as base 64 in one line."""
    return F.translate(F.base64(F.unhex(digits)), "\r\n", "")


def printed(sets: DataFrame, parts: int) -> DataFrame:
    """row, fingerprint, edited_fingerprint of rows (row, own, edited): the cells of a sketch of fixed size."""
    def of(v: int, c: str) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(v).alias("v"), x.alias("digest")))

    rows = sets.repartition(parts, "row").select("row", F.lit(CELLS).alias("width"), F.explode(F.concat(of(0, "own"), of(1, "edited"))).alias("s"))
    cells = sketch(rows.select("row", "s.v", "width", "s.digest", F.lit(1).alias("sign")), ["row", "v"], 0)
    coded = F.concat(F.lpad(F.hex("n"), 8, "0"), F.lpad(F.hex("digest"), 16, "0"), F.lpad(F.hex("check"), 8, "0"))
    held = cells.select("row", "v", "cell", coded.alias("code")).groupBy("row").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("v") == v, F.struct("cell", "code")))).alias(f"c{v}") for v in (0, 1)])

    def text(c: str) -> Column:
        codes = F.transform(F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)), lambda i: F.coalesce(F.try_element_at(F.col(c), i), F.lit("0" * 32)))
        return _coded(F.array_join(codes, ""))

    return held.select("row", text("c0").alias("fingerprint"), text("c1").alias("edited_fingerprint"))


def likeness(a: Column, b: Column, d: Column) -> Column:
    """Shared paragraphs of all paragraphs, from the sizes of both sets and of their difference."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - d) / (a + b + d))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows, parts = versions(docs, text)
    two = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("edited").alias("b")), F.struct(F.lit(1).alias("v"), F.col("next").alias("b"))))
    pairs = rows.select("row", F.col("own").alias("a"), two.alias("x")).select((F.col("row") * 2 + F.col("x.v")).alias("pair"), "a", "x.b")
    found = differences(sized(pairs), parts)
    d = found.groupBy(F.shiftright("pair", 1).alias("row_")).agg(*[F.max(F.when(F.col("pair") % 2 == v, F.col("d"))).alias(f"d{v}") for v in (0, 1)])
    empty = _coded(F.lit("0" * 32 * TABLES * CELLS))
    prints = printed(rows.select("row", "own", "edited"), parts).withColumnRenamed("row", "row__")
    facts = rows.select("row", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("na"), F.size("edited").alias("nb"), F.size("next").alias("nn"))
    out = facts.join(d, F.col("row") == F.col("row_"), "left").join(prints, F.col("row") == F.col("row__"), "left")
    zero = F.lit(0)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", empty).alias("fingerprint"), F.coalesce("edited_fingerprint", empty).alias("edited_fingerprint"),
        likeness(F.col("na"), F.col("nb"), F.coalesce("d0", zero)).alias("near_edited"), likeness(F.col("na"), F.col("nn"), F.coalesce("d1", zero)).alias("near_next"),
    )
