"""Near duplicates by DartMinHash signatures, banded joining and exact checks.

A document is a weighted set of five-word shingles (weight: how often the text holds it). Each element owns strips of
weight [0, 1), [1, 2), [2, 4), ...; darts are thrown into each strip in order of rank, from hashes of element, strip and
throw, at a rate of one per unit of weight and rank. A document keeps the darts that hit below its elements' weights,
deals them to K coordinates by hash, and its signature is the earliest rank of each coordinate. The throws stop where
all coordinates are expected to have a dart (K ln K + 2 K darts in all, whatever the length), and go on for the few
documents that still lack one. Two documents agree in a coordinate with the probability of their weighted Jaccard
similarity.

Signatures meet in bands of ROWS coordinates. All further work is on classes, never on all pairs of a bucket:

1. texts of equal words are one node (a group of exact copies is one row from here on);
2. in each bucket every node is checked exactly against one head, the node whose buckets hold most others in all, which
   is the middle of a group where there is one; connected components of these links are taken;
3. only buckets that hold several components stay open. A node that links to another shares at least t / (1 + t) of
   both their weights with it, so a node too much of whose weight no other open node holds cannot link, and goes;
4. what is left is compared in full between components: nodes are dealt to blocks by the largest bucket that they lie
   in, each pair of blocks that meet in some bucket is compared once, and only links leave the comparison;
5. the components that these links touch are joined.

No link between nodes that share a bucket is lost. With 40 bands of 6 rows a pair at similarity 0.8 shares no bucket with
probability 5e-6. Step 4 costs the square of what neither a head nor a bound settles, in blocks of BLOCK_BYTES.

Defined cases: a text without words (null, empty, white space) is a class of its own, with its doc_id as class_id. A text
of one to four words is one shingle, so it links to equal words only. Rows are told apart by doc_id and words: two rows
of one doc_id with different texts are two members, which may lie in different classes. The class id is the least doc_id
of the class, null if it has none. Ties of heads go to the lower node hash, so reruns agree. Very long texts are hashed
whole, one at a time. Extra columns are left alone, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, SPACE, free_name, golden, mix, release, shingles, slices, small_batches, stored, trim, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
K = BANDS * ROWS
#: Characters of texts that are hashed at once.
SLICE = 500_000
#: Bytes of shingle sets in one block of the full comparison, about.
BLOCK_BYTES = 512 << 10
#: Bytes of shingle hashes that one task counts, about.
PART_BYTES = 32 << 20


def weighted_sets(texts: list[str | None], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and their counts, for each text."""
    hashes, bounds = word_hashes(texts)
    return [np.unique(shingles(hashes[a:b], size), return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum()) + int(b[1].sum()) - common
    return common / whole if whole else 0.0


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """k earliest ranks of each set; a row of infinities for an empty set."""
    out = np.full((len(sets), k), np.inf)
    todo = np.array([i for i, s in enumerate(sets) if len(s[0])], dtype=np.int64)
    darts = k * math.log(k) + 2 * k
    while len(todo):
        _throw([sets[i] for i in todo], todo, darts, out)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        darts *= 2
    return out


def _throw(sets: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, darts: float, out: np.ndarray) -> None:
    """Throw so many darts at each set and keep the earliest rank of each coordinate in its row of out."""
    k = out.shape[1]
    flat = out.reshape(-1)
    lengths = [len(s[0]) for s in sets]
    element, weight = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(np.float64)
    row = np.repeat(rows, lengths)
    last_rank = np.repeat([darts / float(s[1].sum()) for s in sets], lengths)
    low, strip = 0.0, 0
    while len(element):
        width = max(low, 1.0)
        seed = mix(element + golden(strip + 1))
        rank = np.zeros(len(element))
        w, r, stop, throw = weight, row, last_rank, 0
        while len(seed):
            throw += 1
            drawn = mix(seed + golden(throw))
            # 40 bits give the waiting time, the other 24 the coordinate
            rank = rank - np.log(((drawn >> np.uint64(24)).astype(np.float64) + 0.5) * (1.0 / (1 << 40))) / width
            on = np.flatnonzero(rank < stop)
            if len(on) < len(seed):
                seed, rank, w, r, stop, drawn = seed[on], rank[on], w[on], r[on], stop[on], drawn[on]
            at = r * k + (((drawn & np.uint64(0xFFFFFF)) * np.uint64(k)) >> np.uint64(24)).astype(np.int64)
            if strip:
                hit = low + width * ((mix(drawn + GOLD) >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))) < w
                np.minimum.at(flat, at[hit], rank[hit])
            else:
                np.minimum.at(flat, at, rank)
        low, strip = low + width, strip + 1
        more = weight > low
        element, weight, row, last_rank = element[more], weight[more], row[more], last_rank[more]


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit hash for each band of each row; bands differ in their seed."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, -1)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLD), bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        out = mix(out ^ bits[:, :, j])
    return out.view(np.int64)


def words_of(text: Column) -> Column:
    """The words of a text with one space between; null without words."""
    return F.nullif(F.trim(F.regexp_replace(text, SPACE, " ")), F.lit(""))


def name_of(plain: Column) -> Column:
    """64-bit name of plain words."""
    return F.xxhash64(plain)


def other_of(plain: Column) -> Column:
    """A second hash, by which two texts of one name differ."""
    return F.xxhash64(F.lit(7), plain)


def plainly(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """Columns of docs beside `plain_`, the words of the text, which is worked out once a row."""
    return docs.select(words_of(F.col(text)).alias("plain_"), *columns)


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, name (null without words) and other (two hashes of its words), bands."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for start, stop in slices(texts, SLICE):
                bands = band_hashes(dart_signatures(weighted_sets(texts[start:stop])))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, stop - start) for i in range(3)), lists], ["doc_id", "name", "other", "bands"])
        trim()

    plain = F.col("plain_")
    rows = plainly(docs, text, F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", F.when(plain.isNotNull(), name_of(plain)).alias("name"), other_of(plain).alias("other"), "text")
    return rows.mapInArrow(run, "doc_id long, name long, other long, bands array<long>")


def named(rows: DataFrame) -> DataFrame:
    """rows (name, other, ...) with node: the name, or both hashes in one where different words have the same name."""
    spread = rows.where("name is not null").groupBy("name").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    clash = stored(spread.where("low <> high").select("name", F.lit(True).alias("clash")))  # as good as always empty
    if clash.isEmpty():
        return rows.withColumn("node", F.col("name"))
    return rows.join(clash, "name", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("name", "other")).otherwise(F.col("name"))).drop("clash")


#: Two hashes of the words, the doc_id or 0, and whether that is null: what tells rows apart.
KEY = ["name", "other", "of_id", "of_null"]


def texts_of(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """node, text of the wanted nodes (node, name, other, least: a doc_id that it has)."""
    keys = wanted.select("node", "name", "other", F.coalesce("least", F.lit(0)).alias("of_id"), F.col("least").isNull().alias("of_null"))
    doc_id, plain = F.col("doc_id").cast("long"), F.col("plain_")
    rows = plainly(docs, text, F.coalesce(doc_id, F.lit(0)).alias("of_id"), doc_id.isNull().alias("of_null"), F.col(text).alias("text")).where(plain.isNotNull())
    rows = rows.select(name_of(plain).alias("name"), other_of(plain).alias("other"), "of_id", "of_null", "text")
    return rows.join(keys, KEY).select("node", "text").dropDuplicates(["node"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of distinct pairs (a, b) of nodes with texts (node, text)."""
    small_batches(texts.sparkSession)
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_text, kept_set = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            found = []
            for start, stop in slices(tb, SLICE):
                for i, other in zip(range(start, stop), weighted_sets(tb[start:stop]), strict=True):
                    if kept_set is None or ta[i] != kept_text:  # rows mostly come in order of a
                        kept_text, kept_set = ta[i], weighted_sets([ta[i]])[0]
                    found.append(similarity(kept_set, other))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.float64())], ["a", "b", "similarity"])
        trim()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in links (a, b), as a stored table.

    Each round gives every node the least label of itself and its neighbours, then the label of that label, until
    nothing changes; labels travel over hubs and shortcuts. Every round is written to the shared folder, and the one
    before goes.
    """
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).where("node <> other").distinct())
    state = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    while True:
        label = state.select(F.col("node").alias("other"), F.col("component").alias("seen"))
        near = both.join(label, "other").groupBy("node").agg(F.min("seen").alias("near"))
        step = stored(state.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("mid")))
        own = step.select(F.col("node").alias("mid"), F.col("mid").alias("root")).where("mid <> root")
        jumped = stored(step.join(own, "mid", "left").select("node", "was", F.least("mid", "root").alias("component")))
        release(state, step)
        state = jumped
        if jumped.where("component <> was").isEmpty():
            release(both)
            return state


def gram_sets(texts: DataFrame) -> DataFrame:
    """node, size, grams, counts of texts (node, text): the weighted set as bytes, and its whole weight."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            for start, stop in slices(bodies, SLICE):
                sets = weighted_sets(bodies[start:stop])
                size = pa.array([int(c.sum()) for _, c in sets], pa.int64())
                grams, counts = pa.array([g.tobytes() for g, _ in sets], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), size, grams, counts], ["node", "size", "grams", "counts"])
        trim()

    return texts.select("node", "text").mapInArrow(run, "node long, size long, grams binary, counts binary")


def unshared(sets: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """node, alone: the weight of elements of stored sets (node, size, grams, counts) that no other of the sets holds.

    Elements are dealt to parts by their hash; what two sets of one batch hold goes there once, without an owner.
    """
    total = sets.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    parts = 1 + total * 5 // 2 // part_bytes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts = ([np.frombuffer(x, kind) for x in column.to_pylist()] for column, kind in ((batch.column(1), np.uint64), (batch.column(2), np.uint32)))
            if not len(grams):
                continue
            flat, weight, owner = np.concatenate(grams), np.concatenate(counts).copy(), np.repeat(batch.column(0).to_numpy(), [len(g) for g in grams])
            flat, first, times = np.unique(flat, return_index=True, return_counts=True)
            weight, owner = weight[first], owner[first]
            weight[times > 1] = 0
            part = (flat % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            full = [k for k in range(parts) if bounds[k] < bounds[k + 1]]
            columns = [pa.array([x[order[bounds[k] : bounds[k + 1]]].tobytes() for k in full], pa.binary()) for x in (flat, owner, weight)]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *columns], ["part", "grams", "owners", "weights"])
        trim()

    def count(part: pa.Table) -> pa.Table:
        flat, owner, weight = (np.concatenate([np.frombuffer(x, kind) for x in part[name].to_pylist()]) for name, kind in (("grams", np.uint64), ("owners", np.int64), ("weights", np.uint32)))
        _, first, times = np.unique(flat, return_index=True, return_counts=True)
        first = first[times == 1]
        nodes, at = np.unique(owner[first], return_inverse=True)
        return pa.table({"node": nodes, "alone": np.bincount(at, weight[first], len(nodes)).astype(np.int64)})

    by_part = sets.select("node", "grams", "counts").mapInArrow(deal, "part long, grams binary, owners binary, weights binary")
    return by_part.groupBy("part").applyInArrow(count, "node long, alone long").groupBy("node").agg(F.sum("alone").alias("alone"))


def still_open(members: DataFrame) -> DataFrame:
    """Members (bucket, node, component) of the buckets that hold several components."""
    spread = members.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return members.join(spread.where("least <> most").select("bucket"), "bucket")


def may_link(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of open members (bucket, node, component) that can have a link at all.

    A link of r and x needs threshold / (1 + threshold) of the weight of both in common. No more is in common than what r
    shares with any open node, and x weighs no less than the lightest node of their buckets and threshold times r.
    """
    facts = sets.join(unshared(sets), "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))
    sized = stored(members.join(facts, "node"))
    lightest = sized.groupBy("bucket").agg(F.min("size").alias("lightest"))
    partner = sized.join(lightest, "bucket").groupBy("node").agg(F.min("size").alias("size"), F.min("shared").alias("shared"), F.min("lightest").alias("lightest"))
    needed = threshold / (1 + threshold) * (F.col("size") + F.greatest(threshold * F.col("size"), F.col("lightest")))
    out = stored(still_open(members.join(partner.where(F.col("shared") + 1e-6 >= needed).select("node"), "node")))
    release(sized)
    return out


def dealt(members: DataFrame, sets: DataFrame, block_bytes: int) -> DataFrame:
    """bucket, node, component, block of open members.

    A node's home is its largest bucket, and blocks are parts of a home: of its main component, or of the others. A
    bucket in which too many blocks would meet is dealt to blocks of its own.
    """
    weighed = stored(members.join(sets.select("node", (F.octet_length("grams") + F.octet_length("counts")).alias("bytes")), "node"))
    sizes = weighed.groupBy("bucket").agg(F.count("*").alias("n"))
    main = weighed.groupBy("bucket", "component").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("x")).select("bucket", F.col("x.component").alias("main"))
    kept = weighed.join(main, "bucket").select("bucket", "node", "component", (F.col("component") == F.col("main")).alias("is_main"), "bytes")
    room = kept.groupBy("bucket", "is_main").agg(F.ceil(F.sum("bytes") / block_bytes).alias("blocks"))
    block = F.xxhash64("bucket", "is_main", F.pmod(F.xxhash64("node"), "blocks"))
    own = stored(kept.join(room, ["bucket", "is_main"]).join(sizes, "bucket").select("bucket", "node", "component", "n", block.alias("own_block")))
    home = own.groupBy("node").agg(F.max(F.struct("n", "bucket", "own_block")).alias("h")).select("node", F.col("h.own_block").alias("home_block"))
    homed = stored(own.join(home, "node"))
    met = homed.groupBy("bucket").agg(F.count_distinct("home_block").alias("k"))
    out = stored(homed.join(met, "bucket").select("bucket", "node", "component", F.when(F.col("k") * F.col("k") > 16 * F.col("n"), F.col("own_block")).otherwise(F.col("home_block")).alias("block")))
    release(weighed, own, homed)
    return out


def links_between(members: DataFrame, sets: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b, node_a, node_b, similarity: components of open members (bucket, node, component) that links join, with the closest link."""
    small_batches(members.sparkSession)
    placed = dealt(members, sets, block_bytes)
    payload = placed.select("block", "node", "component").distinct().join(sets.select("node", "size", "grams", "counts"), "node")
    rows = F.collect_list(F.struct("component", "node", "size", "grams", "counts")).alias("rows")
    bounds = [F.min("component").alias("least"), F.max("component").alias("most"), F.min("size").alias("lightest"), F.max("size").alias("heaviest")]
    full = stored(payload.groupBy("block").agg(*bounds, rows))
    places = stored(placed.select("bucket", "block").distinct())
    met = places.alias("x").join(places.alias("y"), F.col("x.bucket") == F.col("y.bucket")).where("x.block <= y.block").select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()
    left, right = (full.select(F.col("block").alias(v), *[F.col(c).alias(f"{c}_{v}") for c in ("least", "most", "lightest", "heaviest", "rows")]) for v in "xy")
    near = (F.col("heaviest_x") >= threshold * F.col("lightest_y")) & (F.col("heaviest_y") >= threshold * F.col("lightest_x"))  # of a link neither set weighs more than 1 / threshold of the other
    one = F.col("least_x") == F.col("most_x")
    pairs = stored(met)
    meet = pairs.join(left, "x").join(right, "y").where(near & ~(one & (F.col("least_y") == F.col("most_y")) & (F.col("least_x") == F.col("least_y")))).select("rows_x", "rows_y")

    def opened(rows: list[dict]) -> tuple:
        grams = [np.frombuffer(r["grams"], np.uint64) for r in rows]
        counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]).astype(np.int64)
        named = [(r["component"], r["node"]) for r in rows]
        return np.array([c for c, _ in named]), named, np.array([r["size"] for r in rows]), np.concatenate(grams), counts, np.concatenate(([0], np.cumsum([len(g) for g in grams])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ca, na, sa, ga, wa, ba = opened(batch.column(0)[k].as_py())
                cb, nb, sb, gb, wb, bb = opened(batch.column(1)[k].as_py())
                codes = np.unique(np.concatenate([ga, gb]), return_inverse=True)[1]
                of_a, of_b = codes[: len(ga)], codes[len(ga) :]
                owner, held, out = np.repeat(np.arange(len(sb)), np.diff(bb)), np.zeros(len(codes), np.int64), {}
                for i in range(len(sa)):
                    mine = of_a[ba[i] : ba[i + 1]]
                    held[mine] = wa[ba[i] : ba[i + 1]]
                    common = np.bincount(owner, np.minimum(wb, held[of_b]), len(sb))
                    held[mine] = 0
                    for j in np.flatnonzero((common >= threshold * (sa[i] + sb - common)) & (cb != ca[i])):
                        (a, x), (b, y) = sorted((na[i], nb[j]))
                        link = (-float(common[j] / (sa[i] + sb[j] - common[j])), x, y)
                        out[a, b] = min(out.get((a, b), link), link)
                columns = list(zip(*[(a, b, x, y, -s) for (a, b), (s, x, y) in sorted(out.items())], strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.float64())], ["a", "b", "node_a", "node_b", "similarity"])
        trim()

    links = meet.mapInArrow(run, "a long, b long, node_a long, node_b long, similarity double")
    best = F.min(F.struct(F.negate("similarity").alias("unlike"), "node_a", "node_b")).alias("x")
    found = stored(links.groupBy("a", "b").agg(best).select("a", "b", "x.node_a", "x.node_b", F.negate("x.unlike").alias("similarity")))
    release(placed, full, places, pairs)
    return found


def closest(links: DataFrame) -> DataFrame:
    """node, other, similarity: the closest of the links (a, b, similarity) of each node, of equals that to the lower node."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity").union(links.select("b", "a", "similarity"))
    best = both.groupBy("node").agg(F.min(F.struct(F.negate("similarity").alias("unlike"), "other")).alias("x"))
    return best.select("node", "x.other", F.negate("x.unlike").alias("similarity"))


def linked(docs: DataFrame, nodes: DataFrame, banded: DataFrame, threshold: float, text: str) -> DataFrame | None:
    """node, component, other, similarity of all nodes that have a link, with the closest link that was checked, stored.

    nodes: (node, name, other, least), banded: (node, bucket).
    """
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(banded.join(sizes, "bucket"))
    score = shared.groupBy("node").agg(F.sum("n").alias("score"))
    ranked = shared.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", F.bitwise_not("node").alias("turned"))).alias("h"))
    heads = shared.join(ranked.select("bucket", F.bitwise_not("h.turned").alias("head")), "bucket")
    pairs = stored(heads.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    texts = stored(texts_of(docs, nodes.join(shared.select("node").distinct(), "node"), text))
    links = stored(compared(pairs, texts).where(F.col("similarity") >= threshold))
    found = components(links)
    members = shared.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    members = stored(still_open(members))
    release(shared, pairs)
    if members.isEmpty():
        out = stored(found.join(closest(links), "node"))
        release(members, texts, links, found)
        return out
    sets = stored(gram_sets(texts.join(members.select("node").distinct(), "node")))
    left = may_link(members, sets, threshold)
    release(texts, members)
    more = links_between(left, sets, threshold)
    roots = components(more)  # of components, so this is small
    joined = found.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    lone = roots.join(found.select("node"), "node", "left_anti").select("node", "component")
    every = links.unionByName(more.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "similarity"))
    out = stored(joined.unionByName(lone).join(closest(every), "node"))
    release(found, sets, left, more, roots, links)
    return out


def labelled(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored rows (doc_id, name, other, node) of all documents, and (node, least, class_id, first_node, class_size, linked_to,
    similarity) of all nodes.

    The first node of a class is the one whose doc_id is the class id, so that it stands for the class.
    """
    signatures = stored(signed(docs, text))
    known = named(signatures)
    worded = known.where("node is not null")
    rows = stored(known.select("doc_id", "name", "other", "node"))
    nodes = stored(worded.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("name").alias("name"), F.min("other").alias("other"), F.count("*").alias("n")))
    banded = stored(worded.select("node", F.explode("bands").alias("bucket")).distinct())
    found = linked(docs, nodes, banded, threshold, text)
    release(signatures, banded)
    in_class = nodes.join(found, "node").select("node", "component", "least", "n")
    lead = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("class_id"), F.col("node").alias("first_node"))).alias("x")
    groups = in_class.groupBy("component").agg(lead, F.sum("n").alias("class_size")).select("component", "x.class_id", "x.first_node", "class_size")
    link = found.select("node", "other", "similarity").join(nodes.select(F.col("node").alias("other"), F.col("least").alias("linked_to")), "other").drop("other")
    classed = in_class.select("node", "component", "least").join(groups, "component").drop("component").join(link, "node")
    none = [F.lit(None).cast("long").alias("linked_to"), F.lit(None).cast("double").alias("similarity")]
    alone = nodes.join(found.select("node"), "node", "left_anti").select("node", "least", F.col("least").alias("class_id"), F.col("node").alias("first_node"), F.col("n").alias("class_size"), *none)
    out = stored(classed.unionByName(alone))
    release(nodes, found)
    return rows, out


def classes(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """doc_id, class_id, class_size (in rows), linked_to, similarity of every row.

    linked_to is the document of a link that ties a row to its class: for a copy of equal words that of the least doc_id among
    them (similarity 1), for that one the closest near copy that it was compared with. Rows that are alone, or the least of a
    class of nothing but copies, have none.
    """
    rows, of = labelled(docs, threshold, text)
    found = rows.join(of, "node", "left")
    lone = F.col("node").isNull()
    copy = ~F.col("doc_id").eqNullSafe(F.col("least")) & ~lone
    return found.select(
        "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(lone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.when(copy, F.col("least")).otherwise(F.col("linked_to")).alias("linked_to"),
        F.when(copy, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"),
    )


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each class; the columns stay as they are.

    It is the row with the least doc_id (null last) and, of several texts of that doc_id in the class, the one of the
    lower hash; of repeated rows of one doc_id and text the one whose columns have the lower hash.
    """
    rows, of = labelled(docs, text=text)
    counted = rows.where("node is not null").groupBy("node", "name", "other", "doc_id").agg(F.count("*").alias("rows"))
    stays = (F.col("node") == F.col("first_node")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    marked = counted.join(of, "node").select("name", "other", F.coalesce("doc_id", F.lit(0)).alias("of_id"), F.col("doc_id").isNull().alias("of_null"), stays.alias("stays"), "rows")
    out = stored(marked.where("not stays or rows > 1"))
    release(rows, of)
    mine = {c: free_name(docs, f"{c}_") for c in KEY}
    doc_id, plain = F.col("doc_id").cast("long"), F.col(free_name(docs, "plain_"))
    whole = docs.select("*", words_of(F.col(text)).alias(free_name(docs, "plain_")))
    key = (F.when(plain.isNotNull(), name_of(plain)), other_of(plain), F.coalesce(doc_id, F.lit(0)), doc_id.isNull())
    whole = whole.select(*docs.columns, *[x.alias(mine[c]) for c, x in zip(KEY, key, strict=True)])
    gone = out.select(*[F.col(c).alias(mine[c]) for c in KEY])
    kept = whole.join(gone, list(mine.values()), "left_anti").select(*docs.columns)
    repeated = out.where("stays")
    if repeated.isEmpty():
        return kept
    again = repeated.select(*[F.col(c).alias(mine[c]) for c in KEY])
    hashed = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    one = whole.join(again, list(mine.values()), "left_semi").groupBy(*mine.values()).agg(F.min_by(F.struct(*docs.columns), hashed).alias("row"))
    return kept.unionByName(one.select("row.*"))
