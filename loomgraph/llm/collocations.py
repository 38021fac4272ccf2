"""Phrase collocations by vertical partitioning of a suffix tree that is cut off at three words.

Every word of a text begins a suffix of up to three words, which ends where its piece of text ends; all suffixes form a
tree, and the count of a phrase is the total of the leaves below its node. The tree is built in parts (as in ERA):

* a first pass finds the prefixes (one word, or two) that are too frequent for one part; these are extended by a word;
* each other prefix belongs to a group by its hash, with as many groups as the memory budget of one asks for;
* a second pass deals the suffixes, equal ones of a task counted together, to the groups of their prefixes;
* each group builds its own subtree by putting its suffixes in order, and reads the counts of all nodes from leaf totals.

A prefix that was extended has a node in several subtrees; each gives its part of the count, and the parts are added. All
else (cuts, scores, phrases inside longer ones, ranks) is joins over the nodes of enough occurrences: as no part of a
phrase is rarer than the phrase, nothing else is needed.

Bounds: a task holds FLUSH words, a group about GROUP_BYTES of text (and what one prefix of up to `heavy` occurrences
adds); the list of extended prefixes is at most MOST_HEAVY numbers of eight bytes, as the limit rises with the corpus.
Scores are exact below 10**16 occurrences of a phrase.

Defined cases: a null text is empty, a null language `und`. Only A-Z are made small. Repeated rows count as often as they
come; doc_id plays no part. A very long text is taken in slices. Ties in rank go by count and then by the bytes of the
phrase. Other columns are left alone, whatever their names. Empty tables and languages without a candidate give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, stored, trim

LEAST, SHARE, TOP, UNKNOWN = 10, 50, 2000, "und"
#: Text bytes that a group holds the suffixes of, about.
GROUP_BYTES = 8 << 20
#: A prefix is too frequent for one group from so many occurrences for each GROUP_BYTES.
HEAVY = GROUP_BYTES // 64
MOST_HEAVY = 1_000_000
#: Words of a task that are counted together, and bytes of a text that are taken at once.
FLUSH = 4_000_000
SLICE = 4 << 20

#: Small letters, one separator of pieces and one of words.
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
BREAK = b"."
_BITS = 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _numbers() -> defaultdict:
    """Numbers for words as they come; the break between pieces is 0."""
    found: defaultdict = defaultdict()
    found.default_factory = found.__len__
    found[BREAK]
    return found


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _below(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix and one more word."""
    return mix(prefix * _STEP + word)


def _root(lang: str) -> np.ndarray:
    return _hashes([lang.encode()])


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


class Corpus:
    """Words of texts as numbers, by language, until there are enough to count."""

    def __init__(self) -> None:
        self.number = _numbers()
        self.held: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, raw: bytes) -> Iterator[None]:
        """Take a text; stops whenever enough words are held, and then they must be taken out."""
        raw = raw.translate(_CLEAN)
        at = 0
        while at < len(raw):
            end = raw.find(b" ", at + SLICE) if len(raw) - at > SLICE else -1
            end = len(raw) if end < 0 else end
            words = raw[at:end].replace(BREAK, b" . ").split()
            self.held[lang].append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            self.size += len(words)
            at = end
            if self.size >= FLUSH:
                yield
        self.held[lang].append(np.zeros(1, np.int64))

    def take(self, last: bool) -> tuple[list[bytes], dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The words by number, and the three words of each suffix by language. If more will come, the last two words of each
        language stay, as what follows them isn't known."""
        words, out = list(self.number), {}
        kept: dict[str, list[bytes]] = {}
        for lang, held in self.held.items():
            ids = np.concatenate([*held, np.zeros(2, np.int64)] if last else held)
            kept[lang] = [words[i] for i in ids[-2:].tolist()]
            a, b, c = ids[:-2], ids[1:-1], ids[2:]
            there = a > 0
            a, b, c = a[there], b[there], c[there]
            out[lang] = (a, b, np.where(b > 0, c, 0))
        self.number, self.size = _numbers(), 0
        self.held = defaultdict(list)
        for lang, tail in kept.items():
            self.held[lang].append(np.array([self.number[w] for w in tail], np.int64))
        return words, out


def leaves(a: np.ndarray, b: np.ndarray, c: np.ndarray, counts: np.ndarray | None = None, bits: int = _BITS) -> tuple[np.ndarray, ...]:
    """Distinct suffixes in order of their numbers, with totals."""
    if not len(a):
        return a, b, c, np.zeros(0, np.int64)
    if max(a.max(), b.max(), c.max()) < 1 << bits:
        key = (a << (2 * bits)) | (b << bits) | c
        if counts is None:
            key, totals = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            key, totals = key[starts], np.add.reduceat(counts[order], starts)
        return key >> (2 * bits), (key >> bits) & ((1 << bits) - 1), key & ((1 << bits) - 1), totals
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))))
    counts = np.ones(len(a), np.int64) if counts is None else counts[order]
    return a[starts], b[starts], c[starts], np.add.reduceat(counts, starts)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    size = next(s for s in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * s))
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)


def _chosen(docs: DataFrame, text: str, lang: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )


def heavy_prefixes(docs: DataFrame, limit: int, most_words: int) -> np.ndarray:
    """Hashes, in order, of the prefixes of one and of two words with `limit` occurrences or more; some with half of that.

    A task leaves out what is below half of its share of the limit, so what all leave out of a prefix is below half of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = Corpus()

        def counted(last: bool) -> pa.RecordBatch:
            words, suffixes = corpus.take(last)
            hashed = _hashes(words)
            prefixes, numbers = [], []
            for lang, (a, b, _) in suffixes.items():
                share = limit * len(a) / most_words / 2
                times = np.bincount(a, minlength=len(words))
                found = np.flatnonzero(times >= max(share, 1))
                prefixes.append(_below(_root(lang), hashed[found]))
                numbers.append(times[found])
                often = (times >= max(share, 1))[a] & (b > 0)
                pairs, n = np.unique((a[often] << 32) | b[often], return_counts=True)
                pairs, n = pairs[n >= share], n[n >= share]
                prefixes.append(_below(_below(_root(lang), hashed[pairs >> 32]), hashed[pairs & 0xFFFFFFFF]))
                numbers.append(n)
            prefix = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(np.concatenate([*numbers, np.zeros(0, np.int64)]).astype(np.int64))], ["prefix", "n"])

        for lang, raw in _texts(batches):
            for _ in corpus.add(lang, raw):
                yield counted(False)
        yield counted(True)
        trim()

    found = docs.mapInArrow(run, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= limit / 2)
    return np.sort(np.array([r.prefix for r in found.select("prefix").collect()], np.int64).view(np.uint64))


def nodes(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, group_bytes: int = GROUP_BYTES, heavy: int = HEAVY) -> DataFrame:
    """lang, depth, phrase, f of every phrase of 1 to 3 words with `least` occurrences; depth 0 has the words of a language."""
    chosen = _chosen(docs, text, lang)
    size = chosen.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    most_words = size // 2 + 1
    limit = max(heavy, 4 * most_words // MOST_HEAVY)
    spread = heavy_prefixes(chosen, limit, most_words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = Corpus()

        def dealt(last: bool) -> Iterator[pa.RecordBatch]:
            words, suffixes = corpus.take(last)
            hashed, place = _hashes(words), np.zeros(len(words), np.int64)
            for name, three in suffixes.items():
                a, b, c, n = leaves(*three)
                one = _below(_root(name), hashed)[a]
                two = _below(one, hashed[b])
                key = np.where(_within(one, spread), np.where(_within(two, spread), _below(two, hashed[c]), two), one)
                group = (key % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                bounds = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) > 0, [True]))) if len(a) else []
                for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                    own = order[start:stop]
                    x, y, z = a[own], b[own], c[own]
                    used = np.unique(np.concatenate((x, y, z)))
                    place[used] = np.arange(len(used))
                    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
                    firsts, runs = place[x[starts]], np.diff(np.concatenate((starts, [len(x)])))
                    row = [int(group[own[0]]), name, b" ".join([words[i] for i in used.tolist()])]
                    row += [_small(v) for v in (firsts, runs, place[y], place[z], n[own])]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for name, raw in _texts(batches):
            for _ in corpus.add(name, raw):
                yield from dealt(False)
        yield from dealt(True)
        trim()

    names = ["part", "lang", "words", "firsts", "runs", "seconds", "thirds", "counts"]
    types = [pa.int64(), pa.string(), *[pa.binary()] * 6]

    def grow(part: pa.Table) -> pa.Table:
        rows = defaultdict(list)
        for row in part.to_pylist():
            rows[row["lang"]].append(row)
        out: list[tuple[str, int, bytes, int]] = []
        for name, own in rows.items():
            out += [(name, *x) for x in subtree(name, own, least, spread)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        trim()
        return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64())], ["lang", "depth", "phrase", "f"])

    parts = chosen.mapInArrow(deal, "part long, lang string, words binary, firsts binary, runs binary, seconds binary, thirds binary, counts binary")
    grown = parts.groupBy("part").applyInArrow(grow, "lang string, depth int, phrase string, f long")
    return grown.groupBy("lang", "depth", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("depth") == 0))


def subtree(lang: str, rows: list[dict], least: int, spread: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    """depth, phrase and count of the nodes of one group: frequent ones, and all whose count other groups have parts of."""
    number, held = _numbers(), []
    for row in rows:
        words = row["words"].split(b" ")
        here = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        firsts = np.repeat(_large(row["firsts"]), _large(row["runs"]))
        held.append((here[firsts], here[_large(row["seconds"])], here[_large(row["thirds"])], _large(row["counts"])))
        for x in ("firsts", "runs", "seconds", "thirds", "counts", "words"):
            row[x] = None
    a, b, c, totals = leaves(*(np.concatenate(x) for x in zip(*held, strict=True)))
    words = list(number)
    hashed = _hashes(words)
    yield 0, b"", int(totals.sum())

    twos = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    ones = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    first = _below(_root(lang), hashed[a[ones]])
    extended = _within(first, spread)
    f = np.add.reduceat(totals, ones)
    for i in np.flatnonzero((f >= least) | extended).tolist():
        yield 1, words[a[ones[i]]], int(f[i])

    second = _below(_below(_root(lang), hashed[a[twos]]), hashed[b[twos]])
    above = _within(_below(_root(lang), hashed[a[twos]]), spread)
    f = np.add.reduceat(totals, twos)
    for i in np.flatnonzero((b[twos] > 0) & ((f >= least) | (above & _within(second, spread)))).tolist():
        yield 2, words[a[twos[i]]] + b" " + words[b[twos[i]]], int(f[i])
    for i in np.flatnonzero((c > 0) & (totals >= least)).tolist():
        yield 3, words[a[i]] + b" " + words[b[i]] + b" " + words[c[i]], int(totals[i])


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, group_bytes: int = GROUP_BYTES, heavy: int = HEAVY) -> DataFrame:
    """The first `top` phrases of 2 or 3 words of each language: lang, rank, phrase, a, l, r, n, score."""
    from pyspark.sql import Window as W

    found = stored(nodes(docs, text, lang, least, group_bytes, heavy))
    phrases = found.where("depth > 0").select("lang", "phrase", "f")
    candidates = found.where("depth > 1").select("lang", "depth", "phrase", F.col("f").alias("a"))
    one = F.substring_index("phrase", " ", 1)
    two = F.substring_index("phrase", " ", 2)
    after = lambda first: F.substring(F.col("phrase"), F.length(first) + 2, F.length("phrase"))
    cuts = candidates.select(
        "*", F.explode(F.filter(F.array(
            F.struct(F.lit(1).alias("k"), one.alias("first"), after(one).alias("rest")),
            F.struct(F.lit(2).alias("k"), two.alias("first"), after(two).alias("rest")),
        ), lambda c: c["k"] < F.col("depth"))).alias("cut")
    ).select("lang", "phrase", "a", "cut.*")
    scored = (
        cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .withColumn("score", F.expr("(1000000 * (cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    longer = (
        candidates.where("depth = 3").select("lang", "a", F.explode(F.array(two, after(one))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    )
    alone = scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of some parts of a language, then the first of those
    salted = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
    ahead = alone.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("depth = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """DuckDB SQL of the same rows."""
    return rf"""with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
      split as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
      places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from split),
      grams as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase from places, (values (1), (2), (3)) as t(m) where i + m - 1 <= len(ws)),
      f as (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= {least}),
      n as (select lang, count(*) as n from places group by lang),
      c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m > 1),
      cuts as (select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as x, array_to_string(ws[k + 1:m], ' ') as y from c, (values (1), (2)) as t(k) where k < m),
      scored as (select cuts.*, l.f as l, r.f as r, ((1000000::hugeint * cuts.a * cuts.a) // (l.f::hugeint * r.f))::bigint as score
        from cuts join f l on l.lang = cuts.lang and l.phrase = cuts.x join f r on r.lang = cuts.lang and r.phrase = cuts.y),
      best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
      inside as (select lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as phrase from c where m = 3),
      longer as (select lang, phrase, max(a) as most from inside group by all),
      alone as (select best.* from best left join longer using (lang, phrase) where most is null or 100 * most < {share} * best.a)
      select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from alone join n using (lang)
      qualify rank <= {top}"""
