"""Packing by Karmarkar-Karp differencing: documents as token ids in windows of nearly equal fill.

Ids are those of the tokenizers library, one text as a whole. No token of that vocabulary reaches over white space, so the
words between ASCII white space are encoded once each, by the library, for some megabytes of text at a time.

Whole windows of a long document stand alone; what is left of each document is dealt to shards of bounded size by a hash of
the document, and each shard is packed by multiway differencing: a partial partition is the sums of its windows, the two
partitions of the largest differences are merged so that the fullest windows of one meet the emptiest of the other, until
one is left. If a window exceeds the capacity, the shard is partitioned into more windows. Where that would cost too much
room (as with many pieces of one size) the pieces are cut finer and the differencing begins anew.

Shards bound the memory of a task and cost less than one window of padding each, and neither a hot source nor a very long
document makes a shard large. Repeated rows (one doc_id and text) are told apart by how many a task has seen; only for
those the shard depends on how the input is partitioned.

Defined cases: null and empty texts are one end id. Repeated rows are packed once each. Rows of one doc_id with different
texts are documents of their own. A very long text is held whole by one task, one text at a time. A doc_id of any simple
type is kept as it is. Extra columns are left alone, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import small_batches, trim

CAPACITY = 2048
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Text bytes a shard packs, about.
SHARD_BYTES = 1 << 20
#: Pieces of what is left of a document have at most so many ids, the first where the padding is small enough.
CUTS = (384, 192, 96, 48)
#: Windows that a shard may have beyond the fewest, as a share of these, before it is cut finer.
SPARE = 1 / 50

#: Text bytes of which the distinct words are encoded together.
TEXT_BYTES = 24 << 20

WIDTH = 4  # bytes an id


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Words:
    """The library's ids of texts, each distinct word encoded once for many texts.

    A word of Latin letters that have no other composed form is one pre-token, whatever its case, and signs after its end are
    another. Such words skip the library's normaliser and pattern and go many at once to its model, which marks word ends.
    """

    SIMPLE = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[,.;:!?]*)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
        if hasattr(self.tokenizer.model, "_resize_cache"):  # every word comes once, so keeping them is of no use
            self.tokenizer.model._resize_cache(0)
            self.letters.model._resize_cache(0)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the bounds of each text in them; null is empty."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        ids, sizes = ragged(*self._distinct(coded.dictionary), coded.indices.to_numpy())
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return ids, bounds[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, and how many each has."""
        found = pc.extract_regex(words, self.SIMPLE)
        simple = pc.is_valid(found)
        letters = pc.utf8_lower(found.field("letters").filter(simple)).dictionary_encode()
        signs = found.field("signs").filter(simple).dictionary_encode()
        others = words.filter(pc.invert(simple))
        tables = [self._words(letters.dictionary.to_pylist()), self._texts(signs.dictionary.to_pylist()), self._texts(others.to_pylist())]
        flat, sizes = (np.concatenate(x) for x in zip(*tables, strict=True))
        # each word is two units: letters and signs, or something else and nothing
        n = len(letters.dictionary), len(letters.dictionary) + len(signs.dictionary)
        units, there = np.full((len(words), 2), len(sizes), np.int64), simple.to_numpy(zero_copy_only=False).astype(bool)
        units[there, 0] = letters.indices.to_numpy()
        units[there, 1] = n[0] + signs.indices.to_numpy()
        units[~there, 0] = n[1] + np.arange(len(others))
        ids, each = ragged(flat, np.concatenate((sizes, [0])), units.ravel())
        return ids, each.reshape(-1, 2).sum(axis=1)

    def _words(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of small letters, by the model alone."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for start in range(0, len(some), 1000):
            ids = np.array(self.letters.encode_batch_fast([" ".join(some[start : start + 1000])], add_special_tokens=False)[0].ids, np.uint32)
            flat.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
        return np.concatenate(flat), np.concatenate(sizes)

    def _texts(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [c.ids for c in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return np.array([i for ids in coded for i in ids], np.uint32), np.array([len(ids) for ids in coded], np.int64)


def ragged(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of uneven sizes, one after the other in flat, in a new order, and their sizes."""
    taken = sizes[order]
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    place = np.repeat(((np.cumsum(sizes) - sizes)[order] - (ends - taken)).astype(kind), taken)
    place += np.arange(total, dtype=kind)
    return flat[place], taken


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """The sum and the places in sizes of each of k windows or fewer (empty ones are left out)."""
    parts = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(parts)
    joined: list[tuple[int, int]] = []  # two windows made one, numbered after the pieces
    n = len(sizes)
    while len(parts) > 1:
        (_, _, a), (_, turn, b) = heapq.heappop(parts), heapq.heappop(parts)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the last of a meet the last of b, in opposite order
            merged = a[: len(a) - over] + b[: len(b) - over]
            for (x, at), (y, to) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True):
                merged.append((x + y, n + len(joined)))
                joined.append((at, to))
        merged.sort(reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(parts, (-spread, turn, merged))
    out = []
    for total, at in parts[0][2] if parts else []:
        members, open_ = [], [at]
        while open_:
            at = open_.pop()
            if at < n:
                members.append(at)
            else:
                open_ += joined[at - n]
        out.append((total, members))
    return out


def windows(sizes: list[int], capacity: int, most: int | None = None) -> list[list[int]] | None:
    """Windows of nearly equal sums up to capacity; none if that takes more than `most` windows."""
    k = -(-sum(sizes) // capacity)
    while most is None or k <= most:
        found = differencing(sizes, k)
        over = sum(max(0, total - capacity) for total, _ in found)
        if not over:
            return [members for _, members in found]
        k += max(1, over // capacity)
    return None


def cut(n: int, most: int) -> list[int]:
    """Sizes of the fewest pieces of n ids of which none is above `most`, all within one of each other."""
    pieces = -(-n // most)
    small, more = divmod(n, pieces)
    return [small + 1] * more + [small] * (pieces - more)


def packed(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (place in lengths, start, size) of rests of documents, cut as finely as little padding takes."""
    fewest = -(-sum(lengths) // capacity)
    for most in CUTS:
        most = min(most, capacity)
        last = most == min(CUTS[-1], capacity)
        pieces = []
        for i, n in enumerate(lengths):
            at = 0
            for size in cut(n, most):
                pieces.append((i, at, size))
                at += size
        found = windows([p[2] for p in pieces], capacity, None if last else fewest + max(1, int(fewest * SPARE)))
        if found is not None:
            return [_joined(sorted(pieces[j] for j in members)) for members in found]
    raise AssertionError("the finest cut takes any number of windows")


def _joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring pieces of one document that met in one window are one piece again."""
    out: list[tuple[int, int, int]] = []
    for i, at, size in pieces:
        if out and out[-1][0] == i and out[-1][1] + out[-1][2] == at:
            out[-1] = (i, out[-1][1], out[-1][2] + size)
        else:
            out.append((i, at, size))
    return out


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def parts(docs: DataFrame, shards: int, capacity: int, vocabulary: str, text: str = "text") -> DataFrame:
    """shard, place, doc_id, start, doc_tokens, ids: whole windows of long documents, and what is left of each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = words(vocabulary).encode, np.array([END], "<u4").tobytes()
        seen: Counter = Counter()

        def dealt(some: pa.RecordBatch) -> pa.RecordBatch:
            named = some.column(0).to_pylist()
            every, bounds = encode(some.column(2))
            every, bounds = every.astype("<u4").tobytes(), (WIDTH * bounds).tolist()
            out: list[tuple] = []
            for row, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                ids = every[a:b] + end
                digest = blake2b(f"{named[row]}:".encode() + ids, digest_size=16).digest()
                turn = seen[digest]
                seen[digest] += 1
                n = len(ids) // WIDTH
                whole = n // capacity * capacity
                for start in [*range(0, whole, capacity), *([whole] if whole < n else [])]:
                    place = blake2b(digest + f"{turn}:{start}".encode(), digest_size=16).digest()
                    size = min(capacity, n - start)
                    out.append((int.from_bytes(place[:8], "big") % shards, place, row, start, n, ids[WIDTH * start : WIDTH * (start + size)]))
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), some.column(1).take(pa.array(columns[2], pa.int32())),
                pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.binary()),
            ], ["shard", "place", "doc_id", "start", "doc_tokens", "ids"])

        for some in gathered(batches, TEXT_BYTES):
            yield dealt(some)
        trim()

    schema = StructType([
        StructField("shard", IntegerType()), StructField("place", BinaryType()), StructField("doc_id", docs.schema["doc_id"].dataType),
        StructField("start", LongType()), StructField("doc_tokens", LongType()), StructField("ids", BinaryType()),
    ])
    return docs.select(F.col("doc_id").cast("string").alias("named"), F.col("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian, four bytes each) of every piece."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")) + 1)).first()[0] or 0
    dealt = parts(docs, max(1, -(-total // shard_bytes)), capacity, vocabulary or default_vocabulary(), text)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("place").combine_chunks()
        shard, ids = part.column("shard")[0].as_py(), part.column("ids").to_pylist()
        sizes = [len(x) // WIDTH for x in ids]
        full = [i for i, n in enumerate(sizes) if n == capacity]
        rests = [i for i, n in enumerate(sizes) if n < capacity]
        found = [[(i, 0, capacity)] for i in full] + [[(rests[i], at, n) for i, at, n in w] for w in packed([sizes[i] for i in rests], capacity)]
        rows, starts, lengths, sequences, offsets, cut_up = [], [], [], [], [], []
        for number, window in enumerate(found):
            offset = 0
            for i, at, n in window:
                rows.append(i)
                starts.append(at)
                lengths.append(n)
                sequences.append(shard << 32 | number)
                offsets.append(offset)
                cut_up.append(ids[i][WIDTH * at : WIDTH * (at + n)])
                offset += n
        taken = part.select(["doc_id", "start", "doc_tokens"]).take(pa.array(rows, pa.int64()))
        start = [a + b for a, b in zip(taken.column("start").to_pylist(), starts, strict=True)]
        return pa.table({
            "doc_id": taken.column("doc_id"), "start": pa.array(start, pa.int64()), "length": pa.array(lengths, pa.int64()), "doc_tokens": taken.column("doc_tokens"),
            "sequence_id": pa.array(sequences, pa.int64()), "offset": pa.array(offsets, pa.int64()), "ids": pa.array(cut_up, pa.binary()),
        })

    longs = [StructField(c, LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *longs, StructField("ids", BinaryType())])
    return dealt.groupBy("shard").applyInArrow(run, schema)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row a sequence: n_tokens, doc_ids, cu_seqlens, and its ids padded with the end id to the capacity."""
    pad = F.repeat(F.lit("01000000"), F.lit(capacity) - F.col("n_tokens").cast("int"))
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (
        pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), held.alias("held"))
        .select(
            "sequence_id", "n_tokens", F.col("held.doc_id").alias("doc_ids"),
            F.concat(F.col("held.offset"), F.array("n_tokens")).alias("cu_seqlens"),
            F.concat(F.unhex(F.array_join(F.transform("held.ids", F.hex), "")), F.unhex(pad)).alias("ids"),
        )
    )


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    checked = F.crc32("ids").alias("ids_crc32")
    return pack(docs, text=text).select("doc_id", "start", "length", checked, "doc_tokens", "sequence_id", "offset")
