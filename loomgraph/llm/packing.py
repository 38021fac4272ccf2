"""Token-id output: documents packed into rows of one length by best fit decreasing.

Every document becomes byte-level BPE ids and an end id. Documents longer than a row are cut into whole rows and a rest,
without losing an id. Pieces are dealt to shards of bounded size, and each shard packs its own: the longest piece first,
each into the open row with the least room that still holds it, found by successor search in a segment tree over the
room left. A packed row has its ids (padded with the end id), the cumulative lengths of its segments, and positions that
start again at each segment.

Shards bound the memory of a task, and cost less than one row of room each. A piece goes to the shard that the hash of
its doc_id, number and ids gives, so neither a hot source nor a long document makes a shard large, and packs do not depend
on how the input is partitioned. Repeated rows (one doc_id and text) are told apart by how many a task has seen, so that
they spread as well; only for those the shard depends on the partitions.

Defined cases: null and empty texts are one end id. Repeated rows are packed once each. Of pieces of one length those of
the lower doc_id (null last) and number come first. Very long texts are cut into rows; one text at a time is held whole.
Extra columns are left alone, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, trim

LENGTH = 2048
#: Text bytes a shard packs, about; ids of two bytes each are fewer.
SHARD_BYTES = 4 << 20
RANKS = "byte_bpe_50k.tiktoken"
END = 50256

SCHEMA = "pack_id string, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


_encoders: dict = {}


def encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def cut(n: int, length: int) -> list[int]:
    """Sizes of the pieces of a document of n ids: whole rows, then the rest."""
    whole, rest = divmod(n, length)
    return [length] * whole + ([rest] if rest else [])


class RoomTree:
    """Segment tree over room 0 to length: whether any open row has that much room."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        rows = self.rows.setdefault(room, [])
        rows.append(row)
        at = room + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the least room that is least or more."""
        at = least + self.size
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return room, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Packed rows as lists of places in sizes, the longest pieces first."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if found := tree.take(sizes[i]):
            room, row = found
            rows[row].append(i)
        else:
            room, row = length, len(rows)
            rows.append([i])
        if room > sizes[i]:
            tree.add(room - sizes[i], row)
    return rows


def pieces(docs: DataFrame, shards: int, length: int, ranks: str, text: str = "text") -> DataFrame:
    """shard, doc_id, piece, ids of every piece of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks).encode_to_numpy, np.array([END], "<u2").tobytes()
        seen: Counter = Counter()
        for batch in batches:
            texts, doc_ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for start, stop in slices(texts):
                out: list[tuple] = []
                for doc_id, t in zip(doc_ids[start:stop], texts[start:stop], strict=True):
                    ids = (encode(t).astype("<u2").tobytes() if t else b"") + end
                    digest = blake2b(ids, digest_size=12).digest()
                    turn = seen[doc_id, digest]
                    seen[doc_id, digest] += 1
                    at = 0
                    for k, size in enumerate(cut(len(ids) // 2, length)):
                        drawn = blake2b(f"{doc_id}:{k}:{turn}:".encode() + digest, digest_size=8).digest()
                        out.append((int.from_bytes(drawn, "big") % shards, doc_id, k, ids[2 * at : 2 * (at + size)]))
                        at += size
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["shard", "doc_id", "piece", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "shard int, doc_id long, piece int, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, text: str = "text", ranks: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed rows of all documents (see SCHEMA); ids and positions are little-endian numbers of two bytes."""
    total = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    cut_up = pieces(docs, shards, length, ranks or default_ranks(), text)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "ids"], na_position="last")
        ids, doc_ids, places = part["ids"].tolist(), part["doc_id"].tolist(), part["piece"].tolist()
        sizes = [len(x) // 2 for x in ids]
        shard, out = int(part["shard"].iloc[0]), []
        pad = np.array([END], "<u2").tobytes()
        counted = np.arange(length, dtype="<u2").tobytes()
        for k, row in enumerate(best_fit(sizes, length)):
            n = sum(sizes[i] for i in row)
            bounds = np.concatenate(([0], np.cumsum([sizes[i] for i in row]))).astype(np.int32)
            positions = b"".join(counted[: 2 * sizes[i]] for i in row) + counted[: 2 * (length - n)]
            named = [None if pd.isna(doc_ids[i]) else int(doc_ids[i]) for i in row]
            out.append((f"{shard:06d}-{k:06d}", n, len(row), named, [places[i] for i in row], bounds, b"".join(ids[i] for i in row) + pad * (length - n), positions))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return cut_up.groupBy("shard").applyInPandas(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: the id matrix and its positions as rows of fixed width, and the cumulative lengths."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def matrix(rows: list[bytes], length: int = LENGTH) -> np.ndarray:
    """The matrix of some packed rows (ids or positions)."""
    return np.frombuffer(b"".join(rows), "<u2").reshape(-1, length)
