"""What the operators of this subpackage share: tables, checkpoints, folds, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settle import release, settle, stored  # noqa: F401

#: The six ASCII white-space characters that separate words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows a batch that goes to Python, so that batches of long texts stay small.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; a smaller setting of the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default
        spark.conf.set(key, str(BATCH_BYTES))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def golden(n: int) -> np.uint64:
    """n steps of the golden-ratio sequence modulo 2**64."""
    return np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5DEECE66D1B3C0D7  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        m = 1 << n.bit_length()
        for at, base in enumerate((_BASE, _INVERSE)):
            step = np.full(m, np.uint64(base))
            step[0] = 1
            _powers[at] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the bounds of each text in them (len(texts) + 1 numbers)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    power, inverse = _power(len(data) + 1)
    space = _SPACES[data]
    inside = ~space
    first = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    last = np.flatnonzero(inside & np.concatenate((space[1:], [True]))) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * GOLD)
    return hashes, np.concatenate(([0], np.searchsorted(first, ends, side="left")))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of each run of size words; a shorter text that has words is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - width + 1 + j]
    return mix(out + np.uint64(width))


def trim() -> None:
    """Give memory that a finished task of this worker freed back to the machine; workers go on to other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(texts: list, chars: int = 4_000_000):
    """Bounds of runs of texts of about so many characters; a longer text is a run of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
