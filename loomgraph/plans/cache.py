"""Compiled graphs kept by the digest of what they were made of.

An entry is a folder of section tables and a manifest that is written last: rows and digest of every section. What is read is held
against its manifest first; an entry that is damaged in any way counts as none. Beyond `most_bytes` the entries that were used least
recently go.
"""

from __future__ import annotations

import contextlib
import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counts up whenever compiles of the same inputs give other rows.
VERSION = 3
LIMIT = 8 << 30


def listing_key(listing: DataFrame, extra: str = "") -> str:
    """One digest of a listing (path, kind, sha256) and of what else a compile depends on; no task holds the whole listing."""
    line = F.concat_ws("\x1f", "path", "kind", F.coalesce("sha256", F.lit("")))
    parts = listing.groupBy(F.pmod(F.xxhash64("path"), F.lit(4096)).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\x1e"), 256).alias("digest"))
    ordered = parts.orderBy("part").collect()  # 4,096 rows at most
    return hashlib.sha256("\n".join([f"{VERSION}", extra, *(f"{r.part} {r.digest}" for r in ordered)]).encode()).hexdigest()


def digest(df: DataFrame) -> DataFrame:
    """(n, digest) of a table, whatever the order of its rows."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("digest"))


class Store:
    """Entries under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, base: str, most_bytes: int = LIMIT):
        self.spark, self.base, self.most_bytes = spark, base.rstrip("/"), most_bytes

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def read(self, key: str) -> dict[str, DataFrame] | None:
        """The sections of an entry, or none where it is absent or damaged."""
        place = f"{self.base}/{key}"
        try:
            manifest = self.spark.read.parquet(f"{place}/manifest").collect()  # one row a section
            sections = {r.section: self.spark.read.parquet(f"{place}/{r.section}") for r in manifest}
            for r in manifest:
                if tuple(digest(sections[r.section]).first()) != (r.n, r.digest):
                    return None
        except PySparkException:
            return None
        fs, at = self._fs(f"{place}/manifest/_SUCCESS")
        with contextlib.suppress(Exception):  # not all stores keep times
            fs.setTimes(at, int(time.time() * 1000), -1)
        return sections

    def write(self, key: str, sections: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write an entry, move it into place as a whole, and read it from there."""
        place, fresh = f"{self.base}/{key}", f"{self.base}/.writing-{uuid.uuid4().hex}"
        rows = []
        for name, df in sections.items():
            df.write.parquet(f"{fresh}/{name}")
            rows.append((name, *digest(self.spark.read.parquet(f"{fresh}/{name}")).first()))
        self.spark.createDataFrame(rows, "section string, n long, digest long").coalesce(1).write.parquet(f"{fresh}/manifest")
        fs, at = self._fs(place)
        fs.delete(at, True)
        fs.rename(self._fs(fresh)[1], at)
        self.evict(keep=key)
        return {name: self.spark.read.parquet(f"{place}/{name}") for name in sections}

    def evict(self, keep: str | None = None) -> list[str]:
        """Remove the entries beyond the limit, those used least recently first; returns their keys."""
        fs, at = self._fs(self.base)
        entries = []
        for s in fs.listStatus(at) if fs.exists(at) else []:
            done = self._fs(f"{self.base}/{s.getPath().getName()}/manifest/_SUCCESS")[1]
            if not s.getPath().getName().startswith(".") and fs.exists(done):
                entries.append((fs.getFileStatus(done).getModificationTime(), s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength()))
        total, gone = 0, []
        for _, key, size in sorted(entries, key=lambda e: (e[1] != keep, -e[0])):
            total += size
            if total > self.most_bytes and key != keep:
                fs.delete(self._fs(f"{self.base}/{key}")[1], True)
                gone.append(key)
        return gone


def cached(store: Store, listing: DataFrame, make: Callable[[], dict[str, DataFrame]], extra: str = "") -> tuple[dict[str, DataFrame], bool]:
    """(sections, whether they were there) of the listing; they are made and kept where they are absent or damaged."""
    key = listing_key(listing, extra)
    found = store.read(key)
    return (found, True) if found is not None else (store.write(key, make()), False)
