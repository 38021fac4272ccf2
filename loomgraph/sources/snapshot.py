"""Snapshots of a checkout: a listing as a data source, and inputs that are read only if nothing changes meanwhile."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import GENERATED_DIRS
from ..operators.own import visible
from ..plans.settle import settle
from . import files


NAMES = ["path", "kind", "length", "sha256", "content"]


class Unstable(RuntimeError):
    """A checkout went on changing while it was read."""


class Directory(InputPartition):
    """A directory to list: with all below it, or its own entries alone."""

    def __init__(self, path: str, below: bool):
        super().__init__(path)
        self.path, self.below = path, below


class CheckoutReader(DataSourceReader):
    #: Directories down to this depth are partitions of their own.
    DEPTH = 2

    #: Bytes of contents that go to Spark at once; a larger file goes alone.
    BATCH_BYTES = 16 << 20

    def __init__(self, root: str, generated: set[str], content: bool):
        self.root, self.generated, self.content = root, generated, content

    def _entries(self, rel: str) -> list[os.DirEntry]:
        with os.scandir(os.path.join(self.root, rel)) as found:
            return sorted((e for e in found if e.name not in self.generated), key=lambda e: e.name)

    def partitions(self) -> list[Directory]:
        out, level = [], [""]
        for depth in range(self.DEPTH + 1):
            out += [Directory(rel, depth == self.DEPTH) for rel in level]
            if depth < self.DEPTH:
                level = [f"{rel}/{e.name}".lstrip("/") for rel in level for e in self._entries(rel) if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, partition: Directory) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self._rows(partition):
            rows.append(row)
            held += 200 + len(row[4] or b"")
            if held >= self.BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        path, kind, length, sha256, content = zip(*rows, strict=True)
        columns = [pa.array(path, pa.string()), pa.array(kind, pa.string()), pa.array(length, pa.int64()), pa.array(sha256, pa.string()), pa.array(content, pa.binary())]
        return pa.RecordBatch.from_arrays(columns[: 5 if self.content else 4], NAMES[: 5 if self.content else 4])

    def _rows(self, partition: Directory) -> Iterator[tuple]:
        waiting = [partition.path]
        while waiting:
            at = waiting.pop()
            for e in self._entries(at):
                rel = f"{at}/{e.name}".lstrip("/")
                if e.is_symlink():
                    yield rel, "link", None, hashlib.sha256(os.readlink(e.path).encode("utf-8", "surrogateescape")).hexdigest(), None
                elif e.is_dir(follow_symlinks=False):
                    yield rel, "dir", None, None, None
                    if partition.below:
                        waiting.append(rel)
                elif e.is_file(follow_symlinks=False):
                    digest, length, kept = hashlib.sha256(), 0, []
                    with open(e.path, "rb") as f:
                        while chunk := f.read(1 << 20):
                            digest.update(chunk)
                            length += len(chunk)
                            if self.content:
                                kept.append(chunk)
                    yield rel, "file", length, digest.hexdigest(), b"".join(kept) if self.content else None


class Checkout(DataSource):
    """`spark.read.format("checkout").load(root)`: (path, kind, length, sha256) of all files, directories and links under root.

    With option `content` also the bytes of files. Hidden files are files like any other. Links are not followed. root is a folder that the driver and all executors see; directories that are generated are left out
    (option `generated`: names apart by commas).
    """

    @classmethod
    def name(cls) -> str:
        return "checkout"

    def schema(self) -> str:
        return "path string, kind string, length long, sha256 string" + (", content binary" if self._content() else "")

    def _content(self) -> bool:
        return self.options.get("content", "false").lower() == "true"

    def reader(self, schema) -> CheckoutReader:  # noqa: ANN001
        named = self.options.get("generated")
        return CheckoutReader(self.options["path"].removeprefix("file://"), set(named.split(",") if named is not None else GENERATED_DIRS), self._content())


def capture(spark: SparkSession, root: str, ignored: DataFrame | None = None) -> DataFrame:
    """(path, kind, length, sha256) of what a checkout holds just now, settled."""
    if files.remote(root):  # a store that only Spark reads has files alone
        found = files.inputs(spark, root).select("path", F.lit("file").alias("kind"), "length", "sha256")
    else:
        spark.dataSource.register(Checkout)
        found = spark.read.format("checkout").load(root)
    return settle(found if ignored is None else visible(found, ignored))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path) of entries that two captures don't share."""
    return before.exceptAll(after).select("path").unionByName(after.exceptAll(before).select("path")).distinct()


def stable_inputs(spark: SparkSession, root: str, ignored: DataFrame | None = None, attempts: int = 2, read: Callable[..., DataFrame] = files.inputs) -> tuple[DataFrame, DataFrame]:
    """(inputs, listing) of a checkout that did not change while it was read.

    The checkout is listed, read and listed again. If the listings differ, or what was read differs from the second listing, it is
    done once more; then `Unstable` is raised.
    """
    for _ in range(attempts):
        before = capture(spark, root, ignored)
        found = settle(read(spark, root, ignored))
        after = capture(spark, root, ignored)
        if not differences(before, after).isEmpty():
            continue
        held = after.where("kind = 'file'").select("path", F.col("sha256").alias("now"))
        if found.select("path", "sha256").join(held, "path", "left").where("now is null or now <> sha256").isEmpty():
            return found, after
    raise Unstable("the checkout changed while it was read; try again once edits have settled")
