"""A table kept as a base and one set of change files per micro-batch.

A batch writes the rows it brings and nothing else, so the cost of a batch follows its own size. Readers put the newest complete
base and the changes since together and keep what counts, for example the newest row of a key. Every `every` batches the
table so far becomes a new base; bases before the last one, and changes they hold, are removed. So the number of files is
bounded, and the batch that runs again after a failure always finds what it started from: its writes replace its own folders.

A base counts once Spark has written the marker of a finished job into its folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

EVERY = 20


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a folder: works for every store Spark can read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, folder: str, name: str, complete: bool = False) -> list[int]:
    """The numbers n of folders `name`=n, ascending."""
    store, at = _files(spark, folder)
    if not store.exists(at):
        return []
    out = []
    for status in store.listStatus(at):
        found = status.getPath().getName()
        if found.startswith(f"{name}=") and (not complete or store.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))):
            out.append(int(found.split("=")[1]))
    return sorted(out)


class ChangeLog:
    """`keep` reduces all rows of a table to those that count; it must give the same whatever it has reduced before."""

    def __init__(self, spark: SparkSession, folder: str, keep: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.spark, self.folder, self.keep, self.every = spark, folder, keep, every

    def _base(self, number: int) -> str:
        return os.path.join(self.folder, "base", f"version={number}")

    def _changes(self, number: int) -> str:
        return os.path.join(self.folder, "changes", f"batch={number}")

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table as it is, or as the batch `before` found it; None where nothing is stored."""
        def early(numbers: list[int]) -> list[int]:
            return [n for n in numbers if before is None or n < before]

        bases = early(_numbers(self.spark, os.path.join(self.folder, "base"), "version", complete=True))
        since = bases[-1] if bases else -1
        paths = [self._base(n) for n in bases[-1:]]
        paths += [self._changes(n) for n in early(_numbers(self.spark, os.path.join(self.folder, "changes"), "batch", complete=True)) if n > since]
        return self.keep(self.spark.read.parquet(*paths)) if paths else None

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self._changes(batch))
        if (batch + 1) % self.every == 0:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        """The table after `batch` as a base. The base before it stays, with the changes since."""
        self.read(batch + 1).write.mode("overwrite").parquet(self._base(batch))
        bases = [n for n in _numbers(self.spark, os.path.join(self.folder, "base"), "version", complete=True) if n < batch]
        if not bases:
            return
        gone = [self._base(n) for n in bases[:-1]]
        gone += [self._changes(n) for n in _numbers(self.spark, os.path.join(self.folder, "changes"), "batch") if n <= bases[-1]]
        for path in gone:
            store, at = _files(self.spark, path)
            store.delete(at, True)
