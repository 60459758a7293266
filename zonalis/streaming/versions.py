"""Parquet trees whose partitions are replaced as a whole and never lost: versions and a commit log.

``<root>/<part>=<value>/.../version=<n>/``. A batch writes its partitions under the next number, then a marker in
the log; until the marker exists readers see the versions before it. Only then are the replaced versions deleted. A
driver lost at any moment leaves either the old or the new state; what an unfinished batch wrote carries a number
that was never committed and is overwritten by the next. The marker names the stream and its batch, so that a batch
replayed after its commit changes nothing. Several trees may share one log and are then committed together.

Only folders of partitions a batch touches are listed; data of others is neither read nor written. One writer at a
time per log.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zonalis.sources.files import Files

VERSION = "version"


@dataclass
class Batch:
    """A version that is being written, and the partitions written so far."""

    version: int
    wrote: list[tuple[VersionedTree, Sequence[tuple]]] = field(default_factory=list)


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.path, self.files = path.rstrip("/"), Files(spark, path)

    def last(self) -> tuple[int, str | None, int | None]:
        """The last committed version with the stream and batch that made it; 0 before the first."""
        numbers = [int(n) for n in self.files.names(self.path) if n.isdigit()]
        if not numbers:
            return 0, None, None
        made = json.loads(self.files.text(f"{self.path}/{max(numbers)}"))
        return max(numbers), made["stream"], made["batch"]

    @contextmanager
    def batch(self, stream: str, number: int) -> Iterator[Batch | None]:
        """The batch to write, committed when the block ends well; None if it is committed already."""
        last, made_by, made = self.last()
        if made_by == stream and made is not None and number <= made:
            yield None
            return
        new = Batch(last + 1)
        yield new
        self.files.put(f"{self.path}/{new.version}", json.dumps({"stream": stream, "batch": number}))
        for n in self.files.names(self.path):
            if n.isdigit() and int(n) < last:
                self.files.delete(f"{self.path}/{n}")
        for tree, touched in new.wrote:
            tree.forget(touched, new.version)


class VersionedTree:
    def __init__(self, spark: SparkSession, root: str, parts: Sequence[str] = (), log: CommitLog | None = None):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), list(parts)
        self.files = Files(spark, root)
        self.log = log or CommitLog(spark, f"{self.root}/_log")

    def touched(self, rows: DataFrame) -> list[tuple]:
        """Partitions that rows fall into: folder keys, as few as the folders of one batch."""
        if not self.parts:
            return [] if rows.isEmpty() else [()]
        return [tuple(r) for r in rows.select(*self.parts).distinct().collect()]

    def _folder(self, values: tuple) -> str:
        return "/".join([self.root, *map(self.files.partition, self.parts, values)])

    def _every_folder(self) -> list[str]:
        found = [self.root]
        for p in self.parts:
            found = [f"{f}/{n}" for f in found for n in self.files.names(f) if n.startswith(f"{p}=")]
        return found

    def _versions(self, folder: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.files.names(folder) if n.startswith(f"{VERSION}="))

    def read(self, touched: Sequence[tuple] | None, schema: StructType | str | None = None, version: int | None = None) -> DataFrame | None:
        """Rows of some partitions (None: all): each in its newest committed version, or in exactly ``version``, which need
        not be committed. None if there are none."""
        last = self.log.last()[0]
        paths = []
        for folder in self._every_folder() if touched is None else map(self._folder, touched):
            mine = [v for v in self._versions(folder) if (v == version if version is not None else v <= last)]
            if mine:
                paths.append(f"{folder}/{VERSION}={mine[-1]}")
        if not paths:
            return None
        reader = self.spark.read.option("basePath", self.root)
        return (reader.schema(schema) if schema else reader).parquet(*paths).drop(VERSION)

    def write(self, rows: DataFrame, batch: Batch, touched: Sequence[tuple], band: Column | None = None) -> None:
        """Write whole partitions as the version of a batch; what is committed stays. ``band`` parts a partition among tasks."""
        if self.parts:
            rows = rows.repartition(*self.parts, *([band] if band is not None else []))
        (rows.withColumn(VERSION, F.lit(batch.version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*self.parts, VERSION).parquet(self.root))
        batch.wrote.append((self, touched))

    def forget(self, touched: Sequence[tuple], version: int) -> None:
        """Delete the versions that a committed one replaced."""
        for folder in map(self._folder, touched):
            for old in self._versions(folder):
                if old < version:
                    self.files.delete(f"{folder}/{VERSION}={old}")
