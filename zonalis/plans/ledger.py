"""What a job has done: content hash, status and reason of every piece of work, so that a second run does only what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.streaming.versions import VersionedTree

DONE, BAD = "done", "bad"
SCHEMA = "key string, hash string, status string, reason string"


class Ledger:
    """A small versioned table, a row per piece of work. Work that went wrong is tried again only when its content changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tree = spark, VersionedTree(spark, root)

    def rows(self) -> DataFrame:
        found = self.tree.read(None, SCHEMA)
        return self.spark.createDataFrame([], SCHEMA) if found is None else found

    def open_work(self, work: DataFrame) -> DataFrame:
        """The rows of ``work`` (key, hash, ...) that are new or whose content has changed."""
        return work.join(self.rows().select("key", "hash"), ["key", "hash"], "left_anti")

    def record(self, results: DataFrame) -> None:
        """Put (key, hash, status, reason) in place of what was known of these keys."""
        new = results.select("key", "hash", "status", F.col("reason").cast("string").alias("reason"), F.lit(1).alias("_new"))
        both = new.unionByName(self.rows().withColumn("_new", F.lit(0)))
        merged = both.groupBy("key").agg(F.max_by(F.struct("hash", "status", "reason"), "_new").alias("_r")).select("key", "_r.*")
        with self.tree.log.batch(uuid.uuid4().hex, 0) as batch:
            self.tree.write(merged, batch, [()])
