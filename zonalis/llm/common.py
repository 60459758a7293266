"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from zonalis.session import ship_package, work_folder

#: One word in the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Splits of rows that meet in pairs: at most this many on each side of one task.
BLOCK = 4096
#: Bytes of Arrow data that become Python objects at once.
SLICE = 4 << 20
#: Words of 64 bits that mark which keys may be in a set.
SIEVE = 1 << 17
#: Share of documents that no model learns from.
FOLDS = 5

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared work folder once and go on from the files.

    A lost executor then costs its running tasks only, and what is read twice is computed once.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(key: str | Column) -> Column:
    """True for the rows whose crc32 of the id as text is divisible by five (null ids: false)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def python_ready(spark: SparkSession) -> None:
    """Let the Python workers import this package (called by operators with Python in tasks)."""
    ship_package(spark)


def sliced(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of about ``size`` bytes, one row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def append(df: DataFrame, inputs: Sequence[str], schema: str, work: Callable[..., Sequence]) -> DataFrame:
    """Append columns that ``work`` computes from whole input columns, some rows at a time: about
    ``SLICE`` bytes, and one row at least, are Python objects at once.

    ``work`` gets one list per input and returns one list or array per column of ``schema``. Columns
    of the frame with the names of new ones are replaced. A narrow pass: no shuffle.
    """
    python_ready(df.sparkSession)
    added = StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name not in added.names]
    types = to_arrow_schema(added).types
    names = [f.name for f in kept] + added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            made = work(*[c.to_pylist() for c in part.columns[len(kept):]])
            yield pa.RecordBatch.from_arrays(
                part.columns[:len(kept)] + [pa.array(m, t) for m, t in zip(made, types, strict=True)], names)

    source = df.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(inputs)])
    return source.mapInArrow(run, StructType(kept + added.fields))


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """Bits for a set of keys of any size: at most ``SIEVE`` rows (word, bits), whatever the data."""
    h = F.xxhash64(key, F.lit("sieve"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    return stored(keys.groupBy(F.pmod(F.shiftright(h, 6), F.lit(SIEVE)).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "sieve")


def sifted(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Append ``_maybe``: false only where the key is surely not in the set. No shuffle of ``df``: what is
    broadcast has at most ``SIEVE`` rows of 16 bytes."""
    h = F.xxhash64(key, F.lit("sieve"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    return (df.withColumn("_word", F.pmod(F.shiftright(h, 6), F.lit(SIEVE))).withColumn("_bit", bit)
            .join(F.broadcast(bits), "_word", "left")
            .withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_word", "_bit", "_bits"))


def blocked_pairs(df: DataFrame, keys: Sequence[str], spread: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Deal rows that must meet within a key to tasks of at most about 2 x ``size`` rows.

    Adds ``left_block`` and ``right_block`` to the rows. Rows of a small key keep one copy (0, 0). A
    large key is cut into n blocks by a hash of ``spread`` and every row is copied to the n pairs
    (i, j), i <= j, that hold its own block, which is ``own_block``. Group by the keys and both
    block numbers: every pair of rows of a key then meets in exactly one group, namely that of its
    two own blocks.
    """
    # stored: their size is then known when the join is planned, and a short list moves instead of the rows
    counts = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
                    .select(*keys, F.ceil(F.col("_n") / F.lit(size)).cast("int").alias("_blocks")), "large-keys")
    n = F.coalesce("_blocks", F.lit(1))
    own = F.pmod(F.xxhash64(*spread, F.lit("block")), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    return (df.join(counts, list(keys), "left").withColumn("own_block", own).withColumn("_other", other)
            .withColumn("left_block", F.least("own_block", "_other"))
            .withColumn("right_block", F.greatest("own_block", "_other"))
            .drop("_blocks", "_other"))
