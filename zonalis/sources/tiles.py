"""Quantized and dense-array forms of a tile (one latitude/longitude slice)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.constants import MISSING_CODE, QUANT_STEPS
from zonalis.grid import GridSpec, nan_to_null
from zonalis.session import ship_package
from zonalis.sources.tile_files import opened


def tile_ranges(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, vmin, vmax): (0, 1) without values, vmax = vmin + 1 for constant tiles."""
    r = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1.0))
    return r.select(*keys, lo.alias("vmin"), F.when(hi - lo < 1e-12, lo + 1.0).otherwise(hi).alias("vmax"))


def quantize(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """16-bit codes (half-even rounding, 65535 = missing) with the tile's range.

    The keys must hold everything that tells tiles apart, mean and sigma included.
    """
    r = tile_ranges(df, keys, value)
    code = F.rint((F.col(value) - F.col("vmin")) / (F.col("vmax") - F.col("vmin")) * QUANT_STEPS)
    return (df.join(r, list(keys)).withColumn("q", F.coalesce(code.cast("int"), F.lit(MISSING_CODE)))
            .drop(value))


def dequantize(df: DataFrame, value: str = "value") -> DataFrame:
    v = F.col("vmin") + F.col("q") * (F.col("vmax") - F.col("vmin")) / F.lit(float(QUANT_STEPS))
    return df.withColumn(value, F.when(F.col("q") != MISSING_CODE, v)).drop("q", "vmin", "vmax")


def to_arrays(df: DataFrame, keys: Sequence[str], spec: GridSpec, value: str = "value") -> DataFrame:
    """One row per tile: row-major ARRAY<FLOAT> with NULL for missing cells.

    A tile is exactly nlat x nlon values, the size the grid fixes. Cells carry their position
    and are sorted by it, so the result does not depend on the order in which rows arrive.
    """
    dense = spec.fill(df.select(*keys, "lat_idx", "lon_idx", value), keys, ["lat_idx", "lon_idx"])
    entry = F.struct((F.col("lat_idx") * spec.nlon + F.col("lon_idx")).alias("pos"), F.col(value).cast("float").alias("v"))
    return (dense.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_cells"))
            .select(*keys, F.col("_cells.v").alias("values")))


def from_arrays(tiles: DataFrame, keys: Sequence[str], spec: GridSpec, value: str = "value") -> DataFrame:
    flat = tiles.select(*keys, F.posexplode("values").alias("_p", value))
    return flat.select(*keys, F.floor(F.col("_p") / spec.nlon).cast("int").alias("lat_idx"),
                       (F.col("_p") % spec.nlon).cast("int").alias("lon_idx"),
                       F.col(value).cast("double").alias(value))


def read_float32(spark: SparkSession, path: str, spec: GridSpec, glob: str = "*.bin") -> DataFrame:
    """Raw little-endian float32 tiles: (path, lat_idx, lon_idx, value), NaN as NULL."""
    nlat, nlon = spec.nlat, spec.nlon

    def decode(batches):
        for pdf in batches:
            for p, blob in zip(pdf["path"], pdf["content"]):
                v = np.frombuffer(blob, dtype="<f4").astype(float)
                if v.size != nlat * nlon:
                    raise ValueError(f"{p}: {v.size} values, expected {nlat * nlon}")
                i, j = np.divmod(np.arange(v.size, dtype="int32"), np.int32(nlon))
                yield pd.DataFrame({"path": p, "lat_idx": i, "lon_idx": j, "value": v})

    ship_package(spark)
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    return nan_to_null(raw.mapInPandas(decode, "path string, lat_idx int, lon_idx int, value double"))


def tile_key(paths: DataFrame) -> DataFrame:
    """kind, level, year and month from tile names ``[std_][level_][year_]mm``."""
    stem = F.regexp_extract("path", r"([^/]+?)\.bin(\.gz)?$", 1)
    kind = F.when(stem.startswith("std_"), "std").otherwise("mean")
    parts = F.split(F.regexp_replace(stem, "^std_", ""), "_")
    n = F.size(parts)
    four = F.length(F.element_at(parts, F.greatest(n - 1, F.lit(1)))) == 4
    has_year = (n == 3) | ((n == 2) & four & (F.element_at(parts, 1).cast("int") > 1100))
    level = F.when((n == 3) | ((n == 2) & ~has_year), F.element_at(parts, 1).cast("int"))
    year = F.when(has_year, F.element_at(parts, F.greatest(n - 1, F.lit(1))).cast("int"))
    return paths.select("*", kind.alias("kind"), level.alias("level"), year.alias("year"),
                        F.element_at(parts, -1).cast("int").alias("month"))


def write_float32(tiles: DataFrame, name: str, folder: str) -> int:
    """Write each tile array as a float32 file from the executors; returns the tile count.

    ``folder`` is a path or a URI that Arrow's file systems open; on a cluster all hosts must see it. A task
    writes whole files under fixed names, so a retried task leaves the same bytes behind.
    """
    def write(batches):
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for file, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = values.values.to_numpy(zero_copy_only=False).astype("<f4")       # missing becomes NaN
                with store.open_output_stream(f"{root}/{file}.bin") as f:
                    f.write(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    ship_package(tiles.sparkSession)
    return tiles.select(name, "values").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
