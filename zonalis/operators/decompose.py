"""Zonal / eddy / anomaly / standardized-anomaly views of a field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.operators import ranks, reduce

MODES = ("total", "zonal", "eddy", "anomaly", "zscore")


def _mean_over(value: str, keys: Sequence[str]):
    return F.avg(value).over(W.partitionBy(*keys))


def zonal(df: DataFrame, row_keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """The zonal mean copied to every cell of its latitude, missing cells included."""
    return df.withColumn(out or value, _mean_over(value, row_keys))


def eddy(df: DataFrame, row_keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or value, F.col(value) - _mean_over(value, row_keys))


def self_anomaly(df: DataFrame, cell_keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Departure from the cell's own mean over the months present."""
    return df.withColumn(out or value, F.col(value) - _mean_over(value, cell_keys))


def anomaly(df: DataFrame, reference: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Departure from a reference of the same keys; cells without one become NULL."""
    ref = reference.select(*on, F.col(value).alias("_ref"))
    return df.join(ref, list(on), "left").withColumn(value, F.col(value) - F.col("_ref")).drop("_ref")


def zscore(df: DataFrame, reference: DataFrame, on: Sequence[str], tile_keys: Sequence[str],
           value: str, sigma: str) -> DataFrame:
    """(v - mean) / max(sigma, floor): ``reference`` carries ``value`` and ``sigma``.

    The floor of a tile is its 2nd-percentile positive sigma, one row per tile.
    """
    floor = ranks.sigma_floor(reference, tile_keys, sigma)
    ref = reference.select(*on, F.col(value).alias("_ref"), F.col(sigma).alias("_sd"))
    s = F.greatest(F.col("_sd"), F.col("sigma_floor"))
    return (df.join(ref, list(on), "left").join(floor, list(tile_keys), "left")
            .withColumn(value, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_ref")) / s))
            .drop("_ref", "_sd", "sigma_floor"))


def decompose(df: DataFrame, mode: str, value: str, row_keys: Sequence[str],
              on: Sequence[str], reference: DataFrame | None = None,
              sigma: str | None = None, tile_keys: Sequence[str] = ()) -> DataFrame:
    """Dispatch on mode. A missing reference or an unknown mode passes the field through."""
    if mode == "zonal":
        return zonal(df, row_keys, value)
    if mode == "eddy":
        return eddy(df, row_keys, value)
    if mode == "anomaly" and reference is not None:
        return anomaly(df, reference, on, value)
    if mode == "zscore" and reference is not None and sigma is not None:
        return zscore(df, reference, on, tile_keys, value, sigma)
    return df


def is_symmetric(mode: str, has_reference: bool) -> bool:
    return mode == "eddy" or (mode in ("anomaly", "zscore") and has_reference)


def stable_range(df: DataFrame, mode: str, slice_keys: Sequence[str], value: str,
                 symmetric: bool, clamp_hi: float | None = None) -> DataFrame:
    """Range of a decomposed field pooled over its months."""
    by_month = [*slice_keys, "month"]
    if symmetric and clamp_hi is not None:
        ranges = ranks.clamped_symmetric_range(df, by_month, value, clamp_hi)
    elif symmetric:
        ranges = reduce.symmetric_range(df, by_month, value)
    else:
        ranges = reduce.value_range(df, by_month, value)
    return reduce.pooled_range(ranges, slice_keys, symmetric)
