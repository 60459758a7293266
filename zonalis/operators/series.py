"""Area-mean time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.fields import fractional_year
from zonalis.grid import GridSpec
from zonalis.operators import composite, reduce
from zonalis.registry import Window30

Box = tuple[float, float, float, float]


def area_series(monthly: DataFrame, spec: GridSpec, box: Box, value: str,
                keys: Sequence[str] = ()) -> DataFrame:
    """One cos-weighted mean per (year, month) and slice, with a fractional-year axis."""
    s = reduce.box_mean(monthly, spec, [*keys, "year", "month"], [value], box)
    return s.withColumn("t", fractional_year(F.col("year"), F.col("month")))


def complete_series(series: DataFrame, spec: GridSpec, keys: Sequence[str] = ()) -> DataFrame:
    """All twelve months of every year present; missing months as NULL."""
    return (spec.fill(series.drop("t"), [*keys, "year"], ["month"])
            .withColumn("t", fractional_year(F.col("year"), F.col("month"))))


def series_anomaly(series: DataFrame, clim_series: DataFrame, value: str,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Minus the same-month area mean of one fixed climatology."""
    ref = clim_series.select(*keys, "month", F.col(value).alias("_c"))
    return (series.join(ref, [*keys, "month"], "left")
            .withColumn(value, F.col(value) - F.col("_c")).drop("_c"))


def series_sliding_anomaly(series: DataFrame, window_series: DataFrame, windows: Sequence[Window30],
                           value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Minus the same-month area mean of each year's best-matching window."""
    tagged = composite.best_window(series, windows).drop("win_start", "win_end")
    ref = window_series.select(*keys, "window_id", "month", F.col(value).alias("_c"))
    return (tagged.join(ref, [*keys, "window_id", "month"], "left")
            .withColumn(value, F.col(value) - F.col("_c")).drop("_c"))


def nearest_point(series: DataFrame, t: float) -> DataFrame:
    """The valid point nearest in time (the earlier of two equally near): a hover lookup."""
    return (series.where(F.col("value").isNotNull())
            .orderBy(F.abs(F.col("t") - F.lit(t)), "t").limit(1))


def summary(series: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Points, loaded points, loaded share and mean."""
    return series.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(value).alias("n_loaded"),
        (F.count(value) / F.count("*")).alias("loaded_share"), F.avg(value).alias("mean_value"))


def to_csv_lines(series: DataFrame, value: str) -> DataFrame:
    """CSV text rows ``year,month,value`` (empty for missing)."""
    return series.select(
        "year", "month",
        F.concat_ws(",", F.col("year").cast("string"), F.col("month").cast("string"),
                    F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("line"))
