"""Reductions over time, longitude and area. All are single hash aggregations with a
map-side partial step, so a hot cell never reaches one task row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.fields import in_box
from zonalis.grid import GridSpec

CELL_KEYS = ("level", "lat_idx", "lon_idx")


def mean_by(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def monthly_means(df: DataFrame, values: Sequence[str],
                  keys: Sequence[str] = ("year", "month", *CELL_KEYS)) -> DataFrame:
    """Samples to one value per (year, month, cell)."""
    return mean_by(df, keys, values)


def climatology(monthly: DataFrame, values: Sequence[str],
                keys: Sequence[str] = CELL_KEYS, spread: bool = False) -> DataFrame:
    """Month-of-year mean over years; with ``spread`` also the population sigma over years."""
    aggs = [F.avg(v).alias(v) for v in values]
    if spread:
        aggs += [F.stddev_pop(v).alias(f"{v}_std") for v in values]
    return monthly.groupBy("month", *keys).agg(*aggs)


def annual_mean(clim: DataFrame, values: Sequence[str],
                keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Mean of the monthly means, months weighted equally."""
    return mean_by(clim, keys, values)


def seasonal_mean(clim: DataFrame, values: Sequence[str],
                  keys: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Centred three-month mean with December and January adjacent.

    Every month is copied to the three target months it belongs to; a target month is
    kept only where all three source months of its slice exist (``keys`` minus the cell
    name the slice), and cells inside it skip missing values.
    """
    m = F.col("month")
    targets = F.array(F.pmod(m - 2, F.lit(12)) + 1, m, F.pmod(m, F.lit(12)) + 1)
    slice_keys = [k for k in keys if k not in ("lat_idx", "lon_idx")]
    spread = clim.withColumn("_src", m).withColumn("month", F.explode(targets))
    cells = spread.groupBy("month", *keys).agg(*[F.avg(v).alias(v) for v in values])
    # slices with all three source months: a few rows, pre-aggregated before any shuffle
    whole = (spread.groupBy("month", *slice_keys).agg(F.count_distinct("_src").alias("_n")).where("_n = 3").drop("_n"))
    return cells.join(whole, ["month", *slice_keys], "left_semi")


def zonal_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return mean_by(df, keys, values)


def joint(a: str, b: str) -> Column:
    """``a`` where both are present."""
    return F.when(F.col(b).isNotNull(), F.col(a))


def zonal_covariance(a: str, b: str, form: str = "departures") -> Column:
    """Zonal covariance of two fields as one aggregate expression.

    Each variable's mean is over its own valid cells, the product over the jointly valid
    ones. ``departures`` is mean((a-[a])(b-[b])), ``product`` is [ab]-[a][b]; they differ
    only where the two masks differ. Both are built on the numerically stable covariance.
    """
    ja, jb = F.avg(joint(a, b)), F.avg(joint(b, a))
    cov = F.covar_pop(a, b)
    if form == "departures":
        return cov + (ja - F.avg(a)) * (jb - F.avg(b))
    return cov + ja * jb - F.avg(a) * F.avg(b)


def zonal_moments(df: DataFrame, keys: Sequence[str], means: Sequence[str],
                  covariances: dict[str, tuple[str, str]] | None = None,
                  form: str = "departures") -> DataFrame:
    """Zonal means and covariances of a slice set in one pass."""
    aggs = [F.avg(v).alias(v) for v in means]
    for name, (a, b) in (covariances or {}).items():
        aggs.append(zonal_covariance(a, b, form).alias(name))
    return df.groupBy(*keys).agg(*aggs)


def area_mean(df: DataFrame, spec: GridSpec, keys: Sequence[str], values: Sequence[str],
              where: Column | None = None) -> DataFrame:
    """cos(lat)-weighted mean over the globe or the cells passing ``where``."""
    if where is not None:
        df = df.where(where)
    w = spec.area_weight()
    df = df.withColumn("_w", w).where("_w > 0")
    aggs = [F.try_divide(F.sum(F.col(v) * F.col("_w")),
                         F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(v)
            for v in values]
    return df.groupBy(*keys).agg(*aggs)


def box_mean(df: DataFrame, spec: GridSpec, keys: Sequence[str], values: Sequence[str],
             box: tuple[float, float, float, float]) -> DataFrame:
    """Area mean inside (lat_min, lat_max, lon_min, lon_max)."""
    return area_mean(df, spec, keys, values, in_box(spec.lat(), spec.lon(), *box))


def value_range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min/max over present values, (0, 1) where there are none."""
    return (df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
            .select(*keys, F.coalesce("lo", F.lit(0.0)).alias("vmin"),
                    F.coalesce("hi", F.lit(1.0)).alias("vmax")))


def symmetric_range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """+-max|v|; 1 where the field is (almost) zero or absent."""
    a = F.coalesce(F.max(F.abs(F.col(value))), F.lit(0.0))
    return (df.groupBy(*keys).agg(a.alias("a"))
            .withColumn("a", F.when(F.col("a") < 1e-12, 1.0).otherwise(F.col("a")))
            .select(*keys, (-F.col("a")).alias("vmin"), F.col("a").alias("vmax")))


def pooled_range(monthly_ranges: DataFrame, keys: Sequence[str], symmetric: bool = False) -> DataFrame:
    """Union of the per-month ranges of a slice, so colours stay put while months change."""
    lo, hi = F.min("vmin"), F.max("vmax")
    if symmetric:
        a = F.greatest(F.max(F.abs(F.col("vmin"))), F.max(F.abs(F.col("vmax"))))
        lo, hi = -a, a
    return monthly_ranges.groupBy(*keys).agg(lo.alias("vmin"), hi.alias("vmax"))


def coverage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct years and (year, month) pairs and the year span of each group.

    The months are made distinct first, so the counts are over calendar entries and not
    over samples.
    """
    months = df.select(*keys, "year", "month").distinct()
    return months.groupBy(*keys).agg(
        F.countDistinct("year").alias("n_years"), F.count("*").alias("n_months"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"))
