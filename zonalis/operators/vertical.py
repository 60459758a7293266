"""Isentropic and log-pressure interpolation of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.fields import celsius, mixing_ratio_gkg, potential_temperature
from zonalis.grid import GridSpec
from zonalis.operators.calculus import level_axis, with_level_index


def theta_cube(df: DataFrame, t: str = "t", out: str = "theta") -> DataFrame:
    return df.withColumn(out, potential_temperature(F.col(t), F.col("level")))


def on_isentrope(df: DataFrame, column_keys: Sequence[str], values: Sequence[str], theta0: float,
                 spec: GridSpec, t: str = "t") -> DataFrame:
    """Values on the surface theta = theta0, linear in theta.

    The bracket is the topmost pair of adjacent levels with theta_up >= theta0 > theta_low.
    Columns without a bracket stay in the result with NULL. The window and the aggregation
    share one partitioning by column.
    """
    df = with_level_index(theta_cube(df, t), spec)
    axis = level_axis(spec, column_keys)
    th, below = F.col("theta"), axis.at(F.col("theta"), 1)
    pairs = df.select(*column_keys, "lev_idx", th.alias("_up"), below.alias("_low"),
                      *[F.col(v) for v in values],
                      *[axis.at(F.col(v), 1).alias(f"_{v}") for v in values])
    hit = (F.col("_up") >= theta0) & (F.lit(theta0) > F.col("_low"))
    frac = (F.col("_up") - theta0) / F.when(hit, F.col("_up") - F.col("_low"))
    cols = [F.when(hit, F.col(v) + frac * (F.col(f"_{v}") - F.col(v))).alias(v) for v in values]
    rank = F.when(hit, F.col("lev_idx"))
    return (pairs.select(*column_keys, rank.alias("_k"), F.struct(*cols).alias("_v"))
            .groupBy(*column_keys).agg(F.min_by("_v", "_k").alias("_v"))
            .select(*column_keys, *[F.col(f"_v.{v}").alias(v) for v in values]))


def at_pressure(df: DataFrame, column_keys: Sequence[str], values: Sequence[str], p_hpa: float,
                spec: GridSpec) -> DataFrame:
    """Values at a pressure, linear in ln p between the two bracketing levels.

    The level pair depends only on the axis, so both levels are pruned at the scan and
    combined with one conditional aggregation instead of a window.
    """
    levels = spec.levels
    if not levels[0] <= p_hpa <= levels[-1]:
        return df.groupBy(*column_keys).agg(*[F.lit(None).cast("double").alias(v) for v in values])
    k0 = max((k for k, p in enumerate(levels) if p < p_hpa), default=0)
    lo, hi = levels[k0], levels[min(k0 + 1, len(levels) - 1)]
    frac = _log_fraction(p_hpa, lo, hi)

    def at(v: str, level: int) -> Column:
        return F.max(F.when(F.col("level") == level, F.col(v)))

    return (df.where(F.col("level").isin(lo, hi)).groupBy(*column_keys)
            .agg(*[(at(v, lo) * (1.0 - frac) + at(v, hi) * frac).alias(v) for v in values]))


def _log_fraction(p: float, lo: float, hi: float) -> float:
    import math
    return 0.0 if lo == hi else math.log(p / lo) / math.log(hi / lo)


def levels_to_columns(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Pick (field, level) pairs side by side with one conditional aggregation, no self-join."""
    return (df.where(F.col("level").isin(*{lev for _, lev in wanted.values()}))
            .groupBy(*keys)
            .agg(*[F.max(F.when(F.col("level") == lev, F.col(v))).alias(name)
                   for name, (v, lev) in wanted.items()]))


def fields_to_columns(long: DataFrame, keys: Sequence[str], fields: Sequence[str],
                      name: str = "var", value: str = "value") -> DataFrame:
    """Long (var, value) rows to one column per field with one shuffle."""
    return (long.where(F.col(name).isin(*fields)).groupBy(*keys)
            .agg(*[F.max(F.when(F.col(name) == f, F.col(value))).alias(f) for f in fields]))


def columns_to_fields(wide: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keys), list(fields), "var", "value")


def column_profiles(upper: DataFrame, surface: DataFrame, keys: Sequence[str], spec: GridSpec) -> DataFrame:
    """One row per column: surface values and arrays ordered from the surface upwards.

    ``upper`` holds t (K) and q (kg/kg) on levels, ``surface`` sst (K) and msl (hPa). The
    join keeps the times and cells all four fields share.
    """
    down = sorted(spec.levels, reverse=True)
    upper = spec.on_axis(upper).select(*keys, "level", celsius(F.col("t")).alias("tc"), mixing_ratio_gkg(F.col("q")).alias("r"))

    def profile(c: str) -> Column:
        return F.array(*[F.max(F.when(F.col("level") == p, F.col(c))) for p in down])

    cols = upper.groupBy(*keys).agg(profile("tc").alias("t_profile"), profile("r").alias("r_profile"))
    sfc = surface.select(*keys, celsius(F.col("sst")).alias("sst_c"), F.col("msl").alias("msl_hpa"))
    return cols.join(sfc, list(keys))
