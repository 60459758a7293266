"""Zonal-mean diagnostics on the (level, latitude) plane.

Each starts with one aggregation from cells to (slice, level, latitude). From there on the
data are slices x levels x latitudes rows; they are hash-partitioned by slice once, when the
panel is completed, and all derivatives and integrals run on that partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis import constants as K
from zonalis.functions.fields import coriolis, potential_temperature
from zonalis.grid import GridSpec
from zonalis.operators import ranks, reduce
from zonalis.operators.calculus import (accumulate_p, d_dlambda, d_dp, d_dy, lat_axis,
                                        level_axis, with_level_index)

SLICE = ("month",)


def zonal_table(grid: DataFrame, keys: Sequence[str], means: Sequence[str], spec: GridSpec,
                covariances: dict[str, tuple[str, str]] | None = None,
                form: str = "departures") -> DataFrame:
    """Zonal moments on the full (level, latitude) panel of each slice.

    Rows without data are present as NULL: a derivative exists wherever its two neighbours
    do, whether or not the point itself has a value.
    """
    z = reduce.zonal_moments(spec.on_axis(grid), [*keys, "level", "lat_idx"], means, covariances, form)
    return with_level_index(spec.fill(z, keys, ["level", "lat_idx"]), spec)


def _axes(spec: GridSpec, keys: Sequence[str]):
    return lat_axis(spec, [*keys, "level"]), level_axis(spec, [*keys, "lat_idx"])


def mass_streamfunction(grid: DataFrame, spec: GridSpec, keys: Sequence[str] = SLICE, v: str = "v") -> DataFrame:
    """1e9 kg/s, zero at the top, integrated downwards."""
    z = zonal_table(grid, keys, [v], spec)
    _, lev = _axes(spec, keys)
    scale = F.lit(2.0 * math.pi * K.EARTH_RADIUS / K.GRAVITY / 1e9) * spec.cos_lat()
    return z.select(*keys, "level", "lat_idx", (scale * accumulate_p(F.col(v), lev, spec)).alias("value"))


def absolute_momentum(u: Column, spec: GridSpec) -> Column:
    a_cos = F.lit(K.EARTH_RADIUS) * spec.cos_lat()
    return (F.lit(K.OMEGA) * a_cos + u) * a_cos


def angular_momentum(grid: DataFrame, spec: GridSpec, keys: Sequence[str] = SLICE, u: str = "u") -> DataFrame:
    """1e9 m2/s."""
    z = zonal_table(grid, keys, [u], spec)
    return z.select(*keys, "level", "lat_idx", (absolute_momentum(F.col(u), spec) / 1e9).alias("value"))


def geostrophic_wind(grid: DataFrame, spec: GridSpec, keys: Sequence[str] = SLICE, z: str = "z") -> DataFrame:
    """-(g/f) d[z]/dy from height in metres; NULL within 5 degrees of the equator."""
    zt = zonal_table(grid, keys, [z], spec)
    lat, _ = _axes(spec, keys)
    ug = F.lit(-K.GRAVITY) * d_dy(F.col(z), lat, spec) / F.nullif(coriolis(spec.lat()), F.lit(0.0))
    return zt.select(*keys, "level", "lat_idx", F.when(F.abs(spec.lat()) >= 5, ug).alias("value"))


def brunt_vaisala(grid: DataFrame, spec: GridSpec, keys: Sequence[str] = SLICE, t: str = "t") -> DataFrame:
    """N^2 in 1e-4 s-2 from the zonal-mean temperature."""
    z = zonal_table(grid, keys, [t], spec)
    z = z.withColumn("theta", potential_temperature(F.col(t), F.col("level")))
    _, lev = _axes(spec, keys)
    p = F.col("level") * F.lit(100.0)
    n2 = -(F.lit(K.GRAVITY ** 2) * p / (F.lit(K.R_DRY) * F.col(t) * F.col("theta"))) * d_dp(
        F.col("theta"), lev, spec)
    return z.select(*keys, "level", "lat_idx", (n2 / F.lit(1e-4)).alias("value"))


def friction_torque(surface: DataFrame, keys: Sequence[str] = SLICE, ews: str = "ews") -> DataFrame:
    """-[ews] in N/m2."""
    return (reduce.zonal_mean(surface, [*keys, "lat_idx"], [ews])
            .select(*keys, "lat_idx", (-F.col(ews)).alias("value")))


def mountain_torque(surface: DataFrame, spec: GridSpec, keys: Sequence[str] = SLICE,
                    sp_hpa: str = "sp", height: str = "oro") -> DataFrame:
    """Zonal mean of p_s dh/dlambda over the Earth radius, N/m2."""
    row = [*keys, "lat_idx"]
    flux = F.col(sp_hpa) * F.lit(100.0) * d_dlambda(F.col(height), row, spec)
    return (surface.select(*row, flux.alias("_f")).groupBy(*row)
            .agg((F.avg("_f") / F.lit(K.EARTH_RADIUS)).alias("value")))


def evaporation_precipitation(surface: DataFrame, keys: Sequence[str] = SLICE,
                              slhf: str = "slhf", tp: str = "tp") -> DataFrame:
    """Evaporation, precipitation and their difference per latitude, kg m-2 s-1."""
    z = reduce.zonal_mean(surface, [*keys, "lat_idx"], [slhf, tp])
    e, p = -F.col(slhf) / F.lit(K.LATENT_HEAT), F.col(tp) / F.lit(K.DAY_SECONDS)
    return z.select(*keys, "lat_idx", e.alias("evap"), p.alias("precip"), (e - p).alias("e_minus_p"))


def surface_heating(surface: DataFrame, keys: Sequence[str] = SLICE) -> DataFrame:
    """Turbulent, radiative and total heating of the column per latitude, W/m2 (fluxes are
    positive downwards in the input)."""
    names = ["slhf", "sshf", "ssr", "str", "tisr", "ttr"]
    z = reduce.zonal_mean(surface, [*keys, "lat_idx"], names)
    c = {n: F.col(n) for n in names}
    turb = -c["slhf"] - c["sshf"]
    rad = (c["tisr"] + c["ttr"]) - (c["ssr"] + c["str"])
    return z.select(*keys, "lat_idx", turb.alias("turb"), rad.alias("rad"), (turb + rad).alias("total"))


# How each diagnostic's display range (never its values) is found and limited.
# "percentile": +- the 95th percentile of |v|, "extreme": +- the largest |v|, both held between two
# limits; "range": least and greatest value, each with a limit of its own, and what stands for no values.
DISPLAY_LIMITS = {
    "geostrophic": ("percentile", 5.0, 100.0), "brunt_vaisala": ("range", -2.0, 12.0, 0.0, 4.0),
    "ep_flux": ("extreme", 1.0, 20.0), "pv": ("range", -10.0, 10.0, 0.0, 1.0),
    "m_budget_u": ("percentile", 0.3, 30.0), "m_budget_M": ("percentile", 2.0, 200.0),
    "q_budget": ("percentile", 0.1, 5.0), "h_budget_h": ("percentile", 0.5, 30.0), "h_budget_H": ("percentile", 5.0, 300.0),
}


def display_limits(df: DataFrame, keys: Sequence[str], value: str, which: str) -> DataFrame:
    """(keys, vmin, vmax) of a diagnostic's display."""
    rule, lo, hi, *none = DISPLAY_LIMITS[which]
    if rule == "range":
        r = df.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"))
        return r.select(*keys, F.greatest(F.coalesce("a", F.lit(none[0])), F.lit(lo)).alias("vmin"),
                        F.least(F.coalesce("b", F.lit(none[1])), F.lit(hi)).alias("vmax"))
    if rule == "extreme":
        r = df.groupBy(*keys).agg(F.max(F.abs(F.col(value))).alias("b"))
    else:
        r = ranks.value_at_rank(df, keys, F.abs(F.col(value)), {"b": ranks.floor_rank(0.95)})
    bound = F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce("b", F.lit(0.0))))
    return r.select(*keys, (-bound).alias("vmin"), bound.alias("vmax"))
