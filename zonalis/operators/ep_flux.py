"""Stationary-eddy Eliassen-Palm flux, its divergence and its arrows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis import constants as K
from zonalis.functions.fields import coriolis, potential_temperature
from zonalis.grid import GridSpec
from zonalis.operators.calculus import d_dp, d_dphi, lat_axis, level_axis
from zonalis.operators.diagnostics import SLICE, zonal_table

MIN_STABILITY = 1e-7


def ep_flux(grid: DataFrame, spec: GridSpec, keys: Sequence[str] = SLICE, literal_sign: bool = False) -> DataFrame:
    """(f_phi, f_p, div) per (slice, level, latitude); div in m/s/day.

    ``literal_sign`` keeps the opposite sign of the meridional derivative that the
    original display uses; the default is the northward derivative.
    """
    cells = grid.withColumn("theta", potential_temperature(F.col("t"), F.col("level")))
    z = zonal_table(cells, keys, ["theta"], spec, {"uv": ("u", "v"), "vth": ("v", "theta")}, form="product")
    lat, lev = lat_axis(spec, [*keys, "level"]), level_axis(spec, [*keys, "lat_idx"])
    z = z.withColumn("dth", d_dp(F.col("theta"), lev, spec))
    a_cos = F.lit(K.EARTH_RADIUS) * spec.cos_lat()
    off_pole = ~spec.is_pole()
    dth = F.when(F.abs(F.col("dth")) >= MIN_STABILITY, F.col("dth"))
    z = (z.withColumn("f_phi", F.when(off_pole, -a_cos * F.col("uv")))
         .withColumn("f_p", F.when(off_pole, a_cos * coriolis(spec.lat()) * F.col("vth") / dth)))
    flux_cos = F.col("f_phi") * spec.cos_lat()
    sign = F.lit(-1.0 if literal_sign else 1.0)
    dphi = sign * d_dphi(flux_cos, lat, spec)
    div = (dphi / a_cos + d_dp(F.col("f_p"), lev, spec)) / a_cos * F.lit(K.DAY_SECONDS)
    return z.select(*keys, "level", "lat_idx", "f_phi", "f_p",
                    F.when(spec.cos_lat() > K.POLE_COS, div).alias("div"))


def arrows(flux: DataFrame, spec: GridSpec, keys: Sequence[str] = SLICE, lat_stride: int = 12,
           max_lat: float = 80.0) -> DataFrame:
    """Subsampled arrows with the vertical leg scaled to the horizontal one.

    The two maxima come from the whole panel of a slice, before the subsampling.
    """
    w = W.partitionBy(*keys)

    def peak(c: str):
        m = F.max(F.abs(F.col(c))).over(w)
        return F.when(F.coalesce(m, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(m)

    gain = peak("f_phi") / peak("f_p")
    shown = ((F.col("lat_idx") >= lat_stride) & (F.col("lat_idx") % lat_stride == 0)
             & (F.abs(spec.lat()) <= max_lat) & F.col("dx").isNotNull() & F.col("dy").isNotNull())
    return (flux.select(*keys, "level", "lat_idx", F.col("f_phi").alias("dx"),
                        (F.col("f_p") * gain).alias("dy"))
            .where(shown))
