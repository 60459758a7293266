"""Zonal-mean budgets of angular momentum, moisture and moist static energy.

One implementation serves all three: they differ in the transported quantity, in one power
of cos(lat) of the eddy flux, and in display units.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis import constants as K
from zonalis.functions.fields import moist_static_energy
from zonalis.grid import GridSpec
from zonalis.operators import calculus, diagnostics
from zonalis.operators.diagnostics import SLICE

TERMS = ("mean_y", "mean_p", "eddy_y", "eddy_p")


@dataclass(frozen=True)
class Budget:
    kind: str                    # "momentum", "moisture", "energy"
    residual: str                # name of the implied source


MOMENTUM = Budget("momentum", "torque")
MOISTURE = Budget("moisture", "source")
ENERGY = Budget("energy", "source")


def _scalar(budget: Budget) -> Column:
    if budget is MOMENTUM:
        return F.col("u")
    if budget is MOISTURE:
        return F.col("q") * F.lit(1e-3)
    return moist_static_energy(F.col("t"), F.col("z"), F.col("q"))


def raw_terms(grid: DataFrame, spec: GridSpec, budget: Budget, keys: Sequence[str] = SLICE) -> DataFrame:
    """The four transport terms in SI units per unit mass, NULL at the poles."""
    cells = grid.withColumn("x", _scalar(budget))
    z = diagnostics.zonal_table(cells, keys, ["x", "v", "w"], spec, {"vx": ("v", "x"), "wx": ("w", "x")})
    lat, lev = calculus.lat_axis(spec, [*keys, "level"]), calculus.level_axis(spec, [*keys, "lat_idx"])
    c = spec.cos_lat()
    a = F.lit(K.EARTH_RADIUS)
    momentum = budget is MOMENTUM
    mean = diagnostics.absolute_momentum(F.col("x"), spec) if momentum else F.col("x")
    z = z.withColumn("m", mean)
    metric = c * c if momentum else c
    eddy_scale = a if momentum else F.lit(1.0)
    # v*x covariances commute, so [u*v*] is the covariance of v with u.
    terms = {
        "mean_y": -calculus.d_dy(F.col("v") * F.col("m") * c, lat, spec) / c,
        "mean_p": -calculus.d_dp(F.col("w") * F.col("m"), lev, spec),
        "eddy_y": -eddy_scale * calculus.d_dy(metric * F.col("vx"), lat, spec) / c,
        "eddy_p": -(eddy_scale * c if momentum else eddy_scale) * calculus.d_dp(F.col("wx"), lev, spec),
    }
    off_pole = ~spec.is_pole()
    return z.select(*keys, "level", "lat_idx", *[F.when(off_pole, t).alias(n) for n, t in terms.items()])


def budget_terms(grid: DataFrame, spec: GridSpec, budget: Budget, keys: Sequence[str] = SLICE) -> DataFrame:
    """Smoothed terms in long form: (slice, level, lat_idx, term, value).

    ``total`` counts missing terms as zero, so it is 0 at the poles and, like the
    residual (its negative), takes part in the smoothing there.
    """
    raw = raw_terms(grid, spec, budget, keys)
    total = sum((F.coalesce(F.col(t), F.lit(0.0)) for t in TERMS), F.lit(0.0))
    wide = raw.withColumn("total", total).withColumn(budget.residual, -F.col("total"))
    # One exchange by (slice, term) serves the latitude and the level windows that follow.
    long = (wide.unpivot([*keys, "level", "lat_idx"], [*TERMS, "total", budget.residual], "term", "value")
            .repartition(*[F.col(k) for k in keys], F.col("term")))
    long = calculus.smooth_lat(calculus.with_level_index(long, spec), "value", [*keys, "term", "level"], spec)
    return calculus.smooth_level(long, "value", [*keys, "term", "lat_idx"], spec).drop("lev_idx")


def _display(budget: Budget, form: str, spec: GridSpec) -> Column:
    v = F.col("value")
    if budget is MOMENTUM and form == "u":
        per_day = v / (F.lit(K.EARTH_RADIUS) * spec.cos_lat()) * F.lit(K.DAY_SECONDS)
        return F.when(spec.cos_lat() > K.POLE_COS, per_day)
    if budget is MOMENTUM:
        return v * F.lit(K.DAY_SECONDS / 1e6)
    if budget is MOISTURE:
        return v * F.lit(1000.0 * K.DAY_SECONDS)
    if form == "h":
        return v / F.lit(K.CP) * F.lit(K.DAY_SECONDS)
    return v * F.lit(K.DAY_SECONDS / 1e3)


def section(terms: DataFrame, spec: GridSpec, budget: Budget, form: str) -> DataFrame:
    """(level, latitude) view in display units per day."""
    return terms.withColumn("value", _display(budget, form, spec))


def column_mean(terms: DataFrame, spec: GridSpec, budget: Budget, form: str,
                keys: Sequence[str] = SLICE) -> DataFrame:
    """Mass-weighted column mean (1/p_s) int dp in display units."""
    prof = calculus.integrate_p(section(terms, spec, budget, form), [*keys, "term", "lat_idx"], ["value"], spec)
    return prof.withColumn("value", F.col("value") / F.lit(spec.surface_pa))


def column_integral(terms: DataFrame, spec: GridSpec, budget: Budget, form: str,
                    keys: Sequence[str] = SLICE) -> DataFrame:
    """Vertical integral over dp/g: N/m2, mm/day or W/m2."""
    v = F.col("value")
    c = spec.cos_lat()
    if budget is MOMENTUM:
        v = F.when(c >= K.POLE_COS, v / (F.lit(K.EARTH_RADIUS) * c) if form == "u" else v)
    prof = calculus.integrate_p(terms.withColumn("value", v), [*keys, "term", "lat_idx"], ["value"], spec)
    scale = K.DAY_SECONDS / K.GRAVITY if budget is MOISTURE else 1.0 / K.GRAVITY
    return prof.withColumn("value", F.col("value") * F.lit(scale))


def overlay(surface_flux: Column, spec: GridSpec, budget: Budget, form: str, integral: bool) -> Column:
    """A surface flux in the units of the profile it is drawn with."""
    if integral:
        return surface_flux * F.lit(K.DAY_SECONDS) if budget is MOISTURE else surface_flux
    per_mass = surface_flux * F.lit(K.GRAVITY / spec.surface_pa)
    if budget is MOMENTUM:
        if form == "u":
            return per_mass * F.lit(K.DAY_SECONDS)
        return per_mass * F.lit(K.EARTH_RADIUS) * spec.cos_lat() * F.lit(K.DAY_SECONDS / 1e6)
    if budget is MOISTURE:
        return per_mass * F.lit(1000.0 * K.DAY_SECONDS)
    if form == "h":
        return per_mass / F.lit(K.CP) * F.lit(K.DAY_SECONDS)
    return per_mass * F.lit(K.DAY_SECONDS / 1e3)
