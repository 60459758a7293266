"""Energy cycle: four reservoirs and four conversions from the time-mean fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis import constants as K
from zonalis.functions.fields import potential_temperature
from zonalis.grid import GridSpec
from zonalis.operators import calculus, reduce
from zonalis.operators.diagnostics import SLICE
from zonalis.operators.ranks import locate

FIELDS = ("u", "v", "w", "t")
RESERVOIRS = ("pm", "pe", "km", "ke")
CONVERSIONS = ("c_pm_pe", "c_pe_ke", "c_ke_km", "c_pm_km")


def _layer_thickness(spec: GridSpec) -> Column:
    """Pa around each level, half a layer at both ends."""
    lev = spec.levels
    out = F.lit(None).cast("double")
    for k, p in enumerate(lev):
        top = p if k == 0 else (p + lev[k - 1]) / 2
        bottom = p if k == len(lev) - 1 else (p + lev[k + 1]) / 2
        out = F.when(F.col("level") == p, F.lit((bottom - top) * 100.0)).otherwise(out)
    return out


def sorted_reference(grid: DataFrame, spec: GridSpec, keys: Sequence[str] = SLICE) -> DataFrame:
    """Reference temperature by adiabatic sorting of mass: (slice, level, t_ref).

    The running mass over theta comes from sums in bins; only the cells of the bins that hold a target are
    told apart and ordered, those of equal theta as one.
    """
    cells = (spec.on_axis(grid).where(F.col("t").isNotNull() & ~spec.is_pole())
             .select(*keys, potential_temperature(F.col("t"), F.col("level"), K.KAPPA_ENERGY).alias("theta"),
                     (spec.area_weight() * _layer_thickness(spec)).alias("w"),
                     ((F.col("level").cast("long") * spec.nlat + F.col("lat_idx")) * spec.nlon + F.col("lon_idx")).alias("_place")))
    share = F.array(*[F.struct(F.lit(p).alias("level"), F.lit(p * 100.0 / spec.surface_pa).alias("f")) for p in spec.levels])

    def wanted(total: Column) -> Column:
        return F.transform(share, lambda x: F.struct(x["level"].alias("name"), (x["f"] * total).alias("pos")))

    found = locate(cells, keys, "theta", "w", wanted, descending=True, carry={"w_first": F.min_by("w", "_place")})
    frac = (F.col("pos") - F.col("before")) / F.col("w_first")
    theta_r = (F.when(F.col("prev").isNull() | (frac >= 1), F.col("theta"))
               .otherwise(F.col("prev") * (1 - frac) + F.col("theta") * frac))
    level = F.col("name").cast("double").cast("int")
    return (found.where(level.isNotNull())
            .select(*keys, level.alias("level"),
                    (theta_r * F.pow(level / F.lit(1000.0), F.lit(K.KAPPA_ENERGY))).alias("t_ref")))


def simple_reference(grid: DataFrame, spec: GridSpec, keys: Sequence[str] = SLICE) -> DataFrame:
    """Area mean of T per level."""
    return (reduce.area_mean(spec.on_axis(grid), spec, [*keys, "level"], ["t"])
            .withColumnRenamed("t", "t_ref"))


def _joint_moments(grid: DataFrame, spec: GridSpec, keys: Sequence[str]) -> DataFrame:
    """Zonal means over each field's own cells and eddy products over cells with all four."""
    whole = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("w").isNotNull() & F.col("t").isNotNull()
    df = spec.on_axis(grid).select(*keys, "level", "lat_idx", *FIELDS,
                                   *[F.when(whole, F.col(f)).alias(f"{f}j") for f in FIELDS])

    def product(a: str, b: str) -> Column:
        shift = (F.avg(f"{a}j") - F.avg(a)) * (F.avg(f"{b}j") - F.avg(b))
        return F.covar_pop(f"{a}j", f"{b}j") + shift

    return df.groupBy(*keys, "level", "lat_idx").agg(
        *[F.avg(f).alias(f) for f in FIELDS], F.count("tj").alias("n"),
        product("t", "t").alias("t2"), (product("u", "u") + product("v", "v")).alias("uv2"),
        product("v", "t").alias("vt"), product("w", "t").alias("wt"),
        product("u", "v").alias("uv"), product("u", "w").alias("uw"))


def level_integrands(grid: DataFrame, spec: GridSpec, reference: str = "lorenz",
                     keys: Sequence[str] = SLICE) -> DataFrame:
    """The eight vertical integrands per (slice, level)."""
    ref = (sorted_reference(grid, spec, keys) if reference == "lorenz"
           else simple_reference(grid, spec, keys))
    ref = calculus.with_level_index(ref, spec)
    lev_of_ref = calculus.level_axis(spec, keys)
    p = F.col("level") * F.lit(100.0)
    gamma = F.lit(K.KAPPA_ENERGY) * F.col("t_ref") / p - calculus.d_dp(F.col("t_ref"), lev_of_ref, spec)
    gp = gamma * p
    ref = ref.select(*keys, "level", "t_ref", F.when(gp.isNotNull(), F.greatest(gp, F.lit(1e-9))).alias("gp"))

    z = calculus.with_level_index(_joint_moments(grid, spec, keys), spec).repartition(*[F.col(k) for k in keys])
    lat, lev = calculus.lat_axis(spec, [*keys, "level"]), calculus.level_axis(spec, [*keys, "lat_idx"])
    c = spec.area_weight()
    z = z.withColumn("u_cos", F.when(c > K.POLE_COS, F.col("u") / c))
    z = (z.withColumn("t_y", calculus.d_dy(F.col("t"), lat, spec))
         .withColumn("uc_y", calculus.d_dy(F.col("u_cos"), lat, spec))
         .withColumn("t_p", calculus.d_dp(F.col("t"), lev, spec))
         .withColumn("u_p", calculus.d_dp(F.col("u"), lev, spec))
         .withColumn("c", c)
         .where((F.col("c") >= K.POLE_COS) & (F.col("n") > 0))
         .join(ref, [*keys, "level"]))
    that = F.coalesce(F.col("t"), F.lit(0.0)) - F.col("t_ref")
    w = F.col("c")

    def mean(x: Column) -> Column:                       # over contributing latitudes
        return F.sum(x * w) / F.sum(w)

    def spread(x: Column) -> Column:                     # over all latitudes
        return F.coalesce(F.sum(x * w), F.lit(0.0)) / F.lit(spec.cos_total)

    half_r, half = F.lit(K.R_DRY / (2 * K.GRAVITY)), F.lit(1.0 / (2 * K.GRAVITY))
    rg, g1 = F.lit(-K.R_DRY / K.GRAVITY), F.lit(1.0 / K.GRAVITY)
    gp, p = F.max("gp"), F.max("level") * F.lit(100.0)
    return z.groupBy(*keys, "level").agg(
        (half_r * mean(that * that) / gp).alias("pm"),
        (half_r * mean(F.col("t2")) / gp).alias("pe"),
        (half * mean(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).alias("km"),
        (half * mean(F.col("uv2"))).alias("ke"),
        (rg * spread(F.col("vt") * F.col("t_y")) / gp
         + rg * spread(F.col("wt") * F.col("t_p")) / gp).alias("c_pm_pe"),
        (rg * spread(F.col("wt")) / p).alias("c_pe_ke"),
        (g1 * spread(F.col("uv") * F.col("c") * F.col("uc_y"))
         + g1 * spread(F.col("uw") * F.col("u_p"))).alias("c_ke_km"),
        (rg * spread(F.col("w") * that) / p).alias("c_pm_km"))


def energy_cycle(grid: DataFrame, spec: GridSpec, reference: str = "lorenz",
                 keys: Sequence[str] = SLICE) -> DataFrame:
    """One row per slice: reservoirs (J/m2) and conversions (W/m2)."""
    per_level = level_integrands(grid, spec, reference, keys)
    return calculus.integrate_p(per_level, keys, [*RESERVOIRS, *CONVERSIONS], spec)
