"""Point-wise formulas, reductions and decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalis.functions import fields as fx
from zonalis.grid import nan_to_null, resample_index, stride
from zonalis.operators import decompose, ranks, reduce, vertical
from zonalis.plans.catalogue.base import (CELL, ROW, SPEC, SQL_CLIM, SQL_SAMPLES, SQL_SURFACE, clim, monthly,
                                          query, surface_clim, surface_monthly, with_)
from zonalis.sources import fields as store
from zonalis.sources import tables

KEYS = "month:i level:i lat_idx:i lon_idx:i "
YKEYS = "year:i " + KEYS


# reductions over time ---------------------------------------------------------------
@query("G1_G2_clim_mean_std", KEYS + "t:6 t_std:6 u:6 u_std:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS t, stddev_pop(t) AS t_std, avg(u) AS u,
  stddev_pop(u) AS u_std FROM mon GROUP BY ALL)""")
def clim_mean_std(spark, sf):
    return reduce.climatology(monthly(spark, sf, "t", "u"), ["t", "u"], spread=True)


@query("G1_per_year_monthly", YKEYS + "u:6 v:6 t:6", with_(SQL_SAMPLES) + ", result AS (SELECT * FROM mon)")
def per_year_monthly(spark, sf):
    return monthly(spark, sf, "u", "v", "t")


@query("G3_derived_std", KEYS + "wspd_std:6 mse_std:4", with_(SQL_SAMPLES) + """,
result AS (SELECT month, level, lat_idx, lon_idx, stddev_pop(sqrt(u*u + v*v)) AS wspd_std,
  stddev_pop((1004 * t + 9.80665::DOUBLE * z + 2.501e6 * (q / 1000)) / 1004) AS mse_std FROM mon GROUP BY ALL)""")
def derived_std(spark, sf):
    m = monthly(spark, sf, "u", "v", "t", "z", "q")
    m = m.select("month", *CELL, fx.wind_speed(F.col("u"), F.col("v")).alias("wspd"),
                 fx.mse_kelvin(F.col("t"), F.col("z"), F.col("q")).alias("mse"))
    return reduce.climatology(m, ["wspd", "mse"], spread=True)


@query("G3_shear_std", "month:i lat_idx:i lon_idx:i dls_std:6", with_(SQL_SAMPLES) + """,
piv AS (SELECT year, month, lat_idx, lon_idx, max(u) FILTER (level = 200) AS ut, max(v) FILTER (level = 200) AS vt,
  max(u) FILTER (level = 850) AS ub, max(v) FILTER (level = 850) AS vb FROM mon WHERE level IN (200, 850) GROUP BY ALL),
result AS (SELECT month, lat_idx, lon_idx, stddev_pop(sqrt(pow(ut - ub, 2) + pow(vt - vb, 2))) AS dls_std
  FROM piv GROUP BY ALL)""")
def shear_std(spark, sf):
    p = vertical.levels_to_columns(monthly(spark, sf, "u", "v"), ["year", "month", "lat_idx", "lon_idx"],
                                   {"ut": ("u", 200), "vt": ("v", 200), "ub": ("u", 850), "vb": ("v", 850)})
    p = p.withColumn("dls", fx.shear(*[F.col(c) for c in ("ut", "vt", "ub", "vb")]))
    return reduce.climatology(p, ["dls"], ["lat_idx", "lon_idx"], spread=True)


@query("G6_annual_mean", "level:i lat_idx:i lon_idx:i t:6", with_(SQL_CLIM) + """,
result AS (SELECT level, lat_idx, lon_idx, avg(t) AS t FROM clim GROUP BY ALL)""")
def annual_mean(spark, sf):
    return reduce.annual_mean(clim(spark, sf, "t"), ["t"])


@query("G7_seasonal_mean", KEYS + "t:6", with_(SQL_CLIM) + """,
tgt AS (SELECT (s - 1) % 12 + 1 AS src, m AS month FROM range(1, 13) AS a(m), LATERAL (SELECT unnest([m + 11, m + 12, m + 13]) AS s)),
have AS (SELECT g.month, c.level FROM tgt g JOIN (SELECT DISTINCT month, level FROM clim) c ON c.month = g.src
  GROUP BY ALL HAVING count(*) = 3),
result AS (SELECT g.month, c.level, c.lat_idx, c.lon_idx, avg(c.t) AS t FROM clim c JOIN tgt g ON c.month = g.src
  SEMI JOIN have h ON h.month = g.month AND h.level = c.level GROUP BY ALL)""")
def seasonal_mean(spark, sf):
    return reduce.seasonal_mean(clim(spark, sf, "t"), ["t"])


@query("G8_V12_zonal_mean", "month:i level:i lat_idx:i u:6 v:6 t:6", with_(SQL_CLIM) + """,
result AS (SELECT month, level, lat_idx, avg(u) AS u, avg(v) AS v, avg(t) AS t FROM clim GROUP BY ALL)""")
def zonal_mean(spark, sf):
    return reduce.zonal_mean(clim(spark, sf, "u", "v", "t"), ["month", *ROW], ["u", "v", "t"])


@query("G9_zonal_covariance", "month:i level:i lat_idx:i uv:6 vt:6", with_(SQL_CLIM) + """,
dev AS (SELECT month, level, lat_idx, u - avg(u) OVER r AS du, v - avg(v) OVER r AS dv, t - avg(t) OVER r AS dt
  FROM clim WINDOW r AS (PARTITION BY month, level, lat_idx)),
result AS (SELECT month, level, lat_idx, avg(du * dv) AS uv, avg(dv * dt) AS vt FROM dev GROUP BY ALL)""")
def zonal_covariance(spark, sf):
    return reduce.zonal_moments(clim(spark, sf, "u", "v", "t"), ["month", *ROW], [],
                                {"uv": ("u", "v"), "vt": ("v", "t")})


GAPPY = """,
gap AS (SELECT month, level, lat_idx, lon_idx, CASE WHEN (lon_idx + month) % 5 <> 0 THEN u END AS a,
  CASE WHEN (lon_idx + level) % 4 <> 0 THEN t END AS b FROM clim)"""


def _gappy(spark, sf):
    return clim(spark, sf, "u", "t").select(
        "month", *CELL, F.when((F.col("lon_idx") + F.col("month")) % 5 != 0, F.col("u")).alias("a"),
        F.when((F.col("lon_idx") + F.col("level")) % 4 != 0, F.col("t")).alias("b"))


@query("G9_covariance_forms_with_gaps", "month:i level:i lat_idx:i departures:6 product:5",
       with_(SQL_CLIM) + GAPPY + """,
m AS (SELECT *, avg(a) OVER r AS ma, avg(b) OVER r AS mb FROM gap WINDOW r AS (PARTITION BY month, level, lat_idx)),
result AS (SELECT month, level, lat_idx, avg((a - ma) * (b - mb)) AS departures,
  avg(a * b) - max(ma) * max(mb) AS product FROM m GROUP BY ALL)""")
def covariance_forms(spark, sf):
    df, keys = _gappy(spark, sf), ["month", *ROW]
    one = reduce.zonal_moments(df, keys, [], {"departures": ("a", "b")})
    two = reduce.zonal_moments(df, keys, [], {"product": ("a", "b")}, form="product")
    return one.join(two, keys)


@query("G10_area_mean", "month:i level:i t:6", with_(SQL_CLIM) + """,
result AS (SELECT month, level, sum(t * greatest(0.0, cos(radians(90.0 - 15.0 * lat_idx))))
  / sum(greatest(0.0, cos(radians(90.0 - 15.0 * lat_idx)))) AS t FROM clim GROUP BY ALL)""")
def area_mean(spark, sf):
    return reduce.area_mean(clim(spark, sf, "t"), SPEC, ["month", "level"], ["t"])


@query("G12_tile_range", "month:i level:i vmin:6 vmax:6", with_(SQL_CLIM) + """,
result AS (SELECT month, level, min(u) AS vmin, max(u) AS vmax FROM clim GROUP BY ALL)""")
def tile_range(spark, sf):
    return reduce.value_range(clim(spark, sf, "u"), ["month", "level"], "u")


def _floor_index(value: str, p: float, n: str = "(count({v}) - 1)") -> str:
    at = n.format(v=value)
    return f"list_sort(list({value}))[CAST(floor({p}::DOUBLE * {at}) AS BIGINT) + 1]"


@query("G13_B12_percentile_bounds", "month:i level:i vmin:6 vmax:6", with_(SQL_CLIM) + f""",
result AS (SELECT month, level, {_floor_index('t', 0.005)} AS vmin, {_floor_index('t', 0.995)} AS vmax
  FROM clim GROUP BY ALL)""")
def percentile_bounds(spark, sf):
    return ranks.percentile_bounds(clim(spark, sf, "t"), ["month", "level"], "t", 0.005, 0.995)


@query("G13_sample_percentiles", "level:i vmin:6 vmax:6", with_(SQL_SAMPLES) + f""",
result AS (SELECT level, {_floor_index('u', 0.03)} AS vmin, {_floor_index('u', 0.97)} AS vmax FROM raw GROUP BY ALL)""")
def sample_percentiles(spark, sf):
    """Over every sample of the table: the hot, many-duplicates case."""
    return ranks.percentile_bounds(tables.upper_samples(spark, sf), ["level"], "u", 0.03, 0.97)


@query("G14_symmetric_ranges", "month:i level:i plain:6 clamped:6", with_(SQL_CLIM) + f""",
e AS (SELECT month, level, abs(u - avg(u) OVER (PARTITION BY month, level, lat_idx)) AS a FROM clim),
result AS (SELECT month, level, max(a) AS plain, {_floor_index('a', 0.97)} AS clamped FROM e GROUP BY ALL)""")
def symmetric_ranges(spark, sf):
    e = decompose.eddy(clim(spark, sf, "u"), ["month", *ROW], "u")
    plain = reduce.symmetric_range(e, ["month", "level"], "u").select("month", "level", F.col("vmax").alias("plain"))
    cl = ranks.clamped_symmetric_range(e, ["month", "level"], "u", 0.97)
    return plain.join(cl.select("month", "level", F.col("vmax").alias("clamped")), ["month", "level"])


@query("G15_sigma_floor", "month:i level:i sigma_floor:6", with_(SQL_SAMPLES) + """,
s AS (SELECT month, level, lat_idx, lon_idx, stddev_pop(t) AS sd FROM mon GROUP BY ALL),
f AS (SELECT month, level, list_sort(list(sd))[CAST(floor(0.02::DOUBLE * count(*)) AS BIGINT) + 1] AS f
  FROM s WHERE sd > 0 GROUP BY ALL),
result AS (SELECT g.month, g.level, coalesce(f.f, 0) AS sigma_floor
  FROM (SELECT DISTINCT month, level FROM s) g LEFT JOIN f USING (month, level))""")
def sigma_floor(spark, sf):
    c = reduce.climatology(monthly(spark, sf, "t"), ["t"], spread=True)
    return ranks.sigma_floor(c, ["month", "level"], "t_std")


@query("G16_D13_range_pool", "level:i vmin:6 vmax:6 sym:6", with_(SQL_CLIM) + """,
m AS (SELECT month, level, min(u) AS lo, max(u) AS hi FROM clim GROUP BY ALL),
result AS (SELECT level, min(lo) AS vmin, max(hi) AS vmax, greatest(max(abs(lo)), max(abs(hi))) AS sym FROM m GROUP BY ALL)""")
def range_pool(spark, sf):
    r = reduce.value_range(clim(spark, sf, "u"), ["month", "level"], "u")
    s = reduce.pooled_range(r, ["level"], symmetric=True).select("level", F.col("vmax").alias("sym"))
    return reduce.pooled_range(r, ["level"]).join(s, "level")


@query("G17_coverage", "level:i n_years:l n_months:l first_year:i last_year:i", with_(SQL_SAMPLES) + """,
d AS (SELECT DISTINCT level, year, month FROM samples),
result AS (SELECT level, count(DISTINCT year) AS n_years, count(*) AS n_months, min(year) AS first_year,
  max(year) AS last_year FROM d GROUP BY ALL)""")
def coverage(spark, sf):
    return reduce.coverage(tables.upper_samples(spark, sf), ["level"])


# decompositions -----------------------------------------------------------------------
@query("W1_eddy", KEYS + "u:6", with_(SQL_CLIM) + """,
result AS (SELECT month, level, lat_idx, lon_idx, u - avg(u) OVER (PARTITION BY month, level, lat_idx) AS u FROM clim)""")
def eddy(spark, sf):
    return decompose.eddy(clim(spark, sf, "u"), ["month", *ROW], "u")


@query("W2_zonal_broadcast", KEYS + "u:6", with_(SQL_CLIM) + """,
z AS (SELECT month, level, lat_idx, avg(u) AS u FROM clim GROUP BY ALL),
result AS (SELECT month, level, lat_idx, j AS lon_idx, u FROM z, range(12) AS r(j))""")
def zonal_broadcast(spark, sf):
    """Every cell of the row gets the mean, also those without data."""
    dense = SPEC.fill(clim(spark, sf, "u"), ["month", *ROW], ["lon_idx"])
    return decompose.zonal(dense, ["month", *ROW], "u")


@query("W3_self_anomaly", KEYS + "t:6", with_(SQL_CLIM) + """,
result AS (SELECT month, level, lat_idx, lon_idx, t - avg(t) OVER (PARTITION BY level, lat_idx, lon_idx) AS t FROM clim)""")
def self_anomaly(spark, sf):
    return decompose.self_anomaly(clim(spark, sf, "t"), CELL, "t")


@query("J6_D3_same_month_anomaly", YKEYS + "t:6", with_(SQL_CLIM) + """,
result AS (SELECT m.year, month, level, lat_idx, lon_idx, m.t - c.t AS t FROM mon m
  LEFT JOIN clim c USING (month, level, lat_idx, lon_idx))""")
def same_month_anomaly(spark, sf):
    m = monthly(spark, sf, "t")
    return decompose.anomaly(m, reduce.climatology(m, ["t"]), ["month", *CELL], "t")


@query("D4_zscore_floor", YKEYS + "t:5", with_(SQL_SAMPLES) + """,
c AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS m, stddev_pop(t) AS sd FROM mon GROUP BY ALL),
f AS (SELECT month, level, list_sort(list(sd))[CAST(floor(0.02::DOUBLE * count(*)) AS BIGINT) + 1] AS fl
  FROM c WHERE sd > 0 GROUP BY ALL),
result AS (SELECT year, month, level, lat_idx, lon_idx,
  CASE WHEN sd > 0 THEN (t - m) / greatest(sd, coalesce(fl, 0)) END AS t
  FROM mon LEFT JOIN c USING (month, level, lat_idx, lon_idx) LEFT JOIN f USING (month, level))""")
def zscore_floor(spark, sf):
    m = monthly(spark, sf, "t")
    ref = reduce.climatology(m, ["t"], spread=True)
    return decompose.zscore(m, ref, ["month", *CELL], ["month", "level"], "t", "t_std")


@query("D13_stable_eddy_range", "level:i vmin:6 vmax:6", with_(SQL_CLIM) + f""",
e AS (SELECT month, level, abs(u - avg(u) OVER (PARTITION BY month, level, lat_idx)) AS a FROM clim),
m AS (SELECT month, level, {_floor_index('a', 0.97)} AS hi FROM e GROUP BY ALL),
result AS (SELECT level, -max(hi) AS vmin, max(hi) AS vmax FROM m GROUP BY ALL)""")
def stable_eddy_range(spark, sf):
    e = decompose.eddy(clim(spark, sf, "u"), ["month", *ROW], "u")
    return decompose.stable_range(e, "eddy", ["level"], "u", True, 0.97)


# point-wise formulas --------------------------------------------------------------------
@query("P1_display_units", "var:s year:i month:i level:i lat_idx:i lon_idx:i value:5", with_(SQL_SAMPLES) + """,
result AS (SELECT var, year, month, level, lat_idx, lon_idx, value FROM
  (UNPIVOT (SELECT year, month, level, lat_idx, lon_idx, z, q, pv, d, vo, t FROM mon)
   ON z, q, pv, d, vo, t INTO NAME var VALUE value))""")
def display_units(spark, sf):
    names = ["z", "q", "pv", "d", "vo", "t"]
    raw = tables.upper_monthly(spark, sf, names)
    return store.to_display_units(vertical.columns_to_fields(raw, ["year", "month", *CELL], names))


@query("P1_surface_units", "month:i lat_idx:i lon_idx:i msl:6 sp:6 oro:5 tp:6 ews:6 slhf:5 sshf:5 ssr:5 str:5 tisr:5 ttr:5",
       with_(SQL_SURFACE) + ", result AS (SELECT * FROM sclim)")
def surface_units(spark, sf):
    return surface_clim(spark, sf, "msl", "sp", "oro", "tp", "ews", "slhf", "sshf", "ssr", "str", "tisr", "ttr")


@query("P2_stride", KEYS + "t:6", with_(SQL_CLIM) + """,
result AS (SELECT * FROM clim WHERE lat_idx % 2 = 0 AND lon_idx % 2 = 0)""")
def strided(spark, sf):
    return stride(clim(spark, sf, "t"), 2)


@query("P2_renumbered_subgrid", KEYS + "t:6", with_(SQL_CLIM) + """,
result AS (SELECT month, level, lat_idx // 3 AS lat_idx, lon_idx // 3 AS lon_idx, t FROM clim
  WHERE lat_idx % 3 = 0 AND lon_idx % 3 = 0)""")
def subgrid(spark, sf):
    return resample_index(clim(spark, sf, "t"), 3)


@query("P3_S5_period_climatology", KEYS + "t:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS t FROM mon WHERE year BETWEEN 1996 AND 1998 GROUP BY ALL)""")
def period_climatology(spark, sf):
    return reduce.climatology(store.in_years(monthly(spark, sf, "t"), 1996, 1998), ["t"])


@query("P5_J1_wind_speed", YKEYS + "wspd:6", with_(SQL_SAMPLES) + """,
result AS (SELECT year, month, level, lat_idx, lon_idx, sqrt(u*u + v*v) AS wspd FROM mon)""")
def wind_speed(spark, sf):
    return monthly(spark, sf, "u", "v").withColumn("wspd", fx.wind_speed(F.col("u"), F.col("v")))


@query("P6_J2_shear", "month:i lat_idx:i lon_idx:i dls:6", with_(SQL_CLIM) + """,
result AS (SELECT t.month, t.lat_idx, t.lon_idx, sqrt(pow(t.u - b.u, 2) + pow(t.v - b.v, 2)) AS dls
  FROM clim t JOIN clim b USING (month, lat_idx, lon_idx) WHERE t.level = 200 AND b.level = 850)""")
def shear(spark, sf):
    p = vertical.levels_to_columns(clim(spark, sf, "u", "v"), ["month", "lat_idx", "lon_idx"],
                                   {"ut": ("u", 200), "vt": ("v", 200), "ub": ("u", 850), "vb": ("v", 850)})
    return (p.withColumn("dls", fx.shear(*[F.col(c) for c in ("ut", "vt", "ub", "vb")]))
            .where(F.col("dls").isNotNull()))


@query("P7_mse", KEYS + "mse:4", with_(SQL_CLIM) + """,
result AS (SELECT month, level, lat_idx, lon_idx,
  (1004 * t + 9.80665::DOUBLE * z + 2.501e6 * (q / 1000)) / 1004 AS mse FROM clim)""")
def mse(spark, sf):
    return clim(spark, sf, "t", "z", "q").withColumn("mse", fx.mse_kelvin(F.col("t"), F.col("z"), F.col("q")))


@query("P7_mse_from_source_units", YKEYS + "mse:4", with_(SQL_SAMPLES) + """,
result AS (SELECT year, month, level, lat_idx, lon_idx, (1004 * t + z + 2.501e6 * q) / 1004 AS mse FROM src)""")
def mse_raw(spark, sf):
    raw = tables.upper_monthly(spark, sf, ("t", "z", "q"))
    return raw.withColumn("mse", fx.mse_kelvin_raw(F.col("t"), F.col("z"), F.col("q")))


@query("P8_theta_cube", KEYS + "theta:6", with_(SQL_CLIM) + """,
result AS (SELECT month, level, lat_idx, lon_idx, t * pow(1000.0 / level, 0.2854) AS theta FROM clim)""")
def theta_cube(spark, sf):
    return vertical.theta_cube(clim(spark, sf, "t"))


@query("P9_mixing_ratio", YKEYS + "r:8 tc:6", with_(SQL_SAMPLES) + """,
result AS (SELECT year, month, level, lat_idx, lon_idx, q / greatest(1 - q, 1e-12) * 1000 AS r,
  t - 273.15::DOUBLE AS tc FROM src)""")
def mixing_ratio(spark, sf):
    raw = tables.upper_monthly(spark, sf, ("t", "q"))
    return raw.select("year", "month", *CELL, fx.mixing_ratio_gkg(F.col("q")).alias("r"), fx.celsius(F.col("t")).alias("tc"))


@query("P10_coriolis_weights", "lat_idx:i f_cor:12 cosphi:8 weight:8 n:l", with_(SQL_SAMPLES) + """,
result AS (SELECT lat_idx, 2 * 7.2921e-5 * sin(radians(90.0 - 15.0 * lat_idx)) AS f_cor,
  cos(radians(90.0 - 15.0 * lat_idx)) AS cosphi, greatest(0.0, cos(radians(90.0 - 15.0 * lat_idx))) AS weight,
  count(*) AS n FROM samples GROUP BY ALL)""")
def coriolis_weights(spark, sf):
    rows = tables.upper_samples(spark, sf).groupBy("lat_idx").agg(F.count("*").alias("n"))
    return rows.select("lat_idx", "n", fx.coriolis(SPEC.lat()).alias("f_cor"), SPEC.cos_lat().alias("cosphi"),
                       SPEC.area_weight().alias("weight"))


@query("P11_nan_skipping", "month:i level:i n:l valid:l mean_v:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, level, count(*) AS n, count(*) FILTER (disc <> 0) AS valid,
  avg(v) FILTER (disc <> 0) AS mean_v FROM (SELECT r.month, r.level, r.v, (r.v / 61.80339887::DOUBLE + 0.05::DOUBLE > 0.001)::INT AS disc FROM raw r) GROUP BY ALL)""")
def nan_skipping(spark, sf):
    """Samples without discount are NaN in the file; they must not poison the means."""
    s = tables.upper_samples(spark, sf).select("month", "level", F.when(
        F.col("v") / 61.80339887 + 0.05 > 0.001, F.col("v")).otherwise(F.lit(float("nan"))).alias("v"))
    return nan_to_null(s).groupBy("month", "level").agg(
        F.count("*").alias("n"), F.count("v").alias("valid"), F.avg("v").alias("mean_v"))


@query("P12_flag_mask", "month:i lat_idx:i lon_idx:i sst:6", with_(SQL_SURFACE) + """,
result AS (SELECT month, lat_idx, lon_idx, CASE WHEN sst > 285 THEN sst END AS sst FROM sclim)""")
def flag_mask(spark, sf):
    c = surface_clim(spark, sf, "sst").withColumn("flag", F.when(F.col("sst") > 285, 1).otherwise(0))
    return c.withColumn("sst", F.when(F.col("flag") == 1, F.col("sst")))


@query("P13_P24_capped_ranges", "level:i bound:6 capped:6", with_(SQL_CLIM) + """,
result AS (SELECT level, greatest(abs(min(u)), abs(max(u))) AS bound,
  greatest(5.0::DOUBLE, least(20.0::DOUBLE, greatest(abs(min(u)), abs(max(u))))) AS capped FROM clim GROUP BY ALL)""")
def capped_ranges(spark, sf):
    r = reduce.value_range(clim(spark, sf, "u"), ["level"], "u")
    b = fx.symmetric_bound(F.col("vmin"), F.col("vmax"))
    return r.select("level", b.alias("bound"), fx.clip(b, 5.0, 20.0).alias("capped"))


@query("P14_P15_grid_position", "pid:l wrapped:6 grid_row:6 grid_col:6", """WITH
p AS (SELECT c_custkey AS pid, (c_custkey * 29) % 173 - 86.0 + c_acctbal * 1.118033989e-4 AS lat,
  (c_custkey * 61) % 360 - 180.0 + c_acctbal * 2.236067977e-5 AS lon FROM customer),
result AS (SELECT pid, (((lon + 270) % 360) + 360) % 360 - 180 AS wrapped, (90 - lat) / 15 AS grid_row,
  ((((lon + 90) + 180) % 360) + 360) % 360 / 30 AS grid_col FROM p)""")
def grid_position(spark, sf):
    p = tables.probe_points(spark, sf)
    east = F.col("lon") + 90
    return p.select("pid", fx.wrap_lon(east).alias("wrapped"), SPEC.row_of(F.col("lat")).alias("grid_row"),
                    SPEC.column_of(east).alias("grid_col"))


BOX = "(90.0 - 15.0 * lat_idx) BETWEEN -40 AND 40 AND ((-180 + 30 * lon_idx) >= 150 OR (-180 + 30 * lon_idx) <= -100)"


@query("P16_box_across_date_line", YKEYS + "t:6", with_(SQL_SAMPLES) + f", result AS (SELECT * FROM mon WHERE {BOX})")
def box_across_date_line(spark, sf):
    return monthly(spark, sf, "t").where(fx.in_box(SPEC.lat(), SPEC.lon(), -40, 40, 150, -100))


@query("P17_tropics_mask", "month:i level:i lat_idx:i u:6", with_(SQL_CLIM) + """,
z AS (SELECT month, level, lat_idx, avg(u) AS u FROM clim GROUP BY ALL),
result AS (SELECT month, level, lat_idx, CASE WHEN abs(90.0 - 15.0 * lat_idx) >= 5
  AND cos(radians(90.0 - 15.0 * lat_idx)) >= 1e-3 THEN u END AS u FROM z)""")
def tropics_mask(spark, sf):
    z = reduce.zonal_mean(clim(spark, sf, "u"), ["month", *ROW], ["u"])
    return z.withColumn("u", F.when((F.abs(SPEC.lat()) >= 5) & ~SPEC.is_pole(), F.col("u")))


@query("P18_daylight_weighted_flux", "month:i lat_idx:i declination:8 day:8 darkening:8 tisr_day:6", with_(SQL_SURFACE) + """,
a AS (SELECT month, lat_idx, avg(tisr) AS tisr, sin(radians(90.0 - 15.0 * lat_idx)) AS sl,
  -sin(radians(23.4::DOUBLE)) * cos(month * pi() / 6) AS sd FROM sclim GROUP BY month, lat_idx),
b AS (SELECT *, acos(greatest(-1.0, least(1.0, -(sl / greatest(sqrt(greatest(0.0, 1 - sl * sl)), 1e-4))
  * (sd / greatest(sqrt(greatest(0.0, 1 - sd * sd)), 1e-4))))) / pi() AS day FROM a),
result AS (SELECT month, lat_idx, asin(sd) AS declination, day, greatest(0.0, 1 - 2 * day) AS darkening,
  tisr * day AS tisr_day FROM b)""")
def daylight(spark, sf):
    z = reduce.zonal_mean(surface_clim(spark, sf, "tisr"), ["month", "lat_idx"], ["tisr"])
    day = fx.daylight_fraction(SPEC.lat(), F.col("month"))
    return z.select("month", "lat_idx", fx.solar_declination(F.col("month")).alias("declination"), day.alias("day"),
                    fx.winter_darkening(SPEC.lat(), F.col("month")).alias("darkening"),
                    (F.col("tisr") * day).alias("tisr_day"))


@query("P19_barbs", KEYS + "pennants:i full:i half:i", with_(SQL_CLIM) + """,
k AS (SELECT month, level, lat_idx, lon_idx, sqrt(u*u + v*v) AS s, sqrt(u*u + v*v) * 1.94384::DOUBLE AS kt FROM clim),
f AS (SELECT *, floor(kt / 50) AS p FROM k),
g AS (SELECT *, floor((kt - p * 50) / 10) AS q FROM f),
result AS (SELECT month, level, lat_idx, lon_idx, CASE WHEN s >= 1.5 THEN p END AS pennants,
  CASE WHEN s >= 1.5 THEN q END AS "full", CASE WHEN s >= 1.5 THEN (kt - p * 50 - q * 10 >= 4.5)::INT END AS half FROM g)""")
def barbs(spark, sf):
    c = clim(spark, sf, "u", "v").withColumn("b", fx.wind_barb(fx.wind_speed(F.col("u"), F.col("v"))))
    return c.select("month", *CELL, "b.*")


STOPS = ((0.0, 0.0, 0.3), (0.1, 0.4, 0.8), (0.9, 0.9, 0.9), (0.8, 0.3, 0.2), (0.4, 0.0, 0.1))


@query("P21_colours", "month:i lat_idx:i lon_idx:i r:4 g:4 b:4", with_(SQL_SURFACE) + """,
c AS (SELECT month, lat_idx, lon_idx, greatest(0.0, least(1.0, (sst - 270) / 35)) * 4 AS x FROM sclim),
d AS (SELECT *, CAST(floor(x) AS INT) AS i FROM c),
e AS (SELECT *, x - i AS f, least(4, i + 1) AS j, [0.0, 0.1, 0.9, 0.8, 0.4]::DOUBLE[] AS rr, [0.0, 0.4, 0.9, 0.3, 0.0]::DOUBLE[] AS gg,
  [0.3, 0.8, 0.9, 0.2, 0.1]::DOUBLE[] AS bb FROM d),
result AS (SELECT month, lat_idx, lon_idx, (rr[i+1] + f * (rr[j+1] - rr[i+1])) * 255 AS r,
  (gg[i+1] + f * (gg[j+1] - gg[i+1])) * 255 AS g, (bb[i+1] + f * (bb[j+1] - bb[i+1])) * 255 AS b FROM e)""")
def colours(spark, sf):
    c = surface_clim(spark, sf, "sst")
    return c.select("month", "lat_idx", "lon_idx", fx.colour_at((F.col("sst") - 270) / 35, STOPS).alias("c")).select(
        "month", "lat_idx", "lon_idx", "c.*")


@query("P22_labels", "lat_idx:i lon_idx:i month:i where_label:s season:s event:s n:l", with_(SQL_SAMPLES) + """,
g AS (SELECT lat_idx, lon_idx, month, 90 - 15 * lat_idx AS lat, -180 + 30 * lon_idx AS lon, count(*) AS n FROM samples GROUP BY ALL),
result AS (SELECT lat_idx, lon_idx, month, n,
  CASE WHEN lat = 0 THEN 'Eq' WHEN lat > 0 THEN abs(lat) || '°N' ELSE abs(lat) || '°S' END || ', ' ||
  CASE WHEN lon = 0 THEN '0°' WHEN abs(lon) = 180 THEN '180°' WHEN lon > 0 THEN abs(lon) || '°E' ELSE abs(lon) || '°W' END AS where_label,
  ['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'][month] AS season,
  'ONI ≥ +1.0 · ' || ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month] AS event FROM g)""")
def labels(spark, sf):
    g = tables.upper_samples(spark, sf).groupBy("lat_idx", "lon_idx", "month").agg(F.count("*").alias("n"))
    return g.select("lat_idx", "lon_idx", "month", "n",
                    F.concat_ws(", ", fx.lat_label(SPEC.lat()), fx.lon_label(SPEC.lon())).alias("where_label"),
                    fx.season_label(F.col("month")).alias("season"),
                    fx.composite_label(F.lit("oni"), F.col("month"), "ge", 1.0).alias("event"))


@query("P22_value_and_box_labels", "price:4 value:s box:s n:l", """WITH
v AS (SELECT l_extendedprice * 0.7310585786::DOUBLE * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) / pow(10.0, l_linenumber) AS price, l_quantity AS q FROM lineitem),
s AS (SELECT price, abs(price) AS a, (q - 25)::DOUBLE AS la, (26 - 2 * q)::DOUBLE AS lb, (q * 7 - 180)::DOUBLE AS lo, (q * 13)::DOUBLE AS hi FROM v),
w AS (SELECT *, least(la, lb)::INT AS s1, greatest(la, lb)::INT AS n1, lo::INT AS w1, ((((hi + 180) % 360) + 360) % 360 - 180)::INT AS e1 FROM s),
result AS (SELECT price, CASE WHEN a >= 1000 THEN printf('%.0f', price) WHEN a >= 100 THEN printf('%.1f', price) WHEN a >= 10 THEN printf('%.2f', price) ELSE printf('%.3f', price) END AS value,
  CASE WHEN s1 = 0 THEN 'Eq' ELSE abs(s1) || '°' || CASE WHEN s1 < 0 THEN 'S' ELSE 'N' END END || '–' || CASE WHEN n1 = 0 THEN 'Eq' ELSE abs(n1) || '°' || CASE WHEN n1 < 0 THEN 'S' ELSE 'N' END END || ', ' ||
  CASE WHEN w1 = 0 THEN '0°' WHEN abs(w1) = 180 THEN '180°' ELSE abs(w1) || '°' || CASE WHEN w1 < 0 THEN 'W' ELSE 'E' END END || '–' ||
  CASE WHEN e1 = 0 THEN '0°' WHEN abs(e1) = 180 THEN '180°' ELSE abs(e1) || '°' || CASE WHEN e1 < 0 THEN 'W' ELSE 'E' END END AS box, count(*) AS n FROM w GROUP BY ALL)""")
def value_and_box_labels(spark, sf):
    """Values of many sizes and both signs, boxes with their corners in any order."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    q = F.col("l_quantity")
    li = tables.table(spark, sf, "lineitem").select((F.col("l_extendedprice") * F.lit(0.7310585786) * sign / F.pow(F.lit(10.0), "l_linenumber")).alias("price"),
                                                    fx.box_label(q - 25, 26 - 2 * q, q * 7 - 180, q * 13).alias("box"))
    return li.withColumn("value", fx.value_label(F.col("price"))).groupBy("price", "value", "box").agg(F.count("*").alias("n"))


@query("P23_contour_buckets", "level:i bucket:l n:l", with_(SQL_CLIM) + """,
result AS (SELECT level, CAST(floor(z / 60.0) AS BIGINT) AS bucket, count(*) AS n FROM clim GROUP BY ALL)""")
def contour_buckets(spark, sf):
    return (clim(spark, sf, "z").withColumn("bucket", fx.contour_bucket(F.col("z"), 60.0))
            .groupBy("level", "bucket").agg(F.count("*").alias("n")))


@query("J13_overlay_field", "month:i lat_idx:i lon_idx:i shown:6 contour:4", with_(SQL_CLIM, SQL_SURFACE) + """,
result AS (SELECT s.month, s.lat_idx, s.lon_idx, s.sst AS shown, c.z AS contour FROM sclim s
  JOIN clim c USING (month, lat_idx, lon_idx) WHERE c.level = 500)""")
def overlay_field(spark, sf):
    z = clim(spark, sf, "z").where("level = 500").select("month", "lat_idx", "lon_idx", F.col("z").alias("contour"))
    return (surface_clim(spark, sf, "sst").withColumnRenamed("sst", "shown")
            .join(z, ["month", "lat_idx", "lon_idx"]))


@query("J3_X2_common_times", "year:i month:i sst:6", with_(SQL_SAMPLES, SQL_SURFACE) + """,
common AS (SELECT DISTINCT year, month FROM smon INTERSECT SELECT DISTINCT year, month FROM mon),
result AS (SELECT year, month, avg(sst) AS sst FROM smon SEMI JOIN common USING (year, month) GROUP BY ALL)""")
def common_times(spark, sf):
    sfc, up = surface_monthly(spark, sf, "sst"), tables.upper_samples(spark, sf).select("year", "month")
    return (sfc.join(up.distinct(), ["year", "month"], "left_semi")
            .groupBy("year", "month").agg(F.avg("sst").alias("sst")))
