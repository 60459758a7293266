"""Field requests: selection, coordinates, references and comparisons end to end."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from zonalis.operators import vertical
from zonalis.operators.sampling import great_circle
from zonalis.plans import jobs, sections
from zonalis.plans.catalogue.base import (CELL, SPEC, SQL_CLIM, SQL_INDEX, SQL_LEVELS, SQL_SAMPLES, SQL_SURFACE, SQL_WINDOWS,
                                          WINDOWS, monthly, query, surface_monthly, with_)
from zonalis.plans.catalogue.diagnostics import sql_isentrope
from zonalis.plans.catalogue.events import BOX, SQL_BEST, SQL_BOX, SQL_EVENTS
from zonalis.plans.catalogue.sampling import SQL_ARCS, SQL_LENGTH, sql_corners, sql_great_circle
from zonalis.plans.request import (FieldRequest, FieldStore, base_field, decode, display_range, effective_kind, encode,
                                   expected_inputs, ingredients, resolve, resolve_sides, resolve_with_flags,
                                   sides_range, wind_request)
from zonalis.sources import fields, tables

OUT = "month:i lat_idx:i lon_idx:i "


def store(spark, sf, *names, surface=()) -> FieldStore:
    """The sample fields as a store; without names only the surface ones."""
    keys = ["year", "month", *CELL]
    parts = []
    if names:
        parts.append(vertical.columns_to_fields(monthly(spark, sf, *names), keys, names))
    if surface:
        s = surface_monthly(spark, sf, *surface).withColumn("level", F.lit(0))
        parts.append(vertical.columns_to_fields(s, keys, surface))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return FieldStore(rows, SPEC, active="1995-2001", windows=WINDOWS)


@query("D1_climatology_field", OUT + "value:6", with_(SQL_CLIM) + """,
result AS (SELECT month, lat_idx, lon_idx, t AS value FROM clim WHERE level = 500)""")
def climatology_field(spark, sf):
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=None, level=500))


@query("D1_P3_period_field", OUT + "value:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, lat_idx, lon_idx, avg(t) AS value FROM mon WHERE level = 850 AND year BETWEEN 1997 AND 1999 AND month = 4 GROUP BY ALL)""")
def period_field(spark, sf):
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=4, level=850, period="1997-1999"))


@query("D1_single_year_field", OUT + "value:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, lat_idx, lon_idx, u AS value FROM mon WHERE level = 200 AND year = 1998)""")
def year_field(spark, sf):
    return resolve(store(spark, sf, "u"), FieldRequest("u", month=None, year=1998))


@query("D1_derived_field", OUT + "value:6", with_(SQL_CLIM) + """,
result AS (SELECT month, lat_idx, lon_idx, sqrt(u*u + v*v) AS value FROM clim WHERE level = 200)""")
def derived_field(spark, sf):
    """A climatology of a derived field comes from the climatological ingredients."""
    return resolve(store(spark, sf, "u", "v"), FieldRequest("wspd", month=None))


@query("D1_Q10_derived_single_year", OUT + "value:6", with_(SQL_SAMPLES) + """,
t AS (SELECT * FROM mon WHERE year = 1999 AND level = 200), b AS (SELECT * FROM mon WHERE year = 1999 AND level = 850),
k AS (SELECT DISTINCT month, lat_idx, lon_idx FROM mon WHERE year = 1999 AND level IN (200, 850)),
result AS (SELECT k.month, k.lat_idx, k.lon_idx, sqrt(pow(t.u - b.u, 2) + pow(t.v - b.v, 2)) AS value FROM k
  LEFT JOIN t USING (month, lat_idx, lon_idx) LEFT JOIN b USING (month, lat_idx, lon_idx))""")
def derived_year(spark, sf):
    return resolve(store(spark, sf, "u", "v"), FieldRequest("dls", month=None, year=1999))


@query("D1_V2_theta_field", OUT + "value:6", with_(SQL_CLIM, SQL_LEVELS, sql_isentrope("clim", "month, lat_idx, lon_idx", "pv", 330.0, "x")) + """,
result AS (SELECT month, lat_idx, lon_idx, pv AS value FROM x)""")
def theta_field(spark, sf):
    return resolve(store(spark, sf, "pv", "t"), FieldRequest("pv", month=None, theta=330.0))


@query("D1_surface_field", OUT + "value:5", with_(SQL_SURFACE) + """,
result AS (SELECT month, lat_idx, lon_idx, msl AS value FROM sclim)""")
def surface_field(spark, sf):
    return resolve(store(spark, sf, surface=("msl", "sst")), FieldRequest("msl", month=None))


@query("D1_G7_seasonal_field", OUT + "value:6", with_(SQL_CLIM) + """,
result AS (SELECT 1 AS month, lat_idx, lon_idx, avg(t) AS value FROM clim WHERE level = 500 AND month IN (12, 1, 2) GROUP BY ALL)""")
def seasonal_field(spark, sf):
    """Centred on January: December, January, February."""
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=1, level=500, seasonal=True))


@query("D1_Q11_range_composite_of_theta", OUT + "value:6",
       with_(SQL_SAMPLES, SQL_LEVELS, sql_isentrope("(SELECT * FROM mon WHERE year BETWEEN 1996 AND 1998)", "year, month, lat_idx, lon_idx", "u", 350.0, "x")) + """,
result AS (SELECT month, lat_idx, lon_idx, avg(u) AS value FROM x GROUP BY month, lat_idx, lon_idx)""")
def theta_range(spark, sf):
    return resolve(store(spark, sf, "u", "t"), FieldRequest("u", month=None, coord="theta", theta=350.0, span=(1996, 1998)))


@query("D2_sigma_field", OUT + "value:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, lat_idx, lon_idx, stddev_pop(t) AS value FROM mon WHERE level = 500 GROUP BY ALL)""")
def sigma_field(spark, sf):
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=None, level=500, kind="std"))


@query("D2_derived_sigma_field", OUT + "value:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, lat_idx, lon_idx, stddev_pop(sqrt(u*u + v*v)) AS value FROM mon WHERE level = 200 GROUP BY ALL)""")
def derived_sigma(spark, sf):
    return resolve(store(spark, sf, "u", "v"), FieldRequest("wspd", month=None, kind="std"))


@query("D2_theta_sigma_falls_back_to_mean", "kind:s month:i lat_idx:i lon_idx:i value:6",
       with_(SQL_CLIM, SQL_LEVELS, sql_isentrope("clim", "month, lat_idx, lon_idx", "u", 330.0, "x")) + """,
result AS (SELECT 'mean' AS kind, month, lat_idx, lon_idx, u AS value FROM x)""")
def theta_sigma(spark, sf):
    s, r = store(spark, sf, "u", "t"), FieldRequest("u", month=None, coord="theta", kind="std")
    return resolve(s, r).withColumn("kind", F.lit(effective_kind(s, r)))


@query("D3_eddy_view", OUT + "value:6", with_(SQL_CLIM) + """,
result AS (SELECT month, lat_idx, lon_idx, z - avg(z) OVER (PARTITION BY month, lat_idx) AS value FROM clim WHERE level = 500)""")
def eddy_view(spark, sf):
    return resolve(store(spark, sf, "z"), FieldRequest("z", month=None, level=500, mode="eddy"))


@query("D3_zonal_view", OUT + "value:6", with_(SQL_CLIM) + """,
result AS (SELECT month, lat_idx, lon_idx, avg(z) OVER (PARTITION BY month, lat_idx) AS value FROM clim WHERE level = 500)""")
def zonal_view(spark, sf):
    return resolve(store(spark, sf, "z"), FieldRequest("z", month=None, level=500, mode="zonal"))


@query("D5_self_anomaly_view", OUT + "value:6", with_(SQL_CLIM) + """,
a AS (SELECT lat_idx, lon_idx, avg(t) AS m FROM clim WHERE level = 500 GROUP BY ALL),
result AS (SELECT 7 AS month, lat_idx, lon_idx, t - m AS value FROM clim JOIN a USING (lat_idx, lon_idx) WHERE level = 500 AND month = 7)""")
def self_anomaly_view(spark, sf):
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=7, level=500, mode="anomaly"))


@query("D5_year_anomaly_view", OUT + "value:6", with_(SQL_CLIM) + """,
result AS (SELECT month, lat_idx, lon_idx, m.t - c.t AS value FROM (SELECT * FROM mon WHERE year = 1998 AND level = 500) m
  LEFT JOIN (SELECT * FROM clim WHERE level = 500) c USING (month, lat_idx, lon_idx))""")
def year_anomaly_view(spark, sf):
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=None, level=500, year=1998, mode="anomaly"))


@query("D5_best_match_view", OUT + "value:6", with_(SQL_SAMPLES) + """,
c AS (SELECT month, lat_idx, lon_idx, avg(t) AS c FROM mon WHERE level = 500 AND year BETWEEN 1997 AND 1999 GROUP BY ALL),
result AS (SELECT month, lat_idx, lon_idx, t - c AS value FROM (SELECT * FROM mon WHERE year = 1997 AND level = 500) LEFT JOIN c USING (month, lat_idx, lon_idx))""")
def best_match_view(spark, sf):
    """1997 lies midway between the centres 1996 and 1998: the later window wins."""
    r = FieldRequest("t", month=None, level=500, year=1997, mode="anomaly", reference="best-match")
    return resolve(store(spark, sf, "t"), r)


@query("D5_period_difference_view", OUT + "value:6", with_(SQL_CLIM) + """,
r AS (SELECT month, lat_idx, lon_idx, avg(t) AS r FROM mon WHERE level = 500 AND year BETWEEN 1995 AND 1997 GROUP BY ALL),
result AS (SELECT month, lat_idx, lon_idx, t - r AS value FROM clim LEFT JOIN r USING (month, lat_idx, lon_idx) WHERE level = 500)""")
def period_difference(spark, sf):
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=None, level=500, mode="anomaly", reference="1995-1997"))


@query("D6_theta_year_anomaly", OUT + "value:6",
       with_(SQL_CLIM, SQL_LEVELS, sql_isentrope("clim", "month, lat_idx, lon_idx", "u", 350.0, "c"),
             sql_isentrope("(SELECT * FROM mon WHERE year = 1998)", "month, lat_idx, lon_idx", "v", 350.0, "unused"),
             sql_isentrope("(SELECT * FROM mon WHERE year = 1998)", "month, lat_idx, lon_idx", "u", 350.0, "y")) + """,
result AS (SELECT month, lat_idx, lon_idx, y.u - c.u AS value FROM y LEFT JOIN c USING (month, lat_idx, lon_idx))""")
def theta_year_anomaly(spark, sf):
    """Asked for a standardized anomaly; on theta it becomes a plain one."""
    r = FieldRequest("u", month=None, coord="theta", theta=350.0, year=1998, mode="zscore")
    return resolve(store(spark, sf, "u", "t"), r)


@query("D4_zscore_view", OUT + "value:5", with_(SQL_SAMPLES) + """,
s AS (SELECT month, lat_idx, lon_idx, avg(t) AS m, stddev_pop(t) AS sd FROM mon WHERE level = 500 GROUP BY ALL),
f AS (SELECT month, list_sort(list(sd))[CAST(floor(0.02::DOUBLE * count(*)) AS BIGINT) + 1] AS fl FROM s WHERE sd > 0 GROUP BY ALL),
result AS (SELECT month, lat_idx, lon_idx, CASE WHEN sd > 0 THEN (t - m) / greatest(sd, fl) END AS value
  FROM (SELECT * FROM mon WHERE year = 1998 AND level = 500) LEFT JOIN s USING (month, lat_idx, lon_idx) LEFT JOIN f USING (month))""")
def zscore_view(spark, sf):
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=None, level=500, year=1998, mode="zscore"))


@query("D7_sigma_difference_view", OUT + "value:6", with_(SQL_SAMPLES) + """,
a AS (SELECT month, lat_idx, lon_idx, stddev_pop(t) AS a FROM mon WHERE level = 500 GROUP BY ALL),
b AS (SELECT month, lat_idx, lon_idx, stddev_pop(t) AS b FROM mon WHERE level = 500 AND year BETWEEN 1995 AND 1997 GROUP BY ALL),
result AS (SELECT month, lat_idx, lon_idx, a - b AS value FROM a LEFT JOIN b USING (month, lat_idx, lon_idx))""")
def sigma_difference(spark, sf):
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=None, level=500, kind="std", reference="1995-1997"))


@query("D9_D10_event_request", OUT + "value:6", with_(SQL_SAMPLES, SQL_INDEX, SQL_WINDOWS, SQL_BEST, SQL_EVENTS) + """,
m5 AS (SELECT * FROM mon WHERE level = 500),
wc AS (SELECT w.id AS window_id, month, lat_idx, lon_idx, avg(t) AS c FROM m5 JOIN win w ON m5.year BETWEEN w.first AND w.last GROUP BY ALL),
ew AS (SELECT year, window_id FROM ev JOIN best USING (year)),
ref AS (SELECT month, lat_idx, lon_idx, CASE WHEN count(*) = (SELECT count(*) FROM ew) THEN avg(c) END AS c FROM ew JOIN wc USING (window_id) GROUP BY ALL),
e AS (SELECT month, lat_idx, lon_idx, avg(t) AS t FROM m5 SEMI JOIN ev USING (year) GROUP BY ALL),
result AS (SELECT month, lat_idx, lon_idx, t - c AS value FROM e LEFT JOIN ref USING (month, lat_idx, lon_idx))""")
def event_request(spark, sf):
    """From the compact text of a request to a composite anomaly against sliding windows."""
    r = decode("f=t&L=500&d=anomaly&cr=c:oni:ge:0:7")
    s = replace(store(spark, sf, "t"), index=tables.monthly_index(spark, sf))
    return resolve(s, replace(decode(encode(r)), month=None))


@query("D12_period_comparison", OUT + "value:6", with_(SQL_CLIM) + """,
r AS (SELECT month, lat_idx, lon_idx, avg(t) AS r FROM mon WHERE level = 850 AND year BETWEEN 1999 AND 2001 GROUP BY ALL),
result AS (SELECT month, lat_idx, lon_idx, t - r AS value FROM clim LEFT JOIN r USING (month, lat_idx, lon_idx) WHERE level = 850)""")
def period_comparison(spark, sf):
    return resolve(store(spark, sf, "t"), FieldRequest("t", month=None, level=850, compare_period="1999-2001"))


@query("D12_year_comparison_own_baselines", OUT + "value:6", with_(SQL_SAMPLES) + """,
m AS (SELECT * FROM mon WHERE level = 500),
ca AS (SELECT month, lat_idx, lon_idx, avg(t) AS c FROM m WHERE year BETWEEN 1995 AND 1997 GROUP BY ALL),
cb AS (SELECT month, lat_idx, lon_idx, avg(t) AS c FROM m WHERE year BETWEEN 1999 AND 2001 GROUP BY ALL),
a AS (SELECT month, lat_idx, lon_idx, t - c AS x FROM m LEFT JOIN ca USING (month, lat_idx, lon_idx) WHERE year = 1996),
b AS (SELECT month, lat_idx, lon_idx, t - c AS y FROM m LEFT JOIN cb USING (month, lat_idx, lon_idx) WHERE year = 2000),
result AS (SELECT month, lat_idx, lon_idx, x - y AS value FROM a LEFT JOIN b USING (month, lat_idx, lon_idx))""")
def year_comparison(spark, sf):
    r = FieldRequest("t", month=None, level=500, year=1996, mode="anomaly", reference="best-match", compare_year=2000)
    return resolve(store(spark, sf, "t"), r)


@query("D12_year_comparison_shared_baseline", OUT + "value:6", with_(SQL_CLIM) + """,
m AS (SELECT * FROM mon WHERE level = 500),
a AS (SELECT m.month, lat_idx, lon_idx, m.t - c.t AS x FROM m LEFT JOIN clim c USING (month, level, lat_idx, lon_idx) WHERE year = 1996),
b AS (SELECT m.month, lat_idx, lon_idx, m.t - c.t AS y FROM m LEFT JOIN clim c USING (month, level, lat_idx, lon_idx) WHERE year = 2000),
result AS (SELECT month, lat_idx, lon_idx, x - y AS value FROM a LEFT JOIN b USING (month, lat_idx, lon_idx))""")
def year_comparison_shared(spark, sf):
    r = FieldRequest("t", month=None, level=500, year=1996, mode="anomaly", compare_year=2000)
    return resolve(store(spark, sf, "t"), r)


SQL_SIDES = """,
a AS (SELECT 'active' AS side, month, lat_idx, lon_idx, avg(t) AS value FROM mon WHERE level = 500 GROUP BY ALL),
b AS (SELECT 'target' AS side, month, lat_idx, lon_idx, t AS value FROM mon WHERE level = 500 AND year = 1998),
r AS (SELECT side, month, list_sort(list(value))[CAST(floor(0.005::DOUBLE * (count(value) - 1)) AS BIGINT) + 1] AS lo,
  list_sort(list(value))[CAST(floor(0.995::DOUBLE * (count(value) - 1)) AS BIGINT) + 1] AS hi FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)"""


@query("D12_swipe_sides", "side:s " + OUT + "value:6 vmin:6 vmax:6", with_(SQL_SAMPLES) + SQL_SIDES + """,
result AS (SELECT s.*, (SELECT min(lo) FROM r) AS vmin, (SELECT max(hi) FROM r) AS vmax FROM (SELECT * FROM a UNION ALL SELECT * FROM b) s)""")
def swipe_sides(spark, sf):
    """A climatology beside a year, on one range pooled over both sides and all months."""
    s, r = store(spark, sf, "t"), FieldRequest("t", month=None, level=500, compare_year=1998)
    rows = resolve_sides(s, r)
    both = sides_range(s, r, rows).withColumn("side", F.explode(F.array(F.lit("active"), F.lit("target"))))
    return rows.join(both, "side")


@query("D12_swipe_eddy_range", "vmin:6 vmax:6", with_(SQL_SAMPLES) + """,
p AS (SELECT 'active' AS side, month, lat_idx, lon_idx, avg(u) AS v FROM mon WHERE level = 200 AND year BETWEEN 1995 AND 2001 GROUP BY ALL UNION ALL
  SELECT 'target', month, lat_idx, lon_idx, avg(u) FROM mon WHERE level = 200 AND year BETWEEN 1997 AND 1999 GROUP BY ALL),
e AS (SELECT side, month, abs(v - avg(v) OVER (PARTITION BY side, month, lat_idx)) AS a FROM p),
result AS (SELECT -max(a) AS vmin, 30.0 AS vmax FROM e)""")
def swipe_eddy(spark, sf):
    """Each side loses its own zonal mean; a bound of the user wins."""
    s = store(spark, sf, "u")
    r = FieldRequest("u", month=None, level=200, mode="eddy", compare_period="1997-1999", user_max=30.0)
    return sides_range(s, r, resolve_sides(s, r))


@query("D14_display_range", "view:s vmin:6 vmax:6", with_(SQL_CLIM) + """,
m AS (SELECT month, list_sort(list(t))[CAST(floor(0.005::DOUBLE * (count(t) - 1)) AS BIGINT) + 1] AS lo,
  list_sort(list(t))[CAST(floor(0.995::DOUBLE * (count(t) - 1)) AS BIGINT) + 1] AS hi FROM clim WHERE level = 500 GROUP BY ALL),
result AS (SELECT 'auto' AS view, min(lo) AS vmin, max(hi) AS vmax FROM m UNION ALL
  SELECT 'user', 250.0, max(hi) FROM m UNION ALL
  SELECT 'symmetric', -max(abs(u)), max(abs(u)) FROM clim WHERE level = 200)""")
def display_ranges(spark, sf):
    """Clamped and pooled over the months; with a user bound; and symmetric for a signed field."""
    s = store(spark, sf, "t", "u")
    auto, user = FieldRequest("t", month=None, level=500), FieldRequest("t", month=None, level=500, user_min=250.0)
    sym = FieldRequest("u", month=None, level=200)
    parts = [display_range(s, r, base_field(s, r)).withColumn("view", F.lit(n))
             for n, r in (("auto", auto), ("user", user), ("symmetric", sym))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# sections and series of a request ---------------------------------------------------------------------
SECTION = "month:i level:i lat_idx:i value:6"


@query("D1_V12_zonal_section_derived", SECTION, with_(SQL_CLIM) + """,
result AS (SELECT month, level, lat_idx, avg(sqrt(u*u + v*v)) AS value FROM clim GROUP BY ALL)""")
def zonal_section_derived(spark, sf):
    return sections.zonal_section(store(spark, sf, "u", "v"), FieldRequest("wspd", month=None))


@query("D1_V12_zonal_section_seasonal", SECTION, with_(SQL_CLIM) + """,
s AS (SELECT level, lat_idx, lon_idx, avg(t) AS t FROM clim WHERE month IN (12, 1, 2) GROUP BY ALL),
result AS (SELECT 1 AS month, level, lat_idx, avg(t) AS value FROM s GROUP BY ALL)""")
def zonal_section_seasonal(spark, sf):
    return sections.zonal_section(store(spark, sf, "t"), FieldRequest("t", month=1, seasonal=True))


@query("D1_D5_V12_zonal_section_year_anomaly", SECTION, with_(SQL_CLIM) + """,
a AS (SELECT m.month, m.level, m.lat_idx, m.t - c.t AS x FROM mon m LEFT JOIN clim c USING (month, level, lat_idx, lon_idx) WHERE year = 1998),
result AS (SELECT month, level, lat_idx, avg(x) AS value FROM a GROUP BY ALL)""")
def zonal_section_anomaly(spark, sf):
    return sections.zonal_section(store(spark, sf, "t"), FieldRequest("t", month=None, year=1998, mode="anomaly"))


SQL_ARC_VALUE = """,
dd AS (SELECT arc_id, s, sum(coalesce(d, 0)) OVER (PARTITION BY arc_id ORDER BY s) AS dist_km FROM leg),
x AS (SELECT arc_id, s, month, level, CASE WHEN count(value) = 4 THEN sum(wt * value) ELSE avg(value) END AS value
  FROM cor JOIN f USING (lat_idx, lon_idx) GROUP BY ALL),
result AS (SELECT dd.arc_id, dd.s, m.month, m.level, dist_km, value FROM dd CROSS JOIN (SELECT DISTINCT month, level FROM f) m
  LEFT JOIN x ON x.arc_id = dd.arc_id AND x.s = dd.s AND x.month = m.month AND x.level = m.level)"""
ARC = "arc_id:l s:i month:i level:i dist_km:4 value:6"
SQL_ARC_PATH = (SQL_ARCS, sql_great_circle(192), SQL_LENGTH, sql_corners("gc", "arc_id, s"))


def _arcs(spark, sf):
    return great_circle(tables.arc_ends(spark, sf), ["arc_id"], 192)


@query("D1_V13_arc_section_derived_year", ARC, with_(SQL_SAMPLES, *SQL_ARC_PATH) + """,
f AS (SELECT month, level, lat_idx, lon_idx, sqrt(u*u + v*v) AS value FROM mon WHERE year = 1999 AND month = 7)""" + SQL_ARC_VALUE)
def arc_section_year(spark, sf):
    return sections.arc_section(store(spark, sf, "u", "v"), FieldRequest("wspd", month=7, year=1999), _arcs(spark, sf), ["arc_id"])


@query("D1_V13_arc_section_composite", ARC, with_(SQL_SAMPLES, *SQL_ARC_PATH) + """,
f AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS value FROM mon WHERE year BETWEEN 1996 AND 1998 AND month = 1 GROUP BY ALL)""" + SQL_ARC_VALUE)
def arc_section_composite(spark, sf):
    return sections.arc_section(store(spark, sf, "t"), FieldRequest("t", month=1, span=(1996, 1998)), _arcs(spark, sf), ["arc_id"])


def sql_box_mean(value: str, source: str, keys: str) -> str:
    w = "cos(radians(90.0 - 15.0 * lat_idx))"
    return (f"SELECT {keys}, sum({value} * {w}) / nullif(sum(CASE WHEN {value} IS NOT NULL THEN {w} END), 0) AS value FROM {source} "
            f"WHERE {SQL_BOX} AND {w} > 0 GROUP BY {keys}")


@query("D1_K16_series_of_derived_field", "year:i month:i t:6 value:6", with_(SQL_SAMPLES) + f""",
f AS (SELECT year, month, lat_idx, lon_idx, sqrt(u*u + v*v) AS x FROM mon WHERE level = 200),
result AS (SELECT *, year + (month - 0.5) / 12 AS t FROM ({sql_box_mean('x', 'f', 'year, month')}))""")
def series_derived(spark, sf):
    return sections.area_series(store(spark, sf, "u", "v"), FieldRequest("wspd"), BOX)


@query("D1_K16_series_anomaly_on_theta", "year:i month:i value:6", with_(SQL_SAMPLES, SQL_LEVELS,
       sql_isentrope("mon", "year, month, lat_idx, lon_idx", "u", 350.0, "y"),
       sql_isentrope("(SELECT month, level, lat_idx, lon_idx, avg(u) AS u, avg(t) AS t FROM mon GROUP BY ALL)", "month, lat_idx, lon_idx", "u", 350.0, "c")) + f""",
a AS ({sql_box_mean('u', 'y', 'year, month')}), b AS ({sql_box_mean('u', 'c', 'month')}),
result AS (SELECT a.year, a.month, a.value - b.value AS value FROM a LEFT JOIN b USING (month))""")
def series_theta(spark, sf):
    s = sections.area_series(store(spark, sf, "u", "t"), FieldRequest("u", coord="theta", theta=350.0), BOX, "fixed")
    return s.select("year", "month", "value")


@query("D1_K16_series_sliding_anomaly", "year:i month:i window_id:s value:6", with_(SQL_SAMPLES, SQL_INDEX, SQL_WINDOWS, SQL_BEST) + f""",
m AS (SELECT * FROM mon WHERE level = 500),
wc AS (SELECT w.id AS window_id, month, lat_idx, lon_idx, avg(t) AS t FROM m JOIN win w ON m.year BETWEEN w.first AND w.last GROUP BY ALL),
a AS ({sql_box_mean('t', 'm', 'year, month')}), b AS ({sql_box_mean('t', 'wc', 'window_id, month')}),
result AS (SELECT a.year, a.month, window_id, a.value - b.value AS value FROM a JOIN best USING (year) LEFT JOIN b USING (window_id, month))""")
def series_sliding(spark, sf):
    s = sections.area_series(store(spark, sf, "t"), FieldRequest("t", level=500), BOX, "sliding")
    return s.select("year", "month", "window_id", "value")


@query("S20_K16_series_csv_with_header", "n:l line:s", with_(SQL_SAMPLES) + f""",
m AS (SELECT * FROM mon WHERE level = 500), a AS ({sql_box_mean('t', 'm', 'year, month')}),
result AS (SELECT -2 AS n, '# field: t' AS line UNION ALL SELECT -1, '# year,month,value'
  UNION ALL SELECT year * 12 + month, year || ',' || month || ',' || printf('%.1f', value) FROM a)""")
def series_csv_header(spark, sf):
    s = sections.area_series(store(spark, sf, "t"), FieldRequest("t", level=500), BOX)
    return sections.csv_lines(s, ["field: t", "year,month,value"], places=1)


@query("D15_R1_request_inputs", "var:s level:i n:l", with_(SQL_SAMPLES) + """,
result AS (SELECT nm AS var, level, count(*) AS n FROM mon, (VALUES ('t'), ('pv')) AS a(nm) GROUP BY ALL)""")
def request_inputs(spark, sf):
    """The partitions a request reads, and what they hold."""
    need = ingredients(FieldRequest("pv"), SPEC)
    want = spark.createDataFrame(need, "var string, level int")
    rows = store(spark, sf, "pv", "t", "u").monthly
    return rows.join(want, ["var", "level"], "left_semi").groupBy("var", "level").agg(F.count("*").alias("n"))


@query("D15_expected_inputs", "role:s var:s level:i kind:s n:l", with_(SQL_SAMPLES) + """,
e(role, var, level, kind) AS (VALUES ('field', 'u', 200, 'mean'), ('field', 'v', 200, 'mean'), ('reference', 'u', 200, 'mean'), ('reference', 'v', 200, 'mean'), ('sigma', 'wspd', 200, 'std')),
h AS (SELECT nm AS var, level, count(*) AS n FROM mon, (VALUES ('u'), ('v')) AS a(nm) GROUP BY ALL),
result AS (SELECT e.role, e.var, e.level, e.kind, coalesce(h.n, 0) AS n FROM e LEFT JOIN h USING (var, level))""")
def expected_inputs_of_view(spark, sf):
    """A standardized anomaly of a derived field waits for its ingredients twice and for its sigma."""
    s = store(spark, sf, "u", "v")
    want = spark.createDataFrame(expected_inputs(s, FieldRequest("wspd", mode="zscore")), "role string, var string, level int, kind string")
    have = s.monthly.groupBy("var", "level").agg(F.count("*").alias("n"))
    return want.join(have, ["var", "level"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _catalogued(spark, sf):
    """Mean and sigma of t, only the mean of u."""
    s = store(spark, sf, "t", "u")
    rows = jobs.climatology_rows(s.monthly.withColumn("grp", F.lit("pl")), 1995, 2001)
    return s, rows.where("var = 't' OR kind = 'mean'")


@query("S14_B11_catalogue", "grp:s var:s vmin:6 vmax:6 std_vmin:6 std_vmax:6 has_mean:b has_std:b derived:b n_levels:i n_years:i", with_(SQL_SAMPLES) + """,
c AS (SELECT 't' AS var, month, level, lat_idx, lon_idx, avg(t) AS m, stddev_pop(t) AS d FROM mon GROUP BY ALL
  UNION ALL SELECT 'u', month, level, lat_idx, lon_idx, avg(u), NULL FROM mon GROUP BY ALL),
result AS (SELECT 'pl' AS grp, var, min(m) AS vmin, max(m) AS vmax, min(d) AS std_vmin, max(d) AS std_vmax, true AS has_mean, count(d) > 0 AS has_std, false AS derived,
  count(DISTINCT level) AS n_levels, (SELECT count(DISTINCT year) FROM mon) AS n_years FROM c GROUP BY var)""")
def catalogue_of_tree(spark, sf):
    s, rows = _catalogued(spark, sf)
    meta = fields.catalogue(rows, s.monthly)
    return meta.withColumn("n_levels", F.size("levels")).withColumn("n_years", F.size("years"))


@query("D2_sigma_by_catalogue", "name:s month:i lat_idx:i lon_idx:i value:6 kind:s sigma_unavailable:b reference_empty:b", with_(SQL_SAMPLES) + """,
result AS (SELECT 't' AS name, month, lat_idx, lon_idx, stddev_pop(t) AS value, 'std' AS kind, false AS sigma_unavailable, false AS reference_empty FROM mon WHERE level = 500 GROUP BY ALL
  UNION ALL SELECT 'u', month, lat_idx, lon_idx, avg(u), 'mean', true, false FROM mon WHERE level = 200 GROUP BY ALL)""")
def sigma_by_catalogue(spark, sf):
    """Sigma is shown for the field whose catalogue entry has one; the other says it fell back."""
    s, rows = _catalogued(spark, sf)
    s = replace(s, sigmas=fields.with_sigma(fields.catalogue(rows)))
    parts = [resolve_with_flags(s, FieldRequest(n, month=None, level=level, kind="std")).withColumn("name", F.lit(n)) for n, level in (("t", 500), ("u", 200))]
    return parts[0].unionByName(parts[1])


@query("D3_empty_reference", OUT + "value:6 reference_empty:b", with_(SQL_SAMPLES) + """,
result AS (SELECT month, lat_idx, lon_idx, NULL::DOUBLE AS value, true AS reference_empty FROM mon WHERE level = 500 AND year = 1998)""")
def empty_reference(spark, sf):
    """An anomaly from a period without data is NULL and says why."""
    r = FieldRequest("t", month=None, level=500, year=1998, mode="anomaly", reference="1961-1990")
    return resolve_with_flags(store(spark, sf, "t"), r)


@query("K20_wind_of_request", OUT + "u:6 v:6", with_(SQL_CLIM) + """,
result AS (SELECT month, lat_idx, lon_idx, u, v FROM clim WHERE level = 850)""")
def wind_of_request(spark, sf):
    s = store(spark, sf, "u", "v", "q")
    u, v = (resolve(s, r).withColumnRenamed("value", r.name) for r in wind_request(FieldRequest("q", month=None, level=850)))
    return u.join(v, ["month", "lat_idx", "lon_idx"])
