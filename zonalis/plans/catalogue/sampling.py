"""Arcs, sections, point samples, and contours."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalis.functions import fields as fx
from zonalis.operators import sampling as sm
from zonalis.plans.catalogue.base import (CELL, SPEC, SQL_CLIM, SQL_LEVELS, SQL_SURFACE, clim, query, surface_clim, with_)
from zonalis.plans.catalogue.diagnostics import SQL_PANEL
from zonalis.sources import tables

SQL_POINTS = """pts AS (SELECT c_custkey AS pid, (c_custkey * 29) % 173 - 86.0 + c_acctbal * 1.118033989e-4 AS lat,
  (c_custkey * 61) % 360 - 180.0 + c_acctbal * 2.236067977e-5 AS lon,
  210.0 + (c_custkey * 17) % 780 + c_acctbal * 1.224744871e-3 AS p FROM customer)"""

# the same points stretched beyond every range
SQL_BEYOND = SQL_POINTS.replace("pts AS (", "near AS (", 1) + """,
pts AS (SELECT pid, lat * 1.2 AS lat, lon, p * 1.1 - 60 AS p FROM near)"""


def _beyond(points):
    return points.withColumn("lat", F.col("lat") * 1.2).withColumn("p", F.col("p") * 1.1 - 60)


SQL_ARCS = """arcs AS (SELECT s_suppkey AS arc_id, (s_suppkey * 37) % 151 - 75.0 + s_acctbal * 1.118033989e-4 AS lat1,
  (s_suppkey * 53) % 360 - 180.0 + s_acctbal * 1.322875656e-5 AS lon1, (s_suppkey * 71) % 149 - 74.0 + s_acctbal * 2.236067977e-4 AS lat2,
  (s_suppkey * 97) % 360 - 179.5 + s_acctbal * 3.162277660e-5 AS lon2 FROM supplier),
uv AS (SELECT *, cos(radians(lat1)) * sin(radians(lon1)) AS ax, sin(radians(lat1)) AS ay, cos(radians(lat1)) * cos(radians(lon1)) AS az,
  cos(radians(lat2)) * sin(radians(lon2)) AS bx, sin(radians(lat2)) AS bq, cos(radians(lat2)) * cos(radians(lon2)) AS bz,
  CASE WHEN lon2 - lon1 > 180 THEN lon2 - lon1 - 360 WHEN lon2 - lon1 < -180 THEN lon2 - lon1 + 360 ELSE lon2 - lon1 END AS dl
  FROM arcs)"""


def sql_great_circle(n: int) -> str:
    return f"""gth AS (SELECT *, acos(greatest(-1.0, least(1.0, ax * bx + ay * bq + az * bz))) AS th FROM uv),
gp AS (SELECT arc_id, s, lat1, lon1, th, sin((1 - s / {n}.0) * th) / sin(th) AS wa, sin(s / {n}.0 * th) / sin(th) AS wb, ax, ay, az, bx, bq, bz
  FROM gth, range({n + 1}) AS r(s) WHERE th >= 1e-6 OR s = 0),
gx AS (SELECT arc_id, s, lat1, lon1, th, wa * ax + wb * bx AS x, wa * ay + wb * bq AS y, wa * az + wb * bz AS z FROM gp),
gc AS (SELECT arc_id, s, CASE WHEN th < 1e-6 THEN lat1 ELSE degrees(asin(y / sqrt(x*x + y*y + z*z))) END AS lat,
  CASE WHEN th < 1e-6 THEN lon1 ELSE degrees(atan2(x, z)) END AS lon FROM gx)"""


def sql_seam(x: str) -> str:
    return f"(((({x}) + 540) % 360 + 360) % 360 - 180)"


def sql_haversine(a: str, o: str, b: str, p: str) -> str:
    return (f"(12742.0 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b}))"
            f" * pow(sin(radians({p} - {o}) / 2), 2)))))")


@query("V7_haversine", "arc_id:l km:5", with_(SQL_ARCS) + f"""
, result AS (SELECT arc_id, {sql_haversine('lat1', 'lon1', 'lat2', 'lon2')} AS km FROM arcs)""")
def haversine(spark, sf):
    a = tables.arc_ends(spark, sf)
    return a.select("arc_id", fx.haversine_km(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]).alias("km"))


@query("V8_V11_great_circle", "arc_id:l s:i lat:6 lon:6", with_(SQL_ARCS, sql_great_circle(128)) + ", result AS (SELECT * FROM gc)")
def great_circle(spark, sf):
    return sm.great_circle(tables.arc_ends(spark, sf), ["arc_id"], 128)


@query("V9_straight_arc", "arc_id:l s:i lat:6 lon:6", with_(SQL_ARCS) + f""",
result AS (SELECT arc_id, s, lat1 + s / 128.0 * (lat2 - lat1) AS lat, {sql_seam('lon1 + s / 128.0 * dl')} AS lon FROM uv, range(129) AS r(s))""")
def straight(spark, sf):
    return sm.straight_arc(tables.arc_ends(spark, sf), ["arc_id"], 128)


@query("V9_midpoints", "arc_id:l gc_lat:6 gc_lon:6 straight_lat:6 straight_lon:6", with_(SQL_ARCS) + f""",
m AS (SELECT *, ax + bx AS x, ay + bq AS y, az + bz AS z FROM uv),
result AS (SELECT arc_id, CASE WHEN x*x + y*y + z*z < 1e-12 THEN lat1 ELSE degrees(asin(y / sqrt(x*x + y*y + z*z))) END AS gc_lat,
  CASE WHEN x*x + y*y + z*z < 1e-12 THEN lon1 ELSE degrees(atan2(x, z)) END AS gc_lon,
  (lat1 + lat2) / 2 AS straight_lat, {sql_seam('lon1 + dl / 2')} AS straight_lon FROM m)""")
def midpoints(spark, sf):
    return sm.midpoints(tables.arc_ends(spark, sf), ["arc_id"])


def _pinned(spark, sf):
    return tables.arc_ends(spark, sf).withColumn("latm", (F.col("lat1") + F.col("lat2")) / 3 + 5.0).withColumn(
        "lonm", F.col("lon1") + 20.0)


@query("V10_three_point_arc", "arc_id:l s:i lat:6 lon:6", with_(SQL_ARCS) + """,
p AS (SELECT *, (lat1 + lat2) / 3 + 5.0 AS latm, lon1 + 20.0 AS lonm FROM uv),
q AS (SELECT *, cos(radians(latm)) * sin(radians(lonm)) AS mx, sin(radians(latm)) AS my, cos(radians(latm)) * cos(radians(lonm)) AS mz FROM p),
r AS (SELECT arc_id, s, s / 128.0 AS t, 1 - s / 128.0 AS u, ax, ay, az, bx, bq, bz, 2 * mx - (ax + bx) / 2 AS cx, 2 * my - (ay + bq) / 2 AS cy,
  2 * mz - (az + bz) / 2 AS cz FROM q, range(129) AS g(s)),
v AS (SELECT arc_id, s, u*u*ax + 2*u*t*cx + t*t*bx AS x, u*u*ay + 2*u*t*cy + t*t*bq AS y, u*u*az + 2*u*t*cz + t*t*bz AS z FROM r),
result AS (SELECT arc_id, s, degrees(asin(y / sqrt(x*x + y*y + z*z))) AS lat, degrees(atan2(x, z)) AS lon FROM v
  WHERE x*x + y*y + z*z >= 1e-12)""")
def three_point(spark, sf):
    return sm.three_point_arc(_pinned(spark, sf), ["arc_id"], 128)


@query("V10_three_point_arc_straight", "arc_id:l s:i lat:6 lon:6", with_(SQL_ARCS) + f""",
p AS (SELECT *, (lat1 + lat2) / 3 + 5.0 AS latm, lon1 + 20.0 AS lonm, lon1 + dl AS lone FROM uv),
r AS (SELECT *, s / 128.0 AS t, 1 - s / 128.0 AS u, 2 * latm - (lat1 + lat2) / 2 AS c1, 2 * lonm - (lon1 + lone) / 2 AS c2 FROM p, range(129) AS g(s)),
result AS (SELECT arc_id, s, u*u*lat1 + 2*u*t*c1 + t*t*lat2 AS lat, {sql_seam('u*u*lon1 + 2*u*t*c2 + t*t*lone')} AS lon FROM r)""")
def three_point_straight(spark, sf):
    return sm.three_point_arc(_pinned(spark, sf), ["arc_id"], 128, kind="linear")


SQL_LENGTH = f"""leg AS (SELECT arc_id, s, lat, lon, {sql_haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d
  FROM gc WINDOW w AS (PARTITION BY arc_id ORDER BY s))"""


@query("W12_path_length", "arc_id:l length_km:4", with_(SQL_ARCS, sql_great_circle(128), SQL_LENGTH) + """,
result AS (SELECT arc_id, coalesce(sum(d), 0) AS length_km FROM leg GROUP BY ALL)""")
def path_length(spark, sf):
    return sm.path_length(sm.great_circle(tables.arc_ends(spark, sf), ["arc_id"], 128), ["arc_id"])


@query("W13_date_line_split", "arc_id:l s:i segment:i n_points:i", with_(SQL_ARCS, sql_great_circle(128)) + """,
j AS (SELECT *, (abs(lon - lag(lon) OVER (PARTITION BY arc_id ORDER BY s)) > 180)::INT AS jump FROM gc),
k AS (SELECT *, sum(coalesce(jump, 0)) OVER (PARTITION BY arc_id ORDER BY s) AS segment FROM j),
result AS (SELECT arc_id, s, segment, count(*) OVER (PARTITION BY arc_id, segment) AS n_points FROM k)""")
def date_line_split(spark, sf):
    return sm.split_at_date_line(sm.great_circle(tables.arc_ends(spark, sf), ["arc_id"], 128), ["arc_id"])


def sql_corners(points: str, keys: str) -> str:
    """Four weighted corners per point on the 13 x 12 grid."""
    return f"""pos AS (SELECT *, (90 - lat) / 15 AS r, ((((lon + 180) % 360) + 360) % 360) / 30 AS q FROM {points}),
cell AS (SELECT *, floor(r)::INT AS i0, least(12, floor(r)::INT + 1) AS i1, floor(q)::INT % 12 AS j0, (floor(q)::INT + 1) % 12 AS j1,
  r - floor(r) AS fi, q - floor(q) AS fj FROM pos WHERE r BETWEEN 0 AND 12),
cor AS (SELECT {keys}, i0 AS lat_idx, j0 AS lon_idx, (1 - fi) * (1 - fj) AS wt FROM cell UNION ALL
  SELECT {keys}, i0, j1, (1 - fi) * fj FROM cell UNION ALL SELECT {keys}, i1, j0, fi * (1 - fj) FROM cell UNION ALL
  SELECT {keys}, i1, j1, fi * fj FROM cell)"""


def months(spark):
    """The slices of a climatology of surface fields: known, so that the grid is read once."""
    return SPEC.slices(spark, levels=False)


@query("V4_J11_bilinear_sample", "pid:l month:i sst:6", with_(SQL_SURFACE, SQL_BEYOND, sql_corners("pts", "pid")) + """,
x AS (SELECT pid, month, CASE WHEN count(sst) = 4 THEN sum(wt * sst) ELSE avg(sst) END AS sst
  FROM cor JOIN sclim USING (lat_idx, lon_idx) GROUP BY ALL),
result AS (SELECT p.pid, m.month, x.sst FROM pts p CROSS JOIN (SELECT DISTINCT month FROM sclim) m LEFT JOIN x ON x.pid = p.pid AND x.month = m.month)""")
def bilinear(spark, sf):
    """Some points lie beyond the poles; they stay, with NULL."""
    return sm.bilinear(_beyond(tables.probe_points(spark, sf)), ["pid"], surface_clim(spark, sf, "sst"), ["month"], ["sst"], SPEC, months(spark))


@query("V4_V15_bilinear_with_gaps", "pid:l month:i sst:6", with_(SQL_SURFACE, SQL_POINTS, sql_corners("pts", "pid")) + """,
g AS (SELECT * REPLACE (CASE WHEN (lat_idx + lon_idx) % 3 <> 0 THEN sst END AS sst) FROM sclim),
x AS (SELECT pid, month, CASE WHEN count(sst) = 4 THEN sum(wt * sst) ELSE avg(sst) END AS sst
  FROM cor JOIN g USING (lat_idx, lon_idx) GROUP BY ALL),
result AS (SELECT p.pid, m.month, x.sst FROM pts p CROSS JOIN (SELECT DISTINCT month FROM g) m LEFT JOIN x ON x.pid = p.pid AND x.month = m.month)""")
def bilinear_gaps(spark, sf):
    g = surface_clim(spark, sf, "sst").withColumn(
        "sst", F.when((F.col("lat_idx") + F.col("lon_idx")) % 3 != 0, F.col("sst")))
    return sm.bilinear(tables.probe_points(spark, sf), ["pid"], g, ["month"], ["sst"], SPEC, months(spark))


@query("V5_trilinear_wind", "pid:l month:i u:6 v:6", with_(SQL_CLIM, SQL_BEYOND, SQL_LEVELS, sql_corners("pts", "pid, p")) + """,
kk AS (SELECT pid, p, lat_idx, lon_idx, wt, greatest(0, (SELECT count(*) FROM lev WHERE lev.p < cor.p) - 1) AS k0 FROM cor WHERE p BETWEEN 200 AND 1000),
lv AS (SELECT kk.*, a.p AS p0, b.p AS p1, ln(kk.p / a.p) / ln(b.p / a.p::DOUBLE) AS fk FROM kk JOIN lev a ON a.k = k0 JOIN lev b ON b.k = least(k0 + 1, 6)),
two AS (SELECT pid, lat_idx, lon_idx, p0 AS level, wt * (1 - fk) AS wt FROM lv UNION ALL SELECT pid, lat_idx, lon_idx, p1, wt * fk FROM lv),
x AS (SELECT pid, month, CASE WHEN count(u) = 8 THEN sum(wt * u) END AS u, CASE WHEN count(v) = 8 THEN sum(wt * v) END AS v
  FROM two JOIN clim USING (level, lat_idx, lon_idx) GROUP BY pid, month),
result AS (SELECT p.pid, m.month, x.u, x.v FROM pts p CROSS JOIN (SELECT DISTINCT month FROM clim) m LEFT JOIN x ON x.pid = p.pid AND x.month = m.month)""")
def trilinear(spark, sf):
    """Probes reach beyond the levels and the poles; those are NULL."""
    return sm.trilinear(_beyond(tables.probe_points(spark, sf)), ["pid"], clim(spark, sf, "u", "v"), ["month"], ["u", "v"], SPEC, months(spark))


@query("V6_V14_panel_sample", "probe_id:l month:i u:6", with_(SQL_CLIM, SQL_LEVELS, SQL_BEYOND) + SQL_PANEL + """,
pr AS (SELECT pid AS probe_id, p, (90 - lat) / 15 AS r, greatest(0, (SELECT count(*) FROM lev WHERE lev.p < pts.p) - 1) AS k0 FROM pts),
pk AS (SELECT probe_id, floor(r)::INT AS i0, least(12, floor(r)::INT + 1) AS i1, r - floor(r) AS fi, a.p AS p0, b.p AS p1,
  CASE WHEN a.k = b.k THEN 0 ELSE ln(pr.p / a.p) / ln(b.p / a.p::DOUBLE) END AS fk
  FROM pr JOIN lev a ON a.k = k0 JOIN lev b ON b.k = least(k0 + 1, 6) WHERE r BETWEEN 0 AND 12),
c4 AS (SELECT probe_id, i0 AS lat_idx, p0 AS level, (1 - fi) * (1 - fk) AS wt FROM pk UNION ALL SELECT probe_id, i1, p0, fi * (1 - fk) FROM pk
  UNION ALL SELECT probe_id, i0, p1, (1 - fi) * fk FROM pk UNION ALL SELECT probe_id, i1, p1, fi * fk FROM pk),
x AS (SELECT probe_id, month, CASE WHEN count(u) = 4 THEN sum(wt * u) END AS u FROM c4 JOIN panel USING (level, lat_idx) GROUP BY probe_id, month),
result AS (SELECT p.pid AS probe_id, m.month, x.u FROM pts p CROSS JOIN (SELECT DISTINCT month FROM clim) m LEFT JOIN x ON x.probe_id = p.pid AND x.month = m.month)""")
def panel_sample(spark, sf):
    z = clim(spark, sf, "u").groupBy("month", "level", "lat_idx").agg(F.avg("u").alias("u"))
    probes = _beyond(tables.probe_points(spark, sf)).select(F.col("pid").alias("probe_id"), "lat", "p")
    return sm.panel_sample(z, probes, "u", SPEC, ["month"], months(spark))


@query("V13_arc_section", "arc_id:l s:i month:i dist_km:4 sst:6",
       with_(SQL_ARCS, sql_great_circle(192), SQL_LENGTH, SQL_SURFACE, sql_corners("gc", "arc_id, s")) + """,
dd AS (SELECT arc_id, s, sum(coalesce(d, 0)) OVER (PARTITION BY arc_id ORDER BY s) AS dist_km FROM leg),
x AS (SELECT arc_id, s, month, CASE WHEN count(sst) = 4 THEN sum(wt * sst) ELSE avg(sst) END AS sst
  FROM cor JOIN sclim USING (lat_idx, lon_idx) GROUP BY ALL),
result AS (SELECT dd.arc_id, dd.s, m.month, dist_km, sst FROM dd CROSS JOIN (SELECT DISTINCT month FROM sclim) m
  LEFT JOIN x ON x.arc_id = dd.arc_id AND x.s = dd.s AND x.month = m.month)""")
def arc_section(spark, sf):
    pts = sm.great_circle(tables.arc_ends(spark, sf), ["arc_id"], 192)
    return sm.arc_section(pts, ["arc_id"], surface_clim(spark, sf, "sst"), ["month"], ["sst"], SPEC, months(spark))


@query("V13_upper_air_section", "arc_id:l s:i month:i level:i dist_km:4 u:6",
       with_(SQL_ARCS, sql_great_circle(192), SQL_LENGTH, SQL_CLIM, sql_corners("gc", "arc_id, s")) + """,
dd AS (SELECT arc_id, s, sum(coalesce(d, 0)) OVER (PARTITION BY arc_id ORDER BY s) AS dist_km FROM leg),
x AS (SELECT arc_id, s, month, level, CASE WHEN count(u) = 4 THEN sum(wt * u) ELSE avg(u) END AS u
  FROM cor JOIN clim USING (lat_idx, lon_idx) GROUP BY ALL),
result AS (SELECT dd.arc_id, dd.s, m.month, m.level, dist_km, u FROM dd CROSS JOIN (SELECT DISTINCT month, level FROM clim) m
  LEFT JOIN x ON x.arc_id = dd.arc_id AND x.s = dd.s AND x.month = m.month AND x.level = m.level)""")
def upper_section(spark, sf):
    pts = sm.great_circle(tables.arc_ends(spark, sf), ["arc_id"], 192)
    return sm.arc_section(pts, ["arc_id"], clim(spark, sf, "u"), ["month", "level"], ["u"], SPEC, SPEC.slices(spark))


@query("P20_barb_sites", "month:i level:i lat:6 lon:6 speed:6 pennants:i full:i half:i", with_(SQL_CLIM) + """,
b AS (SELECT -82.0 + 8.0 * i AS lat FROM range(21) AS r(i)),
n AS (SELECT lat, greatest(3, floor(360 / least(30.0, 8 / greatest(0.1, cos(radians(lat)))) + 0.5))::INT AS n FROM b),
st AS (SELECT lat, -180 + j * (360.0::DOUBLE / n) AS lon FROM n, LATERAL (SELECT unnest(range(n)) AS j)),
""" + sql_corners("st", "lat, lon") + """,
x AS (SELECT month, level, lat, lon, CASE WHEN count(u) = 4 THEN sum(wt * u) ELSE avg(u) END AS u, CASE WHEN count(v) = 4 THEN sum(wt * v) ELSE avg(v) END AS v
  FROM cor JOIN clim USING (lat_idx, lon_idx) GROUP BY ALL),
k AS (SELECT *, sqrt(u*u + v*v) AS speed, sqrt(u*u + v*v) * 1.94384::DOUBLE AS kt FROM x),
f AS (SELECT *, floor(kt / 50) AS p FROM k), g AS (SELECT *, floor((kt - p * 50) / 10) AS q FROM f),
result AS (SELECT month, level, lat, lon, speed, p AS pennants, q AS "full", (kt - p * 50 - q * 10 >= 4.5)::INT AS half FROM g WHERE speed >= 1.5)""")
def barb_sites(spark, sf):
    at = sm.bilinear(sm.barb_sites(spark), ["lat", "lon"], clim(spark, sf, "u", "v"), ["month", "level"], ["u", "v"], SPEC, SPEC.slices(spark))
    at = at.withColumn("speed", fx.wind_speed(F.col("u"), F.col("v"))).withColumn("b", fx.wind_barb(F.col("speed")))
    return at.where("b IS NOT NULL").select("month", "level", "lat", "lon", "speed", "b.*")


SQL_CROSS = """,
c0 AS (SELECT month, level, lat_idx, lon_idx, t AS v, floor(t / 0.5) AS k FROM clim),
c1 AS (SELECT b.month, b.level, b.lon_idx, b.lat_idx, b.v, b.k, a.v AS pv, a.k AS pk FROM c0 b JOIN c0 a
  ON a.month = b.month AND a.level = b.level AND a.lon_idx = b.lon_idx AND a.lat_idx = b.lat_idx - 1 WHERE a.k <> b.k),
c2 AS (SELECT *, (CASE WHEN k > pk THEN k ELSE k + 1 END) * 0.5 AS contour FROM c1),
cr AS (SELECT month, level, lon_idx, lat_idx, contour,
  90.0 - 15.0 * (lat_idx - 1) - 15.0 * (contour - pv) / (v - pv) AS lat FROM c2)"""


@query("W11_contour_crossings", "month:i level:i lon_idx:i lat_idx:i contour:4 lat:6", with_(SQL_CLIM) + SQL_CROSS + """,
result AS (SELECT * FROM cr)""")
def contour_crossings(spark, sf):
    return sm.contour_crossings(clim(spark, sf, "t"), ["month", "level", "lon_idx"], "t", 0.5, SPEC, min_gap_deg=None)


@query("W11_contour_labels_spaced", "month:i level:i lon_idx:i lat_idx:i contour:4 lat:6",
       "WITH RECURSIVE " + with_(SQL_CLIM)[5:] + SQL_CROSS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY month, level, lon_idx ORDER BY lat_idx) AS rn FROM cr),
walk AS (SELECT *, lat AS last, TRUE AS kept FROM o WHERE rn = 1 UNION ALL
  SELECT o.*, CASE WHEN abs(o.lat - w.last) >= 12 THEN o.lat ELSE w.last END, abs(o.lat - w.last) >= 12
  FROM walk w JOIN o ON o.month = w.month AND o.level = w.level AND o.lon_idx = w.lon_idx AND o.rn = w.rn + 1),
result AS (SELECT * FROM walk WHERE kept)""")
def contour_labels(spark, sf):
    return sm.contour_crossings(clim(spark, sf, "t"), ["month", "level", "lon_idx"], "t", 0.5, SPEC, min_gap_deg=12.0)


@query("K20_surface_wind_for_surface_fields", "month:i lat_idx:i lon_idx:i sst:6 u:6 v:6", with_(SQL_SURFACE) + """,
result AS (SELECT month, lat_idx, lon_idx, sst, u10 AS u, v10 AS v FROM sclim)""")
def surface_wind(spark, sf):
    c = surface_clim(spark, sf, "sst", "u10", "v10")
    return c.withColumnsRenamed({"u10": "u", "v10": "v"})


@query("K21_orbit", "month:i theta:8 x:8 z:8 n:l", """WITH
result AS (SELECT month(l_shipdate) AS month, month(l_shipdate) * pi() / 6 AS theta, cos(month(l_shipdate) * pi() / 6) AS x,
  sin(month(l_shipdate) * pi() / 6) AS z, count(*) AS n FROM lineitem GROUP BY ALL)""")
def orbit(spark, sf):
    m = tables.upper_samples(spark, sf).groupBy("month").agg(F.count("*").alias("n"))
    th = fx.heliocentric_angle(F.col("month"))
    return m.select("month", "n", th.alias("theta"), F.cos(th).alias("x"), F.sin(th).alias("z"))


@query("K22_S21_annual_frames", "month:i level:i lat_idx:i lon_idx:i u:6", with_(SQL_CLIM) + """,
result AS (SELECT m AS month, l AS level, i AS lat_idx, j AS lon_idx, u FROM range(1, 13) AS a(m),
  (SELECT unnest([200, 300, 500, 700, 850, 925, 1000]) AS l), range(13) AS b(i), range(12) AS c(j)
  LEFT JOIN clim ON clim.month = m AND clim.level = l AND clim.lat_idx = i AND clim.lon_idx = j)""")
def annual_frames(spark, sf):
    """Twelve dense frames per level, ready to be drawn in a loop."""
    return SPEC.densify(clim(spark, sf, "u"), ["level"], ["month", "lat_idx", "lon_idx"], SPEC.level_slices(spark)).select("month", *CELL, "u")
