"""Derivatives, integrals, vertical interpolation, budgets and the energy cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalis.functions import fields as fx
from zonalis.operators import budgets, calculus, diagnostics, ep_flux, lorenz, ranks, reduce, vertical
from zonalis.plans.catalogue.base import (CELL, DYM, ROW, SPEC, SQL_CLIM, SQL_LEVELS, SQL_SAMPLES, SQL_SURFACE, clim,
                                          monthly, query, surface_clim, surface_monthly, with_)
from zonalis.sources import tables

PANEL = "month:i level:i lat_idx:i "
COLUMN = ["month", "lat_idx", "lon_idx"]

# A zonal table on the full (month, level, lat) panel with positions k and i.
SQL_PANEL = """,
zm AS (SELECT month, level, lat_idx, avg(u) AS u, avg(v) AS v, avg(w) AS w, avg(t) AS t, avg(z) AS z, avg(q) AS q
  FROM clim GROUP BY ALL),
panel AS (SELECT m.month, l.k, l.p AS level, a.i AS lat_idx, a.lat, a.c, zm.u, zm.v, zm.w, zm.t, zm.z, zm.q
  FROM (SELECT DISTINCT month FROM clim) m, lev l, lats a
  LEFT JOIN zm ON zm.month = m.month AND zm.level = l.p AND zm.lat_idx = a.i)"""
BASE = with_(SQL_CLIM, SQL_LEVELS) + SQL_PANEL

YW = "(PARTITION BY month, level ORDER BY lat_idx)"
PW = "(PARTITION BY month, lat_idx ORDER BY k)"


def sql_dy(x: str) -> str:
    """Northward derivative on the 15-degree panel, one-sided at both ends."""
    return (f"((CASE WHEN lat_idx = 0 THEN {x} ELSE lag({x}) OVER {YW} END"
            f" - CASE WHEN lat_idx = 12 THEN {x} ELSE lead({x}) OVER {YW} END)"
            f" / ((least(lat_idx + 1, 12) - greatest(lat_idx - 1, 0)) * {DYM}))")


def sql_dp(x: str) -> str:
    return (f"((CASE WHEN k = 6 THEN {x} ELSE lead({x}) OVER {PW} END"
            f" - CASE WHEN k = 0 THEN {x} ELSE lag({x}) OVER {PW} END)"
            f" / ((coalesce(lead(level) OVER {PW}, level) - coalesce(lag(level) OVER {PW}, level)) * 100.0))")


# basic calculus ---------------------------------------------------------------------------
@query("W4_d_dy", PANEL + "dudy:8", BASE + f""",
result AS (SELECT month, level, lat_idx, {sql_dy('u')} * 1e5 AS dudy FROM panel)""")
def d_dy(spark, sf):
    z = diagnostics.zonal_table(clim(spark, sf, "u"), ["month"], ["u"], SPEC)
    ax = calculus.lat_axis(SPEC, ["month", "level"])
    return z.withColumn("dudy", calculus.d_dy(F.col("u"), ax, SPEC) * 1e5)


@query("W5_d_dp", PANEL + "dtdp:8", BASE + f""",
result AS (SELECT month, level, lat_idx, {sql_dp('t')} * 100 AS dtdp FROM panel)""")
def d_dp(spark, sf):
    z = diagnostics.zonal_table(clim(spark, sf, "t"), ["month"], ["t"], SPEC)
    ax = calculus.level_axis(SPEC, ["month", "lat_idx"])
    return z.withColumn("dtdp", calculus.d_dp(F.col("t"), ax, SPEC) * 100)


@query("J12_W5_gaps_stay_gaps", "year:i month:i level:i lat_idx:i lon_idx:i dtdp:8", with_(SQL_SAMPLES, SQL_LEVELS) + """,
c AS (SELECT m.*, l.k FROM mon m JOIN lev l ON l.p = m.level),
result AS (SELECT x.year, x.month, x.level, x.lat_idx, x.lon_idx,
  ((CASE WHEN x.k = 6 THEN x.t ELSE b.t END) - (CASE WHEN x.k = 0 THEN x.t ELSE a.t END))
  / ((lb.p - la.p) * 100.0) * 100 AS dtdp
  FROM c x LEFT JOIN c a ON a.year = x.year AND a.month = x.month AND a.lat_idx = x.lat_idx AND a.lon_idx = x.lon_idx AND a.k = x.k - 1
  LEFT JOIN c b ON b.year = x.year AND b.month = x.month AND b.lat_idx = x.lat_idx AND b.lon_idx = x.lon_idx AND b.k = x.k + 1
  JOIN lev la ON la.k = greatest(x.k - 1, 0) JOIN lev lb ON lb.k = least(x.k + 1, 6))""")
def sparse_d_dp(spark, sf):
    """On sparse single-year columns: a neighbour counts only if it is the adjacent level."""
    m = calculus.with_level_index(monthly(spark, sf, "t"), SPEC)
    ax = calculus.level_axis(SPEC, ["year", *COLUMN])
    return m.withColumn("dtdp", calculus.d_dp(F.col("t"), ax, SPEC) * 100)


@query("G18_trapezoid", "month:i lat_idx:i lon_idx:i column_u:4", with_(SQL_CLIM, SQL_LEVELS) + """,
c AS (SELECT x.month, x.lat_idx, x.lon_idx, l.k, l.p, x.u FROM clim x JOIN lev l ON l.p = x.level),
pairs AS (SELECT a.month, a.lat_idx, a.lon_idx, 0.5 * (a.u + b.u) * (b.p - a.p) * 100 AS s
  FROM c a JOIN c b ON a.month = b.month AND a.lat_idx = b.lat_idx AND a.lon_idx = b.lon_idx AND b.k = a.k + 1),
result AS (SELECT d.month, d.lat_idx, d.lon_idx, coalesce(sum(s), 0) / 1e5 AS column_u
  FROM (SELECT DISTINCT month, lat_idx, lon_idx FROM clim) d LEFT JOIN pairs USING (month, lat_idx, lon_idx) GROUP BY ALL)""")
def trapezoid(spark, sf):
    i = calculus.integrate_p(clim(spark, sf, "u"), COLUMN, ["u"], SPEC)
    return i.withColumn("column_u", F.col("u") / 1e5)


def sql_smooth_lat(src: str, dst: str, keys: str = "month, level") -> str:
    terms = [(-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)]
    w = f"(PARTITION BY {keys} ORDER BY lat_idx)"
    at = {o: ("value" if o == 0 else f"{'lag' if o < 0 else 'lead'}(value, {abs(o)}) OVER {w}") for o, _ in terms}
    num = " + ".join(f"coalesce({at[o]}, 0) * {k}" for o, k in terms)
    den = " + ".join(f"(CASE WHEN {at[o]} IS NULL THEN 0 ELSE {k} END)" for o, k in terms)
    return f"{dst} AS (SELECT * EXCLUDE (value), ({num}) / nullif({den}, 0)::DOUBLE AS value FROM {src})"


def sql_smooth_lev(src: str, dst: str, keys: str = "month, lat_idx") -> str:
    w = f"(PARTITION BY {keys} ORDER BY k)"
    a, b = f"lag(value) OVER {w}", f"lead(value) OVER {w}"
    return (f"{dst} AS (SELECT * EXCLUDE (value), (coalesce({a}, 0) + 2 * coalesce(value, 0) + coalesce({b}, 0))"
            f" / nullif((CASE WHEN {a} IS NULL THEN 0 ELSE 1 END) + (CASE WHEN value IS NULL THEN 0 ELSE 2 END)"
            f" + (CASE WHEN {b} IS NULL THEN 0 ELSE 1 END), 0)::DOUBLE AS value FROM {src})")


HOLES = "CASE WHEN (lat_idx + k) % 5 <> 0 THEN u END"


@query("W7_smooth_lat", PANEL + "value:7", BASE + f""",
s0 AS (SELECT month, level, k, lat_idx, {HOLES} AS value FROM panel), """
       + ", ".join([sql_smooth_lat("s0", "s1"), sql_smooth_lat("s1", "s2"), sql_smooth_lat("s2", "result")]))
def smooth_lat(spark, sf):
    z = diagnostics.zonal_table(clim(spark, sf, "u"), ["month"], ["u"], SPEC)
    z = z.withColumn("value", F.when((F.col("lat_idx") + F.col("lev_idx")) % 5 != 0, F.col("u")))
    return calculus.smooth_lat(z, "value", ["month", "level"], SPEC)


@query("W8_smooth_level", PANEL + "value:7", BASE + f""",
s0 AS (SELECT month, level, k, lat_idx, {HOLES} AS value FROM panel), """ + sql_smooth_lev("s0", "result"))
def smooth_level(spark, sf):
    z = diagnostics.zonal_table(clim(spark, sf, "u"), ["month"], ["u"], SPEC)
    z = z.withColumn("value", F.when((F.col("lat_idx") + F.col("lev_idx")) % 5 != 0, F.col("u")))
    return calculus.smooth_level(z, "value", ["month", "lat_idx"], SPEC)


@query("W9_periodic_gradient", "month:i lat_idx:i lon_idx:i slope:5", with_(SQL_SURFACE) + """,
result AS (SELECT s.month, s.lat_idx, s.lon_idx, (e.oro - w.oro) / (2 * 2 * pi() / 12) AS slope FROM sclim s
  LEFT JOIN sclim e ON e.month = s.month AND e.lat_idx = s.lat_idx AND e.lon_idx = (s.lon_idx + 1) % 12
  LEFT JOIN sclim w ON w.month = s.month AND w.lat_idx = s.lat_idx AND w.lon_idx = (s.lon_idx + 11) % 12)""")
def periodic_gradient(spark, sf):
    c = surface_clim(spark, sf, "oro")
    return c.withColumn("slope", calculus.d_dlambda(F.col("oro"), ["month", "lat_idx"], SPEC))


# vertical interpolation ------------------------------------------------------------------------
def sql_isentrope(source: str, keys: str, value: str, theta0: float, dst: str = "result") -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    sel = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""th_{dst} AS (SELECT {keys}, l.k, {value} AS x, t * pow(1000.0 / level, 0.2854) AS th
  FROM {source} JOIN lev l ON l.p = level),
br_{dst} AS (SELECT {sel}, a.k, a.x + (a.th - {theta0}) / (a.th - b.th) * (b.x - a.x) AS x
  FROM th_{dst} a JOIN th_{dst} b ON {on} AND b.k = a.k + 1 WHERE a.th >= {theta0} AND {theta0} > b.th),
first_{dst} AS (SELECT {keys}, arg_min(x, k) AS x, min(k) AS k FROM br_{dst} GROUP BY ALL),
{dst} AS (SELECT d.*, f.x AS {value} FROM (SELECT DISTINCT {keys} FROM th_{dst}) d LEFT JOIN first_{dst} f USING ({keys}))"""


@query("V1_J9_isentropic", "month:i lat_idx:i lon_idx:i u:6",
       with_(SQL_CLIM, SQL_LEVELS, sql_isentrope("clim", "month, lat_idx, lon_idx", "u", 330.0)))
def isentropic(spark, sf):
    return vertical.on_isentrope(clim(spark, sf, "t", "u"), COLUMN, ["u"], 330.0, SPEC)


@query("V1_isentropic_single_years", "year:i month:i lat_idx:i lon_idx:i u:6",
       with_(SQL_SAMPLES, SQL_LEVELS, sql_isentrope("mon", "year, month, lat_idx, lon_idx", "u", 350.0)))
def isentropic_years(spark, sf):
    """Sparse columns: only adjacent levels may bracket the surface."""
    return vertical.on_isentrope(monthly(spark, sf, "t", "u"), ["year", *COLUMN], ["u"], 350.0, SPEC)


@query("V2_pv_on_theta", "month:i lat_idx:i lon_idx:i pv:6",
       with_(SQL_CLIM, SQL_LEVELS, sql_isentrope("clim", "month, lat_idx, lon_idx", "pv", 330.0)))
def pv_on_theta(spark, sf):
    return vertical.on_isentrope(clim(spark, sf, "t", "pv"), COLUMN, ["pv"], 330.0, SPEC)


@query("V3_derived_on_theta", "month:i lat_idx:i lon_idx:i wspd:6 mse:4",
       with_(SQL_CLIM, SQL_LEVELS, *[sql_isentrope("clim", "month, lat_idx, lon_idx", f, 330.0, f"s_{f}") for f in "uvzq"],
             sql_isentrope("(SELECT *, t AS temp FROM clim)", "month, lat_idx, lon_idx", "temp", 330.0, "s_t")) + """,
result AS (SELECT month, lat_idx, lon_idx, sqrt(u*u + v*v) AS wspd,
  (1004 * temp + 9.80665::DOUBLE * z + 2.501e6 * (q / 1000)) / 1004 AS mse
  FROM s_u JOIN s_v USING (month, lat_idx, lon_idx) JOIN s_z USING (month, lat_idx, lon_idx)
  JOIN s_q USING (month, lat_idx, lon_idx) JOIN s_t USING (month, lat_idx, lon_idx))""")
def derived_on_theta(spark, sf):
    """Ingredients are interpolated first, then combined."""
    c = vertical.on_isentrope(clim(spark, sf, "u", "v", "t", "z", "q"), COLUMN, ["u", "v", "t", "z", "q"], 330.0, SPEC)
    return c.select(*COLUMN, fx.wind_speed(F.col("u"), F.col("v")).alias("wspd"),
                    fx.mse_kelvin(F.col("t"), F.col("z"), F.col("q")).alias("mse"))


@query("J10_log_pressure", "month:i lat_idx:i lon_idx:i u:6", with_(SQL_CLIM) + """,
result AS (SELECT month, lat_idx, lon_idx,
  max(u) FILTER (level = 500) * (1 - ln(600.0 / 500) / ln(700.0 / 500)) + max(u) FILTER (level = 700) * ln(600.0 / 500) / ln(700.0 / 500) AS u
  FROM clim WHERE level IN (500, 700) GROUP BY ALL)""")
def log_pressure(spark, sf):
    return vertical.at_pressure(clim(spark, sf, "u"), COLUMN, ["u"], 600.0, SPEC)


# zonal-mean diagnostics ---------------------------------------------------------------------------
@query("K1_W6_streamfunction", PANEL + "value:5", BASE + f""",
lay AS (SELECT *, CASE WHEN k > 0 THEN 0.5 * (lag(v) OVER {PW} + v) * (level - lag(level) OVER {PW}) * 100 END AS s FROM panel),
result AS (SELECT month, level, lat_idx, CASE WHEN k = 0 THEN 0 WHEN s IS NOT NULL THEN
  2 * pi() * 6.371e6 * c / 9.80665::DOUBLE / 1e9 * sum(coalesce(s, 0)) OVER {PW} END AS value FROM lay)""")
def streamfunction(spark, sf):
    return diagnostics.mass_streamfunction(clim(spark, sf, "v"), SPEC)


@query("K1_W6_streamfunction_with_gaps", PANEL + "value:5", BASE + f""",
g AS (SELECT * REPLACE (CASE WHEN (lat_idx + k) % 4 <> 1 THEN v END AS v) FROM panel),
lay AS (SELECT *, CASE WHEN k > 0 THEN 0.5 * (lag(v) OVER {PW} + v) * (level - lag(level) OVER {PW}) * 100 END AS s FROM g),
acc AS (SELECT *, sum(coalesce(s, 0)) OVER {PW} AS a FROM lay),
result AS (SELECT month, level, lat_idx, CASE WHEN k = 0 THEN 0 WHEN s IS NOT NULL THEN
  2 * pi() * 6.371e6 * c / 9.80665::DOUBLE / 1e9 * a END AS value FROM acc)""")
def streamfunction_gaps(spark, sf):
    c = calculus.with_level_index(clim(spark, sf, "v"), SPEC)
    c = c.withColumn("v", F.when((F.col("lat_idx") + F.col("lev_idx")) % 4 != 1, F.col("v"))).drop("lev_idx")
    return diagnostics.mass_streamfunction(c, SPEC)


@query("K2_ang_momentum", PANEL + "value:8", BASE + """,
result AS (SELECT month, level, lat_idx, (7.2921e-5 * 6.371e6 * c + u) * 6.371e6 * c / 1e9 AS value FROM panel)""")
def ang_momentum(spark, sf):
    return diagnostics.angular_momentum(clim(spark, sf, "u"), SPEC)


@query("K3_P17_geostrophic", PANEL + "value:5", BASE + f""",
result AS (SELECT month, level, lat_idx, CASE WHEN abs(lat) >= 5 THEN
  -9.80665::DOUBLE * {sql_dy('z')} / nullif(2 * 7.2921e-5 * sin(radians(lat)), 0) END AS value FROM panel)""")
def geostrophic(spark, sf):
    return diagnostics.geostrophic_wind(clim(spark, sf, "z"), SPEC)


@query("K4_brunt_vaisala", PANEL + "value:6", BASE + f""",
th AS (SELECT *, t * pow(1000.0 / level, 0.2854) AS th FROM panel),
result AS (SELECT month, level, lat_idx, -(9.80665::DOUBLE * 9.80665::DOUBLE * level * 100 / (287.04::DOUBLE * t * th))
  * {sql_dp('th')} / 1e-4 AS value FROM th)""")
def brunt_vaisala(spark, sf):
    return diagnostics.brunt_vaisala(clim(spark, sf, "t"), SPEC)


SQL_EP = f""",
dev AS (SELECT month, level, lat_idx, u, v, t * pow(1000.0 / level, 0.2854) AS th FROM clim),
cov AS (SELECT month, level, lat_idx, avg(u * v) - avg(u) * avg(v) AS uv, avg(v * th) - avg(v) * avg(th) AS vth,
  avg(th) AS th FROM dev GROUP BY ALL),
e AS (SELECT p.month, p.level, p.k, p.lat_idx, p.lat, p.c, cov.uv, cov.vth, cov.th FROM panel p
  LEFT JOIN cov USING (month, level, lat_idx)),
st AS (SELECT *, {sql_dp('th')} AS dth FROM e),
fl AS (SELECT *, CASE WHEN c >= 1e-3 THEN -6.371e6 * c * uv END AS f_phi,
  CASE WHEN c >= 1e-3 AND abs(dth) >= 1e-7 THEN 6.371e6 * c * 2 * 7.2921e-5 * sin(radians(lat)) * vth / dth END AS f_p FROM st),
dv AS (SELECT *, CASE WHEN c > 1e-3 THEN {sql_dy('(f_phi * c)')} * 6.371e6 END AS dphi, {sql_dp('f_p')} AS dfp FROM fl)"""


def _ep_result(sign: str) -> str:
    return f""",
result AS (SELECT month, level, lat_idx, f_phi / 1e6 AS f_phi, f_p / 1e8 AS f_p,
  ({sign} dphi / (6.371e6 * c) + dfp) / (6.371e6 * c) * 86400 AS div FROM dv)"""


@query("K5_ep_flux", PANEL + "f_phi:5 f_p:5 div:4", BASE + SQL_EP + _ep_result("+"))
def ep(spark, sf):
    f = ep_flux.ep_flux(clim(spark, sf, "u", "v", "t"), SPEC)
    return f.withColumn("f_phi", F.col("f_phi") / 1e6).withColumn("f_p", F.col("f_p") / 1e8)


@query("K5_ep_flux_original_sign", PANEL + "f_phi:5 f_p:5 div:4", BASE + SQL_EP + _ep_result("-"))
def ep_literal(spark, sf):
    f = ep_flux.ep_flux(clim(spark, sf, "u", "v", "t"), SPEC, literal_sign=True)
    return f.withColumn("f_phi", F.col("f_phi") / 1e6).withColumn("f_p", F.col("f_p") / 1e8)


@query("O6_ep_arrows", PANEL + "dx:5 dy:5", BASE + SQL_EP + """,
g AS (SELECT *, max(abs(f_phi)) OVER (PARTITION BY month) / max(abs(f_p)) OVER (PARTITION BY month) AS gain FROM dv),
result AS (SELECT month, level, lat_idx, f_phi / 1e6 AS dx, f_p * gain / 1e6 AS dy FROM g
  WHERE lat_idx >= 2 AND lat_idx % 2 = 0 AND abs(lat) <= 80 AND f_phi IS NOT NULL AND f_p IS NOT NULL)""")
def ep_arrows(spark, sf):
    f = ep_flux.ep_flux(clim(spark, sf, "u", "v", "t"), SPEC)
    a = ep_flux.arrows(f, SPEC, lat_stride=2)
    return a.withColumn("dx", F.col("dx") / 1e6).withColumn("dy", F.col("dy") / 1e6)


# budgets ---------------------------------------------------------------------------------------------
def sql_budget(kind: str) -> str:
    x = {"momentum": "u", "moisture": "(q * 1e-3)",
         "energy": "(1004 * t + 9.80665::DOUBLE * z + 2.501e6 * (q * 1e-3))"}[kind]
    m = "((7.2921e-5 * 6.371e6 * c + x) * 6.371e6 * c)" if kind == "momentum" else "x"
    metric = "(c * c * vx)" if kind == "momentum" else "(c * vx)"
    es = "6.371e6 *" if kind == "momentum" else ""
    ep = "6.371e6 * c *" if kind == "momentum" else ""
    res = "torque" if kind == "momentum" else "source"
    terms = ["mean_y", "mean_p", "eddy_y", "eddy_p", "total", res]
    return f""",
bc AS (SELECT month, level, lat_idx, v, w, {x} AS x FROM clim),
bd AS (SELECT *, v - avg(v) OVER r AS dv, w - avg(w) OVER r AS dw, x - avg(x) OVER r AS dx FROM bc
  WINDOW r AS (PARTITION BY month, level, lat_idx)),
bz AS (SELECT month, level, lat_idx, avg(v) AS v, avg(w) AS w, avg(x) AS x, avg(dv * dx) AS vx, avg(dw * dx) AS wx FROM bd GROUP BY ALL),
bp AS (SELECT p.month, p.level, p.k, p.lat_idx, p.c, z.v, z.w, z.x, z.vx, z.wx FROM panel p LEFT JOIN bz z USING (month, level, lat_idx)),
bm AS (SELECT *, v * {m} * c AS fy, w * {m} AS fp, {metric} AS ey FROM bp),
bt AS (SELECT month, level, k, lat_idx, c, CASE WHEN c >= 1e-3 THEN -{sql_dy('fy')} / c END AS mean_y,
  CASE WHEN c >= 1e-3 THEN -{sql_dp('fp')} END AS mean_p, CASE WHEN c >= 1e-3 THEN -{es} {sql_dy('ey')} / c END AS eddy_y,
  CASE WHEN c >= 1e-3 THEN -{ep} {sql_dp('wx')} END AS eddy_p FROM bm),
bs AS (SELECT *, coalesce(mean_y, 0) + coalesce(mean_p, 0) + coalesce(eddy_y, 0) + coalesce(eddy_p, 0) AS total FROM bt),
bl AS (SELECT month, level, k, lat_idx, c, unnest({terms}) AS term,
  unnest([mean_y, mean_p, eddy_y, eddy_p, total, -total]) AS value FROM bs),
{sql_smooth_lat('bl', 'bl1', 'month, level, term')}, {sql_smooth_lat('bl1', 'bl2', 'month, level, term')},
{sql_smooth_lat('bl2', 'bl3', 'month, level, term')}, {sql_smooth_lev('bl3', 'terms', 'month, lat_idx, term')}"""


def sql_column(value: str, scale: str) -> str:
    w = "(PARTITION BY month, term, lat_idx ORDER BY k)"
    return f""",
disp AS (SELECT month, term, lat_idx, k, level, {value} AS value FROM terms),
seg AS (SELECT month, term, lat_idx, 0.5 * (lag(value) OVER {w} + value) * (level - lag(level) OVER {w}) * 100 AS s FROM disp),
result AS (SELECT month, term, lat_idx, coalesce(sum(s), 0) {scale} AS value FROM seg GROUP BY ALL)"""


FIELDS_OF = {"momentum": ("u", "v", "w"), "moisture": ("v", "w", "q"), "energy": ("v", "w", "t", "z", "q")}
BUDGET = {"momentum": budgets.MOMENTUM, "moisture": budgets.MOISTURE, "energy": budgets.ENERGY}
SHOW = {("momentum", "u"): "CASE WHEN c > 1e-3 THEN value / (6.371e6 * c) * 86400 END",
        ("momentum", "M"): "value * 86400 / 1e6", ("moisture", "q"): "value * 1000 * 86400",
        ("energy", "h"): "value / 1004 * 86400", ("energy", "H"): "value * 86400 / 1e3"}
LETTER = {"momentum": "m", "moisture": "q", "energy": "h"}
OPID = {"momentum": "K6_K7", "moisture": "K9", "energy": "K11"}


def _register_budget(kind: str, form: str, digits: int, suffix: str = "") -> None:
    name = f"{OPID[kind]}_{LETTER[kind]}_budget{suffix}"
    base = BASE + sql_budget(kind)
    b = BUDGET[kind]

    def terms(spark, sf):
        return budgets.budget_terms(clim(spark, sf, *FIELDS_OF[kind]), SPEC, b)

    query(name, f"month:i level:i lat_idx:i term:s value:{digits}", base + f""",
result AS (SELECT month, level, lat_idx, term, {SHOW[kind, form]} AS value FROM terms)""")(
        lambda spark, sf: budgets.section(terms(spark, sf), SPEC, b, form))
    query(f"G19_{name}_1d_mean", f"month:i lat_idx:i term:s value:{digits}",
          base + sql_column(SHOW[kind, form], "/ 100000.0"))(
        lambda spark, sf: budgets.column_mean(terms(spark, sf), SPEC, b, form))
    integral, scale = {
        "momentum": ("CASE WHEN c >= 1e-3 THEN " + ("value / (6.371e6 * c)" if form == "u" else "value") + " END",
                     "/ 9.80665::DOUBLE"),
        "moisture": ("value", "* 86400 / 9.80665::DOUBLE"), "energy": ("value", "/ 9.80665::DOUBLE")}[kind]
    if form == "M":
        scale += " / 1e6"

    def integrated(spark, sf):
        out = budgets.column_integral(terms(spark, sf), SPEC, b, form)
        return out.withColumn("value", F.col("value") / 1e6) if form == "M" else out

    query(f"G19_{name}_1d_int", f"month:i lat_idx:i term:s value:{digits}", base + sql_column(integral, scale))(integrated)


_register_budget("momentum", "u", 4)
_register_budget("momentum", "M", 3, "_form_M")
_register_budget("moisture", "q", 4)
_register_budget("energy", "h", 3)
_register_budget("energy", "H", 3, "_form_H")


def sql_percentile_limits(source: str, lo: float, hi: float, keys: str = "month") -> str:
    return f"""
lim AS (SELECT {keys}, greatest({lo}::DOUBLE, least({hi}::DOUBLE, coalesce(
  list_sort(list(abs(value)) FILTER (WHERE value IS NOT NULL))[CAST(floor(0.95::DOUBLE * (count(value) - 1)) AS BIGINT) + 1], 0))) AS vmax
  FROM {source} GROUP BY {keys}),
result AS (SELECT *, -vmax AS vmin FROM lim)"""


@query("P24_K3_geostrophic_display_limits", "month:i vmin:5 vmax:5", BASE + f""",
g AS (SELECT month, CASE WHEN abs(lat) >= 5 THEN
  -9.80665::DOUBLE * {sql_dy('z')} / nullif(2 * 7.2921e-5 * sin(radians(lat)), 0) END AS value FROM panel),"""
       + sql_percentile_limits("g", 5, 100))
def geostrophic_limits(spark, sf):
    """95th-percentile colour bound, held between 5 and 100 m/s; values stay as they are."""
    return diagnostics.display_limits(diagnostics.geostrophic_wind(clim(spark, sf, "z"), SPEC), ["month"], "value", "geostrophic")


@query("P24_K4_brunt_vaisala_display_limits", "month:i vmin:5 vmax:5", BASE + f""",
th AS (SELECT *, t * pow(1000.0 / level, 0.2854) AS th FROM panel),
n2 AS (SELECT month, -(9.80665::DOUBLE * 9.80665::DOUBLE * level * 100 / (287.04::DOUBLE * t * th)) * {sql_dp('th')} / 1e-4 AS value FROM th),
result AS (SELECT month, greatest(-2.0, coalesce(min(value), 0)) AS vmin, least(12.0, coalesce(max(value), 4)) AS vmax FROM n2 GROUP BY month)""")
def brunt_vaisala_limits(spark, sf):
    """Lower and upper end have limits of their own."""
    return diagnostics.display_limits(diagnostics.brunt_vaisala(clim(spark, sf, "t"), SPEC), ["month"], "value", "brunt_vaisala")


@query("P24_K5_ep_flux_display_limits", "month:i vmin:4 vmax:4", BASE + SQL_EP + _ep_result("+").replace("result AS", "ep AS") + """,
result AS (SELECT month, -greatest(1.0, least(20.0, coalesce(max(abs(div)), 0))) AS vmin, greatest(1.0, least(20.0, coalesce(max(abs(div)), 0))) AS vmax FROM ep GROUP BY month)""")
def ep_limits(spark, sf):
    return diagnostics.display_limits(ep_flux.ep_flux(clim(spark, sf, "u", "v", "t"), SPEC), ["month"], "div", "ep_flux")


@query("P24_V2_pv_display_limits", "month:i vmin:6 vmax:6",
       with_(SQL_CLIM, SQL_LEVELS, sql_isentrope("clim", "month, lat_idx, lon_idx", "pv", 330.0, "onth")) + """,
result AS (SELECT month, greatest(-10.0, coalesce(min(pv), 0)) AS vmin, least(10.0, coalesce(max(pv), 1)) AS vmax FROM onth GROUP BY month)""")
def pv_limits(spark, sf):
    pv = vertical.on_isentrope(clim(spark, sf, "t", "pv"), COLUMN, ["pv"], 330.0, SPEC)
    return diagnostics.display_limits(pv, ["month"], "pv", "pv")


def _register_limits(kind: str, form: str, which: str) -> None:
    _, lo, hi = diagnostics.DISPLAY_LIMITS[which]

    @query(f"P24_{OPID[kind]}_{which}_display_limits", "month:i term:s vmin:4 vmax:4", BASE + sql_budget(kind) + f""",
disp AS (SELECT month, term, {SHOW[kind, form]} AS value FROM terms),""" + sql_percentile_limits("disp", lo, hi, "month, term"))
    def limits(spark, sf):
        terms = budgets.budget_terms(clim(spark, sf, *FIELDS_OF[kind]), SPEC, BUDGET[kind])
        return diagnostics.display_limits(budgets.section(terms, SPEC, BUDGET[kind], form), ["month", "term"], "value", which)


_register_limits("momentum", "u", "m_budget_u")
_register_limits("momentum", "M", "m_budget_M")
_register_limits("moisture", "q", "q_budget")
_register_limits("energy", "h", "h_budget_h")
_register_limits("energy", "H", "h_budget_H")


# surface terms -----------------------------------------------------------------------------------------
@query("K8_friction_torque", "month:i lat_idx:i value:7", with_(SQL_SURFACE) + """,
result AS (SELECT month, lat_idx, -avg(ews) AS value FROM sclim GROUP BY ALL)""")
def friction(spark, sf):
    return diagnostics.friction_torque(surface_clim(spark, sf, "ews"))


SQL_MOUNTAIN = """,
g AS (SELECT s.month, s.lat_idx, s.sp * 100 * (e.oro - w.oro) / (2 * 2 * pi() / 12) AS f FROM sclim s
  LEFT JOIN sclim e ON e.month = s.month AND e.lat_idx = s.lat_idx AND e.lon_idx = (s.lon_idx + 1) % 12
  LEFT JOIN sclim w ON w.month = s.month AND w.lat_idx = s.lat_idx AND w.lon_idx = (s.lon_idx + 11) % 12)"""


@query("K8_W9_mountain_torque", "month:i lat_idx:i value:7", with_(SQL_SURFACE) + SQL_MOUNTAIN + """,
result AS (SELECT month, lat_idx, avg(f) / 6.371e6 AS value FROM g GROUP BY ALL)""")
def mountain(spark, sf):
    return diagnostics.mountain_torque(surface_clim(spark, sf, "sp", "oro"), SPEC)


@query("K8_torque_overlays", "month:i lat_idx:i u_form:6 m_form:6 stress:6", with_(SQL_SURFACE) + SQL_MOUNTAIN + """,
x AS (SELECT month, lat_idx, avg(f) / 6.371e6 AS m FROM g GROUP BY ALL),
y AS (SELECT month, lat_idx, -avg(ews) AS f FROM sclim GROUP BY ALL),
result AS (SELECT month, lat_idx, (m + f) * 9.80665::DOUBLE / 100000 * 86400 AS u_form,
  (m + f) * 9.80665::DOUBLE / 100000 * 6.371e6 * cos(radians(90.0 - 15.0 * lat_idx)) * 86400 / 1e6 AS m_form,
  m + f AS stress FROM x JOIN y USING (month, lat_idx))""")
def torque_overlays(spark, sf):
    s = surface_clim(spark, sf, "sp", "oro", "ews")
    both = (diagnostics.friction_torque(s).withColumnRenamed("value", "f")
            .join(diagnostics.mountain_torque(s, SPEC), ["month", "lat_idx"]))
    tau = F.col("f") + F.col("value")
    over = {"u_form": ("u", False), "m_form": ("M", False), "stress": ("u", True)}
    return both.select("month", "lat_idx", *[budgets.overlay(tau, SPEC, budgets.MOMENTUM, f, i).alias(n)
                                             for n, (f, i) in over.items()])


@query("K10_evaporation_precipitation", "month:i lat_idx:i evap:6 precip:6 e_minus_p:6 mean_form:6", with_(SQL_SURFACE) + """,
z AS (SELECT month, lat_idx, -avg(slhf) / 2.501e6 AS e, avg(tp) / 86400 AS p FROM sclim GROUP BY ALL),
result AS (SELECT month, lat_idx, e * 86400 AS evap, p * 86400 AS precip, (e - p) * 86400 AS e_minus_p,
  (e - p) / (100000 / 9.80665::DOUBLE) * 1000 * 86400 AS mean_form FROM z)""")
def evaporation(spark, sf):
    z = diagnostics.evaporation_precipitation(surface_clim(spark, sf, "slhf", "tp"))
    q = budgets.MOISTURE
    cols = [budgets.overlay(F.col(c), SPEC, q, "q", True).alias(c) for c in ("evap", "precip", "e_minus_p")]
    return z.select("month", "lat_idx", *cols, budgets.overlay(F.col("e_minus_p"), SPEC, q, "q", False).alias("mean_form"))


@query("K12_surface_heating", "month:i lat_idx:i turb:5 rad:5 total:5 k_per_day:6", with_(SQL_SURFACE) + """,
z AS (SELECT month, lat_idx, -avg(slhf) - avg(sshf) AS turb,
  avg(tisr) + avg(ttr) - (avg(ssr) + avg(str)) AS rad FROM sclim GROUP BY ALL),
result AS (SELECT *, turb + rad AS total, (turb + rad) * 9.80665::DOUBLE / (100000 * 1004) * 86400 AS k_per_day FROM z)""")
def heating(spark, sf):
    h = diagnostics.surface_heating(surface_clim(spark, sf, "slhf", "sshf", "ssr", "str", "tisr", "ttr"))
    return h.withColumn("k_per_day", budgets.overlay(F.col("total"), SPEC, budgets.ENERGY, "h", False))


# energy cycle --------------------------------------------------------------------------------------------
SQL_SORTED = """,
kap AS (SELECT 287.04::DOUBLE / 1004 AS kappa),
dpl AS (SELECT k, p, (CASE WHEN k = 6 THEN p ELSE (p + (SELECT p FROM lev b WHERE b.k = l.k + 1)) / 2.0 END
  - CASE WHEN k = 0 THEN p ELSE (p + (SELECT p FROM lev b WHERE b.k = l.k - 1)) / 2.0 END) * 100 AS dp FROM lev l),
par AS (SELECT month, t * pow(1000.0 / level, kappa) AS th, c * dp AS w, k, lat_idx, lon_idx
  FROM clim JOIN dpl ON dpl.p = level JOIN lats ON lats.i = lat_idx, kap WHERE t IS NOT NULL AND c >= 1e-3),
cum AS (SELECT *, sum(w) OVER o AS incl, lag(th) OVER o AS prev, row_number() OVER o AS rn,
  sum(w) OVER (PARTITION BY month) AS total, count(*) OVER (PARTITION BY month) AS n FROM par
  WINDOW o AS (PARTITION BY month ORDER BY th DESC, k, lat_idx, lon_idx)),
tg AS (SELECT DISTINCT month, lev.k AS tk, lev.p AS level, total * lev.p / 1000.0 AS target, n FROM cum, lev),
hit AS (SELECT tg.month, tg.level, tg.tk, min(CASE WHEN incl >= target THEN rn END) AS rn, max(tg.n) AS n
  FROM tg JOIN cum USING (month) GROUP BY ALL),
tref AS (SELECT h.month, h.level, h.tk AS k, (CASE WHEN c.prev IS NULL OR h.rn IS NULL THEN c.th
  ELSE c.prev * (1 - (tg.target - (c.incl - c.w)) / c.w) + c.th * (tg.target - (c.incl - c.w)) / c.w END)
  * pow(h.level / 1000.0, kappa) AS t_ref FROM hit h JOIN tg ON tg.month = h.month AND tg.tk = h.tk
  JOIN cum c ON c.month = h.month AND c.rn = coalesce(h.rn, h.n), kap)"""
SQL_SIMPLE = """,
kap AS (SELECT 287.04::DOUBLE / 1004 AS kappa),
tref AS (SELECT month, level, l.k, sum(t * greatest(0.0, c)) / sum(greatest(0.0, c)) AS t_ref FROM clim
  JOIN lats ON lats.i = lat_idx JOIN lev l ON l.p = level GROUP BY ALL)"""
SQL_CYCLE = f""",
dev4 AS (SELECT *, t - avg(t) OVER r AS dt, u - avg(u) OVER r AS du, v - avg(v) OVER r AS dv, w - avg(w) OVER r AS dw
  FROM clim WINDOW r AS (PARTITION BY month, level, lat_idx)),
mom AS (SELECT month, level, lat_idx, avg(dt * dt) AS t2, avg(du * du + dv * dv) AS uv2, avg(dv * dt) AS vt, avg(dw * dt) AS wt,
  avg(du * dv) AS uv, avg(du * dw) AS uw, count(*) AS n FROM dev4
  WHERE t IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL GROUP BY ALL),
pc AS (SELECT *, CASE WHEN c > 1e-3 THEN u / c END AS uc FROM panel),
der AS (SELECT *, {sql_dy('t')} AS ty, {sql_dy('uc')} AS ucy, {sql_dp('t')} AS tp, {sql_dp('u')} AS up FROM pc),
gam AS (SELECT month, level, t_ref, greatest((kappa * t_ref / (level * 100.0)
  - (coalesce(lead(t_ref) OVER g, t_ref) - coalesce(lag(t_ref) OVER g, t_ref))
  / ((coalesce(lead(level) OVER g, level) - coalesce(lag(level) OVER g, level)) * 100.0)) * level * 100.0, 1e-9) AS gp
  FROM tref, kap WINDOW g AS (PARTITION BY month ORDER BY k)),
j AS (SELECT d.*, m.t2, m.uv2, m.vt, m.wt, m.uv, m.uw, g.gp, coalesce(d.t, 0) - g.t_ref AS th
  FROM der d JOIN mom m USING (month, level, lat_idx) JOIN gam g USING (month, level) WHERE d.c >= 1e-3),
csum AS (SELECT sum(greatest(0.0, c)) AS cs FROM lats),
lv AS (SELECT month, k, level,
  287.04::DOUBLE / (2 * 9.80665::DOUBLE) * (sum(th * th * c) / sum(c)) / max(gp) AS pm,
  287.04::DOUBLE / (2 * 9.80665::DOUBLE) * (sum(t2 * c) / sum(c)) / max(gp) AS pe,
  1 / (2 * 9.80665::DOUBLE) * sum((u * u + v * v) * c) / sum(c) AS km,
  1 / (2 * 9.80665::DOUBLE) * sum(uv2 * c) / sum(c) AS ke,
  -287.04::DOUBLE / 9.80665::DOUBLE * (coalesce(sum(vt * ty * c), 0) + coalesce(sum(wt * tp * c), 0)) / max(cs) / max(gp) AS c_pm_pe,
  -287.04::DOUBLE / 9.80665::DOUBLE * sum(wt * c) / max(cs) / (level * 100.0) AS c_pe_ke,
  (coalesce(sum(uv * c * c * ucy), 0) + coalesce(sum(uw * up * c), 0)) / max(cs) / 9.80665::DOUBLE AS c_ke_km,
  -287.04::DOUBLE / 9.80665::DOUBLE * sum(w * th * c) / max(cs) / (level * 100.0) AS c_pm_km
  FROM j, csum GROUP BY month, k, level),
sg AS (SELECT month, """ + ", ".join(
    f"0.5 * (lag({n}) OVER g + {n}) * (level - lag(level) OVER g) * 100 AS {n}"
    for n in (*lorenz.RESERVOIRS, *lorenz.CONVERSIONS)) + """
  FROM lv WINDOW g AS (PARTITION BY month ORDER BY k)),
result AS (SELECT month, """ + ", ".join(
    f"coalesce(sum({n}), 0){' / 1e3' if n in lorenz.RESERVOIRS else ''} AS {n}"
    for n in (*lorenz.RESERVOIRS, *lorenz.CONVERSIONS)) + " FROM sg GROUP BY ALL)"

CYCLE_COLUMNS = "month:i pm:4 pe:4 km:5 ke:5 c_pm_pe:3 c_pe_ke:3 c_ke_km:4 c_pm_km:3"


def _cycle(spark, sf, reference):
    e = lorenz.energy_cycle(clim(spark, sf, "u", "v", "w", "t"), SPEC, reference)
    return e.withColumns({n: F.col(n) / 1e3 for n in lorenz.RESERVOIRS})


@query("W10_sorted_reference", "month:i level:i t_ref:6",
       with_(SQL_CLIM, SQL_LEVELS) + SQL_SORTED + ", result AS (SELECT * FROM tref)")
def sorted_reference(spark, sf):
    return lorenz.sorted_reference(clim(spark, sf, "t"), SPEC)


@query("K13_lorenz_sorted", CYCLE_COLUMNS, BASE + SQL_SORTED + SQL_CYCLE)
def lorenz_sorted(spark, sf):
    return _cycle(spark, sf, "lorenz")


@query("K13_lorenz_simple", CYCLE_COLUMNS, BASE + SQL_SIMPLE + SQL_CYCLE)
def lorenz_simple(spark, sf):
    return _cycle(spark, sf, "simple")


@query("O2_column_profiles", "year:i month:i lat_idx:i lon_idx:i k:i tc:6 r:8 sst_c:6 msl_hpa:6", with_(SQL_SAMPLES, SQL_SURFACE) + """,
b AS (SELECT DISTINCT year, month, lat_idx, lon_idx FROM src),
c AS (SELECT b.year, b.month, b.lat_idx, b.lon_idx, s.sst - 273.15 AS sst_c, s.msl AS msl_hpa FROM b JOIN smon s USING (year, month, lat_idx, lon_idx)),
l AS (SELECT i AS k, [1000, 925, 850, 700, 500, 300, 200][i + 1] AS level FROM range(7) AS r(i)),
result AS (SELECT c.*, l.k, t - 273.15 AS tc, q / greatest(1 - q, 1e-12) * 1000 AS r FROM c CROSS JOIN l LEFT JOIN src
  ON src.year = c.year AND src.month = c.month AND src.lat_idx = c.lat_idx AND src.lon_idx = c.lon_idx AND src.level = l.level)""")
def column_profiles(spark, sf):
    """Columns from the surface upwards, beside the surface values they belong to."""
    keys = ["year", "month", "lat_idx", "lon_idx"]
    cols = vertical.column_profiles(tables.upper_monthly(spark, sf, ("t", "q")), surface_monthly(spark, sf, "sst", "msl"), keys, SPEC)
    both = F.arrays_zip(F.col("t_profile").alias("tc"), F.col("r_profile").alias("r"))
    return cols.select(*keys, "sst_c", "msl_hpa", F.posexplode(both).alias("k", "_x")).select(*keys, "k", "_x.tc", "_x.r", "sst_c", "msl_hpa")
