"""Operators on fields with known answers."""

import math

import numpy as np
import pytest
from helpers import SMALL, by, cosd, grid
from pyspark.sql import functions as F

from zonalis import constants as K
from zonalis.functions import fields as fx
from zonalis.grid import GridSpec
from zonalis.operators import budgets, calculus, decompose, diagnostics, lorenz, ranks, reduce, sampling, vertical
from zonalis.plans.catalogue.base import rounded
from zonalis.sources import tiles

ROW = ["month", "level", "lat_idx"]


def test_constant_field(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: 7.0, months=range(1, 13))
    assert by(reduce.annual_mean(g, ["u"]), "level", "lat_idx", "lon_idx")[200, 3, 4]["u"] == 7.0
    assert {r["u"] for r in decompose.eddy(g, ROW, "u").collect()} == {0.0}
    assert all(abs(r["u"] - 7) < 1e-12 for r in reduce.area_mean(g, SMALL, ["month", "level"], ["u"]).collect())
    assert all(abs(r["u"] - 7) < 1e-12 for r in reduce.seasonal_mean(g, ["u"]).collect())
    rng = tiles.tile_ranges(g.withColumnRenamed("u", "value"), ["month", "level"]).first()
    assert (rng["vmin"], rng["vmax"]) == (7.0, 8.0)


def test_zonal_wave_covariance(spark):
    def f(m, p, la, lo):
        return (3 * math.cos(2 * math.radians(lo)) + la, 4 * math.cos(2 * math.radians(lo)) - la)
    g = grid(spark, SMALL, f, levels=(500,), names=("a", "b"))
    z = reduce.zonal_moments(g, ROW, ["a"], {"ab": ("a", "b")}).collect()
    assert all(abs(r["ab"] - 6.0) < 1e-9 for r in z)
    assert all(abs(r["a"] - (90 - 15 * r["lat_idx"])) < 1e-9 for r in z)


def test_zonal_plus_eddy_is_total(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: None if lo == 0 else math.sin(la) + lo / 50)
    e = decompose.eddy(g, ROW, "u", "e")
    e = decompose.zonal(e, ROW, "u", "z")
    for r in e.where("u IS NOT NULL").collect():
        assert abs(r["e"] + r["z"] - r["u"]) < 1e-12
    assert all(r["z"] is not None for r in e.collect())
    assert all(abs(r["s"]) < 1e-9 for r in e.groupBy(*ROW).agg(F.sum("e").alias("s")).collect())


def test_floor_index_percentile(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(10)] + [(2, None)], "k int, v double")
    b = by(ranks.percentile_bounds(df, ["k"], "v", 0.0, 0.97), "k")
    assert (b[1,]["vmin"], b[1,]["vmax"]) == (0.0, 8.0)
    assert (b[2,]["vmin"], b[2,]["vmax"]) == (0.0, 1.0)


@pytest.mark.parametrize("kind", ["skew", "tiny range", "outlier", "one value", "many scales"])
def test_rank_search_matches_sorting(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=800)
    v = {"skew": np.concatenate([np.full(400, 2.5), x * 3]), "tiny range": 250 + np.concatenate([x, x]) * 1e-9,
         "outlier": np.concatenate([x, x, [1e300, -1e300]]), "one value": np.full(1300, -7.0),
         "many scales": np.concatenate([x * 1e-12, x * 1e9, np.zeros(5)])}[kind]
    df = spark.createDataFrame([(1, float(x)) for x in v], "k int, v double")
    got = ranks.value_at_rank(df, ["k"], "v", {f"r{i}": (lambda n, i=i: F.lit(float(i))) for i in (0, 7, 600, 1199)}).first()
    s = np.sort(v)
    assert [got[f"r{i}"] for i in (0, 7, 600, 1199)] == [s[i] for i in (0, 7, 600, 1199)]


@pytest.mark.parametrize("weight", [None, "w"])
def test_ranks_of_values_whose_last_bits_differ_between_reads(spark, weight):
    """Partial sums arrive in any order: an average is not the same to the last bit when it is computed again."""
    base = [(k, float(v)) for k, n in ((1, 1), (2, 2), (3, 40), (4, 3000)) for v in np.repeat([5.0, 7.0, 7.0, 9.0], n)]
    noise = F.expr("1 + (CAST(reflect('java.lang.Math', 'random') AS DOUBLE) - 0.5) * 1e-14")
    df = spark.createDataFrame(base, "k int, v double").select("k", (F.col("v") * noise).alias("v"), F.lit(1.0).alias("w"))
    at = [0.0, 0.2, 0.26, 0.5, 0.74, 0.76, 1.0]

    def targets(total):
        return F.array(*[F.struct(F.lit(p).alias("name"), F.greatest(F.lit(1.0), F.ceil(total * p)).cast("double").alias("pos")) for p in at])

    got = {(r["k"], float(r["name"])): r["v"] for r in ranks.locate(df, ["k"], "v", weight, targets).collect()}
    assert len(got) == 4 * len(at)
    for (k, p), v in got.items():
        all_of_k = sorted(x for j, x in base if j == k)
        assert v == pytest.approx(all_of_k[max(1, int(np.ceil(len(all_of_k) * p))) - 1], rel=1e-12)


def test_ranks_keep_groups_with_null_keys(spark):
    rows = [(None, 1, float(v)) for v in range(10)] + [(1, None, float(v)) for v in range(5)] + [(None, None, None), (1, 1, 7.0)]
    df = spark.createDataFrame(rows, "level int, k int, v double")
    for keys in (["level", "k"], ["k", "level"]):
        got = {(r["level"], r["k"]): (r["vmin"], r["vmax"]) for r in ranks.percentile_bounds(df, keys, "v", 0.5, 1.0).collect()}
        assert got == {(None, 1): (4.0, 9.0), (1, None): (2.0, 4.0), (None, None): (0.0, 1.0), (1, 1): (7.0, 7.0)}
    one = ranks.percentile_bounds(df, [], "v", 0.0, 1.0).collect()
    assert [(r["vmin"], r["vmax"]) for r in one] == [(0.0, 9.0)]


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_by_weight(spark, descending):
    """Running weights ahead of a value and through it, equal values as one, the value before it."""
    rng = np.random.default_rng(8)
    v, w = np.round(rng.normal(size=700), 2), rng.integers(1, 9, 700).astype(float)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(v, w)] + [(1, None, 3.0), (2, None, 1.0)], "k int, v double, w double")
    at = [0.1, 0.5, 0.93, 1.0]
    got = ranks.locate(df, ["k"], "v", "w", lambda total: F.array(*[F.struct(F.lit(p).alias("name"), (total * p).alias("pos")) for p in at]),
                       descending, {"most": F.max("w")}).collect()
    assert [r["k"] for r in got if r["name"] is None] == [2]
    x, n = np.unique(v, return_inverse=True)
    sums = np.bincount(n, w)
    if descending:
        x, sums = x[::-1], sums[::-1]
    cum = np.cumsum(sums)
    for r in got:
        if r["name"] is not None:
            k = int(np.searchsorted(cum, float(r["name"]) * cum[-1]))
            assert (r["v"], r["w"], r["before"], r["prev"], r["most"]) == (x[k], sums[k], cum[k] - sums[k], x[k - 1] if k else None, w[v == x[k]].max())


def test_sigma_floor_and_zscore(spark):
    ref = grid(spark, SMALL, lambda m, p, la, lo: (0.0, 1e-9 if (la, lo) == (0, 0) else 2.0), levels=(500,), names=("u", "sd"))
    v = grid(spark, SMALL, lambda m, p, la, lo: 4.0, levels=(500,))
    z = decompose.zscore(v, ref, ["month", "level", "lat_idx", "lon_idx"], ["month", "level"], "u", "sd")
    assert {r["u"] for r in z.collect()} == {2.0}


def test_trapezoid_exact_for_linear_profiles(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: p * 100.0)
    exact = ((1000e2) ** 2 - (200e2) ** 2) / 2
    r = calculus.integrate_p(g, ["month", "lat_idx", "lon_idx"], ["u"], SMALL).first()
    assert abs(r["u"] - exact) < 1e-3


def test_missing_level_is_not_bridged(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: None if p == 500 else float(p)).where("u IS NOT NULL")
    z = calculus.with_level_index(g, SMALL)
    ax = calculus.level_axis(SMALL, ["month", "lat_idx", "lon_idx"])
    d = by(z.withColumn("d", calculus.d_dp(F.col("u"), ax, SMALL)), "level", "lat_idx", "lon_idx")
    assert d[200, 0, 0]["d"] is None and d[850, 0, 0]["d"] is None
    assert abs(d[1000, 0, 0]["d"] - 0.01) < 1e-12


def test_smoothers_keep_constants_and_fill(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: None if la == 30 else 5.0)
    z = calculus.with_level_index(reduce.zonal_mean(g, ROW, ["u"]), SMALL)
    s = calculus.smooth_level(calculus.smooth_lat(z, "u", ["month", "level"], SMALL), "u", ["month", "lat_idx"], SMALL)
    assert all(abs(r["u"] - 5.0) < 1e-12 for r in s.collect())


def test_streamfunction_linear_for_uniform_wind(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: 2.0, names=("v",))
    psi = by(diagnostics.mass_streamfunction(g, SMALL), "level", "lat_idx")
    assert psi[200, 6]["value"] == 0.0
    want = 2 * math.pi * K.EARTH_RADIUS / K.GRAVITY * 2.0 * 300e2 / 1e9
    assert abs(psi[500, 6]["value"] - want) < 1e-6


def test_solid_body_momentum(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: 10 * cosd(la))
    r = by(diagnostics.angular_momentum(g, SMALL), "level", "lat_idx")[500, 3]
    want = (K.OMEGA + 10 / K.EARTH_RADIUS) * K.EARTH_RADIUS ** 2 * cosd(45) ** 2 / 1e9
    assert abs(r["value"] - want) < 1e-9


def test_geostrophic_wind_of_linear_height(spark):
    slope = 1e-4
    g = grid(spark, SMALL, lambda m, p, la, lo: 5000 - slope * K.EARTH_RADIUS * math.radians(la), names=("z",))
    r = by(diagnostics.geostrophic_wind(g, SMALL), "level", "lat_idx")
    f = 2 * K.OMEGA * math.sin(math.radians(45))
    assert abs(r[500, 3]["value"] - K.GRAVITY * slope / f) < 1e-9
    assert r[500, 6]["value"] is None


def test_theta_interpolates_to_itself(spark):
    def f(m, p, la, lo):
        return 300 * (p / 1000) ** K.KAPPA + 0.08 * (1000 - p) + la / 50
    g = grid(spark, SMALL, f, names=("t",))
    g = vertical.theta_cube(g, out="th")
    on = vertical.on_isentrope(g, ["month", "lat_idx", "lon_idx"], ["th"], 320.0, SMALL)
    assert all(abs(r["th"] - 320.0) < 1e-9 for r in on.collect())
    out = vertical.on_isentrope(g, ["month", "lat_idx", "lon_idx"], ["th"], 900.0, SMALL)
    assert out.count() == 156 and all(r["th"] is None for r in out.collect())


def test_log_pressure_ends(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: float(p))
    for p in (200, 500, 1000):
        assert all(abs(r["u"] - p) < 1e-9 for r in vertical.at_pressure(g, ["month", "lat_idx", "lon_idx"], ["u"], p, SMALL).collect())


def test_budget_of_state_at_rest_is_zero(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: (0.0, 0.0, 0.0), names=("u", "v", "w"))
    t = budgets.budget_terms(g, SMALL, budgets.MOMENTUM)
    assert t.count() == 6 * 4 * 13
    assert all(not r["value"] for r in t.collect())


def test_budget_residual_is_negative_total(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: (la / 9, math.sin(lo), p / 1e4 * cosd(lo)), names=("u", "v", "w"))
    t = by(budgets.budget_terms(g, SMALL, budgets.MOMENTUM), "level", "lat_idx", "term")
    for (p, i, term), r in t.items():
        if term == "total":
            assert abs(r["value"] + t[p, i, "torque"]["value"]) < 1e-12


def test_energy_cycle_reservoirs(spark):
    def f(m, p, la, lo):
        return (10 * cosd(la), 2 * math.cos(2 * math.radians(lo)), 0.01, 250 + p / 50 + 10 * cosd(la) + math.cos(math.radians(lo)))
    g = grid(spark, SMALL, f, names=("u", "v", "w", "t"))
    a = lorenz.energy_cycle(g, SMALL, "simple").first()
    b = lorenz.energy_cycle(g, SMALL, "lorenz").first()
    for r in (a, b):
        assert all(r[x] > 0 for x in lorenz.RESERVOIRS)
    w = [cosd(90 - 15 * i) for i in range(13)]
    km = sum(c * (10 * c) ** 2 for c in w) / sum(w) / (2 * K.GRAVITY) * 800e2
    assert abs(a["km"] / km - 1) < 1e-9 and a["ke"] > 0
    assert abs(a["ke"] - 2.0 / (2 * K.GRAVITY) * 800e2) < 1e-6


def _sorted_reference(cells, spec):
    """Straight sort, walk and interpolation."""
    lev = spec.levels
    thick = {}
    for k, p in enumerate(lev):
        top = p if k == 0 else (p + lev[k - 1]) / 2
        low = p if k == len(lev) - 1 else (p + lev[k + 1]) / 2
        thick[p] = (low - top) * 100
    parts = sorted(((t * (1000 / p) ** K.KAPPA_ENERGY, cosd(spec.lat0 - i * spec.dlat) * thick[p])
                    for p, i, j, t in cells if cosd(spec.lat0 - i * spec.dlat) > 1e-3), key=lambda x: -x[0])
    total = sum(w for _, w in parts)
    out = {}
    for p in lev:
        target, cum = p / lev[-1] * total, 0.0
        for n, (th, w) in enumerate(parts):
            if cum + w >= target or n == len(parts) - 1:
                f = (target - cum) / w
                th = th if n == 0 else parts[n - 1][0] * (1 - f) + th * f
                out[p] = th * (p / 1000) ** K.KAPPA_ENERGY
                break
            cum += w
    return out


def test_sorted_reference_with_ties(spark):
    rng = np.random.default_rng(5)
    vals = {}

    def f(m, p, la, lo):
        vals[p, la, lo] = 250.0 if rng.random() < 0.4 else float(250 + 40 * rng.random())
        return vals[p, la, lo]
    g = grid(spark, SMALL, f, names=("t",)).cache()
    cells = [(r["level"], r["lat_idx"], r["lon_idx"], r["t"]) for r in g.collect()]
    want = _sorted_reference(cells, SMALL)
    got = {r["level"]: r["t_ref"] for r in lorenz.sorted_reference(g, SMALL).collect()}
    assert got.keys() == want.keys()
    for p in want:
        assert abs(got[p] - want[p]) < 1e-7


def test_arc_ends_and_date_line(spark):
    arcs = spark.createDataFrame([(1, 10.0, 179.0, -5.0, -179.0), (2, 3.0, 4.0, 3.0, 4.0)],
                                 "id int, lat1 double, lon1 double, lat2 double, lon2 double")
    pts = sampling.great_circle(arcs, ["id"], 16)
    p = by(pts, "id", "s")
    assert abs(p[1, 0]["lat"] - 10) < 1e-9 and abs(p[1, 16]["lon"] + 179) < 1e-9
    assert [k for k in p if k[0] == 2] == [(2, 0)]
    assert all(abs(abs(r["lon"]) - 180) <= 1.0 + 1e-9 for k, r in p.items() if k[0] == 1)
    seg = sampling.split_at_date_line(pts, ["id"]).where("id = 1").agg(F.max("segment")).first()[0]
    assert seg == 1
    straight = by(sampling.straight_arc(arcs, ["id"], 16), "id", "s")
    assert all(abs(abs(r["lon"]) - 180) <= 1.0 + 1e-9 for k, r in straight.items() if k[0] == 1)


def test_haversine_symmetry(spark):
    r = spark.range(1).select(fx.haversine_km(F.lit(10.0), F.lit(20.0), F.lit(-33.0), F.lit(151.0)).alias("a"),
                              fx.haversine_km(F.lit(-33.0), F.lit(151.0), F.lit(10.0), F.lit(20.0)).alias("b"),
                              fx.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("c")).first()
    assert r["a"] == r["b"] and abs(r["c"] - math.pi * 6371) < 1e-6


def test_bilinear_reproduces_linear_fields(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: la * 2 + 1, levels=(500,))
    pts = spark.createDataFrame([(1, 33.0, 170.5), (2, -90.0, 0.0), (3, 90.0, -180.0), (4, 95.0, 0.0)], "pid int, lat double, lon double")
    s = by(sampling.bilinear(pts, ["pid"], g, ["month"], ["u"], SMALL), "pid")
    assert abs(s[1,]["u"] - 67) < 1e-9 and abs(s[2,]["u"] + 179) < 1e-9 and abs(s[3,]["u"] - 181) < 1e-9
    assert s[4,]["u"] is None


def test_full_globe_box_holds_every_column(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: 1.0, levels=(500,))
    assert g.where(fx.in_box(SMALL.lat(), SMALL.lon(), -90, 90, -180, 180)).count() == 156
    assert g.where(fx.in_box(SMALL.lat(), SMALL.lon(), -90, 90, 170, -170)).count() == 13
    with pytest.raises(ValueError):
        fx.check_box(0, 0.2, 0, 10)


def test_quantization_error_bound(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: None if lo == 30 else math.sin(la + lo) * p).withColumnRenamed("u", "value")
    q = tiles.quantize(g, ["month", "level"])
    back = tiles.dequantize(q).join(g.withColumnRenamed("value", "v"), ["month", "level", "lat_idx", "lon_idx"])
    for r in back.collect():
        assert (r["v"] is None) == (r["value"] is None)
        if r["v"] is not None:
            assert abs(r["v"] - r["value"]) <= 2.0 * r["level"] / 65534


def test_daylight(spark):
    r = spark.range(1).select(fx.daylight_fraction(F.lit(0.0), F.lit(5)).alias("eq"), fx.daylight_fraction(F.lit(80.0), F.lit(12)).alias("night"),
                              fx.daylight_fraction(F.lit(80.0), F.lit(6)).alias("day"), fx.season_label(F.lit(12)).alias("s")).first()
    assert abs(r["eq"] - 0.5) < 1e-12 and r["night"] == 0.0 and r["day"] == 1.0 and r["s"] == "NDJ"


def test_fill_equals_densify(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: la).where("lat_idx % 3 <> 1 AND level <> 850")
    z = reduce.zonal_mean(g, ROW, ["u"])
    a = SMALL.fill(z, ["month"], ["level", "lat_idx"]).select(*ROW, "u")
    b = SMALL.densify(z, ["month"], ["level", "lat_idx"]).select(*ROW, "u")
    assert a.count() == 52 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_two_rows_for_one_cell_are_an_error(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: 1.0, levels=(500,))
    twice = g.unionByName(g.limit(1))
    with pytest.raises(Exception, match="two rows for one cell"):
        SMALL.fill(twice, ["month", "level"], ["lat_idx", "lon_idx"]).collect()
    with pytest.raises(Exception, match="level off the axis"):
        SMALL.on_axis(g.withColumn("level", F.lit(600))).collect()


def test_no_point_is_lost(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: la + lo, months=(1, 2))
    pts = spark.createDataFrame([(1, 10.0, 20.0, 600.0), (2, 91.0, 0.0, 600.0), (3, -90.0, 179.9, 600.0), (4, None, 0.0, 600.0), (5, 0.0, 0.0, 1200.0)],
                                "pid int, lat double, lon double, p double")
    two = sampling.bilinear(pts, ["pid"], g.where("level = 500 AND lat_idx < 12"), ["month"], ["u"], SMALL).collect()
    assert len(two) == 10
    got = {r["pid"]: r["u"] for r in two if r["month"] == 2}
    assert abs(got[1] - 30) < 1e-9 and got[2] is None and got[3] is None and got[4] is None and abs(got[5]) < 1e-9
    three = {(r["pid"], r["month"]): r["u"] for r in sampling.trilinear(pts, ["pid"], g, ["month"], ["u"], SMALL).collect()}
    assert len(three) == 10 and abs(three[1, 1] - 30) < 1e-9 and three[5, 1] is None and three[2, 1] is None and three[3, 1] is not None
    none = sampling.bilinear(pts, ["pid"], g.limit(0), ["month"], ["u"], SMALL)
    assert none.count() == 5 and none.where("u IS NOT NULL OR month IS NOT NULL").count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_arcs_of_one_file_are_dealt_out(spark):
    """Points are made by all tasks, and windows along an arc shuffle them no more."""
    arcs = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 90.0) for k in range(40)], "arc_id long, lat1 double, lon1 double, lat2 double, lon2 double").coalesce(1)
    for make in (sampling.great_circle, sampling.straight_arc):
        pts = make(arcs, ["arc_id"], 9)
        assert len([n for n in pts.rdd.glom().map(len).collect() if n]) > 1
        assert _plan(sampling.path_distance(pts, ["arc_id"])).count("Exchange hashpartitioning") == 1
        assert {(r["s"], round(r["lat"], 9), round(r["lon"], 9)) for r in pts.collect()} == {(s, 0.0, 10.0 * s) for s in range(10)}


def test_points_are_not_dealt_by_their_few_homes(spark):
    """A small grid goes to the points, whatever its estimated size; a large one is left to the planner."""
    pts = spark.range(50).selectExpr("id AS pid", "CAST(id AS DOUBLE) AS lat", "CAST(id AS DOUBLE) AS lon")
    g = grid(spark, SMALL, lambda m, p, la, lo: la + 2 * abs(lo))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sampling.bilinear(pts, ["pid"], g, ["month", "level"], ["u"], SMALL, SMALL.slices(spark, [1]))
        assert "BroadcastHashJoin [_h_lat_idx" in _plan(out)
        assert not sampling._small(["month", "level"], ["u"], GridSpec(), ["lat_idx", "lon_idx"])
        assert not sampling._small(["year", "month"], ["u"], SMALL, ["lat_idx", "lon_idx"])
        assert all(abs(r["u"] - 3 * r["pid"]) < 1e-9 for r in out.collect()) and out.count() == 50 * len(SMALL.levels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_rounding_is_that_of_round(spark):
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, -1e-9, 0.5e-6, 1.5e-6, -2.5e-6, 1.0000005, 2.675, 1e300, 123456789.1234565, 4.35, 0.1 + 0.2, 5e-324, 999999.9999995]
    df = spark.createDataFrame([(x,) for x in odd + [k / 8e6 for k in range(-999, 999)]], "x double")
    for digits in (2, 3, 6):
        same = rounded("x", digits).cast("string").eqNullSafe((F.round("x", digits) + F.lit(0.0)).cast("string"))
        assert df.where(~same).count() == 0
