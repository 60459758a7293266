"""Requests: text form, decision rules, and algebra of references."""

from dataclasses import replace

import pytest
from helpers import SMALL, by, cosd, grid
from pyspark.sql import functions as F

from zonalis.operators import composite, decompose, reduce, vertical
from zonalis.plans import jobs
from zonalis.plans.request import (FieldRequest, FieldStore, decode, display_range, effective_kind, effective_mode, encode,
                                   ingredients, open_store, reference_choices, resolve, resolve_sides, sides_range)
from zonalis.registry import CLIMO_WINDOWS, Window30, window_frame

WINDOWS = (Window30(2000, 2002), Window30(2002, 2004))
KEYS = ["year", "month", "level", "lat_idx", "lon_idx"]


@pytest.fixture(scope="module")
def store(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: (230 + p / 20 + cosd(la) * m, 5.0 + lo / 60), months=range(1, 13), names=("t", "u"))
    g = g.withColumn("year", F.explode(F.sequence(F.lit(2000), F.lit(2004))))
    g = g.withColumn("t", F.col("t") + F.pow(F.col("year") - 1999, F.lit(2.0)) * F.col("month") / 10)
    long = vertical.columns_to_fields(g, KEYS, ("t", "u")).cache()
    return FieldStore(long, SMALL, "2000-2004", WINDOWS)


def test_text_form():
    r = FieldRequest("u", month=7, level=200, year=1998, mode="anomaly", seasonal=True, reference="best-match", user_min=-5.0)
    assert decode(encode(r)) == r and encode(FieldRequest()) == ""
    e = decode("#cr=c:roni:ge:1.0:1&f=sst&bogus=1&L=123&m=13&d=wild")
    assert e.event == ("roni", "ge", 1.0, 1) and e.name == "sst" and e.level is None and e.month == 1 and e.mode == "total"
    assert decode("cr=2010-2024").span == (2010, 2024) and decode("cr=2024-2010").span is None
    assert decode("cr=c:x:gt:1:1").event is None and decode(encode(e)).event == e.event


def test_modes_and_kinds(store):
    s = FieldRequest("t", kind="std")
    assert effective_mode(store, s) == "total"
    assert effective_mode(store, replace(s, reference="2000-2002")) == "anomaly"
    assert effective_mode(store, replace(s, reference="2000-2002", compare_period="2000-2002")) == "total"
    assert effective_mode(store, FieldRequest("t", mode="anomaly", compare_period="2000-2002")) == "total"
    assert effective_mode(store, FieldRequest("t", coord="theta", mode="zscore")) == "anomaly"
    assert effective_kind(store, FieldRequest("t", coord="theta", kind="std")) == "mean"
    assert len(ingredients(FieldRequest("pv"), SMALL)) == 8 and ingredients(FieldRequest("dls"), SMALL)[0] == ("u", 200)
    with pytest.raises(ValueError):
        FieldRequest("t", month=13).validate()


def test_window_ties_take_the_later(spark, store):
    assert store.best_window(2002) == "2002-2004"
    y = spark.createDataFrame([(1978,), (1950,), (2030,), (1983,)], "year int")
    got = {r["year"]: r["window_id"] for r in composite.best_window(y, CLIMO_WINDOWS).collect()}
    assert got == {1978: "1966-1995", 1950: "1961-1990", 2030: "1996-2025", 1983: "1971-2000"}
    assert composite.best_window(spark.createDataFrame([(1988,)], "year int"), CLIMO_WINDOWS).first()["window_id"] == "1976-2005"
    assert window_frame(spark).count() == len(CLIMO_WINDOWS) == 8


def test_sliding_reference_equals_subtracting_each_year(store):
    years = (2000, 2003, 2004)
    got = by(resolve(store, FieldRequest("t", month=4, level=500, years=years, mode="anomaly")), "lat_idx", "lon_idx")
    total = {}
    for y in years:
        one = resolve(store, FieldRequest("t", month=4, level=500, year=y, mode="anomaly", reference="best-match"))
        for k, r in by(one, "lat_idx", "lon_idx").items():
            total[k] = total.get(k, 0.0) + r["value"] / len(years)
    assert got.keys() == total.keys() and all(abs(got[k]["value"] - total[k]) < 1e-9 for k in total)


def test_missing_window_falls_to_the_fixed_climatology(store):
    far = replace(store, windows=(Window30(1900, 1902), Window30(2002, 2004)))
    r = FieldRequest("t", month=4, level=500, years=(2000,), mode="anomaly")
    near = by(resolve(replace(store, windows=(Window30(2000, 2002),)), replace(r, sliding=False)), "lat_idx", "lon_idx")
    gone = by(resolve(replace(far, windows=(Window30(1900, 1902),)), r), "lat_idx", "lon_idx")
    assert len(gone) == 156 and all(abs(gone[k]["value"] - near[k]["value"]) < 1e-9 for k in near)


def test_seasonal_of_constant_and_wrap(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: float(m), months=range(1, 13), levels=(500,))
    s = {r["month"]: r["u"] for r in reduce.seasonal_mean(g, ["u"]).where("lat_idx = 3 AND lon_idx = 3").collect()}
    assert s[1] == 5.0 and s[12] == pytest.approx((11 + 12 + 1) / 3) and s[6] == 6.0
    part = reduce.seasonal_mean(g.where("month <> 12"), ["u"]).select("month").distinct()
    assert sorted(r["month"] for r in part.collect()) == list(range(2, 11))


def test_ranges(store):
    r = FieldRequest("t", month=None, level=500, year=2002, mode="zscore")
    assert tuple(display_range(store, r, resolve(store, r)).first()) == (-5.0, 5.0)
    e = FieldRequest("u", month=None, level=500, mode="eddy", user_max=9.0)
    lo, hi = display_range(store, e, resolve(store, e)).first()
    assert lo < 0 and hi == 9.0


def test_unknown_mode_passes_through(store):
    df = resolve(store, FieldRequest("u", level=500))
    assert decompose.decompose(df, "wild", "value", ["month", "lat_idx"], ["month"]) is df
    assert decompose.decompose(df, "anomaly", "value", ["month", "lat_idx"], ["month"]) is df


@pytest.fixture(scope="module")
def both(spark, store, tmp_path_factory):
    """The same fields as yearly rows alone, and with climatologies of every period beside them."""
    root = str(tmp_path_factory.mktemp("trees"))
    long = store.monthly.withColumn("grp", F.lit("pl"))
    jobs.build_per_year(long, root)
    for a, b in ((2000, 2004), *[(w.start, w.end) for w in WINDOWS]):
        jobs.build_climatology(long, root, a, b)
    index = spark.createDataFrame([("oni", y, m, float(y % 2) - 0.5) for y in range(1998, 2007) for m in (1, 7)], "id string, year int, month int, value double")
    stored = open_store(spark, root, SMALL, "2000-2004", WINDOWS, index)
    return replace(stored, climatology=None, tiles=frozenset()), stored


ASKED = [FieldRequest("t", month=None, level=500), FieldRequest("t", month=4, level=500, period="2000-2002"), FieldRequest("t", month=None, level=850, kind="std"),
         FieldRequest("t", month=1, level=500, seasonal=True), FieldRequest("t", month=7, level=500, mode="anomaly"),
         FieldRequest("t", month=None, level=500, year=2001, mode="anomaly", reference="best-match"), FieldRequest("t", month=None, level=500, year=2003, mode="zscore"),
         FieldRequest("t", month=None, level=500, years=(2000, 2003, 2004), mode="anomaly"), FieldRequest("t", month=None, coord="theta", theta=300.0),
         FieldRequest("t", month=None, all_levels=True), FieldRequest("t", month=None, level=500, event=("oni", "ge", 0.0, 7), mode="anomaly"),
         FieldRequest("t", month=None, level=500, period="2001-2003")]


@pytest.mark.parametrize("n", range(len(ASKED)))
def test_stored_trees_give_the_same_rows(both, n):
    rows = [sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in resolve(s, ASKED[n]).select(*ASKED[n].keys, "value").collect()], key=str)
            for s in both]
    assert rows[0] == rows[1] and rows[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_climatology_is_only_filtered(both):
    for n in (0, 1, 2):
        plan = plan_of(resolve(both[1], ASKED[n]))
        filters = plan[plan.index("PartitionFilters"):]
        assert "Aggregate" not in plan and "Exchange" not in plan and "Join" not in plan
        assert all(k in filters for k in ("period", "kind", "var", "level"))
        assert "Aggregate" in plan_of(resolve(both[0], ASKED[n]))
    assert "Aggregate" in plan_of(resolve(both[1], ASKED[-1]))                # that period is not stored


def test_event_years_prune_folders_when_the_query_runs(spark, both):
    sc = spark.sparkContext
    sc.setJobGroup("planning", "")
    df = resolve(both[1], replace(ASKED[10], mode="total"))
    plan = plan_of(df)
    assert list(sc.statusTracker().getJobIdsForGroup("planning")) == []
    sc.setJobGroup("rest", "")
    assert "dynamicpruning" in plan
    years = composite.event_years(both[1].index, "oni", 7, "ge", 0.0)
    want = by(reduce.climatology(both[1].monthly.where("var = 't' AND level = 500 AND year IN (2001, 2003)"), ["value"], ["lat_idx", "lon_idx"]), "month", "lat_idx", "lon_idx")
    assert {r["year"] for r in years.collect()} == {1999, 2001, 2003, 2005}
    got = by(df, "month", "lat_idx", "lon_idx")
    assert got.keys() == want.keys() and all(abs(got[k]["value"] - want[k]["value"]) < 1e-9 for k in want)


def test_reference_choices(store):
    year, clim = FieldRequest("t", year=2001, mode="anomaly"), FieldRequest("t", mode="anomaly")
    assert reference_choices(store, FieldRequest("t")) == []
    assert reference_choices(store, year)[0] == ("default", "vs. 2000–2004 mean (current climatology)", True)
    assert reference_choices(store, clim)[:2] == [("default", "Self · 12-month mean", True), ("best-match", "Best-matching 30 years", False)]
    assert [(p, ok) for p, _, ok in reference_choices(store, replace(clim, kind="std"))[2:]] == [("2000-2004", False), ("2000-2002", True), ("2002-2004", True)]


def test_two_sides_share_a_range(store):
    r = FieldRequest("t", month=None, level=500, compare_year=2004)
    rows = resolve_sides(store, r)
    one = sides_range(store, r, rows).collect()
    each = [display_range(store, FieldRequest("t", month=None, level=500, **k), resolve(store, FieldRequest("t", month=None, level=500, **k))).first()
            for k in ({}, {"year": 2004})]
    assert len(one) == 1 and one[0]["vmin"] == min(x["vmin"] for x in each) and one[0]["vmax"] == max(x["vmax"] for x in each)
    assert {x["side"]: x["count"] for x in rows.groupBy("side").count().collect()} == {"active": 12 * 156, "target": 12 * 156}
    assert sides_range(store, replace(r, user_min=1.0), rows).first()["vmin"] == 1.0
    with pytest.raises(ValueError):
        resolve_sides(store, FieldRequest("t"))


def test_bucketed_tables_meet_without_a_shuffle(spark, sf):
    import re

    from zonalis.plans.catalogue import stored
    monthly, clim = stored.bucketed(spark, sf, "u", "v")
    m, c = spark.table(monthly), spark.table(clim)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df, joins in ((stored.with_reference(m.where("var = 'u'"), c.where("var = 'u'")), 2), (stored.wind_climatology(m), 0)):
            plan = plan_of(df)
            assert not re.search(r"\bExchange", plan) and len(re.findall("SortMergeJoin|ShuffledHashJoin", plan)) == joins
            assert df.count() > 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        for t in (monthly, clim):
            spark.sql(f"DROP TABLE {t}")
