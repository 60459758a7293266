"""Indices, event composites, best-matching windows and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalis.functions import fields as fx
from zonalis.operators import composite, decompose, reduce, series, vertical
from zonalis.plans import jobs
from zonalis.plans.catalogue.base import (CELL, SPEC, SQL_INDEX, SQL_LEVELS, SQL_SAMPLES, SQL_WINDOWS, WINDOWS, monthly,
                                          query, with_)
from zonalis.plans.catalogue.diagnostics import sql_isentrope
from zonalis.session import work_folder
from zonalis.sources import indices, tables
from zonalis.sources.files import Files

KEYS = "month:i level:i lat_idx:i lon_idx:i "
BOX = (-40.0, 40.0, 150.0, -100.0)
SQL_BOX = ("(90.0 - 15.0 * lat_idx) BETWEEN -40 AND 40 AND ((-180 + 30 * lon_idx) >= 150 OR (-180 + 30 * lon_idx) <= -100)")
CODES = ["DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ"]


# index files --------------------------------------------------------------------------------
def _psl_lines(spark, sf):
    """The monthly index written in the yearly text layout: every fifth month carries the
    sentinel the footer declares, months without data the usual one."""
    idx = tables.monthly_index(spark, sf)
    v = F.when(F.col("month") % 5 == 0, F.lit("7.77")).otherwise(F.format_string("%.2f", "value"))
    cell = [F.coalesce(F.max(F.when(F.col("month") == m, v)), F.lit("-99.90")) for m in range(1, 13)]
    body = (idx.groupBy("id", "year").agg(F.concat_ws("  ", *cell).alias("c"))
            .select("id", F.col("year").alias("line_no"), F.concat_ws("  ", F.col("year").cast("string"), "c").alias("value")))
    ends = (idx.groupBy("id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
            .select("id", F.explode(F.array(
                F.struct(F.lit(0).alias("line_no"), F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")).alias("value")),
                F.struct(F.lit(9001).alias("line_no"), F.lit("  7.77").alias("value")),
                F.struct(F.lit(9002).alias("line_no"), F.lit("monthly mean order value").alias("value")))).alias("x"))
            .select("id", "x.*"))
    return body.unionByName(ends)


SQL_PSL = """,
g AS (SELECT DISTINCT id, year FROM idx),
result AS (SELECT g.id, g.year, m AS month, CASE WHEN m % 5 <> 0 THEN round(i.value, 2) END AS value
  FROM g, range(1, 13) AS r(m) LEFT JOIN idx i ON i.year = g.year AND i.month = m)"""


@query("S16_S18_index_psl", "id:s year:i month:i value:2", with_(SQL_INDEX) + SQL_PSL)
def index_psl(spark, sf):
    return indices.parse_psl(_psl_lines(spark, sf))


@query("S17_index_cpc", "id:s year:i month:i value:2", with_(SQL_INDEX) + """,
result AS (SELECT id, year, month, CASE WHEN month <> 4 THEN round(value, 2) END AS value FROM idx)""")
def index_cpc(spark, sf):
    idx = tables.monthly_index(spark, sf)
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), F.col("month"))
    v = F.when(F.col("month") == 4, F.lit("-99.9")).otherwise(F.format_string("%.2f", "value"))
    lines = idx.select("id", F.concat_ws("  ", code, F.col("year").cast("string"), v).alias("value"))
    header = idx.select("id").distinct().select("id", F.lit(" SEAS  YR   ANOM").alias("value"))
    return indices.parse_cpc_seasonal(lines.unionByName(header))


@query("S18_sentinel_test", "quantity:i n:l missing:l", """WITH
result AS (SELECT l_quantity AS quantity, count(*) AS n,
  count(*) FILTER (abs(-(l_quantity - 0.07) + 9.9) < 0.05 OR abs(-(l_quantity - 0.07) + 99.9) < 0.05) AS missing
  FROM lineitem GROUP BY ALL)""")
def sentinel_test(spark, sf):
    v = -(F.col("l_quantity") - 0.07)
    known = F.array(*[F.lit(s) for s in (-99.9, -999.0, -9.9)])
    return (tables.table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("quantity"))
            .agg(F.count("*").alias("n"), F.count(F.when(indices.is_missing(v, known), 1)).alias("missing")))


@query("S19_index_json_roundtrip", "id:s year:i month:i value:6", with_(SQL_INDEX) + """,
result AS (SELECT g.id, g.year, m AS month, i.value FROM (SELECT DISTINCT id, year FROM idx) g, range(1, 13) AS r(m)
  LEFT JOIN idx i ON i.year = g.year AND i.month = m)""")
def index_json(spark, sf):
    return indices.from_json(indices.to_json(tables.monthly_index(spark, sf)))


@query("S19_B13_index_document", "id:s label:s long_name:s source:s year:i month:i value:6", with_(SQL_INDEX) + """,
result AS (SELECT g.id, 'ONI' AS label, 'Oceanic Niño Index' AS long_name, 'https://psl.noaa.gov/data/correlation/oni.data' AS source, g.year, m AS month, i.value
  FROM (SELECT DISTINCT id, year FROM idx) g, range(1, 13) AS r(m) LEFT JOIN idx i ON i.year = g.year AND i.month = m)""")
def index_document(spark, sf):
    """The document of all indices, with their names and sources, and back."""
    return indices.from_document(indices.document(tables.monthly_index(spark, sf)))


@query("B9_updated_indices", "id:s year:i month:i value:2", with_(SQL_INDEX) + SQL_PSL)
def updated_indices(spark, sf):
    """Index files written from the table, parsed by the job beside a broken one, then again with nothing to do."""
    root = work_folder(spark, "indices")
    text = _psl_lines(spark, sf).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("l"))
    text = text.select("id", F.array_join("l.value", "\n").alias("value"))
    for name, body in [(r["id"], r["value"]) for r in text.collect()] + [("pna", "not an index")]:       # one short file per index
        Files(spark, root).put(f"{root}/in/{name}.data", body)
    jobs.update_indices(spark, f"{root}/in", f"{root}/out")
    jobs.update_indices(spark, f"{root}/in", f"{root}/out")
    return spark.read.parquet(f"{root}/out/values")


@query("G21_B9_index_coverage", "id:s n_months:l first_year:i last_year:i", with_(SQL_INDEX) + """,
result AS (SELECT id, count(*) FILTER (month % 5 <> 0) AS n_months, min(year) AS first_year, max(year) AS last_year
  FROM idx GROUP BY ALL)""")
def index_coverage(spark, sf):
    return indices.coverage(indices.parse_all(_psl_lines(spark, sf)))


@query("B13_index_lookup", "id:s year:i month:i value:6", with_(SQL_INDEX) + """,
result AS (SELECT id, year, month, value FROM idx WHERE id = 'oni' AND month = 7)""")
def index_lookup(spark, sf):
    return tables.monthly_index(spark, sf).where("id = 'oni' AND month = 7")


# composites ------------------------------------------------------------------------------------
SQL_EVENTS = """ev AS (SELECT DISTINCT year FROM idx WHERE id = 'oni' AND month = 7 AND value >= 0.0)"""


def _events(spark, sf, cmp="ge", threshold=0.0, month=7):
    return composite.event_years(tables.monthly_index(spark, sf), "oni", month, cmp, threshold)


@query("D8_event_years", "cmp:s year:i", with_(SQL_INDEX) + """,
result AS (SELECT 'ge' AS cmp, year FROM idx WHERE month = 7 AND value >= 0 UNION ALL
  SELECT 'le', year FROM idx WHERE month = 7 AND value <= 0)""")
def event_years(spark, sf):
    return (_events(spark, sf).withColumn("cmp", F.lit("ge"))
            .unionByName(_events(spark, sf, "le").withColumn("cmp", F.lit("le"))))


@query("J5_X3_clip_events", "year:i kept:b", with_(SQL_INDEX, SQL_SAMPLES, SQL_EVENTS) + """,
more AS (SELECT year FROM ev UNION SELECT year - 3 FROM ev),
result AS (SELECT year, year IN (SELECT DISTINCT year FROM samples) AS kept FROM more)""")
def clip_events(spark, sf):
    ev = _events(spark, sf)
    more = ev.unionByName(ev.select((F.col("year") - 3).alias("year"))).distinct()
    kept, dropped = composite.split_available(more, tables.upper_samples(spark, sf))
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


@query("J4_G4_D9_composite_mean", KEYS + "t:6", with_(SQL_SAMPLES, SQL_INDEX, SQL_EVENTS) + """,
result AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS t FROM mon SEMI JOIN ev USING (year) GROUP BY ALL)""")
def composite_mean(spark, sf):
    return composite.composite_mean(monthly(spark, sf, "t"), _events(spark, sf), ["t"])


@query("D11_G4_year_list_composite", KEYS + "t:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS t FROM mon WHERE year IN (1996, 1998, 2001) GROUP BY ALL)""")
def year_list_composite(spark, sf):
    years = composite.requested_years(spark, years=[2001, 1996, 1998, 1996])
    return composite.composite_mean(monthly(spark, sf, "t"), years, ["t"])


@query("D11_range_composite", KEYS + "t:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS t FROM mon WHERE year BETWEEN 1997 AND 1999 GROUP BY ALL)""")
def range_composite(spark, sf):
    years = composite.requested_years(spark, start=1997, end=1999)
    return composite.composite_mean(monthly(spark, sf, "t"), years, ["t"])


@query("G5_derived_composite", KEYS + "wspd:6", with_(SQL_SAMPLES, SQL_INDEX, SQL_EVENTS) + """,
result AS (SELECT month, level, lat_idx, lon_idx, avg(sqrt(u*u + v*v)) AS wspd FROM mon SEMI JOIN ev USING (year) GROUP BY ALL)""")
def derived_composite(spark, sf):
    m = monthly(spark, sf, "u", "v").withColumn("wspd", fx.wind_speed(F.col("u"), F.col("v")))
    return composite.composite_mean(m, _events(spark, sf), ["wspd"])


@query("G5_theta_composite", "month:i lat_idx:i lon_idx:i u:6",
       with_(SQL_SAMPLES, SQL_INDEX, SQL_EVENTS, SQL_LEVELS,
             sql_isentrope("(SELECT * FROM mon SEMI JOIN ev USING (year))", "year, month, lat_idx, lon_idx", "u", 350.0, "th0")) + """,
result AS (SELECT month, lat_idx, lon_idx, avg(u) AS u FROM th0 GROUP BY ALL)""")
def theta_composite(spark, sf):
    """Each year is put on the surface first; then the years are averaged."""
    m = monthly(spark, sf, "t", "u").join(F.broadcast(_events(spark, sf)), "year", "left_semi")
    on = vertical.on_isentrope(m, ["year", "month", "lat_idx", "lon_idx"], ["u"], 350.0, SPEC)
    return reduce.climatology(on, ["u"], ["lat_idx", "lon_idx"])


@query("D9_composite_anomaly", KEYS + "t:6", with_(SQL_SAMPLES, SQL_INDEX, SQL_EVENTS) + """,
e AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS t FROM mon SEMI JOIN ev USING (year) GROUP BY ALL),
c AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS c FROM mon GROUP BY ALL),
result AS (SELECT month, level, lat_idx, lon_idx, t - c AS t FROM e LEFT JOIN c USING (month, level, lat_idx, lon_idx))""")
def composite_anomaly(spark, sf):
    m = monthly(spark, sf, "t")
    mean = composite.composite_mean(m, _events(spark, sf), ["t"])
    return decompose.anomaly(mean, reduce.climatology(m, ["t"]), ["month", *CELL], "t")


SQL_BEST = """best AS (SELECT y.year, arg_min(id, (abs(y.year - center), -center)) AS window_id
  FROM (SELECT DISTINCT year FROM idx) y, win GROUP BY ALL)"""


@query("J7_best_window", "year:i window_id:s win_start:i win_end:i n:l", with_(SQL_INDEX, SQL_WINDOWS, SQL_BEST) + """,
result AS (SELECT b.year, window_id, first AS win_start, last AS win_end, count(*) AS n FROM best b
  JOIN idx USING (year) JOIN win ON win.id = window_id GROUP BY ALL)""")
def best_window(spark, sf):
    years = tables.monthly_index(spark, sf).groupBy("year").agg(F.count("*").alias("n"))
    return composite.best_window(years, WINDOWS)


@query("J8_window_weights", "window_id:s n:l weight:8", with_(SQL_INDEX, SQL_WINDOWS, SQL_BEST, SQL_EVENTS) + """,
result AS (SELECT window_id, count(*) AS n, count(*) / (SELECT count(*) FROM ev)::DOUBLE AS weight
  FROM ev JOIN best USING (year) GROUP BY ALL)""")
def window_weights(spark, sf):
    return composite.window_weights(composite.best_window(_events(spark, sf), WINDOWS))


@query("D10_J8_sliding_composite_anomaly", KEYS + "t:6",
       with_(SQL_SAMPLES, SQL_INDEX, SQL_WINDOWS, SQL_BEST, SQL_EVENTS) + """,
wc AS (SELECT w.id AS window_id, month, level, lat_idx, lon_idx, avg(t) AS c FROM mon JOIN win w ON mon.year BETWEEN w.first AND w.last GROUP BY ALL),
ew AS (SELECT year, window_id FROM ev JOIN best USING (year)),
ref AS (SELECT month, level, lat_idx, lon_idx, CASE WHEN count(*) = (SELECT count(*) FROM ew) THEN avg(c) END AS c
  FROM ew JOIN wc USING (window_id) GROUP BY ALL),
e AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS t FROM mon SEMI JOIN ev USING (year) GROUP BY ALL),
result AS (SELECT month, level, lat_idx, lon_idx, t - c AS t FROM e LEFT JOIN ref USING (month, level, lat_idx, lon_idx))""")
def sliding_composite_anomaly(spark, sf):
    """One climatology per window, weighted by the events that fall to it."""
    m, w = monthly(spark, sf, "t"), WINDOWS
    ev = _events(spark, sf)
    weights = composite.window_weights(composite.best_window(ev, w))
    ref = composite.sliding_reference(composite.window_climatologies(m, w, ["t"]), weights, ["t"])
    return decompose.anomaly(composite.composite_mean(m, ev, ["t"]), ref, ["month", *CELL], "t")


@query("D5_best_match_year_anomaly", "year:i " + KEYS + "t:6", with_(SQL_SAMPLES, SQL_INDEX, SQL_WINDOWS, SQL_BEST) + """,
wc AS (SELECT w.id AS window_id, month, level, lat_idx, lon_idx, avg(t) AS c FROM mon JOIN win w ON mon.year BETWEEN w.first AND w.last GROUP BY ALL),
result AS (SELECT year, month, level, lat_idx, lon_idx, t - c AS t FROM mon JOIN best USING (year)
  LEFT JOIN wc USING (window_id, month, level, lat_idx, lon_idx))""")
def best_match_anomaly(spark, sf):
    m, w = monthly(spark, sf, "t"), WINDOWS
    tagged = composite.best_window(m, w)
    return decompose.anomaly(tagged, composite.window_climatologies(m, w, ["t"]), ["window_id", "month", *CELL], "t")


# time series ---------------------------------------------------------------------------------------
SQL_SERIES = f"""ser AS (SELECT level, year, month, sum(t * cos(radians(90.0 - 15.0 * lat_idx))) / sum(cos(radians(90.0 - 15.0 * lat_idx))) AS t_mean,
  year + (month - 0.5) / 12 AS t FROM mon WHERE {SQL_BOX} GROUP BY level, year, month)"""


def _series(spark, sf):
    return series.area_series(monthly(spark, sf, "t").withColumnRenamed("t", "t_mean"), SPEC, BOX, "t_mean", ["level"])


@query("G11_K16_area_series", "level:i year:i month:i t:6 t_mean:6", with_(SQL_SAMPLES, SQL_SERIES) + ", result AS (SELECT * FROM ser)")
def area_series(spark, sf):
    return _series(spark, sf)


@query("K16_complete_series", "level:i year:i month:i t:6 t_mean:6", with_(SQL_SAMPLES, SQL_SERIES) + """,
result AS (SELECT g.level, g.year, m AS month, g.year + (m - 0.5) / 12 AS t, s.t_mean
  FROM (SELECT DISTINCT level, year FROM ser) g, range(1, 13) AS r(m)
  LEFT JOIN ser s ON s.level = g.level AND s.year = g.year AND s.month = m)""")
def complete_series(spark, sf):
    return series.complete_series(_series(spark, sf), SPEC, ["level"])


@query("K16_series_anomaly", "level:i year:i month:i t_mean:6", with_(SQL_SAMPLES, SQL_SERIES) + f""",
c AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS t FROM mon GROUP BY ALL),
cs AS (SELECT level, month, sum(t * cos(radians(90.0 - 15.0 * lat_idx))) / sum(cos(radians(90.0 - 15.0 * lat_idx))) AS c
  FROM c WHERE {SQL_BOX} GROUP BY level, month),
result AS (SELECT level, year, month, t_mean - c AS t_mean FROM ser LEFT JOIN cs USING (level, month))""")
def series_anomaly(spark, sf):
    c = reduce.climatology(monthly(spark, sf, "t"), ["t"]).withColumnRenamed("t", "t_mean")
    cs = reduce.box_mean(c, SPEC, ["level", "month"], ["t_mean"], BOX)
    return series.series_anomaly(_series(spark, sf), cs, "t_mean", ["level"])


@query("K16_J7_sliding_series_anomaly", "level:i year:i month:i window_id:s t_mean:6",
       with_(SQL_SAMPLES, SQL_INDEX, SQL_WINDOWS, SQL_BEST, SQL_SERIES) + f""",
wc AS (SELECT w.id AS window_id, month, level, lat_idx, lon_idx, avg(t) AS t FROM mon JOIN win w ON mon.year BETWEEN w.first AND w.last GROUP BY ALL),
cs AS (SELECT window_id, level, month, sum(t * cos(radians(90.0 - 15.0 * lat_idx))) / sum(cos(radians(90.0 - 15.0 * lat_idx))) AS c
  FROM wc WHERE {SQL_BOX} GROUP BY window_id, level, month),
result AS (SELECT s.level, s.year, s.month, window_id, t_mean - c AS t_mean FROM ser s JOIN best USING (year)
  LEFT JOIN cs USING (window_id, level, month))""")
def sliding_series(spark, sf):
    w = WINDOWS
    wc = composite.window_climatologies(monthly(spark, sf, "t"), w, ["t"]).withColumnRenamed("t", "t_mean")
    ws = reduce.box_mean(wc, SPEC, ["level", "window_id", "month"], ["t_mean"], BOX)
    return series.series_sliding_anomaly(_series(spark, sf), ws, w, "t_mean", ["level"])


@query("G20_series_summary", "level:i n:l n_loaded:l loaded_share:8 mean_value:6", with_(SQL_SAMPLES, SQL_SERIES) + """,
f AS (SELECT g.level, s.t_mean FROM (SELECT DISTINCT level, year FROM ser) g, range(1, 13) AS r(m)
  LEFT JOIN ser s ON s.level = g.level AND s.year = g.year AND s.month = m),
result AS (SELECT level, count(*) AS n, count(t_mean) AS n_loaded, count(t_mean) / count(*)::DOUBLE AS loaded_share,
  avg(t_mean) AS mean_value FROM f GROUP BY ALL)""")
def series_summary(spark, sf):
    return series.summary(series.complete_series(_series(spark, sf), SPEC, ["level"]), "t_mean", ["level"])


@query("O4_nearest_series_point", "year:i month:i t:6 value:6", with_(SQL_INDEX) + """,
result AS (SELECT year, month, year + (month - 0.5) / 12 AS t, value FROM idx
  ORDER BY abs(year + (month - 0.5) / 12 - 1998.37), t LIMIT 1)""")
def nearest_point(spark, sf):
    s = tables.monthly_index(spark, sf).withColumn("t", fx.fractional_year(F.col("year"), F.col("month")))
    return series.nearest_point(s, 1998.37)


@query("S20_series_csv", "year:i month:i line:s", with_(SQL_INDEX) + """,
result AS (SELECT year, month, year || ',' || month || ',' || CASE WHEN month = 6 THEN '' ELSE CAST(round(value, 3) AS VARCHAR) END AS line FROM idx)""")
def series_csv(spark, sf):
    s = tables.monthly_index(spark, sf).withColumn("value", F.when(F.col("month") != 6, F.round("value", 3)))
    return series.to_csv_lines(s, "value")
