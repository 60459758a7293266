"""Requests answered from stored trees: climatologies, sigmas and references made before, and pruned composites."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from zonalis.functions.fields import wind_speed
from zonalis.operators import vertical
from zonalis.plans import jobs
from zonalis.plans.catalogue.base import CELL, SPEC, SQL_CLIM, SQL_INDEX, SQL_SAMPLES, SQL_WINDOWS, WINDOWS, monthly, query, with_
from zonalis.plans.catalogue.events import SQL_BEST, SQL_EVENTS
from zonalis.plans.request import FieldRequest, FieldStore, decode, open_store, resolve
from zonalis.session import work_folder
from zonalis.sources import fields, tables

OUT = "month:i lat_idx:i lon_idx:i "
ACTIVE = "1995-2001"


def build(spark, sf, *names, periods=(ACTIVE,), derived=False, index=None) -> FieldStore:
    """Monthly fields written as a tree, climatologies of some periods beside them, and the store opened on both."""
    root = work_folder(spark, "stored")
    long = vertical.columns_to_fields(monthly(spark, sf, *names), ["year", "month", *CELL], names).withColumn("grp", F.lit("pressure_levels"))
    jobs.build_per_year(long, root)
    kept = spark.read.parquet(f"{root}/per_year")
    for p in periods:
        a, b = map(int, p.split("-"))
        jobs.build_climatology(kept, root, a, b)
        if derived:
            jobs.build_derived_std(kept, root, a, b)
    return open_store(spark, root, SPEC, ACTIVE, WINDOWS, index)


@query("S12_D1_stored_climatology", "name:s " + OUT + "value:6", with_(SQL_CLIM) + """,
result AS (SELECT 't' AS name, month, lat_idx, lon_idx, t AS value FROM clim WHERE level = 500
  UNION ALL SELECT 'wspd', month, lat_idx, lon_idx, sqrt(u*u + v*v) FROM clim WHERE level = 200)""")
def stored_climatology(spark, sf):
    """A raw field is read as it lies there; a derived one is made of its stored ingredients."""
    s = build(spark, sf, "t", "u", "v")
    parts = [resolve(s, FieldRequest(n, month=None, level=level)).withColumn("name", F.lit(n)) for n, level in (("t", 500), ("wspd", 200))]
    return parts[0].unionByName(parts[1])


@query("S12_B10_stored_active_period", OUT + "value:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, lat_idx, lon_idx, avg(t) AS value FROM mon WHERE level = 850 AND year BETWEEN 1997 AND 1999 AND month = 4 GROUP BY ALL)""")
def stored_active_period(spark, sf):
    """The default period is the active one, here another than that of the other tree."""
    s = replace(build(spark, sf, "t", periods=(ACTIVE, "1997-1999")), active="1997-1999")
    return resolve(s, FieldRequest("t", month=4, level=850))


@query("D2_stored_derived_sigma", OUT + "value:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, lat_idx, lon_idx, stddev_pop(sqrt(u*u + v*v)) AS value FROM mon WHERE level = 200 GROUP BY ALL)""")
def stored_derived_sigma(spark, sf):
    return resolve(build(spark, sf, "u", "v", "t", "z", "q", derived=True), FieldRequest("wspd", month=None, kind="std"))


SQL_ZSCORE = """,
s AS (SELECT month, lat_idx, lon_idx, avg(t) AS m, stddev_pop(t) AS sd FROM mon WHERE level = 500 GROUP BY ALL),
f AS (SELECT month, list_sort(list(sd))[CAST(floor(0.02::DOUBLE * count(*)) AS BIGINT) + 1] AS fl FROM s WHERE sd > 0 GROUP BY ALL),
y AS (SELECT month, lat_idx, lon_idx, t FROM mon WHERE level = 500 AND year = 1998),
result AS (SELECT month, lat_idx, lon_idx, CASE WHEN sd > 0 THEN (t - m) / greatest(sd, fl) END AS value
  FROM y LEFT JOIN s USING (month, lat_idx, lon_idx) LEFT JOIN f USING (month))"""


def bucketed(spark, sf, *names) -> tuple[str, str]:
    """Tables of the monthly fields and of their climatologies, bucketed alike."""
    root, name = work_folder(spark, "bucketed"), f"zonalis_{uuid.uuid4().hex}"
    long = vertical.columns_to_fields(monthly(spark, sf, *names), ["year", "month", *CELL], names).withColumn("grp", F.lit("pressure_levels"))
    fields.write_bucketed(long, f"{name}_monthly", f"{root}/monthly", 8)
    kept = spark.table(f"{name}_monthly")
    fields.write_bucketed(jobs.climatology_rows(kept, 1995, 2001), f"{name}_clim", f"{root}/clim", 8)
    return f"{name}_monthly", f"{name}_clim"


@query("J6_J1_bucketed_anomaly", "year:i month:i level:i lat_idx:i lon_idx:i value:6 sigma:6", with_(SQL_SAMPLES) + """,
s AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS m, stddev_pop(t) AS sigma FROM mon GROUP BY ALL),
result AS (SELECT year, month, level, lat_idx, lon_idx, t - m AS value, sigma FROM mon JOIN s USING (month, level, lat_idx, lon_idx))""")
def bucketed_anomaly(spark, sf):
    """A field of all years beside its climatology and sigma: three reads, two joins, no shuffle."""
    m, c = map(spark.table, bucketed(spark, sf, "t"))
    return with_reference(m.where("var = 't'"), c.where("var = 't'"))


def with_reference(field, clim):
    keys = list(fields.CELL_KEYS)
    mean, sigma = (clim.where(F.col("kind") == k).select(*keys, F.col("value").alias(n)) for k, n in (("mean", "_mean"), ("std", "sigma")))
    both = field.join(mean, keys).join(sigma, keys)
    return both.select("year", *keys, (F.col("value") - F.col("_mean")).alias("value"), "sigma")


@query("J1_G1_bucketed_wind_climatology", OUT + "level:i wspd:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, lat_idx, lon_idx, level, avg(sqrt(u*u + v*v)) AS wspd FROM mon GROUP BY ALL)""")
def bucketed_wind(spark, sf):
    """Components brought together and years averaged where they lie: no shuffle either."""
    m = spark.table(bucketed(spark, sf, "u", "v")[0])
    return wind_climatology(m)


def wind_climatology(m):
    both = vertical.fields_to_columns(m, ["year", *fields.CELL_KEYS], ["u", "v"])
    return both.groupBy(*fields.CELL_KEYS).agg(F.avg(wind_speed(F.col("u"), F.col("v"))).alias("wspd"))


@query("D4_stored_zscore", OUT + "value:5", with_(SQL_SAMPLES) + SQL_ZSCORE)
def stored_zscore(spark, sf):
    """Mean, sigma and its floor from the tree; only the year itself is read from the yearly fields."""
    return resolve(build(spark, sf, "t"), FieldRequest("t", month=None, level=500, year=1998, mode="zscore"))


@query("D9_D10_stored_event_composite", OUT + "value:6", with_(SQL_SAMPLES, SQL_INDEX, SQL_WINDOWS, SQL_BEST, SQL_EVENTS) + """,
m5 AS (SELECT * FROM mon WHERE level = 500),
wc AS (SELECT w.id AS window_id, month, lat_idx, lon_idx, avg(t) AS c FROM m5 JOIN win w ON m5.year BETWEEN w.first AND w.last GROUP BY ALL),
ew AS (SELECT year, window_id FROM ev JOIN best USING (year)),
ref AS (SELECT month, lat_idx, lon_idx, CASE WHEN count(*) = (SELECT count(*) FROM ew) THEN avg(c) END AS c FROM ew JOIN wc USING (window_id) GROUP BY ALL),
e AS (SELECT month, lat_idx, lon_idx, avg(t) AS t FROM m5 SEMI JOIN ev USING (year) GROUP BY ALL),
result AS (SELECT month, lat_idx, lon_idx, t - c AS value FROM e LEFT JOIN ref USING (month, lat_idx, lon_idx))""")
def stored_event_composite(spark, sf):
    """Event years prune the yearly folders when the query runs; the sliding windows are stored climatologies."""
    s = build(spark, sf, "t", periods=(ACTIVE, *[w.id for w in WINDOWS]), index=tables.monthly_index(spark, sf))
    return resolve(s, replace(decode("f=t&L=500&d=anomaly&cr=c:oni:ge:0:7"), month=None))
