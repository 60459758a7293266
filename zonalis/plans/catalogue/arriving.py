"""Streaming runs over the sample tables, driven to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalis.operators import vertical
from zonalis.plans.catalogue.base import CELL, SQL_SAMPLES, monthly, query, with_
from zonalis.session import work_folder
from zonalis.sources import fields as store
from zonalis.sources import tables
from zonalis.streaming import arrivals, settled

KEYS = ["month", *CELL]
LONG = ["year", "month", *CELL]
#: Tasks that hold the state of slices (a month of a level), however many tasks the session's shuffles have.
STATE_TASKS = 12


@query("T2_progressive_climatology", "month:i level:i lat_idx:i lon_idx:i t:6", with_(SQL_SAMPLES) + """,
result AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS t FROM raw GROUP BY ALL)""")
def progressive(spark, sf):
    """Running sums over the arriving samples, in update mode."""
    work = work_folder(spark, "progressive")
    schema = tables.table(spark, sf, "lineitem").schema
    samples = tables.upper_from(arrivals.arriving(spark, f"{sf.rstrip('/')}/lineitem.parq*", schema))
    q = arrivals.upsert_batches(arrivals.progressive_mean(samples, KEYS, "t"), f"{work}/out", f"{work}/ckpt", KEYS)
    q.awaitTermination()
    return arrivals.mean_of(arrivals.latest_rows(spark, f"{work}/out"), "t")


def _landing(spark, sf, work):
    """Monthly fields dropped into a folder in three deliveries, one of them repeated.

    The samples are read once. A delivery has at most a file per year (and one without rows), whatever the number of tasks that made its rows: each
    file is a batch of the streams below.
    """
    rows = vertical.columns_to_fields(monthly(spark, sf, "t"), LONG, ["t"]).withColumn("grp", F.lit("pressure_levels"))
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in store.MONTHLY_SCHEMA])
    rows.write.parquet(f"{work}/made")
    rows = spark.read.schema(store.MONTHLY_SCHEMA).parquet(f"{work}/made")
    folder = f"{work}/landing"
    for years in ((1995, 1996), (1997, 1998, 1999), (1997,), (2000, 2001)):
        rows.where(F.col("year").isin(*years)).repartition("year").write.mode("append").parquet(folder)
    return folder


@query("T1_T4_T6_fresh_climatology", "kind:s month:i level:i lat_idx:i lon_idx:i value:6", with_(SQL_SAMPLES) + """,
s AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS m, stddev_pop(t) AS d FROM mon WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL),
result AS (SELECT 'mean' AS kind, month, level, lat_idx, lon_idx, m AS value FROM s UNION ALL SELECT 'std', month, level, lat_idx, lon_idx, d FROM s)""")
def fresh_climatology(spark, sf):
    work = work_folder(spark, "fresh")
    stream = arrivals.arriving(spark, _landing(spark, sf, work), store.MONTHLY_SCHEMA, files_per_batch=1)
    arrivals.keep_climatology_fresh(stream, f"{work}/out", 1996, 2000, f"{work}/ckpt").awaitTermination()
    return spark.read.parquet(f"{work}/out/climatology")


@query("T3_readiness_gate", "level:i month:i n_years:i ready:b", with_(SQL_SAMPLES) + """,
result AS (SELECT level, month, count(DISTINCT year) AS n_years, count(DISTINCT year) = 3 AS ready FROM mon
  WHERE year IN (1999, 2000, 2001) GROUP BY ALL)""")
def readiness(spark, sf):
    """Slices of which all of 1999-2001 have arrived (2001 ends before December)."""
    work = work_folder(spark, "ready")
    stream = arrivals.arriving(spark, _landing(spark, sf, work), store.MONTHLY_SCHEMA, files_per_batch=1)
    q = arrivals.upsert_batches(arrivals.ready_slices(stream, (1999, 2000, 2001)), f"{work}/out", f"{work}/ckpt", arrivals.SLICE, state_tasks=STATE_TASKS)
    q.awaitTermination()
    return arrivals.latest_rows(spark, f"{work}/out")


@query("T3_ready_slices", "var:s level:i month:i n_years:i", with_(SQL_SAMPLES) + """,
result AS (SELECT 't' AS var, level, month, count(DISTINCT year) AS n_years FROM mon WHERE year IN (1999, 2000, 2001)
  GROUP BY level, month HAVING count(DISTINCT year) = 3)""")
def ready_slices(spark, sf):
    """Each slice once, when the last of its years arrives; its state is gone then."""
    work = work_folder(spark, "once")
    stream = arrivals.arriving(spark, _landing(spark, sf, work), store.MONTHLY_SCHEMA, files_per_batch=1)
    arrivals.emit_ready(stream, (1999, 2000, 2001), f"{work}/out", f"{work}/ckpt", state_tasks=STATE_TASKS).awaitTermination()
    return spark.read.schema("var string, level int, month int, n_years int").parquet(f"{work}/out")


@query("T5_settled_stream", "year:i level:i n:l total:4", with_(SQL_SAMPLES) + """,
d AS (SELECT year, level, t FROM mon UNION ALL SELECT year, level, t FROM mon WHERE year = 1997),
result AS (SELECT year, level, count(*) AS n, sum(t) AS total FROM d GROUP BY ALL)""")
def settled_stream(spark, sf):
    """Only files that have settled are read, two a batch (here any age will do)."""
    work = work_folder(spark, "settled")
    stream = settled.settled_stream(spark, _landing(spark, sf, work), f"{work}/log", store.MONTHLY_SCHEMA, age=0, files_per_batch=2)
    q = stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/ckpt").start()
    q.processAllAvailable()                                # availableNow would run a single batch of this source
    q.stop()
    return spark.read.parquet(f"{work}/out").groupBy("year", "level").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("T7_pending_inputs", "total:l pending:l rows:l", with_(SQL_SAMPLES) + """,
result AS (SELECT 7 * 7 * 12 AS total, 7 * 7 * 12 - count(DISTINCT (level, year, month)) AS pending,
  count(*) + count(*) FILTER (year = 1997) AS rows FROM mon)""")
def pending_inputs(spark, sf):
    """Tiles of a view that are still missing when the stream has seen all there is."""
    work = work_folder(spark, "pending")
    want = arrivals.PendingInputs([("t", lev, y, m) for lev in tables.SAMPLE_SPEC.levels for y in range(1995, 2002) for m in range(1, 13)])
    stream = arrivals.observed(arrivals.arriving(spark, _landing(spark, sf, work), store.MONTHLY_SCHEMA, files_per_batch=1))
    q = stream.writeStream.format("noop").option("checkpointLocation", f"{work}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    for progress in q.recentProgress:
        want.see(progress)
    return spark.range(1).select(F.lit(want.total).alias("total"), F.lit(want.pending).alias("pending"), F.lit(want.rows).alias("rows"))
