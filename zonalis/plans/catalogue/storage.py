"""Trees, tiles, catalogue and level append."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonalis.operators import diagnostics, reduce, vertical
from zonalis.plans import jobs
from zonalis.plans.catalogue.base import CELL, SPEC, SQL_CLIM, SQL_SAMPLES, SQL_SURFACE, clim, monthly, query, surface_monthly, with_
from zonalis.registry import field_frame
from zonalis.session import work_folder
from zonalis.sources import fields as store
from zonalis.sources import tables, tiles

KEYS = "month:i level:i lat_idx:i lon_idx:i "
LONG = ["year", "month", *CELL]


def _long(spark, sf, *names):
    """Long monthly rows in display units."""
    wide = monthly(spark, sf, *names)
    return vertical.columns_to_fields(wide, LONG, names).withColumn("grp", F.lit("pressure_levels"))


def _surface_long(spark, sf, *names):
    wide = surface_monthly(spark, sf, *names).withColumn("level", F.lit(0))
    return vertical.columns_to_fields(wide, LONG, names).withColumn("grp", F.lit("single_levels"))


def sql_long(*names: str) -> str:
    return "lg AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS var, year, month, level, lat_idx, lon_idx, {n} AS value FROM mon" for n in names) + ")"


@query("S1_B1_missing_inputs", "var:s year:i", with_(SQL_SAMPLES) + """,
want AS (SELECT v AS var, y AS year FROM (VALUES ('u'), ('v'), ('t')) AS a(v), range(1993, 2004) AS b(y)),
result AS (SELECT * FROM want ANTI JOIN (SELECT DISTINCT year FROM samples) USING (year))""")
def missing_inputs(spark, sf):
    want = (spark.range(1993, 2004).select(F.col("id").cast("int").alias("year"))
            .withColumn("var", F.explode(F.array(*[F.lit(v) for v in ("u", "v", "t")]))))
    return store.missing_inputs(want, tables.upper_samples(spark, sf), ["year"])


@query("B1_acquisition_plan", "grp:s var:s folder:s first:i last:i n_years:l", with_(SQL_SAMPLES, sql_long("t", "u")) + """,
w AS (SELECT v AS var, y AS year FROM (VALUES ('t'), ('u'), ('v')) AS a(v), range(1993, 2004) AS b(y)),
result AS (SELECT 'pressure_levels' AS grp, var, 'raw_1993_2003' AS folder, min(year) AS first, max(year) AS last, count(*) AS n_years
  FROM w ANTI JOIN (SELECT DISTINCT var, year FROM lg) USING (var, year) GROUP BY var)""")
def acquisition_plan(spark, sf):
    """For a period of its own: two fields lack four years, one lacks all."""
    return jobs.acquisition_plan(_long(spark, sf, "t", "u"), "1993-2003", ["t", "u", "v", "sst"], ["pressure_levels"])


@query("S2_J3_axis_aliases", "year:i month:i level:i lat:i lon:i n:l", with_(SQL_SAMPLES) + """,
result AS (SELECT year, month, level, lat_idx AS lat, lon_idx AS lon, count(*) AS n FROM samples GROUP BY ALL)""")
def axis_aliases(spark, sf):
    """An archive that names its axes differently."""
    df = tables.upper_samples(spark, sf).withColumnsRenamed(
        {"lat_idx": "latitude", "lon_idx": "longitude", "level": "pressure_level"})
    return store.normalise_axes(df).groupBy("year", "month", "level", "lat", "lon").agg(F.count("*").alias("n"))


@query("S3_X1_union_of_sources", "grp:s var:s year:i n:l total:3", with_(SQL_SAMPLES, SQL_SURFACE, sql_long("t")) + """,
result AS (SELECT 'pressure_levels' AS grp, var, year, count(*) AS n, sum(value) AS total FROM lg GROUP BY ALL UNION ALL
  SELECT 'single_levels', 'sst', year, count(*), sum(sst) FROM smon GROUP BY year)""")
def union_of_sources(spark, sf):
    both = store.union_fields([_long(spark, sf, "t"), _surface_long(spark, sf, "sst")])
    return both.groupBy("grp", "var", "year").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("S4_O1_main_and_sidecar_levels", "year:i level:i t:6", with_(SQL_SAMPLES) + """,
result AS (SELECT year, level, avg(t) AS t FROM mon WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL ORDER BY year, level)""")
def sidecar_levels(spark, sf):
    """Levels stored apart are merged along the level axis, the years along time."""
    m = _long(spark, sf, "t")
    main, side = m.where("level <> 500 AND level <> 925"), m.where("level IN (500, 925)")
    merged = store.in_years(store.union_fields([main, side]), 1996, 1999)
    return merged.groupBy("year", "level").agg(F.avg("value").alias("t")).orderBy("year", "level")


@query("S5_span_pruning", "folder:s year:i n:l", with_(SQL_SAMPLES) + """,
f AS (SELECT CASE WHEN year <= 1996 THEN 'raw_1995_1996' WHEN year <= 1999 THEN 'raw_1997_1999' ELSE 'raw' END AS folder, year FROM samples),
result AS (SELECT folder, year, count(*) AS n FROM f WHERE folder <> 'raw_1995_1996' GROUP BY ALL)""")
def span_pruning(spark, sf):
    """Folders whose encoded span misses the period 1998-2000 are not read; unknown spans are."""
    folder = (F.when(F.col("year") <= 1996, "raw_1995_1996").when(F.col("year") <= 1999, "raw_1997_1999").otherwise("raw"))
    s = tables.upper_samples(spark, sf).select(folder.alias("folder"), "year")
    first, last = store.span_columns(F.col("folder"))
    keep = first.isNull() | ((first <= 2000) & (last >= 1998))
    return s.where(keep).groupBy("folder", "year").agg(F.count("*").alias("n"))


@query("S6_settled_files", "level:i n:l", with_(SQL_SAMPLES) + """,
result AS (SELECT level, count(*) AS n FROM samples GROUP BY ALL)""")
def settled(spark, sf):
    li = store.keep_settled(tables.table(spark, sf, "lineitem"))
    return (li.select(F.element_at(SPEC.level_array(), F.least("l_linenumber", F.lit(7))).alias("level"))
            .groupBy("level").agg(F.count("*").alias("n")))


@query("S7_B3_climatology_tree", "period:s kind:s var:s level:i month:i lat_idx:i lon_idx:i value:6", with_(SQL_SAMPLES, sql_long("t", "u")) + """,
s AS (SELECT '1996-1999' AS period, var, level, month, lat_idx, lon_idx, avg(value) AS mean, stddev_pop(value) AS std
  FROM lg WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL),
result AS (SELECT period, 'mean' AS kind, var, level, month, lat_idx, lon_idx, mean AS value FROM s UNION ALL
  SELECT period, 'std', var, level, month, lat_idx, lon_idx, std FROM s)""")
def climatology_tree(spark, sf):
    root = work_folder(spark, "clim")
    jobs.build_climatology(_long(spark, sf, "t", "u"), root, 1996, 1999)
    return spark.read.parquet(f"{root}/climatology")


@query("S8_B3_per_year_tree", "var:s level:i year:i month:i lat_idx:i lon_idx:i value:6", with_(SQL_SAMPLES, sql_long("t", "u")) + """,
result AS (SELECT * FROM lg)""")
def per_year_tree(spark, sf):
    """Written as a partitioned tree and read back whole."""
    root = work_folder(spark, "peryear")
    jobs.build_per_year(_long(spark, sf, "t", "u"), root)
    return spark.read.parquet(f"{root}/per_year")


@query("S9_S10_quantize_roundtrip", KEYS + "q:i value:6", with_(SQL_CLIM) + """,
g AS (SELECT month, level, lat_idx, lon_idx, CASE WHEN (lat_idx + lon_idx) % 7 <> 0 THEN u END AS v FROM clim),
r AS (SELECT *, coalesce(min(v) OVER (PARTITION BY month, level), 0) AS lo, coalesce(max(v) OVER (PARTITION BY month, level), 1) AS hi FROM g),
s AS (SELECT *, CASE WHEN hi - lo < 1e-12 THEN lo + 1 ELSE hi END AS up FROM r),
c AS (SELECT *, coalesce(CAST(round_even((v - lo) / (up - lo) * 65534, 0) AS INTEGER), 65535) AS q FROM s),
result AS (SELECT month, level, lat_idx, lon_idx, q, CASE WHEN q <> 65535 THEN lo + q * (up - lo) / 65534 END AS value FROM c)""")
def quantize_roundtrip(spark, sf):
    g = clim(spark, sf, "u").select("month", *CELL, F.when((F.col("lat_idx") + F.col("lon_idx")) % 7 != 0, F.col("u")).alias("value"))
    q = tiles.quantize(g, ["month", "level"])
    return tiles.dequantize(q.withColumn("code", F.col("q"))).withColumnRenamed("code", "q")


@query("S9_B8_quantized_mean_and_sigma", "kind:s level:i month:i vmin:6 vmax:6 n_missing:l", with_(SQL_SAMPLES) + """,
s AS (SELECT month, level, lat_idx, lon_idx, avg(t) AS mean, stddev_pop(t) AS std FROM mon GROUP BY ALL),
d AS (SELECT 'mean' AS kind, level, month, mean AS v FROM s UNION ALL SELECT 'std', level, month, std FROM s),
result AS (SELECT kind, level, month, min(v) AS vmin, max(v) AS vmax, 0 AS n_missing FROM d GROUP BY ALL)""")
def quantized_kinds(spark, sf):
    """Mean and sigma tiles keep their own ranges: the kind is part of the key."""
    c = reduce.climatology(monthly(spark, sf, "t"), ["t"], spread=True)
    d = c.select("month", *CELL, F.explode(F.array(
        F.struct(F.lit("mean").alias("kind"), F.col("t").alias("value")),
        F.struct(F.lit("std").alias("kind"), F.col("t_std").alias("value")))).alias("x")).select("month", *CELL, "x.*")
    q = tiles.quantize(d, ["kind", "level", "month"])
    return q.groupBy("kind", "level", "month").agg(F.first("vmin").alias("vmin"), F.first("vmax").alias("vmax"),
                                                    F.count(F.when(F.col("q") == 65535, 1)).alias("n_missing"))


@query("S11_float32_tiles", "month:i level:i lat_idx:i lon_idx:i value:4", with_(SQL_CLIM) + """,
result AS (SELECT m AS month, l AS level, i AS lat_idx, j AS lon_idx, CAST(u AS FLOAT) AS value FROM
  (SELECT DISTINCT month AS m, level AS l FROM clim), range(13) AS b(i), range(12) AS c(j)
  LEFT JOIN clim ON month = m AND level = l AND lat_idx = i AND lon_idx = j)""")
def float32_tiles(spark, sf):
    """Tiles written as little-endian float32 files by the executors and decoded again."""
    folder = work_folder(spark, "tiles")
    t = tiles.to_arrays(clim(spark, sf, "u"), ["month", "level"], SPEC, "u")
    t = t.withColumn("name", F.format_string("%d_%02d", "level", "month"))
    tiles.write_float32(t, "name", folder)
    return tiles.tile_key(tiles.read_float32(spark, folder, SPEC))


SQL_CODES = """,
k AS (SELECT DISTINCT month AS m, level AS l FROM clim),
g AS (SELECT m AS month, l AS level, i AS lat_idx, j AS lon_idx, CAST(u AS FLOAT)::DOUBLE AS v FROM k, range(13) AS b(i), range(12) AS c(j)
  LEFT JOIN clim ON month = m AND level = l AND lat_idx = i AND lon_idx = j),
r AS (SELECT *, min(v) OVER (PARTITION BY month, level) AS lo, max(v) OVER (PARTITION BY month, level) AS hi FROM g),
result AS (SELECT month, level, lat_idx, lon_idx, lo + round_even((v - lo) / (hi - lo) * 65534, 0) * (hi - lo) / 65534 AS value FROM r"""


def _tile_cells(spark, sf):
    return clim(spark, sf, "u").withColumnRenamed("u", "value").withColumn("var", F.lit("u"))


@query("S9_S10_S12_tile_files", KEYS + "value:6", with_(SQL_CLIM) + SQL_CODES + " WHERE level IN (500, 850) AND month > 3)")
def tile_files(spark, sf):
    """Gzipped codes with their ranges, written by tasks and committed; read back by filters that pick files."""
    root = work_folder(spark, "tilefiles")
    jobs.write_tile_files(_tile_cells(spark, sf), root, SPEC)
    return jobs.read_tile_files(spark, root, SPEC).where("var = 'u' AND kind = 'mean' AND level IN (500, 850) AND month > 3")


@query("S11_B8_compressed_tile_files", KEYS + "value:6", with_(SQL_CLIM) + SQL_CODES + ")")
def compressed_tile_files(spark, sf):
    """Float32 tiles of the whole field, replaced in place by codes."""
    root = work_folder(spark, "tilefiles")
    jobs.write_tile_files(_tile_cells(spark, sf), root, SPEC, "f32")
    jobs.compress_tile_files(spark, root, SPEC)
    return jobs.read_tile_files(spark, root, SPEC)


@query("A2_tile_arrays", KEYS + "u:4", with_(SQL_CLIM) + """,
result AS (SELECT m AS month, l AS level, i AS lat_idx, j AS lon_idx, CAST(u AS FLOAT) AS u FROM
  (SELECT DISTINCT month AS m, level AS l FROM clim), range(13) AS b(i), range(12) AS c(j)
  LEFT JOIN clim ON month = m AND level = l AND lat_idx = i AND lon_idx = j)""")
def tile_arrays(spark, sf):
    keys = ["month", "level"]
    return tiles.from_arrays(tiles.to_arrays(clim(spark, sf, "u"), keys, SPEC, "u"), keys, SPEC, "u")


SQL_META = """,
m AS (SELECT var, min(value) AS vmin, max(value) AS vmax FROM lg GROUP BY ALL),
k AS (SELECT DISTINCT var, level, year, month FROM lg),
result AS (SELECT var, vmin, vmax, (SELECT string_agg(l, ',' ORDER BY l::INT) FROM (SELECT DISTINCT CAST(level AS VARCHAR) AS l FROM k WHERE k.var = m.var)) AS levels,
  (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT CAST(year AS VARCHAR) AS y FROM k WHERE k.var = m.var)) AS years,
  (SELECT count(DISTINCT (year, month)) FROM k WHERE k.var = m.var) AS n_months FROM m)"""


@query("S13_A4_variable_meta", "var:s vmin:6 vmax:6 levels:s years:s n_months:i", with_(SQL_SAMPLES, sql_long("t", "u", "v")) + SQL_META)
def variable_meta(spark, sf):
    meta = store.variable_meta(_long(spark, sf, "t", "u", "v"))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return meta.select("var", "vmin", "vmax", join("levels").alias("levels"), join("years").alias("years"),
                       F.size("year_months").alias("n_months"))


@query("S14_A5_manifest", "grp:s var:s n_levels:i n_years:i", with_(SQL_SAMPLES, SQL_SURFACE, sql_long("t", "u")) + """,
result AS (SELECT 'pressure_levels' AS grp, var, count(DISTINCT level) AS n_levels, count(DISTINCT year) AS n_years FROM lg GROUP BY ALL
  UNION ALL SELECT 'single_levels', 'sst', 1, count(DISTINCT year) FROM smon)""")
def manifest(spark, sf):
    """The JSON manifest per group, parsed back."""
    both = store.union_fields([_long(spark, sf, "t", "u"), _surface_long(spark, sf, "sst")])
    doc = store.manifest_json(store.variable_meta(both))
    entry = "map<string,struct<vmin:double,vmax:double,levels:array<int>,years:array<int>>>"
    return (doc.select("grp", F.explode(F.from_json("manifest", entry)).alias("var", "m"))
            .select("grp", "var", F.size("m.levels").alias("n_levels"), F.size("m.years").alias("n_years")))


@query("B7_appended_level_panel", "month:i level:i lat_idx:i t:6", with_(SQL_SAMPLES, sql_long("t")) + """,
n AS (SELECT year, month, 600 AS level, lat_idx, lon_idx, value + 1 AS value FROM lg WHERE level = 500),
b AS (SELECT year, month, level, lat_idx, lon_idx, value FROM lg UNION ALL SELECT * FROM n),
c AS (SELECT month, level, lat_idx, lon_idx, avg(value) AS v FROM b GROUP BY ALL),
z AS (SELECT month, level, lat_idx, avg(v) AS t FROM c GROUP BY ALL),
result AS (SELECT m.month, l.level, i AS lat_idx, z.t FROM (SELECT DISTINCT month FROM c) m CROSS JOIN (SELECT DISTINCT level FROM c) l CROSS JOIN range(13) AS r(i)
  LEFT JOIN z ON z.month = m.month AND z.level = l.level AND z.lat_idx = i)""")
def appended_level_panel(spark, sf):
    """A level appended to the store is on the axis that the catalogue gives, and in the panel."""
    m = _long(spark, sf, "t")
    new = m.where("level = 500").withColumn("level", F.lit(600)).withColumn("value", F.col("value") + 1)
    both = m.unionByName(store.append_levels(m, new))
    spec = SPEC.with_levels(store.axis_levels(store.variable_meta(both), "t"))
    c = both.groupBy("month", *CELL).agg(F.avg("value").alias("t"))
    return diagnostics.zonal_table(c, ["month"], ["t"], spec).select("month", "level", "lat_idx", "t")


@query("S15_X4_B7_append_levels", "var:s levels:s vmin:6 vmax:6 n:l", with_(SQL_SAMPLES, sql_long("t")) + """,
result AS (SELECT var, (SELECT string_agg(l, ',' ORDER BY l::INT) FROM (SELECT DISTINCT CAST(level AS VARCHAR) AS l FROM lg)) AS levels,
  min(value) AS vmin, max(value) AS vmax, count(*) AS n FROM lg GROUP BY ALL)""")
def append_levels(spark, sf):
    """Two levels are appended twice; the second time changes nothing."""
    m = _long(spark, sf, "t")
    old, new = m.where("level NOT IN (500, 925)"), m.where("level IN (500, 700, 925)")
    once = old.unionByName(store.append_levels(old, new))
    twice = once.unionByName(store.append_levels(once, new))
    meta = store.variable_meta(twice)
    n = twice.groupBy("var").agg(F.count("*").alias("n"))
    return meta.join(n, "var").select("var", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"), "vmin", "vmax", "n")


@query("J14_J15_registry_attributes", "var:s long_name:s units:s n:l", with_(SQL_SAMPLES, sql_long("t", "u")) + """,
a AS (SELECT * FROM (VALUES ('t', 'Temperature', 'K'), ('u', 'Zonal wind', 'm s-1')) AS r(var, long_name, units)),
result AS (SELECT var, CASE WHEN var = 'u' AND level = 500 THEN 'kept' ELSE long_name END AS long_name, units, count(*) AS n
  FROM lg JOIN a USING (var) GROUP BY ALL)""")
def registry_attributes(spark, sf):
    m = _long(spark, sf, "t", "u").withColumn(
        "long_name", F.when((F.col("var") == "u") & (F.col("level") == 500), "kept")).withColumn("units", F.lit(None).cast("string"))
    reg = field_frame(spark).withColumnRenamed("title", "long_name")
    return store.with_attributes(m, reg).groupBy("var", "long_name", "units").agg(F.count("*").alias("n"))


@query("P4_variable_filter", "var:s level:i n:l", with_(SQL_SAMPLES, sql_long("v")) + """,
result AS (SELECT var, level, count(*) AS n FROM lg GROUP BY ALL)""")
def variable_filter(spark, sf):
    return _long(spark, sf, "t", "u", "v").where("var = 'v'").groupBy("var", "level").agg(F.count("*").alias("n"))


@query("B4_completeness", "level:i have:l expected:l complete:b", with_(SQL_CLIM) + """,
result AS (SELECT level, count(*) AS have, 12 * 156 AS expected, count(*) = 12 * 156 AS complete FROM clim GROUP BY ALL)""")
def completeness(spark, sf):
    return jobs.completeness(clim(spark, sf, "t"), ["level"], 12 * SPEC.cells)


@query("O3_nearest_level", "year:i month:i wanted:i level:i", with_(SQL_SURFACE) + """,
w AS (SELECT year, month, (100 + CAST(floor(avg(msl)) AS INT) * 13 % 900) AS wanted FROM smon GROUP BY ALL),
result AS (SELECT year, month, wanted, arg_min(p, (abs(p - wanted), p)) AS level FROM w, (SELECT unnest([200, 300, 500, 700, 850, 925, 1000]) AS p) GROUP BY ALL)""")
def nearest_level(spark, sf):
    w = surface_monthly(spark, sf, "msl").groupBy("year", "month").agg(
        (F.lit(100) + F.floor(F.avg("msl")).cast("int") * 13 % 900).alias("wanted"))
    best = F.aggregate(SPEC.level_array(), F.lit(SPEC.levels[0]), lambda a, x: F.when(
        F.abs(x - F.col("wanted")) < F.abs(a - F.col("wanted")), x).otherwise(a))
    return w.withColumn("level", best)
