"""Batch jobs: the scripts of the build side as functions over DataFrames.

Each takes long monthly fields and a root folder, writes a partitioned tree and can be run
again: dynamic partition overwrite replaces exactly the partitions it produces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import fields as fx
from zonalis.grid import GridSpec, stride, stride_for
from zonalis.operators import reduce, vertical
from zonalis.plans.ledger import BAD, DONE, Ledger
from zonalis.registry import FIELDS, INDEX_LAYOUT, SHEAR_LEVELS
from zonalis.sources import fields as store
from zonalis.sources import indices, tile_files, tiles

LONG_CELL = ("var", "grp", "level", "lat_idx", "lon_idx")


def select_inputs(long: DataFrame, variables: Sequence[str] | None = None, groups: Sequence[str] | None = None,
                  years: tuple[int, int] | None = None, resolution: float | None = None,
                  native: float = 0.5) -> DataFrame:
    """Variable, group, year and resolution filters, all below any aggregation."""
    if variables:
        long = long.where(F.col("var").isin(*variables))
    if groups:
        long = long.where(F.col("grp").isin(*groups))
    if years:
        long = store.in_years(long, *years)
    return stride(long, stride_for(resolution, native)) if resolution else long


def acquisition_plan(present: DataFrame, period: str | None = None, variables: Sequence[str] | None = None,
                     groups: Sequence[str] | None = None, force: bool = False) -> DataFrame:
    """(grp, var, folder, first, last, n_years) of what has to be fetched for a period: the raw fields of the registry less the
    years that are ``present`` (var, year), unless ``force``. A period of its own goes to its own folder, the default to ``raw``.
    """
    start, end = (int(y) for y in store.resolve_period(period).split("-"))
    folder = "raw" if period is None else f"raw_{start}_{end}"
    names = [(f.name, "pressure_levels" if f.kind == "pl" else "single_levels") for f in FIELDS.values() if not f.derived]
    names = [(v, g) for v, g in names if (not variables or v in variables) and (not groups or g in groups)]
    spark = present.sparkSession
    want = (spark.createDataFrame(names, "var string, grp string")
            .withColumn("year", F.explode(F.sequence(F.lit(start), F.lit(end)))))
    todo = want if force else store.missing_inputs(want, present, ["var", "year"])
    return (todo.groupBy("grp", "var").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("n_years"))
            .withColumn("folder", F.lit(folder)))


def climatology_rows(long: DataFrame, start: int, end: int, spread: bool = True) -> DataFrame:
    """(period, kind, var, grp, level, month, cell, value) rows of one period."""
    c = reduce.climatology(store.in_years(long, start, end), ["value"], LONG_CELL, spread)
    kinds = [F.struct(F.lit("mean").alias("kind"), F.col("value").alias("v"))]
    if spread:
        kinds.append(F.struct(F.lit("std").alias("kind"), F.col("value_std").alias("v")))
    return (c.withColumn("_k", F.explode(F.array(*kinds)))
            .select(F.lit(f"{start}-{end}").alias("period"), F.col("_k.kind").alias("kind"), *LONG_CELL, "month",
                    F.col("_k.v").alias("value")))


def build_climatology(long: DataFrame, root: str, start: int, end: int, spread: bool = True) -> str:
    return store.write_climatology(climatology_rows(long, start, end, spread), root)


def build_per_year(long: DataFrame, root: str) -> str:
    return store.write_monthly(long, root)


def derived_monthly(long: DataFrame) -> DataFrame:
    """wspd, mse (per level) and deep-layer shear per single month, from display units."""
    keys = ["year", "month", "level", "lat_idx", "lon_idx"]
    w = vertical.fields_to_columns(long, keys, ["u", "v", "t", "z", "q"])
    both = w.select(*keys, fx.wind_speed(F.col("u"), F.col("v")).alias("wspd"),
                    fx.mse_kelvin(F.col("t"), F.col("z"), F.col("q")).alias("mse"))
    rows = vertical.columns_to_fields(both, keys, ["wspd", "mse"]).withColumn("grp", F.lit("pressure_levels"))
    top, bottom = SHEAR_LEVELS
    s = vertical.levels_to_columns(w, ["year", "month", "lat_idx", "lon_idx"], {
        "ut": ("u", top), "vt": ("v", top), "ub": ("u", bottom), "vb": ("v", bottom)})
    s = s.select("year", "month", F.lit(store.SURFACE_LEVEL).alias("level"), "lat_idx", "lon_idx",
                 F.lit("dls").alias("var"), fx.shear(*[F.col(c) for c in ("ut", "vt", "ub", "vb")]).alias("value"),
                 F.lit("single_levels").alias("grp"))
    return rows.unionByName(s)


def build_derived_std(long: DataFrame, root: str, start: int, end: int, force: bool = False) -> list[tuple[str, int]]:
    """Sigma of derived fields: evaluated per year first, then spread over years. Returns the (variable, level) done.

    Folders that hold the period's sigma already are left out before anything is computed, unless ``force``; a folder
    appears when its write is committed, so what exists is whole.
    """
    period = f"{start}-{end}"
    kept = set() if force else {(v, lev) for p, k, v, lev in store.stored_tiles(long.sparkSession, root) if (p, k) == (period, "std")}
    levels = [r["level"] for r in long.select("level").where(F.col("level") != store.SURFACE_LEVEL).distinct().collect()]       # an axis
    wanted = [(v, lev) for v in ("wspd", "mse") for lev in sorted(levels)] + [("dls", store.SURFACE_LEVEL)]
    todo = [w for w in wanted if w not in kept]
    if not todo:
        return []
    names, axis = {v for v, _ in todo}, {lev for v, lev in todo if v != "dls"} | (set(SHEAR_LEVELS) if ("dls", store.SURFACE_LEVEL) in todo else set())
    inputs = {n for v in names for n in FIELDS[v].ingredients}
    source = store.in_years(long, start, end).where(F.col("var").isin(*inputs) & F.col("level").isin(*axis))
    mine = F.concat_ws("/", "var", F.col("level").cast("string")).isin(*[f"{v}/{lev}" for v, lev in todo])
    rows = climatology_rows(derived_monthly(source).where(mine), start, end)
    store.write_climatology(rows.where(F.col("kind") == "std"), root)
    return todo


def completeness(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Whether each group already holds all its cells (such groups can be skipped)."""
    return df.groupBy(*keys).agg(F.count("*").alias("have")).select(
        *keys, "have", F.lit(expected).alias("expected"), (F.col("have") >= expected).alias("complete"))


def add_levels(existing: DataFrame, new: DataFrame, root: str) -> str:
    """Append levels to a per-year tree; levels stored before are left alone."""
    return store.write_monthly(store.append_levels(existing, new), root, mode="append")


def quantize_tree(clim: DataFrame, path: str) -> str:
    """Quantized copy of a climatology tree, one range per (period, kind, var, level, month)."""
    q = tiles.quantize(clim, ["period", "kind", "var", "level", "month"])
    band = F.floor(F.col("lat_idx") / 64)
    (q.repartition("period", "kind", "var", "level", band).sortWithinPartitions("period", "kind", "var", "level", "month", "lat_idx").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("period", "kind", "var", "level").parquet(path))
    return path


def write_tile_files(cells: DataFrame, root: str, spec: GridSpec, encoding: str = tile_files.CODES, mode: str = "append", gzip_level: int = 9) -> None:
    """Cells (grp, var, kind, level, year, month, lat_idx, lon_idx, value) as a tree of tile files; what is missing of
    kind, year and grp is ``mean``, none, and the group of the level."""
    tile_files.register(cells.sparkSession)
    level = F.col("level")
    whole = cells.withColumns({
        "kind": F.col("kind") if "kind" in cells.columns else F.lit("mean"), "year": (F.col("year") if "year" in cells.columns else F.lit(None)).cast("int"),
        "grp": F.coalesce(F.col("grp") if "grp" in cells.columns else F.lit(None), F.when(F.coalesce(level, F.lit(0)) == 0, "single_levels").otherwise("pressure_levels")),
        "level": F.coalesce(level, F.lit(store.SURFACE_LEVEL)).cast("int"), "month": F.col("month").cast("int")})
    rows = tiles.to_arrays(whole, tile_files.KEYS, spec).withColumn("level", F.nullif("level", F.lit(store.SURFACE_LEVEL)))
    (rows.select(*tile_files.KEYS, "values").write.format(tile_files.FORMAT).mode(mode)
     .options(path=root, nlat=spec.nlat, nlon=spec.nlon, encoding=encoding, gzipLevel=gzip_level).save())


def read_tile_files(spark: SparkSession, root: str, spec: GridSpec, rows: str = "cells") -> DataFrame:
    """The cells (or whole tiles) of a tree of tile files; filters on its keys pick the files."""
    tile_files.register(spark)
    return spark.read.format(tile_files.FORMAT).options(path=root, nlat=spec.nlat, nlon=spec.nlon, rows=rows).load()


def compress_tile_files(spark: SparkSession, root: str, spec: GridSpec, variables: Sequence[str] | None = None, groups: Sequence[str] | None = None,
                        force: bool = False, gzip_level: int = 9) -> list[tuple[str, str]]:
    """Replace float32 tiles by 16-bit codes, in place; returns the (group, variable) folders that were done.

    Folders that hold codes already are left alone unless ``force``. The floats of a folder go after its codes and
    their ranges are recorded, so a job lost at any moment is simply run again.
    """
    fs, base = tile_files.opened(root)
    todo = [(g, v) for g, v, meta in tile_files.folders(fs, base) if (not variables or v in variables) and (not groups or g in groups)
            and (force or meta.get("encoding", tile_files.FLOATS) != tile_files.CODES)]
    if todo:
        mine = F.struct("grp", "var").isin(*[F.struct(F.lit(g).alias("grp"), F.lit(v).alias("var")) for g, v in todo])
        whole = read_tile_files(spark, root, spec, "tiles").where(F.col("grp").isin(*{g for g, _ in todo}) & F.col("var").isin(*{v for _, v in todo})).where(mine)
        (whole.write.format(tile_files.FORMAT).mode("overwrite")
         .options(path=root, nlat=spec.nlat, nlon=spec.nlon, encoding=tile_files.CODES, gzipLevel=gzip_level).save())
    for g, v, meta in tile_files.folders(fs, base):        # also what an earlier run left behind
        if meta.get("encoding") == tile_files.CODES:
            for i in fs.get_file_info(afs.FileSelector(f"{base}/{g}/{v}")):
                if i.base_name.endswith(tile_files.ENDING[tile_files.FLOATS]):
                    fs.delete_file(i.path)
    return todo


def update_indices(spark: SparkSession, source: str, root: str, only: Sequence[str] | None = None, force: bool = False) -> DataFrame:
    """Parse the index files of a folder that are new or changed; (key, hash, status, reason) of those that were looked at.

    Values go to ``<root>/values`` by index, what was done to ``<root>/ledger``. A file without a single value under its layout, or of
    an unknown index, is recorded as bad with the reason; it neither stops the others nor touches the values it had before.
    """
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^/]*$", 1)
    work = spark.read.text(source, wholetext=True).select(stem.alias("key"), F.sha2("value", 256).alias("hash"), "value")
    if only:
        work = work.where(F.col("key").isin(*only))
    ledger = Ledger(spark, f"{root}/ledger")
    todo = work if force else ledger.open_work(work)
    lines = todo.select(F.col("key").alias("id"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    parsed = indices.parse_all(lines)
    n = parsed.groupBy("id").agg(F.count("value").alias("n")).withColumnRenamed("id", "key")
    known = F.col("key").isin(*INDEX_LAYOUT)
    good = F.coalesce(F.col("n"), F.lit(0)) > 0
    reason = F.when(~known, F.lit("unknown index")).when(~good, F.lit("no value in the layout of this index"))
    results = todo.join(n, "key", "left").select("key", "hash", F.when(known & good, F.lit(DONE)).otherwise(F.lit(BAD)).alias("status"), reason.alias("reason"))
    results = spark.createDataFrame(results.collect(), results.schema)                    # a row per index file
    done = [r["key"] for r in results.where(F.col("status") == DONE).collect()]
    if done:
        (parsed.where(F.col("id").isin(*done)).repartition("id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("id").parquet(f"{root}/values"))
    ledger.record(results)
    return results
