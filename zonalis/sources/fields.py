"""Field storage: Parquet trees of monthly and climatological fields, and their catalogue.

Layout: ``<root>/per_year/var=/level=/year=`` for monthly fields and
``<root>/climatology/period=/kind=/var=/level=`` for month-of-year means and sigmas. Month and
cell stay columns: twelve values would only make small files, and inside a file rows are
sorted so that month and row filters skip row groups. Single-level fields use level 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalis.functions.fields import finite
from zonalis.registry import DEFAULT_PERIOD, FIELDS, UNIT_SCALE, unit_factor
from zonalis.sources.files import Files

SURFACE_LEVEL = 0
SETTLE_SECONDS = 120

MONTHLY_SCHEMA = T.StructType([
    T.StructField("var", T.StringType()), T.StructField("grp", T.StringType()),
    T.StructField("level", T.IntegerType()), T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()), T.StructField("lat_idx", T.IntegerType()),
    T.StructField("lon_idx", T.IntegerType()), T.StructField("value", T.DoubleType())])

CLIMATOLOGY_SCHEMA = T.StructType([T.StructField("period", T.StringType()), T.StructField("kind", T.StringType()),
                                   *[f for f in MONTHLY_SCHEMA.fields if f.name != "year"]])

# Names under which an archive may store the axes.
AXIS_ALIASES = {"latitude": "lat", "longitude": "lon", "pressure_level": "level",
                "isobaricInhPa": "level", "valid_time": "time"}


def resolve_period(period: str | None, active: str = "default") -> str:
    """``default`` means the active window, itself 1991-2020 unless chosen otherwise."""
    p = active if period in (None, "default") else period
    return DEFAULT_PERIOD if p == "default" else p


def settled_files(spark: SparkSession, path: str, age_seconds: int = SETTLE_SECONDS) -> list[str]:
    """Data files old enough not to be in flight. The listing is file metadata, not rows."""
    names = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(path).select("path", "modificationTime"))
    old = F.col("modificationTime") < F.current_timestamp() - F.expr(f"interval {age_seconds} seconds")
    return [r["path"] for r in names.where(old).select("path").collect()]


def keep_settled(df: DataFrame, age_seconds: int = SETTLE_SECONDS) -> DataFrame:
    """Row-wise form for a frame read from files: drops rows of files still being written."""
    t = F.col("_metadata.file_modification_time")
    return df.where(t < F.current_timestamp() - F.expr(f"interval {age_seconds} seconds"))


def normalise_axes(df: DataFrame) -> DataFrame:
    """Rename aliased axis columns to the canonical names."""
    for old, new in AXIS_ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def pick_variable(columns: Sequence[str], short: str, axes: Sequence[str]) -> str:
    """The column named ``short``, else the only data column, else an error."""
    data = [c for c in columns if c not in axes]
    if short in data:
        return short
    if len(data) == 1:
        return data[0]
    raise ValueError(f"no column {short!r} and not exactly one candidate in {data}")


def span_of(name: str, default: tuple[int, int] | None = None) -> tuple[int, int] | None:
    """Years encoded in a folder name ending in ``_YYYY_YYYY``."""
    parts = name.rstrip("/").split("/")[-1].split("_")
    if len(parts) == 3 and parts[0] == "raw" and all(len(x) == 4 and x.isdigit() for x in parts[1:]):
        return int(parts[1]), int(parts[2])
    return default


def prune_folders(folders: Sequence[str], start: int, end: int) -> list[str]:
    """Folders whose span overlaps the period; unknown spans are kept."""
    out = []
    for f in folders:
        s = span_of(f)
        if s is None or (s[0] <= end and s[1] >= start):
            out.append(f)
    return out


def span_columns(name: Column) -> tuple[Column, Column]:
    """Start and end year of a folder name as columns, NULL when it encodes none."""
    pattern = r"^raw_(\d{4})_(\d{4})$"
    first, last = (F.nullif(F.regexp_extract(name, pattern, g), F.lit("")).cast("int") for g in (1, 2))
    return first, last


def read_union(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Several monthly roots (further years, or appended levels) as one frame."""
    return union_fields([spark.read.schema(MONTHLY_SCHEMA).parquet(r) for r in roots])


def union_fields(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def in_years(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where(F.col("year").between(start, end))


def to_display_units(long: DataFrame, value: str = "value") -> DataFrame:
    """Missing becomes NULL and the unit factor of the variable is applied (means and sigmas)."""
    return long.withColumn(value, finite(F.col(value).cast("double")) * unit_factor(F.col("var")))


def display_columns(wide: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The same for one column per field."""
    return wide.withColumns({f: F.col(f) * F.lit(UNIT_SCALE[f]) for f in fields if f in UNIT_SCALE})


# writers -----------------------------------------------------------------------
def write_monthly(long: DataFrame, root: str, mode: str = "overwrite") -> str:
    """Per-year tree. Hash partitioning by the folder keys gives one file per folder; the
    extra row band keeps a folder of a fine grid from resting on one task."""
    path = f"{root}/per_year"
    band = F.floor(F.col("lat_idx") / 64)
    (long.withColumn("level", F.coalesce("level", F.lit(SURFACE_LEVEL)))
     .repartition("var", "level", "year", band).sortWithinPartitions("var", "level", "year", "month", "lat_idx")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("var", "level", "year").parquet(path))
    return path


def write_climatology(clim: DataFrame, root: str, mode: str = "overwrite") -> str:
    """(period, kind, var, grp, level, month, lat_idx, lon_idx, value) tree."""
    path = f"{root}/climatology"
    band = F.floor(F.col("lat_idx") / 64)
    (clim.withColumn("level", F.coalesce("level", F.lit(SURFACE_LEVEL)))
     .repartition("period", "kind", "var", "level", band)
     .sortWithinPartitions("period", "kind", "var", "level", "month", "lat_idx")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("period", "kind", "var", "level").parquet(path))
    return path


#: What tells the cells of a month apart; the keys on which a field meets its climatology and its sigma.
CELL_KEYS = ("month", "level", "lat_idx", "lon_idx")


def write_bucketed(rows: DataFrame, table: str, path: str, buckets: int) -> str:
    """Rows of fields as a table bucketed and sorted by cell and month, in folders by variable (and kind and period).

    Tables with the same number of buckets are joined by cell, and grouped over years, without a shuffle: everything
    that belongs to a cell and month of any year already lies in the bucket of the same number. A bucket is written by
    one task; choose their number so that a bucket of a variable fits a task.
    """
    folders = [c for c in ("period", "kind", "var") if c in rows.columns]
    (rows.withColumn("level", F.coalesce("level", F.lit(SURFACE_LEVEL))).repartition(buckets, *CELL_KEYS)
     .write.mode("overwrite").option("path", path).partitionBy(*folders).bucketBy(buckets, *CELL_KEYS).sortBy(*CELL_KEYS).saveAsTable(table))
    return table


def stored_tiles(spark: SparkSession, root: str) -> frozenset[tuple[str, str, str, int]]:
    """(period, kind, var, level) of the climatologies a tree holds, from the names of its folders."""
    found = Files(spark, root).partitions(f"{root}/climatology", ["period", "kind", "var", "level"])
    return frozenset((p, k, v, int(lev)) for p, k, v, lev in found)


def stored_years(spark: SparkSession, root: str) -> frozenset[int]:
    """Years of the monthly fields a tree holds, from the names of its folders."""
    return frozenset(int(y) for _, _, y in Files(spark, root).partitions(f"{root}/per_year", ["var", "level", "year"]))


def append_levels(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose tile (variable, level, time) is not stored yet: appending them twice
    changes nothing.

    Only the tile keys of the levels in question are read from the store (partition columns), and
    they are as few as its folders and months, however many cells a tile has.
    """
    key = [c for c in ("period", "kind", "var", "level", "year", "month") if c in new.columns]
    levels = [r["level"] for r in new.select("level").distinct().collect()]             # an axis: a short list
    return new.join(existing.where(F.col("level").isin(levels)).select(*key).distinct(), key, "left_anti")


# catalogue ---------------------------------------------------------------------
def variable_meta(long: DataFrame, keys: Sequence[str] = ("grp", "var")) -> DataFrame:
    """Levels, years, (year, month) pairs and value range of each variable.

    The range comes from a plain aggregation; the lists from *distinct* keys, which are
    few, so no group's rows are ever collected.
    """
    rng = long.groupBy(*keys).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    slots = long.select(*keys, "level", "year", "month").distinct()
    lists = slots.groupBy(*keys).agg(
        F.array_sort(F.collect_set("level")).alias("levels"),
        F.array_sort(F.collect_set("year")).alias("years"),
        F.array_sort(F.collect_set(F.struct(F.col("year").alias("y"), F.col("month").alias("m")))).alias("year_months"))
    return rng.join(lists, list(keys))


def manifest_json(meta: DataFrame) -> DataFrame:
    """One JSON document per group: {var: {...}}."""
    body = F.struct("vmin", "vmax", "levels", "years")
    return (meta.groupBy("grp")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("var").alias("key"), body.alias("value")))).alias("e"))
            .select("grp", F.to_json(F.map_from_entries("e")).alias("manifest")))


def catalogue(clim: DataFrame, monthly: DataFrame | None = None, resolution_deg: float | None = None) -> DataFrame:
    """One row per variable of a climatology tree: ranges of mean and sigma, what exists, units.

    ``clim`` has (kind, var, grp, level, month, value); with ``monthly`` the years are listed too. All
    sums and extremes are pre-aggregated before a shuffle; lists come from distinct keys.
    """
    def of(kind: str, how) -> Column:
        return how(F.when(F.col("kind") == kind, F.col("value")))

    has = {k: F.coalesce(F.bool_or((F.col("kind") == k) & F.col("value").isNotNull()), F.lit(False)) for k in ("mean", "std")}
    meta = clim.groupBy("grp", "var").agg(
        of("mean", F.min).alias("vmin"), of("mean", F.max).alias("vmax"), of("std", F.min).alias("std_vmin"), of("std", F.max).alias("std_vmax"),
        has["mean"].alias("has_mean"), has["std"].alias("has_std"), F.array_sort(F.collect_set("level")).alias("levels"))
    names = F.create_map(*[F.lit(x) for f in FIELDS.values() for x in (f.name, f.units)])
    derived = F.create_map(*[F.lit(x) for f in FIELDS.values() for x in (f.name, f.derived)])
    meta = meta.withColumns({"units": names[F.col("var")], "derived": F.coalesce(derived[F.col("var")], F.lit(False)),
                             "resolution_deg": F.lit(resolution_deg).cast("double")})
    if monthly is None:
        return meta
    years = monthly.select("var", "year").distinct().groupBy("var").agg(F.array_sort(F.collect_set("year")).alias("years"))
    return meta.join(years, "var", "left")


def with_sigma(meta: DataFrame) -> frozenset[str]:
    """Variables whose sigma a catalogue lists (one row per variable comes to the driver)."""
    return frozenset(r["var"] for r in meta.where("has_std").select("var").collect())


def axis_levels(meta: DataFrame, var: str) -> list[int]:
    """The level axis of a variable as the catalogue has it (one row)."""
    row = meta.where(F.col("var") == var).select("levels").first()
    return list(row["levels"]) if row else []


def available_levels(long: DataFrame, var: str) -> DataFrame:
    return long.where(F.col("var") == var).select("level").distinct().orderBy("level")


def missing_inputs(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What still has to be acquired."""
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")


def with_attributes(long: DataFrame, config: DataFrame) -> DataFrame:
    """Fill long_name and units from a variable list where the data carry none. A variable listed twice gets its
    least texts and multiplies no rows; the list, one row per variable then, is broadcast."""
    c = config.groupBy("var").agg(F.min("long_name").alias("_n"), F.min("units").alias("_u"))
    return (long.join(F.broadcast(c), "var", "left")
            .withColumn("long_name", F.coalesce("long_name", "_n"))
            .withColumn("units", F.coalesce("units", "_u")).drop("_n", "_u"))


def nearest_level(levels: Sequence[int], wanted: float) -> int:
    """Snap to the nearest legal value, the first of two equally near."""
    return min(levels, key=lambda x: abs(x - wanted))
