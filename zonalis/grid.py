"""The regular latitude/longitude/level grid and NaN handling.

A *field frame* is a DataFrame with some of the key columns
``period, year, month, level, lat_idx, lon_idx`` and one DOUBLE column per field.
Missing values are NULL everywhere inside the package; NaN only exists in files.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalis.constants import POLE_COS, PRESSURE_LEVELS
from zonalis.functions.fields import turn

CELL = ("lat_idx", "lon_idx")


@dataclass(frozen=True)
class GridSpec:
    """Row 0 is the northernmost latitude; levels ascend in pressure."""

    nlat: int = 181
    nlon: int = 360
    dlat: float = 1.0
    dlon: float = 1.0
    lat0: float = 90.0
    lon0: float = -180.0
    levels: tuple[int, ...] = PRESSURE_LEVELS

    # coordinates -------------------------------------------------------------
    # SQL text keeps each of these a single call when plans are built.
    def _lat_sql(self, idx: str) -> str:
        return f"({self.lat0!r}D - {idx} * {self.dlat!r}D)"

    def lat(self, idx: str = "lat_idx") -> Column:
        return F.expr(self._lat_sql(idx))

    def lon(self, idx: str = "lon_idx") -> Column:
        return F.expr(f"({self.lon0!r}D + {idx} * {self.dlon!r}D)")

    def cos_lat(self, idx: str = "lat_idx") -> Column:
        return F.expr(f"cos(radians({self._lat_sql(idx)}))")

    def area_weight(self, idx: str = "lat_idx") -> Column:
        return F.expr(f"greatest(0.0D, cos(radians({self._lat_sql(idx)})))")

    def is_pole(self, idx: str = "lat_idx") -> Column:
        return F.expr(f"cos(radians({self._lat_sql(idx)})) < {POLE_COS!r}D")

    def row_of(self, lat: Column) -> Column:
        """Fractional row of a latitude."""
        return (F.lit(self.lat0) - lat) / F.lit(self.dlat)

    def column_of(self, lon: Column) -> Column:
        """Fractional column of a longitude on the periodic axis."""
        return turn(lon - F.lit(self.lon0)) / F.lit(self.dlon)

    # levels ------------------------------------------------------------------
    @property
    def surface_pa(self) -> float:
        return self.levels[-1] * 100.0

    @property
    def dlat_rad(self) -> float:
        return math.radians(self.dlat)

    @property
    def dlon_rad(self) -> float:
        return 2.0 * math.pi / self.nlon

    @property
    def cos_total(self) -> float:
        return sum(max(0.0, math.cos(math.radians(self.lat0 - i * self.dlat)))
                   for i in range(self.nlat))

    @property
    def cells(self) -> int:
        return self.nlat * self.nlon

    @property
    def levels_sql(self) -> str:
        return f"array({', '.join(str(int(p)) for p in self.levels)})"

    def level_pos(self, level: str = "level") -> Column:
        """0-based position of a level on the axis; NULL when it is not on it."""
        return F.expr(f"CAST(nullif(array_position({self.levels_sql}, {level}), 0) - 1 AS INT)")

    def level_array(self) -> Column:
        return F.expr(self.levels_sql)

    def on_axis(self, df: DataFrame) -> DataFrame:
        """The frame itself; a row whose level is not on the axis is an error, never dropped.

        Levels appended to a store belong on the axis: see ``with_levels``.
        """
        off = F.raise_error(F.concat(F.lit("level off the axis: "), F.coalesce(F.col("level").cast("string"), F.lit("NULL"))))
        return df.where(F.when(F.col("level").isin(*self.levels), F.lit(True)).otherwise(off.cast("boolean")))

    def with_levels(self, levels: Iterable[int]) -> GridSpec:
        """This grid on other levels, for instance those a store's catalogue lists."""
        return replace(self, levels=tuple(sorted(int(p) for p in levels)))

    # completion --------------------------------------------------------------
    def densify(self, df: DataFrame, keys: Sequence[str], axes: Sequence[str], slices: DataFrame | None = None) -> DataFrame:
        """One row per (slice, coordinate): absent rows appear with NULL values.

        ``slices`` lists the slices where they are known (an axis, a catalogue); otherwise they come
        from the frame, which is then read twice. The generated side never exceeds slices x grid.
        """
        if slices is None:
            slices = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
        for axis in axes:
            slices = slices.withColumn(axis, F.explode(self._axis(axis)))
        return slices.join(df, [*keys, *axes], "left")

    def level_slices(self, spark: SparkSession) -> DataFrame:
        """One row per level of the axis."""
        return spark.range(1).select(F.explode(self.level_array()).alias("level"))

    def slices(self, spark: SparkSession, months: Iterable[int] = range(1, 13), levels: bool = True) -> DataFrame:
        """One row per month, and per level of the axis if asked for."""
        out = spark.range(1).select(F.explode(F.array(*[F.lit(int(m)) for m in months])).alias("month"))
        return out.withColumn("level", F.explode(self.level_array())) if levels else out

    def fill(self, df: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
        """``densify`` for slices of one panel, tile or year: no join and no second read.

        The rows of a slice (at most the product of its axes, one per coordinate) are packed,
        padded with an empty row per coordinate and unpacked, all on the slice's own
        partitioning. Two rows for one coordinate are an error.
        """
        values = [f for f in df.schema.fields if f.name not in (*keys, *axes)]
        row = F.struct(*[F.col(c) for c in (*axes, *[f.name for f in values])], F.lit(True).alias("_real"))
        packed = df.groupBy(*keys).agg(F.collect_list(row).alias("_rows"))
        types = dict(df.dtypes)
        blank = {f.name: F.lit(None).cast(f.dataType) for f in values}

        def pad(rest: list[str], at: dict[str, Column]) -> Column:
            if not rest:
                return F.array(F.struct(*[at[a].cast(types[a]).alias(a) for a in axes],
                                        *[b.alias(n) for n, b in blank.items()], F.lit(False).alias("_real")))
            return F.flatten(F.transform(self._axis(rest[0]), lambda x: pad(rest[1:], {**at, rest[0]: x})))

        rows = packed.select(*keys, F.explode(F.concat("_rows", pad(list(axes), {}))).alias("_r"))
        return (rows.select(*keys, "_r.*").groupBy(*keys, *axes)
                .agg(*[only_one(F.col(f.name), F.col("_real")).alias(f.name) for f in values]))

    def _axis(self, axis: str) -> Column:
        if axis == "level":
            return self.level_array()
        if axis == "month":
            return F.sequence(F.lit(1), F.lit(12))
        return F.sequence(F.lit(0), F.lit((self.nlat if axis == "lat_idx" else self.nlon) - 1))


def only_one(value: Column, counted: Column) -> Column:
    """Aggregate: the value of the one row for which ``counted`` holds; an error if there are two."""
    return F.when(F.count_if(counted) > 1, F.raise_error(F.lit("two rows for one cell")).cast("double")).otherwise(F.max(value))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column (done once, on read)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
            out.append(F.when(finite, c).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def null_to_nan(df: DataFrame) -> DataFrame:
    """The reverse, only for export."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.coalesce(c, F.lit(float("nan")).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)


def stride(df: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column from 0: a subsample, not an average."""
    if step <= 1:
        return df
    return df.where((F.col("lat_idx") % step == 0) & (F.col("lon_idx") % step == 0))


def stride_for(resolution_deg: float, native_deg: float = 0.5) -> int:
    return max(1, round(resolution_deg / native_deg))


def resample_index(df: DataFrame, step: int) -> DataFrame:
    """``stride`` followed by renumbering, so that the result is a grid of its own."""
    return (stride(df, step)
            .withColumn("lat_idx", (F.col("lat_idx") / step).cast("int"))
            .withColumn("lon_idx", (F.col("lon_idx") / step).cast("int")))
