"""Finite differences, integrals and smoothers along latitude, longitude and pressure.

Neighbours are taken by *position*: a lag/lead only counts when the neighbouring row is
really the adjacent grid point, so a missing level or latitude gives NULL and is never
bridged. All windows partition by a slice; hash-partition the (small) zonal table by the
slice once and every window here runs without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.constants import EARTH_RADIUS
from zonalis.grid import GridSpec


class Axis:
    """Guarded neighbour access along one index column inside a slice."""

    def __init__(self, index: str, partition: Sequence[str], last: int):
        self.name, self.last = index, last
        self.index = F.col(index)
        self.window = W.partitionBy(*partition).orderBy(index)
        self._adjacent: dict[int, Column] = {}
        self.edges = {-1: F.expr(f"{index} = 0"), 1: F.expr(f"{index} = {last}")}

    def _there(self, offset: int) -> Column:
        """Whether the row ``offset`` away is the grid point ``offset`` away."""
        if offset not in self._adjacent:
            moved = (F.lag if offset < 0 else F.lead)(self.index, abs(offset)).over(self.window)
            self._adjacent[offset] = moved == F.expr(f"{self.name} + {offset}")
        return self._adjacent[offset]

    def at(self, value: Column, offset: int) -> Column:
        if offset == 0:
            return value
        step = F.lag if offset < 0 else F.lead
        return F.when(self._there(offset), step(value, abs(offset)).over(self.window))

    def clamped(self, value: Column, offset: int) -> Column:
        """Neighbour one step away, or the point itself at the end of the axis."""
        return F.when(self.edges[offset], value).otherwise(self.at(value, offset))

    def across(self, value: Column) -> Column:
        """Lower-index neighbour minus higher-index neighbour, one-sided at the ends."""
        return self.clamped(value, -1) - self.clamped(value, 1)

    @property
    def spacing(self) -> str:
        """SQL for the index distance between the two clamped neighbours."""
        return f"(least({self.name} + 1, {self.last}) - greatest({self.name} - 1, 0))"


def lat_axis(spec: GridSpec, partition: Sequence[str]) -> Axis:
    return Axis("lat_idx", partition, spec.nlat - 1)


def level_axis(spec: GridSpec, partition: Sequence[str]) -> Axis:
    """Needs a ``lev_idx`` column, see ``with_level_index``."""
    return Axis("lev_idx", partition, len(spec.levels) - 1)


def with_level_index(df: DataFrame, spec: GridSpec) -> DataFrame:
    return df.withColumn("lev_idx", spec.level_pos()).where("lev_idx IS NOT NULL")


def d_dy(value: Column, axis: Axis, spec: GridSpec) -> Column:
    """Northward derivative per metre, one-sided at the poles."""
    return axis.across(value) / F.expr(f"{axis.spacing} * {EARTH_RADIUS * spec.dlat_rad!r}D")


def d_dphi(value: Column, axis: Axis, spec: GridSpec) -> Column:
    """Northward derivative per radian of latitude."""
    return axis.across(value) / F.expr(f"{axis.spacing} * {spec.dlat_rad!r}D")


def _level_sql(spec: GridSpec, pos: str) -> str:
    return f"element_at({spec.levels_sql}, {pos} + 1)"


def d_dp(value: Column, axis: Axis, spec: GridSpec) -> Column:
    """Derivative per Pa on the unevenly spaced levels, one-sided at top and bottom."""
    above, below = f"greatest({axis.name} - 1, 0)", f"least({axis.name} + 1, {axis.last})"
    minus_dp = F.expr(f"({_level_sql(spec, above)} - {_level_sql(spec, below)}) * 100.0D")
    return axis.across(value) / minus_dp


def layer_above(value: Column, axis: Axis, spec: GridSpec) -> Column:
    """Trapezoid of the layer between the level above and this one, NULL if either is."""
    above = _level_sql(spec, f"greatest({axis.name} - 1, 0)")
    half_dp = F.expr(f"CASE WHEN {axis.name} > 0 THEN ({_level_sql(spec, axis.name)} - {above}) * 50.0D END")
    return (axis.at(value, -1) + value) * half_dp


def integrate_p(df: DataFrame, keys: Sequence[str], values: Sequence[str], spec: GridSpec) -> DataFrame:
    """Integral over pressure (Pa) per column; layers with a missing end are skipped."""
    df = with_level_index(df, spec)
    axis = level_axis(spec, keys)
    layers = df.select(*keys, *[layer_above(F.col(v), axis, spec).alias(v) for v in values])
    return layers.groupBy(*keys).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])


def accumulate_p(value: Column, axis: Axis, spec: GridSpec) -> Column:
    """Integral from the top down to each level: 0 at the top, NULL where the layer above is
    incomplete, while the accumulator carries on unchanged past it."""
    layer = layer_above(value, axis, spec)
    total = F.sum(F.coalesce(layer, F.lit(0.0))).over(
        axis.window.rowsBetween(W.unboundedPreceding, W.currentRow))
    return F.when(axis.edges[-1], F.lit(0.0)).when(layer.isNotNull(), total)


def _smooth(value: Column, axis: Axis, weights: dict[int, int]) -> Column:
    pairs = F.array(*[F.struct(axis.at(value, off).alias("v"), F.lit(float(wt)).alias("w"))
                      for off, wt in weights.items()])
    present = F.filter(pairs, lambda x: x["v"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    return F.aggregate(present, zero, lambda a, x: F.struct((a["n"] + x["v"] * x["w"]).alias("n"), (a["d"] + x["w"]).alias("d")),
                       lambda a: a["n"] / F.nullif(a["d"], F.lit(0.0)))


def smooth_lat(df: DataFrame, value: str, keys: Sequence[str], spec: GridSpec, passes: int = 3) -> DataFrame:
    """Binomial [1 4 6 4 1] along latitude, renormalized over present neighbours. Missing
    centres are filled, so pass a dense frame."""
    for _ in range(passes):
        axis = lat_axis(spec, keys)
        df = df.withColumn(value, _smooth(F.col(value), axis, {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}))
    return df


def smooth_level(df: DataFrame, value: str, keys: Sequence[str], spec: GridSpec) -> DataFrame:
    """Binomial [1 2 1] along the level index; needs ``lev_idx``."""
    axis = level_axis(spec, keys)
    return df.withColumn(value, _smooth(F.col(value), axis, {-1: 1, 0: 2, 1: 1}))


def d_dlambda(value: Column, row_keys: Sequence[str], spec: GridSpec) -> Column:
    """Eastward derivative per radian on the periodic axis."""
    j = F.col("lon_idx")
    w = W.partitionBy(*row_keys).orderBy(j)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = spec.nlon - 1

    def wrapped(edge: int, opposite: int, end) -> Column:
        return F.when((j == edge) & (end(j).over(whole) == opposite), end(value).over(whole))

    axis = Axis("lon_idx", row_keys, last)
    east = F.coalesce(axis.at(value, 1), wrapped(last, 0, F.first))
    west = F.coalesce(axis.at(value, -1), wrapped(0, last, F.last))
    return (east - west) / F.lit(2.0 * spec.dlon_rad)
