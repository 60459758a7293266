"""Arcs on the sphere and sampling of fields at points, along arcs and in panels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions.fields import haversine_km, unit_vector, vector_lat, vector_lon
from zonalis.grid import GridSpec, only_one

DEFAULT_SEGMENTS = 128
#: Boxes of at most so many values are copied to the tasks that hold the points.
SMALL_BOXES = 1 << 18


def _shortest(dlon: Column) -> Column:
    return F.when(dlon > 180, dlon - 360).when(dlon < -180, dlon + 360).otherwise(dlon)


def _seam(lon: Column) -> Column:
    return F.pmod(lon + 540, F.lit(360.0)) - 180


def _steps(arcs: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """n+1 rows per arc. Arcs are few and short, so that their file is one task: they are dealt out first. The number of
    tasks is stated, else they would be put together again; windows along an arc need no further shuffle."""
    tasks = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (arcs.repartition(tasks, *keys).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n))))
            .withColumn("_t", F.col("s") / F.lit(float(n))))


def great_circle(arcs: DataFrame, keys: Sequence[str], n: int = DEFAULT_SEGMENTS) -> DataFrame:
    """n+1 points of the minor arc (lat1, lon1) -> (lat2, lon2) by spherical interpolation;
    coinciding ends give one point."""
    ends = {f"_{e}{k}": c for e in "12" for k, c in zip("xyz", unit_vector(F.col(f"lat{e}"), F.col(f"lon{e}")))}
    df = arcs.withColumns(ends)                             # columns of their own: once per arc, not in every term of a point
    a, b = ([F.col(f"_{e}{k}") for k in "xyz"] for e in "12")
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    df = df.withColumn("_th", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    df = df.withColumn("_sin", F.nullif(F.sin("_th"), F.lit(0.0)))
    df = _steps(df, keys, n).where((F.col("_th") >= 1e-6) | (F.col("s") == 0))
    th, t = F.col("_th"), F.col("_t")
    df = df.withColumns({"_wa": F.sin((1 - t) * th) / F.col("_sin"), "_wb": F.sin(t * th) / F.col("_sin")})
    df = df.withColumns({f"_{k}": F.col("_wa") * p + F.col("_wb") * q for k, p, q in zip("xyz", a, b)})
    x, y, z = (F.col(f"_{k}") for k in "xyz")
    same = th < 1e-6
    return df.select(*keys, "s", F.when(same, F.col("lat1")).otherwise(vector_lat(x, y, z)).alias("lat"),
                     F.when(same, F.col("lon1")).otherwise(vector_lon(x, z)).alias("lon"))


def straight_arc(arcs: DataFrame, keys: Sequence[str], n: int = DEFAULT_SEGMENTS) -> DataFrame:
    """n+1 points straight in (lat, lon), taking the short way round."""
    d = _shortest(F.col("lon2") - F.col("lon1"))
    t = F.col("_t")
    return _steps(arcs, keys, n).select(
        *keys, "s", (F.col("lat1") + t * (F.col("lat2") - F.col("lat1"))).alias("lat"),
        _seam(F.col("lon1") + t * d).alias("lon"))


def midpoints(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Great-circle and straight midpoints of each arc."""
    a, b = unit_vector(F.col("lat1"), F.col("lon1")), unit_vector(F.col("lat2"), F.col("lon2"))
    x, y, z = (p + q for p, q in zip(a, b))
    opposite = (x * x + y * y + z * z) < 1e-12
    d = _shortest(F.col("lon2") - F.col("lon1"))
    return arcs.select(
        *keys,
        F.when(opposite, F.col("lat1")).otherwise(vector_lat(x, y, z)).alias("gc_lat"),
        F.when(opposite, F.col("lon1")).otherwise(vector_lon(x, z)).alias("gc_lon"),
        ((F.col("lat1") + F.col("lat2")) / 2).alias("straight_lat"),
        _seam(F.col("lon1") + d / 2).alias("straight_lon"))


def three_point_arc(arcs: DataFrame, keys: Sequence[str], n: int = DEFAULT_SEGMENTS,
                    kind: str = "gc") -> DataFrame:
    """Quadratic curve through (lat1, lon1), (latm, lonm), (lat2, lon2) at t = 0, 1/2, 1."""
    df = _steps(arcs, keys, max(2, n))
    t = F.col("_t")
    u = 1 - t
    w0, w1, w2 = u * u, 2 * u * t, t * t

    def curve(p0: Column, mid: Column, p2: Column) -> Column:
        return w0 * p0 + w1 * (2 * mid - 0.5 * (p0 + p2)) + w2 * p2

    if kind == "linear":
        lon1 = F.col("lon1")
        lon_m = lon1 + _shortest(F.col("lonm") - lon1)
        lon_2 = lon1 + _shortest(F.col("lon2") - lon1)
        return df.select(*keys, "s", curve(F.col("lat1"), F.col("latm"), F.col("lat2")).alias("lat"),
                         _seam(curve(lon1, lon_m, lon_2)).alias("lon"))
    a = unit_vector(F.col("lat1"), F.col("lon1"))
    m = unit_vector(F.col("latm"), F.col("lonm"))
    b = unit_vector(F.col("lat2"), F.col("lon2"))
    x, y, z = (curve(p, q, r) for p, q, r in zip(a, m, b))
    return (df.where((x * x + y * y + z * z) >= 1e-12)
            .select(*keys, "s", vector_lat(x, y, z).alias("lat"), vector_lon(x, z).alias("lon")))


def path_distance(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Along-path distance of each point from the start of its arc."""
    w = W.partitionBy(*keys).orderBy("s")
    leg = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return (points.withColumn("_leg", F.coalesce(leg, F.lit(0.0)))
            .withColumn("dist_km", F.sum("_leg").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
            .drop("_leg"))


def path_length(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("s")
    leg = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return (points.select(*keys, leg.alias("_leg")).groupBy(*keys)
            .agg(F.coalesce(F.sum("_leg"), F.lit(0.0)).alias("length_km")))


def split_at_date_line(points: DataFrame, keys: Sequence[str], order: str = "s") -> DataFrame:
    """Number the contiguous pieces of each line; a jump of more than 180 degrees starts one.

    ``n_points`` is the length of the piece: pieces of one point draw no line.
    """
    w = W.partitionBy(*keys).orderBy(order)
    jump = F.abs(F.col("lon") - F.lag("lon").over(w)) > 180
    df = points.withColumn("segment", F.sum(F.when(jump, 1).otherwise(0)).over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"))
    return df.withColumn("n_points", F.count("*").over(W.partitionBy(*keys, "segment")).cast("int"))


def _reach(own: str, n: int, periodic: bool) -> Column:
    """The homes a grid position serves: its own (side 0) and that before it (side 1). A periodic
    axis wraps; on another the last position is its own neighbour."""
    c = F.col(own)
    before = F.pmod(c - 1, F.lit(n)) if periodic else F.when(c > 0, c - 1)
    pairs = [F.struct(c.alias("home"), F.lit(0).alias("side")),
             F.when(before.isNotNull(), F.struct(before.alias("home"), F.lit(1).alias("side")))]
    if not periodic:
        pairs.append(F.when(c == n - 1, F.struct(c.alias("home"), F.lit(1).alias("side"))))
    return F.filter(F.array(*pairs), lambda x: x.isNotNull())


def boxes(grid: DataFrame, slice_keys: Sequence[str], values: Sequence[str], spec: GridSpec, axes: Sequence[str],
          slices: DataFrame | None = None) -> DataFrame:
    """Per slice and home position, the values at its corners, for every position of the axes.

    ``slices`` lists the slices where they are known (an axis, a catalogue, a request); else they come from the grid,
    which is then read twice. Neighbours are brought together once per grid cell (the side the grid bounds), so a point later
    needs one join and no aggregation. Two rows for one cell are an error. Columns: slice keys,
    ``_h_<axis>`` and ``<value>_<sides>`` with a digit per axis.
    """
    size = {"lat_idx": spec.nlat, "lon_idx": spec.nlon, "_k": len(spec.levels)}
    df = grid.select(*slice_keys, *axes, *values)
    for a in axes:
        df = df.withColumn("_p", F.explode(_reach(a, size[a], a == "lon_idx")))
        df = df.withColumn(f"_h_{a}", F.col("_p.home").cast("int")).withColumn(f"_s_{a}", F.col("_p.side")).drop("_p")
    homes = [f"_h_{a}" for a in axes]
    aggs = []
    for sides in product((0, 1), repeat=len(axes)):
        here = reduce(and_, [F.col(f"_s_{a}") == x for a, x in zip(axes, sides)])
        for v in values:
            aggs.append(only_one(F.when(here, F.col(v)), here).alias(f"{v}_{''.join(map(str, sides))}"))
    found = df.groupBy(*slice_keys, *homes).agg(*aggs)
    every = slices.select(*slice_keys) if slices is not None else df.select(*slice_keys).distinct() if slice_keys else df.limit(1).select()
    for a in axes:
        every = every.withColumn(f"_h_{a}", F.explode(F.sequence(F.lit(0), F.lit(size[a] - 1))))
    return every.join(found, [*slice_keys, *homes], "left")


def _small(slice_keys: Sequence[str], values: Sequence[str], spec: GridSpec, axes: Sequence[str]) -> bool:
    """Whether the axes alone keep boxes small. Then points, of which there is any number, need not be dealt anew by
    their homes, which are few."""
    if not {*slice_keys} <= {"month", "level"}:
        return False
    size = {"lat_idx": spec.nlat, "lon_idx": spec.nlon, "_k": len(spec.levels), "month": 12, "level": len(spec.levels)}
    return len(values) * 2 ** len(axes) * math.prod(size[k] for k in (*axes, *slice_keys)) <= SMALL_BOXES


def _sampled(points: DataFrame, grid: DataFrame, slice_keys: Sequence[str], values: Sequence[str], spec: GridSpec,
             places: dict[str, tuple[Column, Column]], inside: Column, point_keys: Sequence[str], partial_mean: bool,
             slices: DataFrame | None = None) -> DataFrame:
    """Join points to their home boxes; ``places`` has (home, fraction) per axis. A point outside, or
    without the corners it needs, stays with NULL in every slice (and once with NULL keys if the
    grid is empty)."""
    axes = list(places)
    at = points.withColumn("_in", inside)
    for a, (home, frac) in places.items():
        at = at.withColumn(f"_h_{a}", F.coalesce(F.when(F.col("_in"), home), F.lit(0)).cast("int")).withColumn(f"_f_{a}", frac)
    near = boxes(grid, slice_keys, values, spec, axes, slices)
    hit = at.join(F.broadcast(near) if _small(slice_keys, values, spec, axes) else near, [f"_h_{a}" for a in axes], "left")
    out = []
    for v in values:
        total, present, n = F.lit(0.0), F.lit(0), 0
        mean = F.lit(0.0)
        for sides in product((0, 1), repeat=len(axes)):
            c = F.col(f"{v}_{''.join(map(str, sides))}")
            w = reduce(mul, [F.col(f"_f_{a}") if x else 1 - F.col(f"_f_{a}") for a, x in zip(axes, sides)])
            total, mean = total + c * w, mean + F.coalesce(c, F.lit(0.0))
            present, n = present + c.isNotNull().cast("int"), n + 1
        rest = F.when(present > 0, mean / present) if partial_mean else F.lit(None).cast("double")
        out.append(F.when(F.col("_in"), F.when(present == n, total).otherwise(rest)).alias(v))
    return hit.select(*point_keys, *slice_keys, *out)


def _lat_place(spec: GridSpec) -> tuple[Column, Column]:
    r = spec.row_of(F.col("lat"))
    i = F.greatest(F.lit(0), F.least(F.lit(spec.nlat - 1), F.floor(r)))
    return i, r - i


def _lon_place(spec: GridSpec) -> tuple[Column, Column]:
    q = spec.column_of(F.col("lon"))
    return F.pmod(F.floor(q), F.lit(spec.nlon)), q - F.floor(q)


def _p_place(spec: GridSpec) -> tuple[Column, Column]:
    """Level position above p and the fraction in ln p towards the one below."""
    last = len(spec.levels) - 1
    above = F.aggregate(spec.level_array(), F.lit(0), lambda acc, x: acc + F.when(x < F.col("p"), 1).otherwise(0))
    k0 = F.least(F.greatest(above - 1, F.lit(0)), F.lit(last))
    k1 = F.least(k0 + 1, F.lit(last))
    p0, p1 = (F.element_at(spec.level_array(), k + 1) for k in (k0, k1))
    return k0, F.when(k0 == k1, F.lit(0.0)).otherwise(F.ln(F.col("p") / p0) / F.ln(p1 / p0))


def _in_lat(spec: GridSpec) -> Column:
    return F.coalesce(spec.row_of(F.col("lat")).between(0, spec.nlat - 1), F.lit(False))


def bilinear(points: DataFrame, point_keys: Sequence[str], grid: DataFrame, slice_keys: Sequence[str],
             values: Sequence[str], spec: GridSpec, slices: DataFrame | None = None) -> DataFrame:
    """Sample every slice of ``grid`` at every point: points x slices rows, by contract.

    With all four corners present the result is bilinear, otherwise the plain mean of the present
    ones; a point without any, outside the latitude range or without coordinates is NULL.
    """
    places = {"lat_idx": _lat_place(spec), "lon_idx": _lon_place(spec)}
    inside = _in_lat(spec) & F.col("lon").isNotNull()
    return _sampled(points.select(*dict.fromkeys([*point_keys, "lat", "lon"])), grid, slice_keys, values, spec, places, inside, point_keys, True, slices)


def arc_section(points: DataFrame, arc_keys: Sequence[str], grid: DataFrame, slice_keys: Sequence[str],
                values: Sequence[str], spec: GridSpec, slices: DataFrame | None = None) -> DataFrame:
    """Vertical section along arcs with the along-path distance."""
    return bilinear(path_distance(points, arc_keys), [*arc_keys, "s", "dist_km"], grid, slice_keys, values, spec, slices)


def panel_sample(panel: DataFrame, probes: DataFrame, value: str, spec: GridSpec,
                 slice_keys: Sequence[str] = (), slices: DataFrame | None = None) -> DataFrame:
    """Sample a (level, lat) panel at probes (probe_id, lat, p): linear in latitude and ln p.

    Any missing corner gives NULL, and so does a probe outside the latitude range; beyond the
    lowest and highest level the layer there is extended.
    """
    places = {"_k": _p_place(spec), "lat_idx": _lat_place(spec)}
    on = spec.on_axis(panel).withColumn("_k", spec.level_pos())
    return _sampled(probes.select("probe_id", "lat", "p"), on, slice_keys, [value], spec, places,
                    _in_lat(spec) & F.coalesce(F.col("p") > 0, F.lit(False)), ["probe_id"], False, slices)


def barb_sites(spark, lat_step: float = 8.0, pole_limit: float = 82.0) -> DataFrame:
    """Barb stations: rows every 8 degrees, fewer per row towards the poles."""
    rows = int(2 * pole_limit // lat_step)
    raw = F.least(F.lit(30.0), F.lit(lat_step) / F.greatest(F.lit(0.1), F.cos(F.radians("lat"))))
    n = F.greatest(F.lit(3), F.floor(F.lit(360.0) / raw + 0.5).cast("int"))
    return (spark.range(rows + 1).select((F.col("id") * lat_step - pole_limit).alias("lat"))
            .withColumn("_n", n)
            .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            .select("lat", (F.lit(-180.0) + F.col("_i") * (F.lit(360.0) / F.col("_n"))).alias("lon")))


def contour_crossings(df: DataFrame, meridian_keys: Sequence[str], value: str, interval: float,
                      spec: GridSpec, min_gap_deg: float | None = 3.0) -> DataFrame:
    """Where a meridian crosses a contour, with the crossing latitude interpolated linearly.

    With ``min_gap_deg`` a crossing closer than that to the last kept one (north to south)
    is dropped; the greedy pass folds the crossings of one meridian, at most nlat of them.
    """
    w = W.partitionBy(*meridian_keys).orderBy("lat_idx")
    v, k = F.col(value), F.col("_k")
    df = df.withColumn("_k", F.floor(v / F.lit(interval)))
    adjacent = F.lag("lat_idx").over(w) == F.col("lat_idx") - 1
    df = (df.withColumn("_pv", F.when(adjacent, F.lag(v).over(w)))
          .withColumn("_pk", F.when(adjacent, F.lag("_k").over(w))))
    level = F.when(k > F.col("_pk"), k).otherwise(k + 1) * F.lit(interval)
    t = (level - F.col("_pv")) / F.nullif(v - F.col("_pv"), F.lit(0.0))
    north = spec.lat("(lat_idx - 1)")
    lat = north + t * (spec.lat() - north)
    hits = (df.where(k != F.col("_pk"))
            .select(*meridian_keys, "lat_idx", level.alias("contour"), lat.alias("lat")))
    if min_gap_deg is None:
        return hits
    item = F.struct("lat_idx", "contour", "lat")
    gap = F.lit(float(min_gap_deg))
    ordered = F.array_sort(F.collect_list(item))
    kept = F.aggregate(
        "_a", F.slice("_a", 1, 1),
        lambda acc, x: F.when(F.abs(x["lat"] - F.element_at(acc, -1)["lat"]) >= gap,
                              F.concat(acc, F.array(x))).otherwise(acc))
    return (hits.groupBy(*meridian_keys).agg(ordered.alias("_a"))
            .select(*meridian_keys, F.inline(kept)))


def trilinear(points: DataFrame, point_keys: Sequence[str], grid: DataFrame, slice_keys: Sequence[str],
              values: Sequence[str], spec: GridSpec, slices: DataFrame | None = None) -> DataFrame:
    """Sample at (lat, lon, p): bilinear on two levels and linear in ln p. Any missing corner and
    any point off the pressure or latitude range gives NULL."""
    places = {"_k": _p_place(spec), "lat_idx": _lat_place(spec), "lon_idx": _lon_place(spec)}
    on = spec.on_axis(grid).withColumn("_k", spec.level_pos())
    inside = _in_lat(spec) & F.col("lon").isNotNull() & F.coalesce(F.col("p").between(spec.levels[0], spec.levels[-1]), F.lit(False))
    return _sampled(points.select(*dict.fromkeys([*point_keys, "lat", "lon", "p"])), on, slice_keys, values, spec, places, inside, point_keys, False, slices)
