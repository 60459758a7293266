"""Sections and series of a requested field: whatever a request can name, on all levels or over time.

All of them honour derived fields, seasons, single years, composites, decompositions and references,
because the request is resolved first (with its level kept as a key) and sampled or averaged after.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.operators import composite, reduce, sampling, series
from zonalis.plans.request import FieldRequest, FieldStore, _evaluate, _inputs, _mean_inputs, resolve


def on_all_levels(store: FieldStore, req: FieldRequest) -> DataFrame:
    """(month, level, lat_idx, lon_idx, value) of a request on every level."""
    return resolve(store, replace(req, all_levels=True))


def zonal_section(store: FieldStore, req: FieldRequest) -> DataFrame:
    """(month, level, lat_idx, value): the zonal mean of a request on every level."""
    return reduce.zonal_mean(on_all_levels(store, req), ["month", "level", "lat_idx"], ["value"])


def arc_section(store: FieldStore, req: FieldRequest, points: DataFrame, arc_keys: Sequence[str]) -> DataFrame:
    """(arc keys, s, dist_km, month, level, value): a request along arcs (points with s, lat, lon)."""
    known = store.spec.slices(points.sparkSession, [req.month]) if req.month is not None else None
    return sampling.arc_section(points, arc_keys, on_all_levels(store, req), ["month", "level"], ["value"], store.spec, known)


def area_series(store: FieldStore, req: FieldRequest, box: series.Box, baseline: str | None = None) -> DataFrame:
    """(year, month, t, value): the area mean of a request in every month of every year.

    ``baseline``: None for the values, "fixed" for departures from the request's climatology, "sliding"
    from that of each year's best-matching window. A climatology averages its ingredients first.
    """
    every = replace(req, month=None, seasonal=False)
    spec, keys = store.spec, ["lat_idx", "lon_idx"]
    months = _evaluate(_inputs(store, every), ["year", "month", *keys], every, spec)
    out = series.area_series(months, spec, box, "value")
    if baseline == "fixed":
        clim = _evaluate(_mean_inputs(store, every), ["month", *keys], every, spec)
        return series.series_anomaly(out, reduce.box_mean(clim, spec, ["month"], ["value"], box), "value")
    if baseline == "sliding":
        df = _inputs(store, every)
        names = [c for c in df.columns if c not in ("year", "month", "level", "lat_idx", "lon_idx")]
        clims = composite.window_climatologies(df, store.windows, names)
        values = _evaluate(clims, ["window_id", "month", *keys], every, spec)
        means = reduce.box_mean(values, spec, ["window_id", "month"], ["value"], box)
        return series.series_sliding_anomaly(out, means, store.windows, "value")
    if baseline is not None:
        raise ValueError(f"unknown baseline {baseline}")
    return out


def csv_lines(points: DataFrame, header: Sequence[str], value: str = "value", places: int = 4) -> DataFrame:
    """(n, line): a series as numbered CSV lines, first the header lines (with a leading #)."""
    head = points.sparkSession.createDataFrame([(k - len(header), f"# {h}") for k, h in enumerate(header)], "n long, line string")
    body = F.concat_ws(",", F.col("year").cast("string"), F.col("month").cast("string"),
                       F.when(F.col(value).isNotNull(), F.format_string(f"%.{places}f", value)).otherwise(F.lit("")))
    rows = points.select(((F.col("year") * 12 + F.col("month")).cast("long")).alias("n"), body.alias("line"))
    return head.unionByName(rows)


def write_csv(lines: DataFrame, path: str) -> None:
    """Text files whose lines, in order of files and lines, follow ``n`` (one file for up to a few
    thousand lines, as a series over calendar months has)."""
    lines.repartitionByRange("n").sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)
