"""Small analytic fields."""

import math

from zonalis.grid import GridSpec

SMALL = GridSpec(nlat=13, nlon=12, dlat=15.0, dlon=30.0, levels=(200, 500, 850, 1000))


def grid(spark, spec, fn, months=(1,), levels=None, names=("u",)):
    """fn(month, level, lat, lon) -> tuple of values (None for missing)."""
    rows = []
    for m in months:
        for p in levels or spec.levels:
            for i in range(spec.nlat):
                for j in range(spec.nlon):
                    v = fn(m, p, spec.lat0 - i * spec.dlat, spec.lon0 + j * spec.dlon)
                    v = v if isinstance(v, tuple) else (v,)
                    rows.append((m, p, i, j, *[None if x is None else float(x) for x in v]))
    cols = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"month int, level int, lat_idx int, lon_idx int, {cols}")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def cosd(x):
    return math.cos(math.radians(x))
