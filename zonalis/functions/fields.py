"""Point-wise formulas as Column expressions (evaluated inside whole-stage codegen)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonalis import constants as K
from zonalis.registry import INDEX_INFO, SEASON_CENTER


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


# derived fields ----------------------------------------------------------------
def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def shear(u_top: Column, v_top: Column, u_bot: Column, v_bot: Column) -> Column:
    return F.hypot(u_top - u_bot, v_top - v_bot)


def moist_static_energy(t: Column, z_m: Column, q_gkg: Column) -> Column:
    """J/kg from display units (height in m, humidity in g/kg)."""
    return F.lit(K.CP) * t + F.lit(K.GRAVITY) * z_m + F.lit(K.LATENT_HEAT) * (q_gkg / F.lit(1000.0))


def mse_kelvin(t: Column, z_m: Column, q_gkg: Column) -> Column:
    return moist_static_energy(t, z_m, q_gkg) / F.lit(K.CP)


def mse_kelvin_raw(t: Column, geopotential: Column, q_kgkg: Column) -> Column:
    return (F.lit(K.CP) * t + geopotential + F.lit(K.LATENT_HEAT) * q_kgkg) / F.lit(K.CP)


def potential_temperature(t: Column, level_hpa: Column, kappa: float = K.KAPPA) -> Column:
    return t * F.pow(F.lit(1000.0) / level_hpa, F.lit(kappa))


def mixing_ratio_gkg(q_kgkg: Column) -> Column:
    return q_kgkg / F.greatest(F.lit(1.0) - q_kgkg, F.lit(1e-12)) * F.lit(1000.0)


def celsius(t: Column) -> Column:
    return t - F.lit(273.15)


def coriolis(lat_deg: Column) -> Column:
    return F.lit(2.0 * K.OMEGA) * F.sin(F.radians(lat_deg))


# ranges ------------------------------------------------------------------------
def symmetric_bound(vmin: Column, vmax: Column) -> Column:
    return F.greatest(F.abs(vmin), F.abs(vmax))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


# longitude and boxes -----------------------------------------------------------
def turn(x: Column) -> Column:
    """An angle in [0, 360), rounding like ((x mod 360) + 360) mod 360 for every sign."""
    return (x % F.lit(360.0) + F.lit(360.0)) % F.lit(360.0)


def wrap_lon(lon: Column) -> Column:
    """Into [-180, 180)."""
    return turn(lon + F.lit(180.0)) - F.lit(180.0)


def wrap_lon_value(lon: float) -> float:
    return (lon + 180.0) % 360.0 - 180.0


def in_box(lat: Column, lon: Column, lat_min: float, lat_max: float,
           lon_min: float, lon_max: float) -> Column:
    """Inside a box whose west edge may lie east of its east edge (date line)."""
    rows = lat.between(min(lat_min, lat_max), max(lat_min, lat_max))
    if abs(lon_max - lon_min) >= 360.0:
        return rows
    x, west, east = wrap_lon(lon), wrap_lon_value(lon_min), wrap_lon_value(lon_max)
    cols = (x >= west) | (x <= east) if west > east else (x >= west) & (x <= east)
    return rows & cols


def check_box(lat_min: float, lat_max: float, lon_min: float, lon_max: float,
              dragged: bool = False) -> None:
    """A region must span at least 0.4 degrees of latitude (a dragged one of longitude too)."""
    if abs(lat_max - lat_min) < 0.4:
        raise ValueError("region spans less than 0.4 degrees of latitude")
    if dragged and abs(lon_max - lon_min) <= 0.4:
        raise ValueError("region spans no more than 0.4 degrees of longitude")


# sphere ------------------------------------------------------------------------
def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)))
    return F.lit(2.0 * K.EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    p, x = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.sin(x), F.sin(p), F.cos(p) * F.cos(x)


def vector_lat(x: Column, y: Column, z: Column) -> Column:
    n = F.sqrt(x * x + y * y + z * z)
    return F.degrees(F.asin(F.when(n == 0, F.lit(0.0)).otherwise(y / F.nullif(n, F.lit(0.0)))))


def vector_lon(x: Column, z: Column) -> Column:
    return F.degrees(F.atan2(x, z))


# sun ---------------------------------------------------------------------------
def solar_declination(month: Column) -> Column:
    """Radians."""
    tilt = math.sin(math.radians(K.AXIAL_TILT_DEG))
    return F.asin(F.lit(-tilt) * F.cos(month * F.lit(math.pi / 6)))


def daylight_fraction(lat_deg: Column, month: Column) -> Column:
    """Share of the day with the sun up: the sunset hour angle over pi, all or nothing at the poles."""
    sun = solar_declination(month)
    hour_angle = F.acos(clip(-F.tan(F.radians(lat_deg)) * F.tan(sun), -1.0, 1.0))
    towards = F.signum(lat_deg) * F.when(F.abs(sun) < 1e-9, F.lit(0.0)).otherwise(F.signum(sun))
    return F.when(F.abs(lat_deg) > 89.99, (towards + 1) / 2).otherwise(hour_angle / F.lit(math.pi))


def winter_darkening(lat_deg: Column, month: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2.0) * daylight_fraction(lat_deg, month))


def heliocentric_angle(month: Column) -> Column:
    """Radians along the orbit: 30 degrees a month, December at 0."""
    return month * F.lit(math.pi / 6)


# barbs, contours, colours --------------------------------------------------------
def wind_barb(speed_ms: Column) -> Column:
    """Pennants (50 kt), full (10 kt) and half (5 kt) feathers; NULL below 1.5 m/s."""
    kt = speed_ms * F.lit(K.MS_TO_KNOTS)
    pennants = F.floor(kt / 50)
    rest = kt - pennants * 50
    full = F.floor(rest / 10)
    half = F.when(rest - full * 10 >= 4.5, 1).otherwise(0)
    return F.when(speed_ms >= 1.5, F.struct(
        pennants.cast("int").alias("pennants"), full.cast("int").alias("full"),
        half.cast("int").alias("half")))


def contour_bucket(v: Column, interval: float) -> Column:
    return F.floor(v / F.lit(interval)).cast("long")


def table_lookup(t: Column, table: Sequence[Sequence[float]]) -> list[Column]:
    """Linear interpolation of every column of an evenly spaced table at t in 0..1 (clamped)."""
    at = clip(t, 0.0, 1.0) * (len(table) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    out = []
    for column in zip(*table):
        values = F.array(*[F.lit(float(x)) for x in column])
        start = F.get(values, low)
        out.append(start + (F.get(values, high) - start) * (at - low))
    return out


# The colour of missing data.
NO_DATA = (18.0, 26.0, 22.0)


def colour_at(t: Column, stops: Sequence[tuple[float, float, float]]) -> Column:
    """RGB (0 to 255) from a table of stops; NULL gives the no-data colour."""
    rgb = [F.coalesce(c * 255.0, F.lit(none)).alias(n) for c, none, n in zip(table_lookup(t, stops), NO_DATA, "rgb")]
    return F.struct(*rgb)


# labels ------------------------------------------------------------------------
def degrees_label(angle: Column, positive: str, negative: str, plain: dict[int, str]) -> Column:
    """Whole degrees with a letter by sign; some values have a text of their own."""
    size = F.abs(F.round(angle)).cast("int")
    named = F.create_map(*[F.lit(x) for item in plain.items() for x in item])
    return F.coalesce(named[size], F.format_string("%d°%s", size, F.when(angle < 0, negative).otherwise(positive)))


def lat_label(lat: Column) -> Column:
    return degrees_label(lat, "N", "S", {0: "Eq"})


def lon_label(lon: Column) -> Column:
    return degrees_label(wrap_lon(lon), "E", "W", {0: "0°", 180: "180°"})


def season_label(month: Column) -> Column:
    """Name of the three-month season centred on a month."""
    names = {m: s for s, m in SEASON_CENTER.items()}
    return F.create_map(*[F.lit(x) for item in sorted(names.items()) for x in item])[month]


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in K.MONTH_NAMES]), month)


# Signs of comparisons.
SIGNS = {"ge": "≥", "le": "≤"}


def composite_label(index_id: Column, month: Column, cmp: str, threshold: float) -> Column:
    """An event rule by the index's own label, else its id in capitals."""
    known = F.create_map(*[F.lit(x) for i, info in INDEX_INFO.items() for x in (i, info.label)])
    rule = F.format_string(f"%s {SIGNS[cmp]} %+.1f", F.coalesce(known[index_id], F.upper(index_id)), F.lit(float(threshold)))
    return F.concat_ws(" · ", rule, month_label(month))


# From this size on a value is written with so many decimals.
DECIMALS = ((1000.0, 0), (100.0, 1), (10.0, 2), (0.0, 3))


def value_label(value: Column) -> Column:
    """A value to the precision its size asks for; NULL where there is none."""
    text = F.lit(None).cast("string")
    for size, places in reversed(DECIMALS):
        text = F.when(F.abs(value) >= size, F.format_string(f"%.{places}f", value)).otherwise(text)
    return text


def box_label(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """A box from south to north and from its western to its eastern side; the latitudes may come in any order."""
    span = "–"
    return F.concat_ws(", ", F.concat_ws(span, lat_label(F.least(lat_min, lat_max)), lat_label(F.greatest(lat_min, lat_max))),
                       F.concat_ws(span, lon_label(lon_min), lon_label(lon_max)))


def fractional_year(year: Column, month: Column) -> Column:
    return year + (month - F.lit(0.5)) / F.lit(12.0)
