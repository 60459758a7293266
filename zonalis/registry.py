"""Fixed tables: fields, units, climatology windows, climate indices."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.constants import DAY_SECONDS, GRAVITY


@dataclass(frozen=True)
class Field:
    name: str
    kind: str                      # "pl" pressure levels, "sl" single level
    group: str
    title: str
    units: str
    contour: float | None = None
    default_level: int | None = None
    symmetric: bool = False
    clamp: tuple[float, float] | None = None
    derived: bool = False
    theta_only: bool = False
    hidden: bool = False
    ingredients: tuple[str, ...] = ()


def _f(*args, **kw) -> Field:
    return Field(*args, **kw)


# Display metadata, contour steps and percentile clamps per field.
FIELDS: dict[str, Field] = {f.name: f for f in (
    _f("t", "pl", "Dynamics", "Temperature", "K", 10, 500, clamp=(0.005, 0.995)),
    _f("u", "pl", "Dynamics", "Zonal wind", "m s-1", 10, 200, symmetric=True),
    _f("v", "pl", "Dynamics", "Meridional wind", "m s-1", 5, 200, symmetric=True),
    _f("wspd", "pl", "Dynamics", "Wind speed", "m s-1", 10, 200, derived=True,
       ingredients=("u", "v")),
    _f("vo", "pl", "Dynamics", "Relative vorticity", "1e-5 s-1", 2, 500, symmetric=True,
       clamp=(0.03, 0.97)),
    _f("d", "pl", "Dynamics", "Horizontal divergence", "1e-5 s-1", 1, 200, symmetric=True,
       clamp=(0.03, 0.97)),
    _f("w", "pl", "Dynamics", "Vertical velocity", "Pa s-1", 0.05, 500, symmetric=True,
       clamp=(0.05, 0.95)),
    _f("z", "pl", "Dynamics", "Geopotential height", "m", 60, 500, clamp=(0.005, 0.995)),
    _f("psi", "pl", "Dynamics", "Streamfunction", "1e6 m2 s-1", 20, 200, symmetric=True),
    _f("chi", "pl", "Dynamics", "Velocity potential", "1e6 m2 s-1", 2, 200, symmetric=True),
    _f("q", "pl", "Moisture", "Specific humidity", "g kg-1", 2, 850, clamp=(0.0, 0.99)),
    _f("r", "pl", "Moisture", "Relative humidity", "%", 10, 700, clamp=(0.0, 0.995)),
    _f("pv", "pl", "Derived & PV", "Ertel PV", "PVU", 1, 330, symmetric=True, derived=True,
       theta_only=True, ingredients=("pv", "t")),
    _f("mse", "pl", "Derived & PV", "Moist static energy / cp", "K", 5, 850, derived=True,
       clamp=(0.005, 0.995), ingredients=("t", "z", "q")),
    _f("t2m", "sl", "Surface", "2-m temperature", "K", 5),
    _f("d2m", "sl", "Surface", "2-m dewpoint", "K", 5),
    _f("sst", "sl", "Surface", "Sea surface temperature", "K", 2),
    _f("msl", "sl", "Surface", "Mean sea-level pressure", "hPa", 4),
    _f("dls", "sl", "Derived & PV", "Deep-layer shear of the mean flow", "m s-1", 5,
       derived=True, ingredients=("u", "v")),
    _f("sp", "sl", "Surface", "Surface pressure", "hPa", 20, clamp=(0.005, 0.995)),
    _f("blh", "sl", "Surface", "Boundary-layer height", "m", 200),
    _f("tcwv", "sl", "Moisture", "Precipitable water", "kg m-2", 5),
    _f("tp", "sl", "Moisture", "Total precipitation", "mm day-1", 2, clamp=(0.0, 0.99)),
    _f("ews", "sl", "Surface fluxes", "Eastward surface stress", "N m-2", 0.05, symmetric=True),
    _f("sshf", "sl", "Surface fluxes", "Sensible heat flux", "W m-2", 20, symmetric=True),
    _f("slhf", "sl", "Surface fluxes", "Latent heat flux", "W m-2", 25, symmetric=True),
    _f("ssr", "sl", "Surface fluxes", "Net SW radiation", "W m-2", 25),
    _f("str", "sl", "Surface fluxes", "Net LW radiation", "W m-2", 10, symmetric=True),
    _f("tisr", "sl", "TOA", "Incoming solar", "W m-2", 50),
    _f("ttr", "sl", "TOA", "Net LW at TOA", "W m-2", 20),
    _f("u10", "sl", "_internal", "10-m zonal wind", "m s-1", symmetric=True, hidden=True),
    _f("v10", "sl", "_internal", "10-m meridional wind", "m s-1", symmetric=True, hidden=True),
)}

# Source unit -> display unit factors, applied once on read to mean and sigma.
UNIT_SCALE: dict[str, float] = {
    "z": 1.0 / GRAVITY, "oro": 1.0 / GRAVITY,
    "msl": 0.01, "sp": 0.01,
    "tp": 1000.0,
    **{n: 1.0 / DAY_SECONDS for n in ("sshf", "slhf", "ssr", "str", "tisr", "ttr", "ews")},
    "q": 1000.0,
    "d": 1e5, "vo": 1e5,
    "chi": 1e-6, "psi": 1e-6,
    "pv": 1e6,
}


# The two levels of deep-layer shear.
SHEAR_LEVELS = (200, 850)


@dataclass(frozen=True)
class Window30:
    start: int
    end: int

    @property
    def id(self) -> str:
        return f"{self.start}-{self.end}"

    @property
    def center(self) -> float:
        return (self.start + self.end) / 2.0


# The eight overlapping reference windows.
CLIMO_WINDOWS = (
    Window30(1961, 1990), Window30(1966, 1995), Window30(1971, 2000), Window30(1976, 2005),
    Window30(1981, 2010), Window30(1986, 2015), Window30(1991, 2020), Window30(1996, 2025),
)
DEFAULT_PERIOD = "1991-2020"


def window_frame(spark: SparkSession, windows: tuple[Window30, ...] = CLIMO_WINDOWS) -> DataFrame:
    return spark.createDataFrame(
        [(w.id, w.start, w.end, w.center) for w in windows],
        "id string, start int, `end` int, center double")


def field_frame(spark: SparkSession) -> DataFrame:
    """The registry as a (32-row) table."""
    return spark.createDataFrame(
        [(f.name, f.kind, f.group, f.title, f.units, f.default_level,
          None if f.contour is None else float(f.contour), f.symmetric,
          f.clamp[0] if f.clamp else None, f.clamp[1] if f.clamp else None,
          f.derived, f.theta_only, f.hidden) for f in FIELDS.values()],
        "var string, type string, grp string, title string, units string, default_level int, "
        "contour double, symmetric boolean, clamp_lo double, clamp_hi double, derived boolean, "
        "theta_only boolean, hidden boolean")


def unit_factor(var):
    """CASE over the variable name."""
    expr = None
    for name, factor in UNIT_SCALE.items():
        expr = F.when(var == name, factor) if expr is None else expr.when(var == name, factor)
    return expr.otherwise(F.lit(1.0))


# The eight monthly indices and the text layout each is published in.
INDEX_LAYOUT = {
    "roni": "cpc_seasonal", "oni": "psl", "pna": "psl", "nao": "psl",
    "ao": "psl", "pdo": "psl", "amm": "psl", "pmm": "psl",
}


class IndexInfo(NamedTuple):
    label: str
    long_name: str
    source: str


# Names of the indices and where they are published.
INDEX_INFO = {
    "roni": IndexInfo("RONI", "Relative Oceanic Niño Index", "https://www.cpc.ncep.noaa.gov/data/indices/RONI.ascii.txt"),
    "oni": IndexInfo("ONI", "Oceanic Niño Index", "https://psl.noaa.gov/data/correlation/oni.data"),
    "pna": IndexInfo("PNA", "Pacific / North American teleconnection", "https://psl.noaa.gov/data/correlation/pna.data"),
    "nao": IndexInfo("NAO", "North Atlantic Oscillation", "https://psl.noaa.gov/data/correlation/nao.data"),
    "ao": IndexInfo("AO", "Arctic Oscillation", "https://psl.noaa.gov/data/correlation/ao.data"),
    "pdo": IndexInfo("PDO", "Pacific Decadal Oscillation", "https://psl.noaa.gov/data/correlation/pdo.data"),
    "amm": IndexInfo("AMM", "Atlantic Meridional Mode", "https://psl.noaa.gov/data/timeseries/monthly/AMM/ammsst.data"),
    "pmm": IndexInfo("PMM", "Pacific Meridional Mode", "https://psl.noaa.gov/data/timeseries/monthly/PMM/pmmsst.data"),
}
# Centre month of an overlapping three-month season.
SEASON_CENTER = {
    "DJF": 1, "JFM": 2, "FMA": 3, "MAM": 4, "AMJ": 5, "MJJ": 6,
    "JJA": 7, "JAS": 8, "ASO": 9, "SON": 10, "OND": 11, "NDJ": 12,
}
