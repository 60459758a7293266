"""Adapter: the star-schema sample tables seen as gridded fields.

``lineitem`` supplies the upper-air samples (ship date gives year and month, line number the
level, part and supplier keys the cell) and ``orders`` the surface samples and a monthly
index. Field values are smooth functions of level plus affine transforms of the measures, in
the *source* units of a reanalysis archive (geopotential in m2/s2, humidity in kg/kg, ...).
One hash aggregation with a map-side partial step turns samples into monthly cells; unused
fields are pruned from it and from the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zonalis.grid import GridSpec
from zonalis.registry import Window30

SAMPLE_SPEC = GridSpec(nlat=13, nlon=12, dlat=15.0, dlon=30.0, levels=(200, 300, 500, 700, 850, 925, 1000))
SAMPLE_WINDOWS = (Window30(1995, 1997), Window30(1997, 1999), Window30(1999, 2001))

UPPER = ("u", "v", "w", "t", "z", "q", "pv", "d", "vo")
SURFACE = ("sst", "msl", "sp", "oro", "tp", "ews", "slhf", "sshf", "ssr", "str", "tisr", "ttr",
           "u10", "v10")


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; its schema is read from a footer once per process, not once per use."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def upper_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, fields in source units."""
    return upper_from(table(spark, sf_dir, "lineitem"))


# The upper-air fields over the columns level, lat, qty, price, disc and tax.
UPPER_SQL = {
    "u": "(qty - 25.5D) * 0.7310585786D + 12.3D * sin(radians(lat * 2))",
    "v": "(disc - 0.05D) * 61.80339887D",
    "w": "(tax - 0.04D) * 1.414213562D",
    "t": "300.0D * pow(level / 1000.0D, 0.2854D) + (1000.0D - level) * 0.08D + price * 3.14159265e-5D",
    "z": "434730.0D * (1.0D - pow(level / 1013.25D, 0.1903D)) + price * 0.0271828183D + 3000.0D * cos(radians(lat))",
    "q": "exp((level - 1000.0D) / 250.0D) * (qty + 20.0D) * 2.236067977e-4D",
    "pv": "pow(1000.0D / level, 1.5D) * (disc + 0.05D) * 5.772156649e-6D",
    "d": "(disc - tax) * 1.618033989e-4D",
    "vo": "(tax - disc) * 2.718281828e-4D + 1e-5D",
}


def upper_from(li: DataFrame, names: Sequence[str] = UPPER) -> DataFrame:
    """The row-wise mapping alone, for batch and streaming frames."""
    keys = ["year", "month", "level", "lat_idx", "lon_idx"]
    placed = li.selectExpr(
        "year(l_shipdate) AS year", "month(l_shipdate) AS month",
        f"element_at({SAMPLE_SPEC.levels_sql}, least(l_linenumber, 7)) AS level",
        "CAST(pmod(l_partkey, 13) AS INT) AS lat_idx", "CAST(pmod(l_suppkey, 12) AS INT) AS lon_idx",
        "90.0D - 15.0D * pmod(l_partkey, 13) AS lat", "l_quantity AS qty", "l_extendedprice AS price",
        "l_discount AS disc", "l_tax AS tax")
    return _placed(placed.selectExpr(*keys, *[f"{UPPER_SQL[n]} AS {n}" for n in names]), *keys)


def _placed(df: DataFrame, *keys: str) -> DataFrame:
    """Samples without a place in time or space are no samples. Saying so at the source also
    lets both sides of a join of a field with its own aggregate share one scan and shuffle."""
    return df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))


def upper_monthly(spark: SparkSession, sf_dir: str, fields: Sequence[str] = UPPER) -> DataFrame:
    """(year, month, level, lat_idx, lon_idx) with source-unit fields."""
    samples = upper_from(table(spark, sf_dir, "lineitem"), fields)
    return (samples.groupBy("year", "month", "level", "lat_idx", "lon_idx")
            .agg(*[F.avg(f).alias(f) for f in fields]))


# The surface fields over x (order value, 0 to 5), warm (cosine of latitude) and lon_idx.
SURFACE_SQL = {
    "sst": "272.0D + warm * 29.0D + x * 0.577215665D",
    "msl": "100500.0D + x * 314.159265D",
    "sp": "98000.0D + x * 271.828183D",
    "oro": "9000.0D + sin(radians(lon_idx * 60.0D)) * 4000.0D + x * 141.421356D",
    "tp": "x * 1.7320508e-3D",
    "ews": "(x - 2.5D) * 4472.135955D",
    "slhf": "x * -1234567.0D",
    "sshf": "(x - 1.0D) * -345678.9D",
    "ssr": "warm * 1.6e7D + x * 234567.8D",
    "str": "x * -654321.0D - 2e6D",
    "tisr": "warm * 3.0e7D + x * 12345.6D",
    "ttr": "x * -1111111.0D - 1.7e7D",
    "u10": "(x - 2.5D) * 3.3166248D",
    "v10": "(2.5D - x) * 1.4422496D",
}


def surface_samples(spark: SparkSession, sf_dir: str, names: Sequence[str] = SURFACE) -> DataFrame:
    """One row per order, fields in source units."""
    keys = ["year", "month", "lat_idx", "lon_idx"]
    placed = table(spark, sf_dir, "orders").selectExpr(
        "year(o_orderdate) AS year", "month(o_orderdate) AS month", "CAST(pmod(o_custkey, 13) AS INT) AS lat_idx",
        "CAST(pmod(o_orderkey, 12) AS INT) AS lon_idx", "o_totalprice / 1e5D AS x",
        "cos(radians(90.0D - 15.0D * pmod(o_custkey, 13))) AS warm")
    return _placed(placed.selectExpr(*keys, *[f"{SURFACE_SQL[n]} AS {n}" for n in names]), *keys)


def surface_monthly(spark: SparkSession, sf_dir: str, fields: Sequence[str] = SURFACE) -> DataFrame:
    return (surface_samples(spark, sf_dir, fields).groupBy("year", "month", "lat_idx", "lon_idx")
            .agg(*[F.avg(f).alias(f) for f in fields]))


def monthly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, year, month, value): the mean order value per month, in units of 1e4 around 25."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
    return (o.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
            .agg((F.avg("o_totalprice") / 1e4 - F.lit(25.0)).alias("value"))
            .select(F.lit("oni").alias("id"), "year", "month", "value"))


def arc_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arc per supplier."""
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select(
        k.alias("arc_id"),
        (F.pmod(k * 37, F.lit(151)) - 75.0 + bal * 1.118033989e-4).alias("lat1"),
        (F.pmod(k * 53, F.lit(360)) - 180.0 + bal * 1.322875656e-5).alias("lon1"),
        (F.pmod(k * 71, F.lit(149)) - 74.0 + bal * 2.236067977e-4).alias("lat2"),
        (F.pmod(k * 97, F.lit(360)) - 179.5 + bal * 3.162277660e-5).alias("lon2"))


def probe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per customer."""
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        k.alias("pid"), (F.pmod(k * 29, F.lit(173)) - 86.0 + bal * 1.118033989e-4).alias("lat"),
        (F.pmod(k * 61, F.lit(360)) - 180.0 + bal * 2.236067977e-5).alias("lon"),
        (F.lit(210.0) + F.pmod(k * 17, F.lit(780)) + bal * 1.224744871e-3).alias("p"))
