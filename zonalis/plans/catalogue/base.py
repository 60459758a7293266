"""Registration of queries with their independent SQL, and the SQL view of the sample grid.

A column list such as ``"month:i level:i value:6"`` fixes names, types and rounding of a
result for both engines (i/l integers, s text, b boolean, a digit = decimals).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.sources import fields, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPEC = tables.SAMPLE_SPEC
WINDOWS = tables.SAMPLE_WINDOWS
CELL = ["level", "lat_idx", "lon_idx"]
ROW = ["level", "lat_idx"]


def query(name: str, columns: str, sql: str | None = None):
    """Register a query; ``sql`` must end in a relation the column list is selected from."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shaped(fn(spark, sf_dir), columns)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"{sql}\nSELECT {_sql_columns(columns)} FROM result"
        return fn
    return register


def _parts(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in columns.split()]


def shaped(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _parts(columns):
        c = F.col(name)
        if kind in "il":
            c = c.cast("int" if kind == "i" else "long")
        elif kind == "s":
            c = c.cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = c.cast("double")
        out.append(c.alias(name))
    df = df.select(*out)
    digits = {n: int(k) for n, k in _parts(columns) if k.isdigit()}
    return df.select(*[rounded(n, digits[n]).alias(n) if n in digits else n for n in df.columns]) if digits else df


def rounded(name: str, digits: int) -> Column:
    """``round`` of a double column, for most values without its decimal arithmetic, which costs more than most formulas.

    Where the scaled value is small and clearly nearer to one integer than to the next, the quotient of that integer and
    the scale is the double that ``round`` gives: both are the double next to that decimal number.
    """
    c, scale = F.col(name), F.lit(10.0 ** digits)
    whole = F.rint(c * scale)
    clear = (F.abs(whole) < 1e12) & (F.abs(c * scale - whole) < 0.49)
    return F.when(clear, whole / scale).otherwise(F.round(c, digits)) + F.lit(0.0)     # + 0.0 turns -0.0 into 0.0


def _sql_columns(columns: str) -> str:
    types = {"i": "INTEGER", "l": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}
    return ", ".join(
        f'CAST("{n}" AS {types[k]}) AS "{n}"' if k in types
        else f'round(CAST("{n}" AS DOUBLE), {k}) + CAST(0 AS DOUBLE) AS "{n}"'
        for n, k in _parts(columns))


# Spark side of the sample grid ----------------------------------------------------
def monthly(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(year, month, level, cell) in display units."""
    return fields.display_columns(tables.upper_monthly(spark, sf_dir, names), names)


def clim(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Month-of-year climatology over all years."""
    m = monthly(spark, sf_dir, *names)
    return m.groupBy("month", *CELL).agg(*[F.avg(n).alias(n) for n in names])


def surface_monthly(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return fields.display_columns(tables.surface_monthly(spark, sf_dir, names), names)


def surface_clim(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    m = surface_monthly(spark, sf_dir, *names)
    return m.groupBy("month", "lat_idx", "lon_idx").agg(*[F.avg(n).alias(n) for n in names])


# SQL side ---------------------------------------------------------------------------
SQL_SAMPLES = """samples AS (
  SELECT year(l_shipdate) AS year, month(l_shipdate) AS month,
    CASE l_linenumber WHEN 1 THEN 200 WHEN 2 THEN 300 WHEN 3 THEN 500 WHEN 4 THEN 700
         WHEN 5 THEN 850 WHEN 6 THEN 925 ELSE 1000 END AS level,
    l_partkey % 13 AS lat_idx, l_suppkey % 12 AS lon_idx,
    l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax
  FROM lineitem),
raw AS (
  SELECT year, month, level, lat_idx, lon_idx,
    (qty - 25.5) * 0.7310585786::DOUBLE + 12.3::DOUBLE * sin(radians((90.0 - 15.0 * lat_idx) * 2)) AS u,
    (disc - 0.05::DOUBLE) * 61.80339887::DOUBLE AS v,
    (tax - 0.04::DOUBLE) * 1.414213562::DOUBLE AS w,
    300.0::DOUBLE * pow(level / 1000.0, 0.2854) + (1000.0 - level)::DOUBLE * 0.08::DOUBLE
      + price * 3.14159265e-5 AS t,
    434730.0::DOUBLE * (1.0 - pow(level / 1013.25, 0.1903)) + price * 0.0271828183::DOUBLE
      + 3000.0::DOUBLE * cos(radians(90.0 - 15.0 * lat_idx)) AS z,
    exp((level - 1000.0) / 250.0) * (qty + 20.0) * 2.236067977e-4 AS q,
    pow(1000.0 / level, 1.5) * (disc + 0.05::DOUBLE) * 5.772156649e-6 AS pv,
    (disc - tax) * 1.618033989e-4 AS d,
    (tax - disc) * 2.718281828e-4 + 1e-5 AS vo
  FROM samples),
src AS (
  SELECT year, month, level, lat_idx, lon_idx, avg(u) AS u, avg(v) AS v, avg(w) AS w, avg(t) AS t,
    avg(z) AS z, avg(q) AS q, avg(pv) AS pv, avg(d) AS d, avg(vo) AS vo
  FROM raw GROUP BY ALL),
mon AS (
  SELECT year, month, level, lat_idx, lon_idx, u, v, w, t, z / 9.80665::DOUBLE AS z, q * 1000 AS q,
    pv * 1e6 AS pv, d * 1e5 AS d, vo * 1e5 AS vo FROM src)"""

SQL_CLIM = SQL_SAMPLES + """,
clim AS (
  SELECT month, level, lat_idx, lon_idx, avg(u) AS u, avg(v) AS v, avg(w) AS w, avg(t) AS t,
    avg(z) AS z, avg(q) AS q, avg(pv) AS pv FROM mon GROUP BY ALL)"""

SQL_SURFACE = """srows AS (
  SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, o_custkey % 13 AS lat_idx,
    o_orderkey % 12 AS lon_idx, o_totalprice / 1e5 AS x, cos(radians(90.0 - 15.0 * (o_custkey % 13))) AS warm
  FROM orders),
sraw AS (
  SELECT year, month, lat_idx, lon_idx,
    272.0 + warm * 29.0 + x * 0.577215665::DOUBLE AS sst, 100500.0 + x * 314.159265::DOUBLE AS msl,
    98000.0 + x * 271.828183::DOUBLE AS sp,
    9000.0 + sin(radians(lon_idx * 60.0)) * 4000.0 + x * 141.421356::DOUBLE AS oro,
    x * 1.7320508e-3 AS tp, (x - 2.5) * 4472.135955::DOUBLE AS ews, x * -1234567.0::DOUBLE AS slhf,
    (x - 1.0) * -345678.9::DOUBLE AS sshf, warm * 1.6e7 + x * 234567.8::DOUBLE AS ssr,
    x * -654321.0::DOUBLE - 2e6 AS str, warm * 3.0e7 + x * 12345.6::DOUBLE AS tisr,
    x * -1111111.0::DOUBLE - 1.7e7 AS ttr, (x - 2.5) * 3.3166248::DOUBLE AS u10,
    (2.5 - x) * 1.4422496::DOUBLE AS v10
  FROM srows),
smon AS (
  SELECT year, month, lat_idx, lon_idx, avg(sst) AS sst, avg(msl) / 100 AS msl, avg(sp) / 100 AS sp,
    avg(oro) / 9.80665::DOUBLE AS oro, avg(tp) * 1000 AS tp, avg(ews) / 86400 AS ews,
    avg(slhf) / 86400 AS slhf, avg(sshf) / 86400 AS sshf, avg(ssr) / 86400 AS ssr, avg(str) / 86400 AS str,
    avg(tisr) / 86400 AS tisr, avg(ttr) / 86400 AS ttr, avg(u10) AS u10, avg(v10) AS v10
  FROM sraw GROUP BY ALL),
sclim AS (
  SELECT month, lat_idx, lon_idx, avg(sst) AS sst, avg(msl) AS msl, avg(sp) AS sp, avg(oro) AS oro,
    avg(tp) AS tp, avg(ews) AS ews, avg(slhf) AS slhf, avg(sshf) AS sshf, avg(ssr) AS ssr, avg(str) AS str,
    avg(tisr) AS tisr, avg(ttr) AS ttr, avg(u10) AS u10, avg(v10) AS v10 FROM smon GROUP BY ALL)"""

SQL_INDEX = """idx AS (
  SELECT 'oni' AS id, year(o_orderdate) AS year, month(o_orderdate) AS month,
    avg(o_totalprice) / 1e4 - 25.0 AS value FROM orders GROUP BY 2, 3)"""

SQL_WINDOWS = """win AS (
  SELECT * FROM (VALUES ('1995-1997', 1995, 1997, 1996.0), ('1997-1999', 1997, 1999, 1998.0),
                        ('1999-2001', 1999, 2001, 2000.0)) AS w(id, first, last, center))"""

# level table with neighbours (Pa spacing) for derivatives
SQL_LEVELS = """lev AS (
  SELECT k, p FROM (VALUES (0, 200), (1, 300), (2, 500), (3, 700), (4, 850), (5, 925), (6, 1000)) AS l(k, p)),
lats AS (SELECT i, 90.0 - 15.0 * i AS lat, cos(radians(90.0 - 15.0 * i)) AS c FROM range(13) AS r(i))"""

DYM = "(6.371e6 * radians(15.0))"          # metres per grid row


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)
