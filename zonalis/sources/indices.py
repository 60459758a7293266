"""Monthly climate indices from the two published text layouts, and their JSON form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.constants import SENTINEL_TOLERANCE, SENTINELS
from zonalis.registry import INDEX_INFO, INDEX_LAYOUT, SEASON_CENTER


def is_missing(v: Column, sentinels: Column) -> Column:
    """Not finite, or within 0.05 of a sentinel."""
    return (v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
            | F.exists(sentinels, lambda s: F.abs(v - s) < SENTINEL_TOLERANCE))


def _words(line: str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def parse_psl(lines: DataFrame) -> DataFrame:
    """(id, line_no, value text) -> (id, year, month, value).

    A data line is a year and twelve values; a later line holding one number declares a further
    missing-value sentinel of that file. The first non-blank line is the header. Sentinels
    are a handful per file and are matched by a join on the file id.
    """
    df = lines.where(F.length(F.trim("value")) > 0)
    first = df.groupBy("id").agg(F.min("line_no").alias("_first"))
    df = (df.join(first, "id").where(F.col("line_no") > F.col("_first"))
          .withColumn("_p", _words()).withColumn("_year", F.try_element_at("_p", F.lit(1)).try_cast("int")))
    is_data = (F.size("_p") >= 13) & F.col("_year").isNotNull()
    footer = (df.where((F.size("_p") == 1)).select("id", F.try_element_at("_p", F.lit(1)).try_cast("double").alias("s"))
              .where(F.col("s").isNotNull()).groupBy("id").agg(F.collect_set("s").alias("_extra")))
    known = F.array(*[F.lit(s) for s in SENTINELS])
    rows = (df.where(is_data).select("id", F.col("_year").alias("year"),
                                     F.posexplode(F.slice("_p", 2, 12)).alias("_m", "_v"))
            .join(footer, "id", "left"))
    v = F.col("_v").try_cast("double")
    sentinels = F.concat(known, F.coalesce("_extra", F.array().cast("array<double>")))
    return rows.select("id", "year", (F.col("_m") + 1).cast("int").alias("month"),
                       F.when(~is_missing(v, sentinels), v).alias("value"))


def parse_cpc_seasonal(lines: DataFrame) -> DataFrame:
    """``SEAS YR ANOM`` rows anchored on the centre month of the season."""
    pairs = [x for k, m in SEASON_CENTER.items() for x in (F.lit(k), F.lit(m))]
    df = lines.withColumn("_p", _words()).where(F.size("_p") == 3)
    month = F.element_at(F.create_map(*pairs), F.try_element_at("_p", F.lit(1)))
    v = F.try_element_at("_p", F.lit(3)).try_cast("double")
    known = F.array(*[F.lit(s) for s in SENTINELS])
    return (df.select("id", F.try_element_at("_p", F.lit(2)).try_cast("int").alias("year"), month.alias("month"),
                      v.alias("_v"))
            .where("year IS NOT NULL AND month IS NOT NULL AND _v IS NOT NULL")
            .select("id", "year", "month", F.when(~is_missing(F.col("_v"), known), F.col("_v")).alias("value")))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"psl": parse_psl, "cpc_seasonal": parse_cpc_seasonal}


def read_text(spark, path: str) -> DataFrame:
    """(id, line_no, value) of index files; the id is the file stem.

    Index files are a few kilobytes, so a file is one record and its lines get their
    numbers from the position inside it.
    """
    df = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^/]*$", 1).alias("id"), F.col("value"))
    return df.select("id", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def parse_all(lines: DataFrame, layouts: dict[str, str] = INDEX_LAYOUT) -> DataFrame:
    """Every known index through its parser; unknown ids are skipped."""
    out = None
    for layout, parser in PARSERS.items():
        ids = [i for i, kind in layouts.items() if kind == layout]
        part = parser(lines.where(F.col("id").isin(ids)))
        out = part if out is None else out.unionByName(part)
    return out


def coverage(index: DataFrame) -> DataFrame:
    """Non-missing months and the year span of each index."""
    return index.groupBy("id").agg(F.count("value").alias("n_months"), F.min("year").alias("first_year"),
                                   F.max("year").alias("last_year"))


def to_json(index: DataFrame) -> DataFrame:
    """One document per index: {year: [twelve values or null]}."""
    months = [F.max(F.when(F.col("month") == m, F.col("value"))) for m in range(1, 13)]
    years = index.groupBy("id", "year").agg(F.array(*months).alias("row"))
    entry = F.struct(F.col("year").cast("string").alias("key"), F.col("row").alias("value"))
    return (years.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
            .select("id", F.to_json("m").alias("json")))


def listing(index: DataFrame) -> DataFrame:
    """(id, label, long_name, source, n_months, first_year, last_year) of each index; unknown ids are labelled by themselves."""
    def info(part: str) -> Column:
        return F.create_map(*[F.lit(x) for i, row in INDEX_INFO.items() for x in (i, getattr(row, part))])[F.col("id")]

    return coverage(index).select("id", F.coalesce(info("label"), F.upper("id")).alias("label"), info("long_name").alias("long_name"),
                                  info("source").alias("source"), "n_months", "first_year", "last_year")


def document(index: DataFrame) -> DataFrame:
    """One JSON document of all indices: {"indices": {id: {label, long_name, source, values: {year: [twelve values]}}}}.

    Indices are a few hundred months each and a handful, so the document is small.
    """
    values = to_json(index).select("id", F.from_json("json", "map<string,array<double>>").alias("values"))
    body = F.struct("label", "long_name", "source", "values")
    entry = F.struct(F.col("id").alias("key"), body.alias("value"))
    return (listing(index).join(values, "id").groupBy()
            .agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))).alias("indices"))
            .select(F.to_json(F.struct("indices"), {"ignoreNullFields": "false"}).alias("json")))


def from_document(docs: DataFrame) -> DataFrame:
    """(id, label, long_name, source, year, month, value) of such documents."""
    body = "struct<indices:map<string,struct<label:string,long_name:string,source:string,values:map<string,array<double>>>>>"
    one = docs.select(F.explode(F.from_json("json", body)["indices"]).alias("id", "i"))
    years = one.select("id", "i.label", "i.long_name", "i.source", F.explode("i.values").alias("y", "row"))
    return (years.select("id", "label", "long_name", "source", F.col("y").try_cast("int").alias("year"), F.posexplode("row").alias("_m", "value"))
            .withColumn("month", F.col("_m") + 1).drop("_m"))


def from_json(docs: DataFrame) -> DataFrame:
    m = F.from_json("json", "map<string,array<double>>")
    return (docs.select("id", F.explode(m).alias("y", "row"))
            .select("id", F.col("y").try_cast("int").alias("year"),
                    F.posexplode("row").alias("_m", "value"))
            .select("id", "year", (F.col("_m") + 1).alias("month"), "value"))
