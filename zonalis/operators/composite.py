"""Event composites and best-matching climatology windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.operators import reduce
from zonalis.registry import Window30


def event_years(index: DataFrame, index_id: str, month: int, cmp: str, threshold: float) -> DataFrame:
    """Years whose index value in a month passes the test; missing values never do."""
    passes = F.col("value") >= threshold if cmp == "ge" else F.col("value") <= threshold
    return (index.where((F.col("id") == index_id) & (F.col("month") == month) & passes)
            .select("year").distinct())


def split_available(events: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event years with fields, and those without."""
    years = available.select("year").distinct()
    return events.join(years, "year", "left_semi"), events.join(years, "year", "left_anti")


def requested_years(spark, years: Sequence[int] | None = None, start: int | None = None,
                    end: int | None = None) -> DataFrame:
    """A year list (deduplicated) or an inclusive range as a DataFrame."""
    if years is not None:
        arr = F.array_sort(F.array_distinct(F.array(*[F.lit(int(y)) for y in years]))) if years else None
    elif start is not None and end is not None and end >= start:
        arr = F.sequence(F.lit(int(start)), F.lit(int(end)))
    else:
        arr = None
    if arr is None:
        return spark.createDataFrame([], "year int")
    return spark.range(1).select(F.explode(arr).alias("year"))


def composite_mean(monthly: DataFrame, years: DataFrame, values: Sequence[str],
                   keys: Sequence[str] = reduce.CELL_KEYS) -> DataFrame:
    """Mean over the listed years, missing cells skipped. The semi-join prunes the years
    before the aggregation; its list has at most one row per calendar year, so it is broadcast
    and the fields are not shuffled by year."""
    listed = F.broadcast(years.select("year").distinct())
    return reduce.climatology(monthly.join(listed, "year", "left_semi"), values, keys)


def _packed(windows: Sequence[Window30]) -> Column:
    """The fixed list of windows as an array literal, by centre."""
    rows = ", ".join(f"named_struct('center', {w.center!r}D, 'id', '{w.id}', 'start', {w.start}, 'end', {w.end})"
                     for w in sorted(windows, key=lambda w: w.center))
    return F.expr(f"array({rows})")


def best_window(years: DataFrame, windows: Sequence[Window30], year: str = "year") -> DataFrame:
    """The window whose centre is nearest to each year; of two equally near, the later.

    The windows are a fixed list of a few rows, packed into one array per task: no join at
    all, whatever the number of years.
    """
    packed = _packed(windows)

    def nearer(acc: Column, x: Column) -> Column:
        return F.when(F.abs(F.col(year) - x["center"]) <= F.abs(F.col(year) - acc["center"]), x).otherwise(acc)

    best = F.aggregate(packed, F.element_at(packed, 1), nearer)
    return years.withColumn("_b", best).select(
        *years.columns, F.col("_b.id").alias("window_id"), F.col("_b.start").alias("win_start"),
        F.col("_b.end").alias("win_end"))


def window_weights(event_windows: DataFrame) -> DataFrame:
    """Share of the events that fall to each window.

    The closing window function sees one row per climatology window, a fixed short list.
    """
    n = event_windows.groupBy("window_id").agg(F.count("*").alias("n"))
    whole = W.partitionBy(F.lit(0))
    return n.select("window_id", "n", (F.col("n") / F.sum("n").over(whole)).alias("weight"),
                    F.count("*").over(whole).alias("n_windows"))


def window_climatologies(monthly: DataFrame, windows: Sequence[Window30], values: Sequence[str],
                         keys: Sequence[str] = reduce.CELL_KEYS) -> DataFrame:
    """Month-of-year means of every window in one pass.

    Windows overlap, so years are first summed in the spans between window edges, where no
    year counts twice; only those few sums per cell are then copied to the windows that
    contain them. The window list is fixed and enters as literals: no join.
    """
    edges = sorted({w.start for w in windows} | {w.end + 1 for w in windows})
    cases = " ".join(f"WHEN year >= {a} AND year < {b} THEN {a}" for a, b in zip(edges, edges[1:]))
    # Years outside every window get no span and leave with the explode below; a filter here would
    # be pushed to the scan and part it from the one the fields themselves use.
    sums = (monthly.withColumn("span", F.expr(f"CASE {cases} END"))
            .groupBy("span", "month", *keys)
            .agg(*[F.sum(v).alias(v) for v in values], *[F.count(v).alias(f"_n_{v}") for v in values]))
    holding = F.filter(_packed(windows), lambda w: (w["start"] <= F.col("span")) & (F.col("span") <= w["end"]))
    return (sums.withColumn("window_id", F.explode(F.transform(holding, lambda w: w["id"])))
            .groupBy("window_id", "month", *keys)
            .agg(*[F.try_divide(F.sum(v), F.sum(f"_n_{v}")).alias(v) for v in values]))


def sliding_reference(clims: DataFrame, weights: DataFrame, values: Sequence[str],
                      keys: Sequence[str] = reduce.CELL_KEYS) -> DataFrame:
    """Event-weighted climatology sum_w (n_w/N) clim_w.

    Linear, hence equal to subtracting each event's own window and averaging, at one
    climatology per window. A cell is present only if every window has it.
    """
    aggs = [F.when(F.count(v) == F.max("n_windows"), F.sum(F.col(v) * F.col("weight"))).alias(v)
            for v in values]
    return clims.join(weights, "window_id").groupBy("month", *keys).agg(*aggs)
