"""Exact order statistics with the floor-index convention, and exact prefix sums.

A rank is bracketed by a small summary of its group, then found exactly; the source is read twice.

1. The summary merges map-side. Ranks by number: equi-depth edges of a Greenwald-Khanna sketch, whose rank error has a fixed
   bound far below the width of a bracket. Ranks by weight: sums in logarithmic bins.
2. The second read keeps the values inside a bracket apart and sums up whatever lies between brackets, so that one row per task
   and gap remains of all the rest. Equal values are added up before they move. One window per group then gives the running weight.

A third of all rows with one value, a tiny range (ranks by number) or an extreme outlier never bring a group into one task:
what is ordered are the distinct values of a bracket. Averages below this operator may differ in their last bits between the two
reads, as partial sums arrive in any order; so a bracket ends at values clearly apart from the rank's own, and is open where there are
none. A rank that its bracket should miss all the same stops the query rather than giving a wrong value.
Groups with NULL keys are groups like others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Equi-depth edges of a group, and the sketch's accuracy: its ranks are wrong by n / ACCURACY at most.
EDGES, ACCURACY = 512, 10_000
#: Values closer than this, relative to their size, may change places between two reads.
APART = 1e-9
#: Logarithmic bins per power of two.
PER_OCTAVE = 4096
#: Keys whose values come from fixed lists (calendar, axis of levels, registry), so that their combinations are few.
FEW = frozenset({"month", "level", "year", "var", "grp", "kind", "period", "window_id", "side"})


def log_bin(value: Column) -> Column:
    """Monotone bin number of a value: sign, power of two and a linear part in between."""
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    part = octave + size / F.pow(F.lit(2.0), octave) + 1100.0               # above 0 for every double
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * F.floor(part * PER_OCTAVE))


def _clearly_below(value: Column) -> Column:
    return value - F.abs(value) * APART


def _clearly_above(value: Column) -> Column:
    return value + F.abs(value) * APART


def _by_number(rows: DataFrame, keys: Sequence[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """(keys, _t): each target with values surely around it, from the edges of the group's sketch."""
    edges = F.percentile_approx("_v", [k / EDGES for k in range(EDGES + 1)], ACCURACY)
    s = rows.groupBy(*keys).agg(edges.alias("_edges"), F.count("_v").cast("double").alias("_n"))

    def edge(place: Column) -> Column:
        return F.element_at("_edges", F.greatest(F.lit(0), F.least(F.lit(EDGES), place)).cast("int") + 1)

    def around(x: Column) -> Column:
        lo, hi = edge(F.floor((x["pos"] - 1) / F.col("_n") * EDGES) - 1), edge(F.ceil(x["pos"] / F.col("_n") * EDGES) + 1)
        below = F.array_max(F.filter("_edges", lambda e: e < _clearly_below(lo)))
        above = F.array_min(F.filter("_edges", lambda e: e > _clearly_above(hi)))
        return F.struct(x["name"].alias("name"), x["pos"].alias("pos"), F.coalesce(below, F.lit(float("-inf"))).alias("lo"),
                        F.coalesce(above, F.lit(float("inf"))).alias("hi"))

    inside = F.filter(wanted(F.col("_n")), lambda x: (x["pos"] > 0) & (x["pos"] <= F.col("_n")))
    return s.select(*keys, F.transform(inside, around).alias("_t"))


def _by_weight(rows: DataFrame, keys: Sequence[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """The same from sums in logarithmic bins; a bracket spans the neighbours of its bin, and is open beyond the first and last."""
    bins = (rows.groupBy(*keys, log_bin(F.col("_v")).alias("_bin"))
            .agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))).alias("_bw"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    by_bin, whole = W.partitionBy(*keys).orderBy(F.col("_bin").asc_nulls_first()), W.partitionBy(*keys)
    cum = F.coalesce(F.sum("_bw").over(by_bin.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0.0))
    bins = (bins.withColumn("_cum", cum).withColumn("_total", F.coalesce(F.sum("_bw").over(whole), F.lit(0.0)))
            .withColumn("_first", F.coalesce(F.lag("_cum").over(by_bin), F.lit(0.0)))
            .withColumn("_below", F.coalesce(_clearly_below(F.lag("_lo").over(by_bin)), F.lit(float("-inf"))))
            .withColumn("_above", F.coalesce(_clearly_above(F.lead("_hi").over(by_bin)), F.lit(float("inf"))))
            .withColumn("_end", F.lead("_bin").over(by_bin).isNull()))
    here = F.filter(wanted(F.col("_total")), lambda x: (F.col("_bw") > 0) & (x["pos"] > F.col("_first")) & ((x["pos"] <= F.col("_cum")) | F.col("_end")))
    found = F.transform(here, lambda x: F.struct(x["name"].cast("string").alias("name"), x["pos"].alias("pos"), F.col("_below").alias("lo"), F.col("_above").alias("hi")))
    return bins.withColumn("_t", found).groupBy(*keys).agg(F.flatten(F.collect_list("_t")).alias("_t"))       # as many as targets


def locate(weights: DataFrame, keys: Sequence[str], order: str, weight: str | None,
           targets: Callable[[Column], Column], descending: bool = False, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Find, per group, the first value whose inclusive running weight reaches given targets.

    Rows without an order value carry no weight; without a ``weight`` column each row weighs 1. ``targets``
    maps the group's total weight to an array of structs (name, pos) with 0 < pos <= total. Rows with equal
    values count as one; ``carry`` aggregates further columns over them.

    Result: (keys, name as text, pos, order value, weight, carry, before, prev): ``before`` is the running
    weight ahead of the value and ``prev`` the order value ahead of it, NULL for the first. A
    group without weight yields one row with a NULL name.
    """
    carry = dict(carry or {})
    given = list(keys)
    keys = given or ["_all"]
    sign = -1.0 if descending else 1.0
    v = F.col(order).cast("double") * sign if descending else F.col(order).cast("double")
    rows = weights.withColumn("_v", v).withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    if not given:
        rows = rows.withColumn("_all", F.lit(0))

    def wanted(total: Column) -> Column:
        return F.transform(targets(total), lambda x: F.struct(x["name"].cast("string").alias("name"), x["pos"].cast("double").alias("pos")))

    summary = (_by_weight if weight else _by_number)(rows, keys, wanted)
    summary = summary.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_t")
    if set(keys) <= FEW | {"_all"}:
        summary = F.broadcast(summary)                     # a row per slice of fixed lists; other keys are left to AQE
    both = rows.join(summary, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]))
    t, v = F.col("_t"), F.col("_v")
    inside = F.coalesce(F.exists(t, lambda x: (v >= x["lo"]) & (v <= x["hi"])), F.lit(False))
    gap = F.array_max(F.transform(F.filter(t, lambda x: x["hi"] < v), lambda x: x["hi"]))
    cells = (both.withColumn("_outside", ~inside).withColumn("_at", F.when(inside, v).otherwise(gap))
             .groupBy(*keys, "_t", "_at", "_outside")
             .agg(F.sum(F.when(v.isNotNull(), F.col("_w"))).alias("_weight"), F.max("_v").alias("_edge"), *[c.alias(n) for n, c in carry.items()]))
    along = W.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_outside")
    cum = F.coalesce(F.sum("_weight").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0.0))
    cells = (cells.withColumn("_cum", cum).withColumn("before", F.coalesce(F.lag("_cum").over(along), F.lit(0.0)))
             .withColumn("prev", F.lag("_edge").over(along)).withColumn("_last", F.lead("_outside").over(along).isNull())
             .withColumn("_first", F.lag("_outside").over(along).isNull()))
    # at the end the total decides, whatever the last bits of a sum
    hit = F.filter(t, lambda x: (x["pos"] > F.col("before")) & ((x["pos"] <= F.col("_cum")) | F.col("_last")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("pos"),
                            F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")))
    found = cells.withColumn("_x", F.explode(F.when((F.size(t) == 0) & F.col("_first"), none).otherwise(hit)))
    missed = F.col("_outside") & F.col("_x.name").isNotNull()
    value = F.when(missed, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).when(F.col("_x.name").isNotNull(), F.col("_edge"))
    return found.select(*given, F.col("_x.name").alias("name"), F.col("_x.pos").alias("pos"), (value * sign).alias(order),
                        F.col("_weight").alias(weight or "n"), *carry, "before", (F.col("prev") * sign).alias("prev"))


def value_at_rank(df: DataFrame, keys: Sequence[str], value: str | Column, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Sorted values at 0-based ranks, one column per entry of ``ranks`` (functions of n).

    Groups without values stay in the result with NULL, and so do groups with NULL keys.
    """
    v = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    rows = df.select(*keys, v.cast("double").alias("_value"))

    def wanted(n: Column) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("name"), (r(n) + 1).cast("double").alias("pos"))
                         for k, r in ranks.items()])

    found = locate(rows, keys, "_value", None, wanted)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, F.col("_value"))).alias(k) for k in ranks])


def floor_rank(p: float) -> Callable[[Column], Column]:
    """The 0-based rank floor(p*(n-1)), kept inside the group."""
    return lambda n: F.greatest(F.lit(0.0), F.least(n - 1, F.floor(F.lit(p) * (n - 1)).cast("double")))


def percentile_bounds(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float) -> DataFrame:
    """sorted[floor(p*(n-1))] at both ends; groups with no values give (0, 1)."""
    at = value_at_rank(df, keys, value, {"vmin": floor_rank(lo), "vmax": floor_rank(hi)})
    return at.select(*keys, F.coalesce("vmin", F.lit(0.0)).alias("vmin"), F.coalesce("vmax", F.lit(1.0)).alias("vmax"))


def clamped_symmetric_range(df: DataFrame, keys: Sequence[str], value: str, hi: float) -> DataFrame:
    """+- the floor-index percentile of |v|; 1 where that is (almost) zero or absent."""
    at = value_at_rank(df, keys, F.abs(F.col(value)), {"a": floor_rank(hi)})
    a = F.when(F.col("a") >= 1e-12, F.col("a")).otherwise(F.lit(1.0))
    return at.select(*keys, (-a).alias("vmin"), a.alias("vmax"))


def sigma_floor(df: DataFrame, keys: Sequence[str], sigma: str, p: float = 0.02) -> DataFrame:
    """sorted positive sigma[floor(p*n)] (n, not n-1), 0 for groups without one."""
    positive = F.when(F.col(sigma) > 0, F.col(sigma))
    at = value_at_rank(df, keys, positive, {"f": lambda n: F.least(n - 1, F.floor(F.lit(p) * n).cast("double"))})
    return at.select(*keys, F.coalesce("f", F.lit(0.0)).alias("sigma_floor"))
