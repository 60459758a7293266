"""A field request and the DataFrame that answers it.

A request names a field, a vertical coordinate, a time selection and a view (decomposition,
reference, comparison). ``resolve`` composes the operators into one lazy DataFrame; choosing
references and fallbacks is plain Python on the request, never on data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.constants import PRESSURE_LEVELS, THETA_LEVELS
from zonalis.functions import fields as fx
from zonalis.grid import GridSpec
from zonalis.operators import composite, decompose, diagnostics, ranks, reduce, vertical
from zonalis.registry import CLIMO_WINDOWS, DEFAULT_PERIOD, FIELDS, SHEAR_LEVELS, Window30
from zonalis.sources import fields

@dataclass(frozen=True)
class FieldRequest:
    name: str = "t"
    month: int | None = 1                      # None: all twelve
    level: int | None = None
    coord: str = "pressure"                    # or "theta"
    theta: float = 330.0
    kind: str = "mean"                         # or "std"
    period: str = "default"
    year: int | None = None
    years: tuple[int, ...] | None = None       # explicit composite years
    span: tuple[int, int] | None = None        # contiguous composite range
    event: tuple[str, str, float, int] | None = None   # (index, ge|le, threshold, month)
    seasonal: bool = False
    mode: str = "total"                        # total, zonal, eddy, anomaly, zscore
    reference: str = "default"                 # a period, "best-match" or "default"
    sliding: bool = True
    compare_year: int | None = None
    compare_period: str | None = None
    user_min: float | None = None
    user_max: float | None = None
    all_levels: bool = False                   # every level of the axis, as sections need it

    @property
    def keys(self) -> list[str]:
        """What tells the values of an answer apart."""
        return ["month", *(["level"] if self.all_levels else []), "lat_idx", "lon_idx"]

    @property
    def meta(self):
        return FIELDS[self.name]

    @property
    def on_theta(self) -> bool:
        return self.meta.theta_only or (self.coord == "theta" and self.meta.kind == "pl")

    @property
    def composite(self) -> bool:
        return self.years is not None or self.span is not None or self.event is not None

    @property
    def comparing(self) -> bool:
        return self.compare_year is not None or self.compare_period is not None

    @property
    def effective_level(self) -> int | None:
        return None if self.meta.kind == "sl" or self.all_levels else (self.level or self.meta.default_level)

    def validate(self) -> FieldRequest:
        if self.name not in FIELDS:
            raise ValueError(f"unknown field {self.name}")
        if self.month is not None and not 1 <= self.month <= 12:
            raise ValueError("month must be 1..12")
        if self.kind not in ("mean", "std") or self.mode not in decompose.MODES:
            raise ValueError("unknown kind or mode")
        if self.all_levels and (self.on_theta or self.meta.kind == "sl" or self.name == "dls"):
            raise ValueError("only fields on pressure levels have all levels")
        return self


@dataclass(frozen=True)
class FieldStore:
    """Long monthly fields (var, level, year, month, cell, value) in display units, and what was made of them before.

    ``climatology`` is a tree of (period, kind, var, level) folders and ``tiles`` lists those it has. A
    request takes the climatology, sigma or reference it needs from there if all its folders exist,
    and else aggregates the yearly fields; either way the rows are the same.
    """

    monthly: DataFrame
    spec: GridSpec
    active: str = DEFAULT_PERIOD
    windows: tuple[Window30, ...] = CLIMO_WINDOWS
    #: Variables with a sigma, as the catalogue lists them; None: derived from the yearly fields, so all.
    sigmas: frozenset[str] | None = None
    climatology: DataFrame | None = None
    tiles: frozenset[tuple[str, str, str, int]] = frozenset()
    #: Years with fields, as the folders say; None: not known without reading.
    years: frozenset[int] | None = None
    #: Monthly indices (id, year, month, value) for composites by event.
    index: DataFrame | None = None

    def period_name(self, period: str) -> str:
        return "{}-{}".format(*self.period_years(period))

    def period_years(self, period: str) -> tuple[int, int]:
        """``default`` stands for the active period; a literal period is itself."""
        a, b = (self.active if period == "default" else period).split("-")
        return int(a), int(b)

    def best_window(self, year: int) -> str:
        return min(self.windows, key=lambda w: (abs(year - w.center), -w.center)).id


def open_store(spark: SparkSession, root: str, spec: GridSpec, active: str = DEFAULT_PERIOD, windows: tuple[Window30, ...] = CLIMO_WINDOWS,
               index: DataFrame | None = None) -> FieldStore:
    """The store of a folder with a ``per_year`` and, if there is one, a ``climatology`` tree. Only folder names are read."""
    tiles = fields.stored_tiles(spark, root)
    clim = spark.read.schema(fields.CLIMATOLOGY_SCHEMA).parquet(f"{root}/climatology") if tiles else None
    return FieldStore(spark.read.schema(fields.MONTHLY_SCHEMA).parquet(f"{root}/per_year"), spec, active, windows, climatology=clim, tiles=tiles,
                      years=fields.stored_years(spark, root), index=index)


# what a request needs ---------------------------------------------------------------------
def ingredients(req: FieldRequest, spec: GridSpec) -> list[tuple[str, int | None]]:
    """(variable, level) partitions the request reads."""
    names = req.meta.ingredients or (req.name,)
    if req.name == "dls":
        return [(n, lev) for n in names for lev in SHEAR_LEVELS]
    if req.on_theta:
        return [(n, lev) for n in dict.fromkeys((*names, "t")) for lev in spec.levels]
    return [(n, req.effective_level) for n in names]


def kind_available(store: FieldStore, req: FieldRequest) -> bool:
    """Sigma exists for the fields whose catalogue entry says so on pressure, never on theta."""
    return req.kind == "mean" or (not req.on_theta and (store.sigmas is None or req.name in store.sigmas))


def effective_kind(store: FieldStore, req: FieldRequest) -> str:
    if req.kind == "std" and (not kind_available(store, req) or req.year is not None or req.composite):
        return "mean"
    return req.kind


def effective_mode(store: FieldStore, req: FieldRequest) -> str:
    """Sigma is only ever shown plain or as a difference to another period's; comparing with a
    climatology cancels the anomaly view; theta has no sigma to standardize with."""
    if effective_kind(store, req) == "std":
        other = req.reference not in ("default", store.active)
        return "anomaly" if other and not req.comparing else "total"
    if req.comparing and req.mode == "anomaly" and req.compare_year is None:
        return "total"
    if req.mode == "zscore" and req.on_theta:
        return "anomaly"
    return req.mode


def expected_inputs(store: FieldStore, req: FieldRequest) -> list[tuple[str, str, int | None, str]]:
    """Everything a view waits for: (role, variable, level, kind) of its own field, its sigma, the
    reference of an anomaly, and the field it is compared with."""
    kind, mode = effective_kind(store, req), effective_mode(store, req)
    need = [("field", n, level, kind) for n, level in ingredients(req, store.spec)]
    if mode in ("anomaly", "zscore"):
        need += [("reference", n, level, kind) for n, level in ingredients(req, store.spec)]
    if mode == "zscore":
        need += [("sigma", req.name, req.effective_level, "std")]
    if req.comparing:
        need += [("target", n, level, "mean" if req.compare_year is not None else kind) for n, level in ingredients(req, store.spec)]
    return list(dict.fromkeys(need))


def resolve_with_flags(store: FieldStore, req: FieldRequest) -> DataFrame:
    """The answer with what it fell back to: ``kind`` shown, ``sigma_unavailable`` where a sigma was
    asked for and the mean is shown, ``reference_empty`` per month without any reference value."""
    out = (resolve(store, req).withColumn("kind", F.lit(effective_kind(store, req)))
           .withColumn("sigma_unavailable", F.lit(req.kind == "std" and not kind_available(store, req))))
    if effective_mode(store, req) not in ("anomaly", "zscore"):
        return out.withColumn("reference_empty", F.lit(False))
    there = (reference_field(store, req).groupBy("month").agg(F.count("value").alias("_n")).where("_n > 0").select("month", F.lit(True).alias("_there")))
    return out.join(there, "month", "left").withColumn("reference_empty", F.col("_there").isNull()).drop("_there")


# evaluation ---------------------------------------------------------------------------------
INPUT_KEYS = ["year", "month", "level", "lat_idx", "lon_idx"]


def _rows(store: FieldStore, req: FieldRequest) -> tuple[DataFrame, list[str]]:
    """The long rows a request reads (partition pruning on var, level and month) and their fields."""
    need = ingredients(req, store.spec)
    names = list(dict.fromkeys(n for n, _ in need))
    levels = {lev for _, lev in need if lev is not None}
    rows = store.monthly.where(F.col("var").isin(*names))
    if levels:
        rows = rows.where(F.col("level").isin(*levels))
    months = _months(req)
    return (rows.where(F.col("month").isin(*months)) if months else rows), names


def _inputs(store: FieldStore, req: FieldRequest) -> DataFrame:
    """Ingredient columns per (year, month, level, cell). One field is renamed, not shuffled."""
    rows, names = _rows(store, req)
    if len(names) == 1:
        return rows.select(*INPUT_KEYS, F.col("value").alias(names[0]))
    return vertical.fields_to_columns(rows, INPUT_KEYS, names)


def _stored(store: FieldStore, periods: Sequence[str], kind: str, need: Sequence[tuple[str, int | None]], months: Sequence[int] | None) -> DataFrame | None:
    """Rows of the climatology tree that hold all of ``need`` for all periods; None if a folder is missing.

    Every filter but that of the month names folders, so nothing else is listed or read.
    """
    wanted = [(n, lev) for n, level in need
              for lev in (store.spec.levels if level is None and FIELDS[n].kind == "pl" else [fields.SURFACE_LEVEL if level is None else level])]
    if store.climatology is None or not {(p, kind, n, lev) for p in periods for n, lev in wanted} <= store.tiles:
        return None
    rows = store.climatology.where(F.col("period").isin(*periods) & (F.col("kind") == kind) & F.col("var").isin(*{n for n, _ in wanted})
                                   & F.col("level").isin(*{lev for _, lev in wanted}))
    return rows.where(F.col("month").isin(*months)) if months else rows


def _mean_inputs(store: FieldStore, req: FieldRequest) -> DataFrame:
    """Climatological ingredient columns per (month, level, cell): as stored, else by one aggregation of the long rows."""
    rows = _stored(store, [store.period_name(req.period)], "mean", ingredients(req, store.spec), _months(req))
    if rows is not None:
        names = list(dict.fromkeys(n for n, _ in ingredients(req, store.spec)))
        keys = ["month", *INPUT_KEYS[2:]]
        return rows.select(*keys, F.col("value").alias(names[0])) if len(names) == 1 else vertical.fields_to_columns(rows, keys, names)
    rows, names = _rows(store, req)
    rows = rows.where(F.col("year").between(*store.period_years(req.period)))
    return rows.groupBy("month", *INPUT_KEYS[2:]).agg(*[F.avg(F.when(F.col("var") == n, F.col("value"))).alias(n) for n in names])


#: Fields that are made of others at one point; the columns come in the order of the registry's ingredients.
BUILDERS: dict[str, Callable[..., Column]] = {"wspd": fx.wind_speed, "mse": fx.mse_kelvin}


def _evaluate(df: DataFrame, keys: Sequence[str], req: FieldRequest, spec: GridSpec) -> DataFrame:
    """Ingredient columns to (keys, value)."""
    names = list(req.meta.ingredients or (req.name,))
    keys = list(keys)
    if req.name == "dls":
        top, bottom = SHEAR_LEVELS
        w = vertical.levels_to_columns(df, keys, {"ut": ("u", top), "vt": ("v", top), "ub": ("u", bottom), "vb": ("v", bottom)})
        return w.select(*keys, fx.shear(*[F.col(c) for c in ("ut", "vt", "ub", "vb")]).alias("value"))
    if req.on_theta:
        on = df if "t" not in names else df.withColumn("_t", F.col("t"))
        df = vertical.on_isentrope(on, keys, names, req.theta, spec, "_t" if "t" in names else "t")
    build = BUILDERS.get(req.name)
    value = build(*[F.col(n) for n in req.meta.ingredients]) if build else F.col(req.name)
    return df.select(*keys, value.alias("value"))


def _years_of(store: FieldStore, req: FieldRequest) -> DataFrame:
    """The years of a composite, one row each. Those of an event are found when the query runs, and as a semi-join on the
    folder column they prune the folders that are read."""
    spark = store.monthly.sparkSession
    if req.event and store.index is not None:
        i, cmp, threshold, month = req.event
        years = composite.event_years(store.index, i, month, cmp, threshold)
        if store.years is not None:
            return years.where(F.col("year").isin(*store.years))
        return composite.split_available(years, store.monthly)[0]
    return composite.requested_years(spark, req.years, *(req.span or (None, None)))


def _months(req: FieldRequest) -> list[int] | None:
    if req.month is None:
        return None
    m = req.month
    return [(m + 10) % 12 + 1, m, m % 12 + 1] if req.seasonal else [m]


def base_field(store: FieldStore, req: FieldRequest) -> DataFrame:
    """(month, lat_idx, lon_idx, value) before any decomposition.

    Single years and composites evaluate each year and then average; a climatology averages
    its ingredients first and evaluates once; sigma evaluates each year and takes the spread.
    """
    by_year = ["year", *req.keys]
    if not (req.year is not None or req.composite or effective_kind(store, req) == "std"):
        out = _evaluate(_mean_inputs(store, req), req.keys, req, store.spec)
        return _centred(out, req)
    if req.year is None and not req.composite:             # a sigma; that of a derived field cannot be made from its ingredients'
        rows = _stored(store, [store.period_name(req.period)], "std", [(req.name, req.effective_level)], _months(req))
        if rows is not None:
            return _centred(rows.select(*req.keys, "value"), req)
    df = _inputs(store, req)
    if req.year is not None:
        out = _evaluate(df.where(F.col("year") == req.year), by_year, req, store.spec).drop("year")
    elif req.composite:
        df = df.join(F.broadcast(_years_of(store, req)), "year", "left_semi")      # calendar years: a short list
        out = reduce.climatology(_evaluate(df, by_year, req, store.spec), ["value"], req.keys[1:])
    else:
        yearly = _evaluate(df.where(F.col("year").between(*store.period_years(req.period))), by_year, req, store.spec)
        out = yearly.groupBy(*req.keys).agg(F.stddev_pop("value").alias("value"))
    return _centred(out, req)


def _centred(out: DataFrame, req: FieldRequest) -> DataFrame:
    """The seasonal mean where asked for, and the month of the request."""
    if req.seasonal:
        out = reduce.seasonal_mean(out, ["value"], req.keys[1:])
    return out if req.month is None else out.where(F.col("month") == req.month)


def _plain(req: FieldRequest, **change) -> FieldRequest:
    return replace(req, year=None, years=None, span=None, mode="total", compare_year=None, compare_period=None,
                   **{"kind": "mean", "period": "default", **change})


def reference_field(store: FieldStore, req: FieldRequest) -> DataFrame:
    """What an anomaly is taken from: (month, cell, value)."""
    ref = req.reference
    explicit = ref not in ("default", "best-match", store.active)
    timed = req.year is not None or req.composite
    sliding = (req.sliding and (req.years is not None or req.event is not None) and req.year is None and not req.on_theta
               and ref in ("default", "best-match"))
    if sliding:
        return _sliding(store, req)
    if timed:
        period = "default"
        if ref == "best-match" and req.year is not None:
            period = store.best_window(req.year)
        elif explicit:
            period = ref
        return base_field(store, _plain(req, period=period))
    if explicit and (req.on_theta or not req.meta.derived):
        return base_field(store, _plain(req, period=ref, kind=effective_kind(store, req)))
    months = base_field(store, _plain(req, month=None, period=req.period))
    mean = reduce.mean_by(months, req.keys[1:], ["value"])
    wanted = [req.month] if req.month is not None else range(1, 13)
    return mean.withColumn("month", F.explode(F.array(*[F.lit(m) for m in wanted])))


def _sliding(store: FieldStore, req: FieldRequest) -> DataFrame:
    """Event-weighted climatology; months in which a needed window has no field at all use the
    fixed climatology instead."""
    w = store.windows
    weights = composite.window_weights(composite.best_window(_years_of(store, req), w))
    months = _months(req)
    need = ingredients(req, store.spec)
    names = list(dict.fromkeys(n for n, _ in need))
    rows = _stored(store, [x.id for x in w], "mean", need, months)
    if rows is not None:
        rows, keys = rows.withColumnRenamed("period", "window_id"), ["window_id", "month", *INPUT_KEYS[2:]]
        clims = rows.select(*keys, F.col("value").alias(names[0])) if len(names) == 1 else vertical.fields_to_columns(rows, keys, names)
    else:
        clims = composite.window_climatologies(_inputs(store, req), w, names)
    values = _evaluate(clims, ["window_id", *req.keys], req, store.spec)
    usable = (values.select("window_id", "month").distinct().join(weights, "window_id").groupBy("month")
              .agg(F.count("*").alias("n_have"), F.max("n_windows").alias("n_need")).where("n_have = n_need"))
    fixed = base_field(store, _plain(req, month=None, seasonal=False))
    if months:
        fixed = fixed.where(F.col("month").isin(*months))
    out = (composite.sliding_reference(values, weights, ["value"], req.keys[1:]).join(usable, "month", "left_semi")
           .unionByName(fixed.select(*req.keys, "value").join(usable, "month", "left_anti")))
    return _centred(out, req)


def _one_period(store: FieldStore, req: FieldRequest, period: str) -> bool:
    """Whether mean and sigma of a standardized anomaly are of the same raw field and period and neither is stored."""
    timed = req.year is not None or req.span is not None
    raw = not req.meta.ingredients and not req.on_theta and not req.seasonal
    best = req.reference == "best-match" and req.year is not None
    return timed and raw and not best and not any(t[0] == store.period_name(period) and t[2] == req.name for t in store.tiles)


def _mean_and_sigma(store: FieldStore, req: FieldRequest, period: str) -> DataFrame:
    """Both in one aggregation of the long rows."""
    rows, _ = _rows(store, req)
    rows = rows.where(F.col("year").between(*store.period_years(period)))
    return rows.groupBy(*req.keys).agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("sigma"))


def _decomposed(store: FieldStore, req: FieldRequest, baseline: DataFrame | None = None) -> DataFrame:
    mode = effective_mode(store, req)
    df = base_field(store, req)
    if mode in ("zonal", "eddy"):
        return decompose.decompose(df, mode, "value", req.keys[:-1], req.keys)
    if mode in ("anomaly", "zscore"):
        period = req.reference if req.reference not in ("default", "best-match") else "default"
        if mode == "zscore" and baseline is None and _one_period(store, req, period):
            return decompose.zscore(df, _mean_and_sigma(store, req, period), req.keys, req.keys[:-2], "value", "sigma")
        ref = baseline if baseline is not None else reference_field(store, req)
        if mode == "anomaly":
            return decompose.anomaly(df, ref, req.keys, "value")
        sd = base_field(store, _plain(req, kind="std", period=period)).withColumnRenamed("value", "sigma")
        both = ref.join(sd, req.keys, "outer")
        return decompose.zscore(df, both, req.keys, req.keys[:-2], "value", "sigma")
    return df


def resolve(store: FieldStore, req: FieldRequest) -> DataFrame:
    """(month, lat_idx, lon_idx, value) of a request; a comparison gives active minus target."""
    req.validate()
    left = _decomposed(store, req)
    if not req.comparing:
        return left
    return decompose.anomaly(left, _other_side(store, req), req.keys, "value")


def _other_side(store: FieldStore, req: FieldRequest) -> DataFrame:
    """What a comparison is with, in the same view."""
    target = replace(req, compare_year=None, compare_period=None, year=req.compare_year, years=None, span=None, event=None,
                     period=req.compare_period or "default", mode=effective_mode(store, req))
    if target.year is not None:
        target = replace(target, kind="mean")
    own = req.reference == "best-match" and target.year is not None
    shared = reference_field(store, req) if target.mode == "anomaly" and not own else None
    return _decomposed(store, target, shared)


def resolve_sides(store: FieldStore, req: FieldRequest) -> DataFrame:
    """Both fields of a comparison, side by side: (side, month, cell, value) with side ``active`` or ``target``."""
    req.validate()
    if not req.comparing:
        raise ValueError("two sides need a year or a period to compare with")
    sides = [df.select(F.lit(name).alias("side"), *req.keys, "value")
             for name, df in (("active", _decomposed(store, req)), ("target", _other_side(store, req)))]
    return sides[0].unionByName(sides[1])


def sides_range(store: FieldStore, req: FieldRequest, rows: DataFrame) -> DataFrame:
    """One (vmin, vmax) row for both sides: the range of each side and month in one aggregation, then pooled."""
    return _pooled_range(store, req, rows, ["side", "month"], effective_mode(store, req) in ("eddy", "anomaly", "zscore"))


def display_range(store: FieldStore, req: FieldRequest, df: DataFrame) -> DataFrame:
    """One (vmin, vmax) row: per-month ranges, clamped by percentile where the field asks for
    it, pooled over the months of ``df``; a user bound wins over both."""
    centred = effective_mode(store, req) in ("eddy", "anomaly", "zscore") or req.comparing
    return _pooled_range(store, req, df, ["month"], centred)


def _pooled_range(store: FieldStore, req: FieldRequest, df: DataFrame, by: Sequence[str], centred: bool) -> DataFrame:
    mode, clamp = effective_mode(store, req), req.meta.clamp
    if mode == "zscore" and not req.comparing:
        out = df.sparkSession.range(1).select(F.lit(-5.0).alias("vmin"), F.lit(5.0).alias("vmax"))
    elif centred:
        each = (ranks.clamped_symmetric_range(df, by, "value", clamp[1]) if clamp else reduce.symmetric_range(df, by, "value"))
        out = reduce.pooled_range(each, [], True)
    else:
        each = ranks.percentile_bounds(df, by, "value", *clamp) if clamp else reduce.value_range(df, by, "value")
        symmetric = req.meta.symmetric and effective_kind(store, req) != "std"
        out = reduce.pooled_range(each, [], symmetric)
        if req.name == "pv" and req.on_theta:
            _, lo, hi, *_ = diagnostics.DISPLAY_LIMITS["pv"]
            out = out.select(F.greatest("vmin", F.lit(lo)).alias("vmin"), F.least("vmax", F.lit(hi)).alias("vmax"))
    return out.select(F.coalesce(F.lit(req.user_min).cast("double"), "vmin").alias("vmin"),
                      F.coalesce(F.lit(req.user_max).cast("double"), "vmax").alias("vmax"))


def reference_choices(store: FieldStore, req: FieldRequest) -> list[tuple[str, str, bool]]:
    """(reference, text, offered) of every reference a view may be set against; none where the view uses none.

    The default means the field's own twelve months for a climatology and the active climatology for a year; the active
    period itself would be subtracted from itself and is not offered.
    """
    used = req.mode in ("anomaly", "zscore") or (req.comparing and req.compare_year is None) or req.kind == "std"
    if not used:
        return []
    active = store.period_name("default")
    own = f"vs. {active.replace('-', '–')} mean (current climatology)" if req.year is not None else "Self · 12-month mean"
    periods = list(dict.fromkeys([active, *[w.id for w in store.windows]]))
    return [("default", own, True), ("best-match", "Best-matching 30 years", req.year is not None or req.composite),
            *[(p, f"vs. {p.replace('-', '–')}", p != active) for p in periods]]


def wind_request(req: FieldRequest) -> tuple[FieldRequest, FieldRequest]:
    """The wind drawn over a field: 10-m winds for surface fields, else its own surface."""
    u, v = ("u10", "v10") if req.meta.kind == "sl" else ("u", "v")
    return tuple(FieldRequest(n, req.month, req.level, req.coord, req.theta) for n in (u, v))


# text form -----------------------------------------------------------------------------------
def _enum(*allowed):
    return lambda s: s if s in allowed else None


def _number(lo: float | None = None, hi: float | None = None, cast=float, among: Sequence | None = None):
    def read(s: str):
        try:
            x = cast(s)
        except ValueError:
            return None
        ok = (lo is None or x >= lo) and (hi is None or x <= hi) and (among is None or x in among)
        return x if ok else None
    return read


def _read_selection(s: str) -> dict:
    """``YYYY-YYYY`` or ``c:<index>:<ge|le>:<threshold>:<month>``."""
    p = s.split(":")
    if p[0] == "c" and len(p) == 5 and p[2] in ("ge", "le"):
        t, m = _number()(p[3]), _number(1, 12, int)(p[4])
        return {} if t is None or m is None else {"event": (p[1], p[2], t, m), "years": ()}
    ends = s.split("-")
    if len(ends) == 2 and all(len(e) == 4 and e.isdigit() for e in ends):
        a, b = int(ends[0]), int(ends[1])
        return {"span": (a, b)} if 1900 <= a <= b <= 2100 else {}
    return {}


# The short keys of the text form. (attribute, key, reader)
TEXT_KEYS = (
    ("name", "f", _enum(*FIELDS)), ("level", "L", _number(cast=int, among=PRESSURE_LEVELS)),
    ("theta", "th", _number(among=THETA_LEVELS)), ("month", "m", _number(1, 12, int)), ("year", "y", _number(cast=int)),
    ("period", "cp", str), ("reference", "rp", str), ("mode", "d", _enum(*decompose.MODES)),
    ("compare_year", "cy", _number(cast=int)), ("user_min", "cbmin", _number()), ("user_max", "cbmax", _number()),
)
# Attributes written as codes. (attribute, key, {value: code})
TEXT_CODES = (("coord", "vc", {"theta": "t", "pressure": "p"}), ("kind", "k", {"std": "s", "mean": "m"}),
              ("seasonal", "sn", {True: "1", False: "0"}), ("sliding", "sc", {True: "1", False: "0"}))


def encode(req: FieldRequest) -> str:
    """Compact text of a request; values equal to the defaults are left out."""
    base, out = FieldRequest(), {}
    for attr, key, _ in TEXT_KEYS:
        v = getattr(req, attr)
        if v is not None and v != getattr(base, attr):
            out[key] = f"{v:g}" if isinstance(v, float) else str(v)
    for attr, key, codes in TEXT_CODES:
        if getattr(req, attr) != getattr(base, attr):
            out[key] = codes[getattr(req, attr)]
    if req.event:
        i, cmp, t, m = req.event
        out["cr"] = f"c:{i}:{cmp}:{t:g}:{m}"
    elif req.span:
        out["cr"] = f"{req.span[0]}-{req.span[1]}"
    return urlencode(out)


def decode(text: str) -> FieldRequest:
    """The reverse; unknown keys and malformed values are dropped."""
    given = dict(parse_qsl(text.lstrip("#")))
    change: dict = {}
    for attr, key, read in TEXT_KEYS:
        if key in given and (v := read(given[key])) is not None:
            change[attr] = v
    for attr, key, codes in TEXT_CODES:
        for v, code in codes.items():
            if given.get(key) == code:
                change[attr] = v
    if "cr" in given:
        change.update(_read_selection(given["cr"]))
    return FieldRequest(**change)
