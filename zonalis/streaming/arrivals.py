"""Fields that arrive over time: incremental climatologies, readiness and refresh.

State and outputs are bounded by the grid (cells x months x years), not by the number of arrivals: every
batch is merged into the partitions it touches. State lives in versioned trees (``versions.py``): a batch lost
half-way leaves the state before it whole, and its replay gives the same state as if it had not been lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import StreamingQueryProgress
from pyspark.sql.types import StructType

from zonalis.session import ship_package
from zonalis.sources import fields as store
from zonalis.streaming.versions import CommitLog, VersionedTree

SLICE = ["var", "level", "month"]
CELL_KEY = ["var", "grp", "level", "year", "month", "lat_idx", "lon_idx"]


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files landing in a folder, oldest first. Writers must move finished
    files in (a file is read once, when it is first seen)."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


@contextmanager
def _settings(spark: SparkSession, changes: dict[str, str | int | None]) -> Iterator[None]:
    """Settings of the queries started inside (a query keeps those it was started with); None leaves one as it is."""
    changes = {k: str(v) for k, v in changes.items() if v is not None}
    kept = {k: spark.conf.get(k, None) for k in changes}
    try:
        for k, v in changes.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in kept.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def upsert_batches(df: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], interval: str | None = None,
                   parts: Sequence[str] = (), state_tasks: int | None = None) -> StreamingQuery:
    """Keep the newest row of every key. ``parts`` (some of the keys) partition the state: a batch reads and writes
    the partitions it touches. ``state_tasks``: tasks of each shuffle of a batch, for a state of known size (a checkpoint
    keeps its number); None: as the session has it. Read the state with ``latest_rows``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        tree = VersionedTree(batch.sparkSession, folder, parts)
        with tree.log.batch(checkpoint, batch_id) as new:
            touched = tree.touched(batch) if new else []
            if not touched:
                return
            rest = [c for c in batch.columns if c not in keys]
            both = batch.withColumn("_new", F.lit(1))
            before = tree.read(touched, batch.schema)
            if before is not None:
                both = both.unionByName(before.withColumn("_new", F.lit(0)))
            merged = (both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_r"))
                      .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))
            tree.write(merged, new, touched)

    with _settings(df.sparkSession, {SHUFFLE_TASKS: state_tasks}):
        return _start(df.writeStream.outputMode("update").foreachBatch(write), checkpoint, interval)


def latest_rows(spark: SparkSession, folder: str, parts: Sequence[str] = ()) -> DataFrame:
    """The committed state."""
    rows = VersionedTree(spark, folder, parts).read(None)
    if rows is None:
        raise FileNotFoundError(f"no committed state in {folder}")
    return rows


def progressive_mean(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Running sum and count per key: use whatever has arrived, sharpen later."""
    return stream.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def mean_of(latest: DataFrame, value: str) -> DataFrame:
    return latest.withColumn(value, F.col("total") / F.nullif(F.col("n").cast("double"), F.lit(0.0))).drop("total", "n")


def ready_slices(stream: DataFrame, expected_years: Sequence[int]) -> DataFrame:
    """(var, level, month, n_years, ready): ready once every expected year has arrived.

    The state of a slice is a set of at most ``len(expected_years)`` years.
    """
    years = [int(y) for y in expected_years]
    seen = stream.where(F.col("year").isin(*years)).groupBy(*SLICE).agg(F.collect_set("year").alias("_y"))
    n = F.size("_y")
    return seen.select(*SLICE, n.alias("n_years"), (n == len(years)).alias("ready"))


def keep_climatology_fresh(stream: DataFrame, root: str, start: int, end: int, checkpoint: str,
                           interval: str | None = None) -> StreamingQuery:
    """Keep the climatology of a period up to date with what arrives.

    A field delivered twice counts once, its latest delivery (``delivered``, a time, if the stream has it; else, within
    one batch, the greatest value). Two versioned trees hold the state under one log: ``landed``, the rows of each
    (variable, level, year), and ``moments``, the count, mean and sum of squared departures of each cell and month. A
    batch reads and writes the years it touches and the moments of its variables and levels, whatever the history holds:
    the moments of the rows it replaces are taken out, those of the new rows put in. A surface field has level 0.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, f"{root}/_log")
        landed = VersionedTree(spark, f"{root}/landed", ["var", "level", "year"], log)
        moments = VersionedTree(spark, f"{root}/moments", ["var", "level"], log)
        with log.batch(checkpoint, batch_id) as new:
            rows = batch.withColumn("level", F.coalesce("level", F.lit(store.SURFACE_LEVEL)))
            touched = landed.touched(rows) if new else []
            if not touched:
                return
            fields = list(dict.fromkeys(t[:2] for t in touched))
            old = landed.read(touched, LANDED)
            landed.write(_newest(rows, old), new, touched, _band())
            now = landed.read(touched, LANDED, new.version)
            moments.write(_moved(moments.read(fields, MOMENTS), old, now, start, end), new, fields, _band())
            store.write_climatology(climatology_of(moments.read(fields, MOMENTS, new.version), start, end), root)

    return _start(stream.writeStream.foreachBatch(step), checkpoint, interval)


#: A month of a cell of a field; the moments of a month of a cell over the years.
LANDED = "var string, grp string, level int, year int, month int, lat_idx int, lon_idx int, value double"
MOMENTS = "var string, grp string, level int, month int, lat_idx int, lon_idx int, n long, mean double, squares double"
MOMENT_KEY = ["var", "grp", "level", "month", "lat_idx", "lon_idx"]
#: Rows of a grid that one task writes.
BAND = 64


def _band() -> Column:
    return F.floor(F.col("lat_idx") / BAND)


def _newest(arrived: DataFrame, old: DataFrame | None) -> DataFrame:
    """One value per cell and time: what arrived last, before what had landed."""
    def ranked(rows: DataFrame, new: int, delivered: Column) -> DataFrame:
        order = F.struct(F.lit(new).alias("new"), delivered.cast("timestamp").alias("delivered"), F.col("value"))
        return rows.select(*CELL_KEY, "value", order.alias("_order"))

    when = F.col("delivered") if "delivered" in arrived.columns else F.lit(None)
    both = ranked(arrived, 1, when)
    if old is not None:
        both = both.unionByName(ranked(old, 0, F.lit(None)))
    return both.groupBy(*CELL_KEY).agg(F.max_by("value", "_order").alias("value"))


Moments = tuple[Column, Column, Column]


def together(a: Moments, b: Moments) -> Moments:
    """(n, mean, squares) of two sets of values."""
    n = a[0] + b[0]
    shift, share = b[1] - a[1], b[0] / F.greatest(n, F.lit(1))
    return n, a[1] + shift * share, a[2] + b[2] + shift * shift * a[0] * share


def without(a: Moments, b: Moments) -> Moments:
    """(n, mean, squares) of the values of ``a`` that are left when those of ``b`` are taken out."""
    n = a[0] - b[0]
    mean = (a[1] * a[0] - b[1] * b[0]) / F.greatest(n, F.lit(1))
    shift = b[1] - mean
    squares = a[2] - b[2] - shift * shift * n * b[0] / F.greatest(a[0], F.lit(1))
    return n, F.when(n > 0, mean).otherwise(F.lit(0.0)), F.when(n > 0, F.greatest(F.lit(0.0), squares)).otherwise(F.lit(0.0))


def _moved(state: DataFrame | None, old: DataFrame | None, now: DataFrame, start: int, end: int) -> DataFrame:
    """The moments after the rows ``old`` gave way to ``now``: one aggregation over the touched years and the state."""
    names, types = ("n", "mean", "squares"), ("long", "double", "double")

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.where(F.col("year").between(start, end)).select(
            *MOMENT_KEY, F.lit(kind).alias("_kind"), "value", *[F.lit(None).cast(t).alias(n) for n, t in zip(names, types)])

    parts = [rows(df, kind) for kind, df in (("old", old), ("now", now)) if df is not None]
    if state is not None:
        parts.append(state.select(*MOMENT_KEY, F.lit("state").alias("_kind"), F.lit(None).cast("double").alias("value"), *names))

    def of(kind: str) -> list[Column]:
        v = F.when(F.col("_kind") == kind, F.col("value"))
        return [F.count(v).alias(f"{kind}_n"), F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{kind}_mean"),
                F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias(f"{kind}_squares")]

    def columns(kind: str) -> Moments:
        return tuple(F.col(f"{kind}_{n}") for n in names)

    sums = reduce(DataFrame.unionByName, parts).groupBy(*MOMENT_KEY).agg(
        *of("old"), *of("now"), *[F.coalesce(F.max(n), F.lit(0).cast(t)).alias(f"state_{n}") for n, t in zip(names, types)])
    left = sums.select(*MOMENT_KEY, *columns("now"), *[c.alias(f"left_{n}") for n, c in zip(names, without(columns("state"), columns("old")))])
    return left.select(*MOMENT_KEY, *[c.alias(n) for n, c in zip(names, together(columns("left"), columns("now")))])


def climatology_of(moments: DataFrame, start: int, end: int) -> DataFrame:
    """Mean and sigma rows from moments."""
    n = F.nullif(F.col("n"), F.lit(0).cast("long"))
    kinds = F.array(F.struct(F.lit("mean").alias("kind"), F.when(F.col("n") > 0, F.col("mean")).alias("value")),
                    F.struct(F.lit("std").alias("kind"), F.sqrt(F.col("squares") / n).alias("value")))
    return (moments.withColumn("_k", F.explode(kinds))
            .select(F.lit(f"{start}-{end}").alias("period"), "_k.kind", "var", "grp", "level", "lat_idx", "lon_idx", "month", "_k.value"))


class OnceComplete(StatefulProcessor):
    """Emits a slice when its last expected year arrives, and forgets it."""

    def __init__(self, years: frozenset[int]):
        self.years = years

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("years", "years array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = set(self.seen.get()[0]) if self.seen.exists() else set()
        seen |= {r["year"] for r in rows} & self.years
        if seen == self.years:
            self.seen.clear()
            yield Row(var=key[0], level=key[1], month=key[2], n_years=len(seen))
        elif seen:
            self.seen.update((sorted(seen),))

    def close(self) -> None:
        pass


def emit_ready(stream: DataFrame, expected_years: Sequence[int], folder: str, checkpoint: str, interval: str | None = None,
               state_tasks: int | None = None) -> StreamingQuery:
    """Append (var, level, month, n_years) of each slice to a folder, once, when all expected years have arrived.

    State holds incomplete slices only, each at most the list of its years. A surface field has level 0. A slice that is
    delivered anew after it was complete counts its years from the start. ``state_tasks`` as in ``upsert_batches``.
    """
    spark = stream.sparkSession
    ship_package(spark)
    wanted = frozenset(int(y) for y in expected_years)
    rows = (stream.where(F.col("year").isin(*wanted)).withColumn("level", F.coalesce("level", F.lit(store.SURFACE_LEVEL)))
            .select(*SLICE, "year").groupBy(*SLICE)
            .transformWithState(OnceComplete(wanted), "var string, level int, month int, n_years int", "append", "none"))
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with _settings(spark, {STATE_STORE: rocks, SHUFFLE_TASKS: state_tasks}):
        return _start(rows.writeStream.outputMode("append").format("parquet").option("path", folder), checkpoint, interval)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SHUFFLE_TASKS = "spark.sql.shuffle.partitions"
TILE = ["var", "level", "year", "month"]


def observed(stream: DataFrame, name: str = "arrived") -> DataFrame:
    """The same stream; each batch also tells which tiles it held (a handful of keys per file)."""
    key = F.struct("var", F.coalesce("level", F.lit(store.SURFACE_LEVEL)).alias("level"), "year", "month")
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.collect_set(key).alias("tiles"))


class PendingInputs(StreamingQueryListener):
    """How many of the expected tiles (var, level, year, month) are still to arrive, over the session's ``observed`` streams."""

    def __init__(self, expected: Iterable[tuple], name: str = "arrived") -> None:
        self.missing = {(v, store.SURFACE_LEVEL if lev is None else lev, y, m) for v, lev, y, m in expected}
        self.total, self.name = len(self.missing), name
        self.rows = 0

    @property
    def pending(self) -> int:
        return len(self.missing)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.see(event.progress)

    def see(self, progress: StreamingQueryProgress) -> None:
        seen = progress.observedMetrics.get(self.name)
        if seen is not None:
            self.rows += seen["rows"]
            self.missing -= {tuple(t[k] for k in TILE) for t in seen["tiles"]}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class ArrivalProgress(StreamingQueryListener):
    """Counts batches and rows of the session's streams."""

    def __init__(self) -> None:
        self.batches = 0
        self.rows = 0
        self.running = 0

    def onQueryStarted(self, event) -> None:
        self.running += 1

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running -= 1
