"""Arriving fields: replays, repeats and readiness."""

import pyarrow.parquet as pq
import pytest
from helpers import SMALL, grid
from pyspark.sql import functions as F

from zonalis.operators import vertical
from zonalis.plans.catalogue.arriving import _landing
from zonalis.plans.catalogue.base import monthly
from zonalis.sources import fields as store
from zonalis.streaming import arrivals, settled, versions

KEYS = ["year", "month", "level", "lat_idx", "lon_idx"]


def deliver(spark, folder, year, value):
    g = grid(spark, SMALL, lambda m, p, la, lo: value, levels=(500, 850), names=("t",)).withColumn("year", F.lit(year))
    rows = vertical.columns_to_fields(g, KEYS, ("t",)).withColumn("grp", F.lit("pl"))
    rows.select(*[F.col(f.name).cast(f.dataType) for f in store.MONTHLY_SCHEMA]).coalesce(1).write.mode("append").parquet(folder)


def test_corrected_field_replaces_the_first(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    deliver(spark, src, 2000, 1.0)
    deliver(spark, src, 2001, 3.0)

    def run():
        s = arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1)
        arrivals.keep_climatology_fresh(s, out, 2000, 2001, ck).awaitTermination()
        return spark.read.parquet(f"{out}/climatology").where("kind = 'mean'")

    assert {r["value"] for r in run().collect()} == {2.0}
    deliver(spark, src, 2001, 5.0)
    after = run()
    assert {r["value"] for r in after.collect()} == {3.0} and after.count() == 2 * 156


def test_running_mean_and_readiness(spark, tmp_path):
    src = str(tmp_path / "in")
    for y, v in ((2000, 1.0), (2001, 2.0), (2001, 2.0)):
        deliver(spark, src, y, v)
    s = arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1)
    arrivals.upsert_batches(arrivals.ready_slices(s, (2000, 2001, 2002)), f"{tmp_path}/r", f"{tmp_path}/rc", arrivals.SLICE).awaitTermination()
    rows = arrivals.latest_rows(spark, f"{tmp_path}/r").collect()
    assert len(rows) == 2 and all(r["n_years"] == 2 and not r["ready"] for r in rows)
    deliver(spark, src, 2002, 9.0)
    s = arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1)
    arrivals.upsert_batches(arrivals.ready_slices(s, (2000, 2001, 2002)), f"{tmp_path}/r", f"{tmp_path}/rc", arrivals.SLICE).awaitTermination()
    assert all(r["ready"] for r in arrivals.latest_rows(spark, f"{tmp_path}/r").collect())


def test_progress_listener(spark, tmp_path):
    deliver(spark, str(tmp_path / "in"), 2000, 1.0)
    seen = arrivals.ArrivalProgress()
    spark.streams.addListener(seen)
    try:
        s = arrivals.arriving(spark, str(tmp_path / "in"), store.MONTHLY_SCHEMA)
        keys = ["month", "level"]
        arrivals.upsert_batches(arrivals.progressive_mean(s, keys, "value"), f"{tmp_path}/o", f"{tmp_path}/c", keys).awaitTermination()
        import time
        for _ in range(50):
            if seen.rows:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert seen.rows == 2 * 156 and seen.batches >= 1


def test_state_does_not_grow_with_batches(spark, tmp_path):
    import os
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sizes = []
    for n in range(5):
        deliver(spark, src, 2000 + n % 2, float(n))
        s = arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1)
        arrivals.keep_climatology_fresh(s, out, 2000, 2001, f"{tmp_path}/c").awaitTermination()
        s = arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1)
        arrivals.upsert_batches(arrivals.progressive_mean(s, ["month", "level"], "value"), f"{out}/mean", f"{tmp_path}/m", ["month", "level"]).awaitTermination()
        sizes.append((sum(f.endswith(".parquet") for _, _, fs in os.walk(f"{out}/landed") for f in fs),
                      spark.read.parquet(f"{out}/landed").count(), len(os.listdir(f"{out}/mean"))))
    assert len({x[:2] for x in sizes[1:]}) == 1 and sizes[-1][2] <= 3, sizes


def fields_of(spark, var, level, year, value):
    g = grid(spark, SMALL, lambda m, p, la, lo: value + m, levels=(500,), months=(1, 2), names=("t",))
    return g.select(F.lit(var).alias("var"), F.lit("g").alias("grp"), F.lit(level).cast("int").alias("level"), F.lit(year).cast("int").alias("year"),
                    F.col("month").cast("int").alias("month"), F.col("lat_idx").cast("int").alias("lat_idx"), F.col("lon_idx").cast("int").alias("lon_idx"),
                    F.col("t").alias("value")).coalesce(1)


def fresh(spark, src, out, ck, years=(2000, 2009)):
    arrivals.keep_climatology_fresh(arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1), out, *years, ck).awaitTermination()
    return spark.read.parquet(f"{out}/climatology")


def test_surface_fields_and_odd_names(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for var, level in (("msl", None), ("o'neill =50%", 300)):
        for year, value in ((2000, 1.0), (2001, 4.0), (2000, 2.0), (1990, 77.0)):
            fields_of(spark, var, level, year, value).write.mode("append").parquet(src)
    got = {(r["var"], r["level"], r["month"], r["kind"]): r["v"] for r in
           fresh(spark, src, out, ck).groupBy("var", "level", "month", "kind").agg(F.avg("value").alias("v")).collect()}
    want = {(v, lev, m, k): x for v, lev in (("msl", 0), ("o'neill =50%", 300)) for m in (1, 2) for k, x in (("mean", 3.0 + m), ("std", 1.0))}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def files_of(folder):
    import os
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


@pytest.mark.parametrize("broken", ["landed", "moments", "climatology", "log", "cleaning"])
def test_a_batch_lost_half_way_is_replayed(spark, tmp_path, monkeypatch, broken):
    """Whatever was written when the driver went, history stays and the replay gives the same rows."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for year, value in ((2000, 1.0), (2001, 5.0)):
        fields_of(spark, "t", 500, year, value).write.mode("append").parquet(src)
    fresh(spark, src, out, ck)
    fields_of(spark, "t", 500, 2001, 9.0).write.mode("append").parquet(src)
    with monkeypatch.context() as m:
        if broken in ("landed", "moments"):
            real = versions.VersionedTree.write

            def write(tree, *args):
                real(tree, *args)
                if tree.root.endswith(broken):
                    raise RuntimeError("lost")
            m.setattr(versions.VersionedTree, "write", write)
        elif broken == "climatology":
            m.setattr(store, "write_climatology", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        elif broken == "log":
            m.setattr(versions.Files, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        else:
            m.setattr(versions.VersionedTree, "forget", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            fresh(spark, src, out, ck)
    landed = versions.VersionedTree(spark, f"{out}/landed", ["var", "level", "year"], versions.CommitLog(spark, f"{out}/_log"))
    seen = {r["year"]: r["v"] for r in landed.read(None).where("month = 1").groupBy("year").agg(F.avg("value").alias("v")).collect()}
    assert seen == {2000: 2.0, 2001: 10.0 if broken == "cleaning" else 6.0}
    after = fresh(spark, src, out, ck).where("month = 1").groupBy("kind").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    assert {r["kind"]: (r["a"], r["b"]) for r in after.collect()} == {"mean": (6.0, 6.0), "std": (4.0, 4.0)}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """Bytes written do not grow with the years that landed before."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    written = []
    for year in range(2000, 2006):
        before = files_of(f"{out}")
        fields_of(spark, "t", 500, year, float(year)).write.mode("append").parquet(src)
        fresh(spark, src, out, ck)
        written.append(sum(n for f, n in files_of(out).items() if f not in before))
    assert max(written[1:]) < 1.2 * min(written[1:])
    clim = spark.read.parquet(f"{out}/climatology").where("kind = 'std' AND month = 2")
    assert {round(r["value"], 9) for r in clim.collect()} == {round((35 / 12) ** 0.5, 9)}


def test_state_in_partitions(spark, tmp_path):
    """Only the months that arrive are written anew."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        s = arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1)
        keys = ["month", "level"]
        arrivals.upsert_batches(arrivals.progressive_mean(s, keys, "value"), out, f"{tmp_path}/c", keys, parts=["month"]).awaitTermination()
        return files_of(out)

    fields_of(spark, "t", 500, 2000, 1.0).write.mode("append").parquet(src)
    first = run()
    fields_of(spark, "t", 500, 2001, 3.0).where("month = 2").write.mode("append").parquet(src)
    second = run()
    assert {f for f in first if "month=1" in f} <= set(second) and not {f for f in first if "month=2" in f} & set(second)
    rows = arrivals.mean_of(arrivals.latest_rows(spark, out, ["month"]), "value").collect()
    assert {r["month"]: r["value"] for r in rows} == {1: 2.0, 2: 4.0}


def test_young_files_wait(spark, tmp_path):
    """A file that is still being written is left out, not lost; a replay and a restart read each file once."""
    import glob
    import os
    import time
    src, log, out, ck = (str(tmp_path / x) for x in ("in", "log", "out", "ck"))
    for year in (2000, 2001, 2002):
        fields_of(spark, "t", 500, year, float(year)).write.mode("append").parquet(src)

    def age(files, seconds):
        for f in files:
            os.utime(f, (time.time() - seconds,) * 2)

    def run():
        s = settled.settled_stream(spark, src, log, store.MONTHLY_SCHEMA, files_per_batch=1)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["year"] for r in spark.read.parquet(out).select("year").distinct().collect()), spark.read.parquet(out).count()

    files = {int(pq.read_table(f).column("year")[0].as_py()): f for f in glob.glob(f"{src}/*.parquet")}
    age([files[2001]], 500)
    with open(f"{src}/part-unfinished.parquet", "wb") as f:
        f.write(b"PAR1 still being written")
    years, n = run()
    assert years == [2001]
    age([files[2000]], 9000)                                # settled long ago, found later: not skipped
    years, n = run()
    assert years == [2000, 2001]
    age([files[2002]], 121)
    assert run() == ([2000, 2001, 2002], 3 * 2 * 156) == run()


def test_a_slice_is_emitted_once_and_forgotten(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    seen = []

    def run():
        q = arrivals.emit_ready(arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1), (2000, 2001), out, ck)
        q.awaitTermination()
        seen.extend(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators)
        return sorted((r["var"], r["level"], r["month"], r["n_years"]) for r in spark.read.schema("var string, level int, month int, n_years int").parquet(out).collect())

    fields_of(spark, "t", 500, 2000, 1.0).write.mode("append").parquet(src)
    fields_of(spark, "msl", None, 2000, 1.0).write.mode("append").parquet(src)
    fields_of(spark, "t", 500, 1990, 1.0).write.mode("append").parquet(src)
    assert run() == [] and max(seen) == 4
    fields_of(spark, "t", 500, 2001, 1.0).where("month = 2").write.mode("append").parquet(src)
    assert run() == [("t", 500, 2, 2)] and seen[-1] == 3
    for var, level in (("t", 500), ("msl", None)):
        fields_of(spark, var, level, 2001, 1.0).where("var = 'msl' OR month = 1").write.mode("append").parquet(src)
    assert run() == [("msl", 0, 1, 2), ("msl", 0, 2, 2), ("t", 500, 1, 2), ("t", 500, 2, 2)] and seen[-1] == 0


def test_pending_goes_to_zero(spark, tmp_path):
    import time
    src = str(tmp_path / "in")
    want = arrivals.PendingInputs([(v, lev, y, m) for v, lev in (("t", 500), ("msl", None)) for y in (2000, 2001) for m in (1, 2)])
    spark.streams.addListener(want)

    def run(pending):
        s = arrivals.observed(arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1))
        q = s.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if want.pending <= pending:
                break
            time.sleep(0.1)
        return want.pending, want.total

    try:
        fields_of(spark, "t", 500, 2000, 1.0).write.mode("append").parquet(src)
        fields_of(spark, "t", 500, 1980, 1.0).write.mode("append").parquet(src)
        assert run(6) == (6, 8)
        fields_of(spark, "t", 500, 2001, 1.0).write.mode("append").parquet(src)
        for y in (2000, 2001):
            fields_of(spark, "msl", None, y, 1.0).write.mode("append").parquet(src)
        assert run(0) == (0, 8)
    finally:
        spark.streams.removeListener(want)


def test_state_tasks_are_those_asked_for(spark, tmp_path):
    """The session's shuffle tasks grow with tables; a state of few slices need not. The session keeps its own number."""
    src = str(tmp_path / "in")
    for y in (2000, 2001):
        deliver(spark, src, y, 1.0)
    before = spark.conf.get(arrivals.SHUFFLE_TASKS)
    stream = arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1)
    arrivals.upsert_batches(arrivals.ready_slices(stream, (2000, 2001)), f"{tmp_path}/a", f"{tmp_path}/ck_a", arrivals.SLICE, state_tasks=2).awaitTermination()
    assert {(r["level"], r["n_years"], r["ready"]) for r in arrivals.latest_rows(spark, f"{tmp_path}/a").collect()} == {(500, 2, True), (850, 2, True)}
    arrivals.emit_ready(arrivals.arriving(spark, src, store.MONTHLY_SCHEMA, 1), (2000, 2001), f"{tmp_path}/b", f"{tmp_path}/ck_b", state_tasks=2).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    for ck in ("ck_a", "ck_b"):
        assert {p.name for p in (tmp_path / ck / "state" / "0").iterdir() if p.name.isdigit()} == {"0", "1"}
    assert spark.conf.get(arrivals.SHUFFLE_TASKS) == before


def test_deliveries_have_few_files(spark, sf, tmp_path):
    """A file is a batch: their number must not follow the number of tasks that made the rows."""
    changes = {arrivals.SHUFFLE_TASKS: "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in changes}
    try:
        for k, v in changes.items():
            spark.conf.set(k, v)
        folder = _landing(spark, sf, str(tmp_path))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "landing").glob("*.parquet"))) <= 2 + 3 + 1 + 2 + 4          # Spark adds a file without rows
    assert spark.read.parquet(folder).where("year = 1998").count() == monthly(spark, sf, "t").where("year = 1998").count()
