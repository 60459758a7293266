"""Sources, sinks and batch jobs."""

import os
import struct
import time

import pytest
from helpers import SMALL, by, cosd, grid
from pyspark.sql import functions as F

from zonalis.grid import nan_to_null, null_to_nan, stride, stride_for
from zonalis.operators import vertical
from zonalis.plans import jobs
from zonalis.sources import fields as store
from zonalis.sources import indices, tiles

KEYS = ["year", "month", "level", "lat_idx", "lon_idx"]


def long_fields(spark, years=(2000, 2001, 2002)):
    names = ("u", "v", "t", "z", "q")
    g = grid(spark, SMALL, lambda m, p, la, lo: (10 * cosd(la) + m, p / 500 + lo / 90, 230 + p / 20, 16000 - 15 * p, p / 100), names=names, months=(1, 2))
    g = g.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    g = g.withColumn("t", F.col("t") + (F.col("year") - 2001) * 2.0)
    return vertical.columns_to_fields(g, KEYS, names).withColumn("grp", F.lit("pressure_levels"))


def lines(spark, text, index="oni"):
    return spark.createDataFrame([(index, i, x) for i, x in enumerate(text.split("\n"))], "id string, line_no int, value string")


PSL = """ 1950 1952
1950 -1.5 -1.3 -1.2 -1.2 -1.1 -0.9 -0.5 -0.4 -0.4 -0.4 -0.6 -0.8
1951 -99.9 -9.88 5.55 abc 0.2 0.4 0.6 0.7 0.9 1.0 1.2 1.0
1952  0.5  0.4

  5.55
 an index of something
 https://example.org/index"""


def test_psl_text(spark):
    r = by(indices.parse_psl(lines(spark, PSL)), "year", "month")
    assert len(r) == 24 and r[1950, 1]["value"] == -1.5
    assert [r[1951, m]["value"] for m in (1, 2, 3, 4)] == [None, None, None, None]
    assert r[1951, 12]["value"] == 1.0


def test_cpc_text(spark):
    t = " SEAS  YR   ANOM\n DJF 1998   2.1\n NDJ 1998  -1.4\n XYZ 1998 3.0\n JFM 19x8 1.0\n JJA 1999 -99.9\n JAS 1999 bad"
    r = by(indices.parse_cpc_seasonal(lines(spark, t)), "year", "month")
    assert {k: v["value"] for k, v in r.items()} == {(1998, 1): 2.1, (1998, 12): -1.4, (1999, 7): None}


def test_index_files_and_json(spark, tmp_path):
    (tmp_path / "oni.data").write_text(PSL)
    (tmp_path / "roni.txt").write_text(" SEAS YR ANOM\n DJF 1998 2.1\n")
    (tmp_path / "other.txt").write_text("unknown 1 2")
    parsed = indices.parse_all(indices.read_text(spark, str(tmp_path)))
    assert {r["id"] for r in parsed.select("id").distinct().collect()} == {"oni", "roni"}
    back = indices.from_json(indices.to_json(parsed))
    key = ["id", "year", "month"]
    valid = parsed.where("value IS NOT NULL").select(*key, "value")
    assert valid.exceptAll(back.select(*key, "value")).count() == 0
    assert by(indices.coverage(parsed), "id")["oni",]["n_months"] == 20


def test_nan_and_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5), (4, None)], "k int, v double")
    clean = nan_to_null(df)
    assert [r["v"] for r in clean.orderBy("k").collect()] == [None, None, 1.5, None]
    assert null_to_nan(clean).where(F.isnan("v")).count() == 3


def test_names_and_periods():
    assert store.resolve_period("default") == store.resolve_period(None) == "1991-2020"
    assert store.resolve_period("default", "1961-1990") == "1961-1990" and store.resolve_period("1991-2020", "1961-1990") == "1991-2020"
    assert store.span_of("data/raw_2021_2026") == (2021, 2026) and store.span_of("data/raw") is None
    assert store.prune_folders(["raw", "raw_1961_1990", "raw_2021_2026"], 1991, 2020) == ["raw"]
    assert store.pick_variable(["time", "lat", "x"], "t2m", ["time", "lat"]) == "x"
    with pytest.raises(ValueError):
        store.pick_variable(["a", "b"], "t", [])
    assert store.nearest_level((280, 300, 320), 290) == 280
    assert stride_for(1.0) == 2 and stride_for(0.25) == 1


def test_stride_is_a_subsample(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: la, levels=(500,))
    assert stride(g, 2).count() == 7 * 6 and stride(g, 1) is g


def test_trees_are_rewritten_not_doubled(spark, tmp_path):
    long = long_fields(spark)
    for _ in range(2):
        jobs.build_per_year(long, str(tmp_path))
        jobs.build_climatology(long, str(tmp_path), 2000, 2001)
        jobs.build_derived_std(long, str(tmp_path), 2000, 2002)
    assert spark.read.parquet(f"{tmp_path}/per_year").count() == long.count()
    clim = spark.read.parquet(f"{tmp_path}/climatology")
    raw = clim.where("var = 't' AND kind = 'std' AND period = '2000-2001'")
    assert raw.count() == 2 * 4 * 156 and {round(r["value"], 9) for r in raw.collect()} == {1.0}
    mse = clim.where("var = 'mse' AND period = '2000-2002'")
    assert {round(r["value"], 6) for r in mse.collect()} == {round((8 / 3) ** 0.5, 6)}
    assert clim.where("var = 'dls'").count() == 2 * 156
    plan = spark.read.parquet(f"{tmp_path}/per_year").where("var = 't' AND level = 500 AND year = 2000 AND month = 1")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(var" in text and "PushedFilters: [IsNotNull(month), EqualTo(month,1)]" in text


def test_level_append_is_idempotent(spark, tmp_path):
    long = long_fields(spark).where("var = 't'")
    jobs.build_per_year(long.where("level <> 500"), str(tmp_path))
    path = f"{tmp_path}/per_year"
    for _ in range(2):
        have = spark.read.parquet(path).withColumn("var", F.col("var").cast("string"))
        jobs.add_levels(have, long.where("level IN (500, 850)"), str(tmp_path))
    after = spark.read.parquet(path)
    assert after.count() == long.count()
    assert [r["level"] for r in store.available_levels(after, "t").collect()] == [200, 500, 850, 1000]


def test_quantized_tree(spark, tmp_path):
    rows = jobs.climatology_rows(long_fields(spark).where("var IN ('t', 'u')"), 2000, 2002)
    jobs.quantize_tree(rows, f"{tmp_path}/q")
    back = tiles.dequantize(spark.read.parquet(f"{tmp_path}/q"))
    key = ["kind", "var", "level", "month", "lat_idx", "lon_idx"]
    worst = rows.join(back.withColumnRenamed("value", "b"), key).agg(F.max(F.abs(F.col("value") - F.col("b")))).first()[0]
    assert worst < 21 / 65534


def test_float32_tiles(spark, tmp_path):
    folder = tmp_path / "tiles"
    folder.mkdir()
    n = SMALL.cells
    for name, base in (("500_01", 0), ("std_500_01", 1000), ("850_1998_12", 5), ("1998_03", 7), ("07", 9)):
        v = [float("nan")] + [float(base + k) for k in range(1, n)]
        (folder / f"{name}.bin").write_bytes(struct.pack(f"<{n}f", *v))
    df = tiles.tile_key(tiles.read_float32(spark, str(folder), SMALL)).where("lat_idx = 0 AND lon_idx < 2")
    got = {(r["kind"], r["level"], r["year"], r["month"]): r["value"] for r in df.where("lon_idx = 1").collect()}
    assert got == {("mean", 500, None, 1): 1.0, ("std", 500, None, 1): 1001.0, ("mean", 850, 1998, 12): 6.0,
                   ("mean", None, 1998, 3): 8.0, ("mean", None, None, 7): 10.0}
    assert df.where("lon_idx = 0 AND value IS NOT NULL").count() == 0


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_float32_tiles_on_a_cluster(spark, tmp_path, monkeypatch, prefix):
    """A shared folder may be given as a path, as tile files take it."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    g = grid(spark, SMALL, lambda m, p, la, lo: la + lo + m, levels=(500,), months=(1, 2))
    t = tiles.to_arrays(g, ["month", "level"], SMALL, "u").withColumn("name", F.format_string("%d_%02d", "level", "month"))
    assert tiles.write_float32(t, "name", f"{prefix}{tmp_path}/tiles") == 2
    got = by(tiles.tile_key(tiles.read_float32(spark, f"{prefix}{tmp_path}/tiles", SMALL)), "month", "lat_idx", "lon_idx")
    assert len(got) == 2 * SMALL.cells and got[2, 0, 1]["value"] == 90 - 150 + 2


def test_files_in_flight_are_left_alone(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a"))
    assert store.settled_files(spark, str(tmp_path)) == []
    for root, _, files in os.walk(tmp_path):
        for f in files:
            os.utime(os.path.join(root, f), (time.time() - 500,) * 2)
    assert len(store.settled_files(spark, str(tmp_path))) == 1


def test_attributes_and_units(spark):
    df = spark.createDataFrame([("z", 9806.65, None), ("q", 0.002, None), ("t", float("nan"), "kept")], "var string, value double, long_name string")
    u = {r["var"]: r["value"] for r in store.to_display_units(df).collect()}
    assert abs(u["z"] - 1000) < 1e-9 and abs(u["q"] - 2) < 1e-12 and u["t"] is None
    cfg = spark.createDataFrame([("z", "Height", "m"), ("t", "Temp", "K")], "var string, long_name string, units string")
    a = {r["var"]: r for r in store.with_attributes(df.withColumn("units", F.lit(None).cast("string")), cfg).collect()}
    assert a["z"]["long_name"] == "Height" and a["t"]["long_name"] == "kept" and a["q"]["units"] is None
