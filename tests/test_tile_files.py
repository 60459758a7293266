"""Tile files: round trips, filters that pick files, commits and aborts, compression in place."""

import glob
import gzip
import json
import os

import numpy as np
import pytest
from helpers import SMALL, by, grid
from pyspark.sql import functions as F

from zonalis.plans import jobs
from zonalis.sources import tile_files as tf


@pytest.fixture(scope="module")
def cells(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: None if (la, lo) == (0, 0) else p / 10 + la + m * lo / 7, months=(1, 2, 12), levels=(500, 850), names=("value",))
    upper = g.withColumn("var", F.lit("t")).withColumn("kind", F.explode(F.array(F.lit("mean"), F.lit("std"))))
    flat = g.where("level = 500").withColumn("level", F.lit(None).cast("int")).withColumn("var", F.lit("msl")).withColumn("kind", F.lit("mean"))
    years = flat.withColumn("var", F.lit("sst")).withColumn("year", F.explode(F.array(F.lit(1999), F.lit(2000)))).withColumn("value", F.lit(7.0))
    return upper.unionByName(flat).withColumn("year", F.lit(None).cast("int")).unionByName(years).cache()


#: Half a step of the widest range (about 740), and the last bits of float32.
HALF = 0.5 * 740 / 65534 + 1e-4
KEY = ("var", "kind", "level", "year", "month", "lat_idx", "lon_idx")


@pytest.mark.parametrize("encoding", [tf.CODES, tf.FLOATS])
def test_round_trip(spark, cells, tmp_path, encoding):
    root = str(tmp_path / "tiles")
    jobs.write_tile_files(cells, root, SMALL, encoding)
    got, want = by(jobs.read_tile_files(spark, root, SMALL), *KEY), by(cells, *KEY)
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (r["value"] is None) == (got[k]["value"] is None) and (r["value"] is None or abs(got[k]["value"] - r["value"]) < HALF)
    assert {r["grp"] for r in got.values()} == {"pressure_levels", "single_levels"}
    end = tf.ENDING[encoding]
    assert os.path.exists(f"{root}/pressure_levels/t/std_850_12{end}") and os.path.exists(f"{root}/single_levels/sst/1999_02{end}")
    assert not glob.glob(f"{root}/{tf.STAGED}/*")
    assert set(json.load(open(f"{root}/manifest.json"))["groups"]["single_levels"]) == {"msl", "sst"}


def test_codes_are_those_of_the_format(spark, cells, tmp_path):
    root = str(tmp_path / "tiles")
    jobs.write_tile_files(cells, root, SMALL)
    meta = json.load(open(f"{root}/single_levels/sst/meta.json"))
    assert meta["encoding"] == "f16-gz" and meta["nan_sentinel"] == 65535 and meta["tiles"]["1999_01"] == {"vmin": 7.0, "vmax": 8.0}
    q = np.frombuffer(gzip.open(f"{root}/single_levels/msl/01.bin.gz").read(), "<u2")
    assert len(q) == SMALL.cells and (q == 65535).sum() == 1 and q.min() == 0 and sorted(q)[-2] == 65534


def test_filters_pick_files(spark, cells, tmp_path):
    root = str(tmp_path / "tiles")
    jobs.write_tile_files(cells, root, SMALL)
    reader = tf.TileReader({"path": root, "nlat": 13, "nlon": 12})
    left = list(reader.pushFilters([tf.ds.EqualTo(("var",), "t"), tf.ds.In(("month",), (1, 12)), tf.ds.GreaterThan(("level",), 500),
                                    tf.ds.IsNull(("year",)), tf.ds.LessThan(("lat_idx",), 3)]))
    assert [f.attribute for f in left] == [("lat_idx",)]
    assert sorted(os.path.basename(t.path) for p in reader.partitions() for t in p.tiles) == ["850_01.bin.gz", "850_12.bin.gz", "std_850_01.bin.gz", "std_850_12.bin.gz"]
    for name in glob.glob(f"{root}/pressure_levels/t/500_*") + glob.glob(f"{root}/single_levels/*/*.gz"):
        with open(name, "wb") as f:
            f.write(b"unreadable")
    df = jobs.read_tile_files(spark, root, SMALL).where("var = 't' AND level = 850 AND kind = 'mean' AND month IN (1, 2) AND lat_idx < 3 AND year IS NULL")
    assert df.count() == 2 * 3 * 12
    assert jobs.read_tile_files(spark, root, SMALL).where("var = 'none'").count() == 0
    with pytest.raises(Exception, match="(?i)gzip"):
        jobs.read_tile_files(spark, root, SMALL).where("level = 500 AND kind = 'mean'").count()


def test_a_failed_write_leaves_the_tree_alone(spark, cells, tmp_path):
    root = str(tmp_path / "tiles")
    jobs.write_tile_files(cells.where("var = 'msl'"), root, SMALL)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f)}
    with pytest.raises(Exception, match="exists"):
        jobs.write_tile_files(cells, root, SMALL)                                   # append: msl is there
    bad = cells.where("var = 't'").withColumn("value", F.when((F.col("month") == 12) & (F.col("lat_idx") == 3), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        jobs.write_tile_files(bad, root, SMALL)
    assert {f: os.path.getmtime(f) for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f)} == before
    jobs.write_tile_files(cells.where("var = 'msl' AND month = 2").withColumn("value", F.lit(1.0)), root, SMALL, mode="overwrite")
    got = by(jobs.read_tile_files(spark, root, SMALL).groupBy("month").agg(F.max("value").alias("v")), "month")
    assert got[2,]["v"] == 1.0 and got[1,]["v"] > 50 and len(got) == 3


def test_compression_in_place(spark, cells, tmp_path):
    root = str(tmp_path / "tiles")
    jobs.write_tile_files(cells, root, SMALL, tf.FLOATS)
    want = by(jobs.read_tile_files(spark, root, SMALL), *KEY)
    assert jobs.compress_tile_files(spark, root, SMALL, variables=["sst"]) == [("single_levels", "sst")]
    assert {os.path.basename(f) for f in glob.glob(f"{root}/single_levels/sst/*.bin*")} == {f"{y}_{m:02d}.bin.gz" for y in (1999, 2000) for m in (1, 2, 12)}
    assert sorted(jobs.compress_tile_files(spark, root, SMALL)) == [("pressure_levels", "t"), ("single_levels", "msl")]
    got = by(jobs.read_tile_files(spark, root, SMALL), *KEY)
    assert got.keys() == want.keys() and not glob.glob(f"{root}/*/*/*.bin")
    assert all((r["value"] is None and got[k]["value"] is None) or abs(got[k]["value"] - r["value"]) < HALF for k, r in want.items())
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{root}/**", recursive=True)}
    assert jobs.compress_tile_files(spark, root, SMALL) == [] and {f: os.path.getmtime(f) for f in glob.glob(f"{root}/**", recursive=True)} == before
    assert jobs.compress_tile_files(spark, root, SMALL, groups=["single_levels"], force=True) == [("single_levels", "msl"), ("single_levels", "sst")]
