"""Jobs that are run again: ledgers, broken sources, folders that are done."""

import glob
import os

import pytest
from helpers import SMALL, by, cosd, grid
from pyspark.sql import functions as F

from zonalis.operators import vertical
from zonalis.plans import jobs
from zonalis.plans.ledger import Ledger
from zonalis.sources import fields as store

MONTHS = "  ".join(f"{m / 10:.2f}" for m in range(1, 13))


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def times(folder):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def status(df):
    return {r["key"]: (r["status"], r["reason"]) for r in df.collect()}


def test_indices_again_and_again(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for name in ("oni", "nao"):
        put(src, f"{name}.data", f"1999 2000\n 1999  {MONTHS}\n 2000  {MONTHS}\n -9.9\n")
    put(src, "roni.txt", " SEAS YR ANOM\nDJF 1999 1.5\nJFM 1999 1.4\n")
    put(src, "pdo.data", "<html>moved</html>")
    put(src, "other.data", f"1999 2000\n 1999  {MONTHS}\n")
    first = status(jobs.update_indices(spark, src, out))
    assert first == {"oni": ("done", None), "nao": ("done", None), "roni": ("done", None),
                     "pdo": ("bad", "no value in the layout of this index"), "other": ("bad", "unknown index")}
    before = times(f"{out}/values")
    assert status(jobs.update_indices(spark, src, out)) == {} and times(f"{out}/values") == before
    put(src, "nao.data", "gone")                                           # a source that breaks keeps its values
    put(src, "pdo.data", f"1999 2000\n 1999  {MONTHS}\n")
    assert status(jobs.update_indices(spark, src, out, only=["nao"])) == {"nao": ("bad", "no value in the layout of this index")}
    assert status(jobs.update_indices(spark, src, out)) == {"pdo": ("done", None)}
    after = times(f"{out}/values")
    assert {f for f in before if "id=oni" in f or "id=nao" in f} <= set(after)
    n = {r["id"]: r["count"] for r in spark.read.parquet(f"{out}/values").groupBy("id").count().collect()}
    assert n == {"oni": 24, "nao": 24, "roni": 2, "pdo": 12}
    rows = status(Ledger(spark, f"{out}/ledger").rows())
    assert len(rows) == 5 and rows["nao"][0] == "bad" and rows["pdo"][0] == "done"


@pytest.fixture(scope="module")
def fields(spark):
    g = grid(spark, SMALL, lambda m, p, la, lo: (10.0 + cosd(la), 3.0, 250.0 + p / 50, 100.0, 2.0), months=(1, 2), levels=(200, 500, 850), names=("u", "v", "t", "z", "q"))
    g = g.withColumn("year", F.explode(F.array(*[F.lit(y) for y in (2000, 2001)]))).withColumn("u", F.col("u") * (F.col("year") - 1999))
    keys = ["year", "month", "level", "lat_idx", "lon_idx"]
    return vertical.columns_to_fields(g, keys, ("u", "v", "t", "z", "q")).withColumn("grp", F.lit("pl")).cache()


def test_derived_sigmas_are_made_once(spark, fields, tmp_path):
    root = str(tmp_path / "tree")
    assert len(jobs.build_derived_std(fields.where("level = 500"), root, 2000, 2001)) == 3
    before = times(root)
    done = jobs.build_derived_std(fields, root, 2000, 2001)
    assert sorted(done) == [("mse", 200), ("mse", 850), ("wspd", 200), ("wspd", 850)] or ("dls", 0) in done
    assert set(before) <= set(times(root)) and all(times(root)[f] == t for f, t in before.items() if "dls" not in f)
    want = by(jobs.climatology_rows(jobs.derived_monthly(fields), 2000, 2001).where("kind = 'std' AND var <> 'dls'"), "var", "level", "month", "lat_idx", "lon_idx")
    got = by(spark.read.schema(store.CLIMATOLOGY_SCHEMA).parquet(f"{root}/climatology").where("var <> 'dls'"), "var", "level", "month", "lat_idx", "lon_idx")
    assert got.keys() == want.keys()
    assert all(abs((got[k]["value"] or 0) - (r["value"] or 0)) < 1e-9 and (got[k]["value"] is None) == (r["value"] is None) for k, r in want.items())
    before = times(root)
    assert jobs.build_derived_std(fields, root, 2000, 2001) == [] and times(root) == before
    assert len(jobs.build_derived_std(fields, root, 2000, 2001, force=True)) == 7 and times(root) != before


def test_acquisition_plan(spark, fields):
    plan = {r["var"]: (r["folder"], r["first"], r["last"], r["n_years"]) for r in jobs.acquisition_plan(fields, "1999-2002", ["u", "msl"]).collect()}
    assert plan == {"u": ("raw_1999_2002", 1999, 2002, 2), "msl": ("raw_1999_2002", 1999, 2002, 4)}
    whole = jobs.acquisition_plan(fields, "2000-2001", ["u"])
    assert whole.collect() == [] and jobs.acquisition_plan(fields, "2000-2001", ["u"], force=True).count() == 1
    default = jobs.acquisition_plan(fields, groups=["single_levels"]).collect()
    assert {(r["folder"], r["first"], r["last"]) for r in default} == {("raw", 1991, 2020)} and "wspd" not in {r["var"] for r in default}
