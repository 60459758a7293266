"""Exact results beside brute force, and what the bounds promise."""

import math

import numpy as np
import pytest

from zonalis.llm import topk as tk


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in ok[::-1] if i % 20 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_bounds_hold():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-40, 40, (50, 6)), rng.integers(-40, 40, (9, 6))
    top = tk.bounds(q, [v.min(0).tolist()], [v.max(0).tolist()])
    assert (top[:, 0] >= (q @ v.T).max(1)).all()
    big = np.array([[1 << 40, 3]])
    assert tk.exact(big, np.array([[1 << 20, 1]]))[0, 0] == (1 << 60) + 3


@pytest.mark.parametrize("sizes", [(256, 128, 1024), (4, 2, 3)])
def test_odd_rows(spark, monkeypatch, tmp_path, sizes):
    for name, n in zip(("BLOCK", "SHARD", "CHUNK"), sizes):
        monkeypatch.setattr(tk, name, n)
    rng = np.random.default_rng(4)
    rows = [(k, np.round(rng.normal(size=5) * 0.2, 2).tolist()) for k in range(120)]          # many ties
    rows += [(200, [0.1] * 5), (220, None), (240, [None] * 5), (260, [float("nan")] * 5), (261, [float("inf")] * 5), (280, []), (301, [0.5, 0.5]), (None, [1.0] * 5)]
    rows += [(5, rows[5][1]), (300, [9e5] * 5), (320, [-9e5] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in tk.op4_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(set((q, r) for q, r, _, _ in got)) and set(got) == brute(rows)


def test_empty(spark):
    none = spark.createDataFrame([], "id long, values array<long>")
    assert tk.search(none, none).count() == 0
    one = spark.createDataFrame([(20, [1, 2])], "id long, values array<long>")
    assert tk.search(one, one).count() == 0


def test_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in tk.op4_topk(spark, sf).collect()} == brute(rows)
