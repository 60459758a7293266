"""Links, counts and components beside brute force; recall of the index."""

import math

import numpy as np
import pytest

from test_simhash import slow_components
from zonalis.llm import pivots as pv


def brute(rows):
    """{place: (links, component)} of (id, vector) rows."""
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    near = {k: [] for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.95:
                    near[a].append(b)
                    near[b].append(a)
    where = slow_components(near)
    low = {}
    for k, c in where.items():
        if rows[k][0] is not None:
            low[c] = min(low.get(c, rows[k][0]), rows[k][0])
    return [(len(near[k]), low.get(where[k])) for k in range(len(rows))]


@pytest.mark.parametrize("block", [4096, 3])
def test_odd_rows(spark, monkeypatch, block):
    from zonalis.llm import common
    monkeypatch.setattr(pv, "blocked_pairs", lambda df, keys, spread: common.blocked_pairs(df, keys, spread, block))
    rng = np.random.default_rng(3)
    rows = []
    for c in rng.normal(size=(12, 8)):
        for _ in range(6):
            rows.append((len(rows), (c + rng.normal(size=8) * rng.choice([0.05, 0.1, 0.2])).tolist()))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (None, rows[0][1]), (202, None), (203, []), (204, [0.0] * 8),
             (205, [None] + [1.0] * 7), (206, [float("nan")] * 8), (207, [float("inf")] + [1.0] * 7), (208, rows[0][1][:5]), (209, [1e30] * 8), (210, [1e-30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS kept")
    got = sorted(map(tuple, pv.near_duplicates(df).collect()), key=str)
    want = sorted(((i, n, c, i is not None and i == c) for (i, _), (n, c) in zip(rows, brute(rows))), key=str)
    assert got == want
    assert pv.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    v = np.array([x for _, x in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = (v @ v.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r for r in pv.op7_pivots(spark, sf).collect()}
    assert len(got) == len(rows)
    found = np.array([got[i]["n_links"] for i, _ in rows])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum()
