import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonalis.llm import hard_negatives as hn


def slow(rows, anchors, k=5, m=3):
    out = []
    for a, label, x in anchors:
        score = lambda y: sum(p * q for p, q in zip(x, y))
        same = sorted((-score(y), i) for i, other, y in rows if i != a and other == label)[:k]
        for s, p in same:
            fit = sorted((-score(y), i) for i, other, y in rows if i != a and other != label and 50 * -s <= 100 * score(y) <= 95 * -s)[:m]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [hn.BLOCK, 7])
def test_same_as_comparing_all(spark, size):
    """Ties, repeated vectors, short and empty vectors, an anchor alone with its label; one block and many."""
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(0, 3)), r.integers(-9, 9, 6).tolist()) for i in range(60)]
    rows += [(60 + i, 1, rows[2][2]) for i in range(9)] + [(70, 2, rows[2][2][:3]), (71, 1, []), (72, 9, [5] * 6)]
    df = spark.createDataFrame(rows, "id long, label int, values array<long>").withColumn("block", hn.F.lit("mine"))
    anchors = [x for x in rows if x[0] % 4 == 0]
    assert got(hn.mine(df, df.where("id % 4 = 0"), size=size)) == slow(rows, anchors)


def test_numbers_beyond_floating_point(spark):
    big = 1_500_000_019
    rows = [(i, i % 2, [big - i, big + 3 * i]) for i in range(12)] + [(20, 1, [big // 2 + 7, 2 * big // 3]), (21, 1, [big // 2 + 6, 2 * big // 3])]
    df = spark.createDataFrame(rows, "id long, label int, values array<long>")
    want = slow([(i, lab, x) for i, lab, x in rows], [rows[0]])
    assert want and got(hn.mine(df, df.where("id = 0"))) == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, label int, values array<long>")
    assert hn.mine(df, df).collect() == []
    one = spark.createDataFrame([(0, 1, [1])], "id long, label int, values array<long>")
    assert hn.mine(one, one).collect() == []


def test_rows_that_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(50, 1, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (2, 2, [0.5, 0.9]), (3, 2, None), (4, None, [0.5, 0.9]), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]),
            (None, 2, [0.5, 0.9]), (8, 2, [None, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r["anchor_id"], r["positive_id"], r["negative_id"]) for r in hn.op12_hard_negatives(spark, str(tmp_path)).collect()] == [(50, 1, 2)]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 40), st.integers(1, 12), st.integers(1, 3))
def test_a_block_gives_what_a_full_scan_gives(seed, n, width, labels):
    r = np.random.default_rng(seed)
    m = r.integers(-20, 20, (width, n))
    block = hn.Block(np.arange(n), r.integers(0, labels, n), m)
    q = r.integers(-20, 20, width)
    rows = [(int(i), int(block.labels[i]), m[:, i].tolist()) for i in range(n)]
    want = sorted((-int(q @ m[:, i]), i) for i, lab, _ in rows if lab == 0)[:5]
    ids, scores = hn.positives(block, -1, 0, q, 5)
    assert list(zip((-scores).tolist(), ids.tolist())) == want
    windows = [hn.window(int(s)) for s in scores]
    for (lo, hi), (ids, scores) in zip(windows, hn.negatives(block, -1, 0, q, windows, 3)):
        want = sorted((-int(q @ m[:, i]), i) for i, lab, _ in rows if lab != 0 and lo <= int(q @ m[:, i]) <= hi)[:3]
        assert list(zip((-scores).tolist(), ids.tolist())) == want
