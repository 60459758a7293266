"""Targets by resharing round after round, cuts by plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from zonalis.llm import mixing as mx


def reshared(sizes, weights=mx.WEIGHTS, epochs=mx.EPOCHS):
    """Targets as the contract words them: cap, reshare the excess by weight, repeat."""
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, done = float(sum(sizes.values())), {}
    while len(done) < len(names):
        left = total - sum(done.values())
        rest = [s for s in names if s not in done]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] >= epochs * sizes[s]]
        if not over:
            return done | share
        done |= {s: float(epochs * sizes[s]) for s in over}
    return done


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return mx.mix(docs, mx.word_count("text"), **kw).collect()


def holds(got):
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = reshared(sizes)
    for s, n in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == n and r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
    for r in got:
        assert 0 <= r["taken"] <= mx.EPOCHS * r["size"] and r["taken"] == r["copies"] * r["size"] + r["cut_words"]


def test_targets_and_cuts(spark):
    rows = [(k, f"s{k % 5}", "w " * (1 + k * 7 % 23)) for k in range(300)] + [(900 + k, "tiny", "a b") for k in range(3)]
    rows += [(None, None, "x y\tz"), (1, "s1", "w " * 8), (1, "s1", "w " * 8), (7, "s2", None), (8, "s2", ""), (9, "void", " \n"), (10, "big", "u " * 4000)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    holds(got)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    again = run(spark, rows[::-1])
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in again)
    other = run(spark, rows, seed=1)
    assert [r["taken"] for r in sorted(other, key=lambda r: (str(r["doc_id"]), r["size"]))] != [
        r["taken"] for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["size"]))]


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", "one two"), (2, None, "three")], [(1, "a", "x"), (2, "b", "x y z " * 9)]])
def test_small_tables(spark, rows):
    got = run(spark, rows)
    assert len(got) == len(rows)
    if rows:
        holds(got)


def test_prefix_sums_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit(2).alias("v"))
    got = mx.running_sums(df, [F.col("k")], {"before": F.col("v")}, "t").collect()
    assert all(r["before"] == 2 * r["k"] for r in got) and len(got) == 5000


def test_whole_table(spark, sf):
    got = mx.op10_mix(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in got} == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in texts.items()}
    holds(got)
