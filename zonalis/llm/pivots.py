"""Near-duplicate vectors through a pivot-permutation index.

Pivots are well-separated vectors of a bounded sample. A vector is described by its ``NEAREST`` nearest
pivots in order. Inverted lists are kept per combination of ``SHARED`` pivots, so two vectors meet in
a list exactly if they share that many of their nearest pivots; the shared-pivot count of a pair also
tells the one list that is to verify it (that of its smallest shared pivots). Verification is the cosine in double
precision. Every vector is indexed; the index misses a pair only if it shares too few pivots; a test
measures that against brute force.

Equal vectors are collapsed first, with a map-side partial step, so copies never meet in lists. Lists
that hold very many vectors are cut into blocks that meet in pairs. A task returns the number of links of each
vector and links that connect what it found, never all pairs of a group.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null id, link with nothing; vectors of different length do not link; repeated rows are vectors of
their own that link with each other; rows that share an id belong together. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.blocks import groups, meetings, stars
from zonalis.llm.common import blocked_pairs, python_ready, stored, table
from zonalis.llm.components import components

LEAST = 0.95
SAMPLE = 4096
PIVOTS = 512
NEAREST = 5
SHARED = 2
#: Pivots of the sample are no closer to each other than this cosine.
APART = 0.9
KEYS = ["list", "left_block", "right_block"]


def usable(vector: str) -> Column:
    """Whether all components are there and finite and one is not zero."""
    v = F.col(vector)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of equal width (shorter ones filled with zeros, longer ones cut)."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v[:width]
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.maximum(np.abs(rows).max(1, keepdims=True), 1e-300)      # no overflow in the squares
    return scaled / np.maximum(np.sqrt((scaled * scaled).sum(1, keepdims=True)), 1e-300)


def choose_pivots(vectors: list, most: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Farthest-first choice: each pivot is the vector least similar to those chosen before."""
    if not vectors:
        return np.zeros((0, 0))
    v = unit(matrix(vectors, max(map(len, vectors))))
    chosen, best = [0], v @ v[0]
    while len(chosen) < min(most, len(v)):
        k = int(best.argmin())
        if best[k] > apart:
            break
        chosen.append(k)
        best = np.maximum(best, v @ v[k])
    return v[chosen]


def nearest(vectors: list, pivots: np.ndarray, count: int = NEAREST) -> np.ndarray:
    """Numbers of the nearest pivots in order, ties to the smaller number."""
    sims = unit(matrix(vectors, pivots.shape[1])) @ pivots.T
    return np.argsort(-sims, axis=1, kind="stable")[:, :count]


def postings(classes: DataFrame, pivots: np.ndarray, shared: int = SHARED) -> DataFrame:
    """(list, id, n, pivots, vector): each vector in the list of every combination of its nearest pivots."""
    held = classes.sparkSession.sparkContext.broadcast(pivots)
    schema = pa.schema([("list", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("pivots", pa.binary()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            vectors = [np.array(v, float) for v in batch.column("v").to_pylist()]
            if not vectors:
                continue
            top = np.sort(nearest(vectors, held.value), axis=1)
            picks = list(combinations(range(top.shape[1]), min(shared, top.shape[1])))
            size = len(held.value)
            raw, described = [v.tobytes() for v in vectors], [t.astype("<u2").tobytes() for t in top]
            for pick in picks:
                lists = np.zeros(len(top), np.int64)
                for p in pick:
                    lists = lists * size + top[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(ids), pa.array(n), pa.array(described, pa.binary()), pa.array(raw, pa.binary())], schema=schema)

    return classes.select("id", "n", "v").mapInArrow(run, "list long, id long, n long, pivots binary, vector binary")


def _verify(least: float, shared: int, size: int):
    """Link counts (id, null, n) and star links (id, id, 0) of the lists in a task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in groups(batches, KEYS):
            lists, own, left, right, ids, n = (rows.column(c).to_numpy() for c in ("list", "own_block", "left_block", "right_block", "id", "n"))
            top = np.frombuffer(b"".join(rows.column("pivots").to_pylist()), "<u2").reshape(len(ids), -1).astype(np.int64)
            vectors = [np.frombuffer(v) for v in rows.column("vector").to_pylist()]
            width = np.array(list(map(len, vectors)))
            v = unit(matrix(vectors, int(width.max())))
            need = min(shared, top.shape[1])

            def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                cos = np.einsum("ij,ij->i", v[x], v[y]) if x.ndim == 1 else v[x[:, 0]] @ v[y[0]].T
                return (cos >= least) & (width[x] == width[y])

            count = np.zeros(len(ids), np.int64)
            for x, y in meetings(starts, len(ids), own, left, right, near):
                # the list of the smallest shared pivots verifies a pair
                both = (top[x][:, :, None] == top[y][:, None, :]).any(2)
                rank = np.cumsum(both, 1)
                home = np.zeros(len(x), np.int64)
                for k in range(1, need + 1):
                    home = home * size + np.take_along_axis(top[x], np.argmax(both & (rank == k), 1)[:, None], 1)[:, 0]
                due = home == lists[x]
                x, y = x[due], y[due]
                np.add.at(count, x, n[y])
                np.add.at(count, y, n[x])
                if len(x):
                    a, b = stars(len(ids), x, y)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(np.zeros(len(a), np.int64))], schema=schema)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(count[some])], schema=schema)
    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    python_ready(vectors.sparkSession)
    given = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    given = given.withColumn("ok", usable("v") & F.col("id").isNotNull()).withColumns(
        {f"h{k}": F.xxhash64(F.lit(k), F.col("v")) for k in (1, 2)})            # 128 bits name a vector
    rows = stored(given.select("id", "ok", "h1", "h2"), "vector-names")
    classes = stored(given.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "vector-classes")
    some = classes.orderBy(F.xxhash64("id", "h1"), "id").limit(SAMPLE).select("v").collect()
    pivots = choose_pivots([r["v"] for r in some])
    if len(pivots):
        dealt = blocked_pairs(postings(classes, pivots), ["list"], ["id", "vector"])
        part = dealt.repartition(F.xxhash64(*KEYS)).sortWithinPartitions(*KEYS)
        found = stored(part.mapInArrow(_verify(least, SHARED, len(pivots)), "a long, b long, n long"), "vector-links")
    else:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("_id")).agg(F.sum("n").alias("_links"))
    reach = components(found.where(F.col("b").isNotNull()), "a", "b").withColumnRenamed("node", "_node")
    told = stored(classes.select("h1", "h2", "id", "n").join(counts, F.col("id") == F.col("_id"), "left").join(reach, F.col("id") == F.col("_node"), "left")
                  .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"),
                          F.coalesce("component", "id").alias("component_id")), "vector-told")
    fine = rows.where("ok").join(told, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("id", "n_links", "component_id")
    rest = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return fine.union(rest).select(F.col("id").alias(key), "n_links", "component_id",
                                   F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same rows in SQL: all pairs, and the smallest id reachable over the links.
OP7_SQL = """WITH RECURSIVE
v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a WHERE r.c < e.b),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN m ON m.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""
