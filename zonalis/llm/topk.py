"""Exact top-k by integer inner product, with block-at-a-time pruning.

Vectors are laid out in document ranges. A block keeps, per dimension, the least and the greatest value
of its vectors (its term extrema) and a forward index (ids and values). For a query, no vector of a
block scores more than the sum over dimensions of the larger of q x least and q x greatest. Blocks
are visited in order of that sum; once it falls below the k-th score found so far, no later block can
matter. Equal bounds are still visited, since ties go to the smaller id.

Document order: vectors are range-sorted by their strongest dimensions, so those of a block resemble
each other and the bounds are tight. Queries come in chunks. A first pass scores each query's best
blocks and gives a lower bound of its k-th score; the second prunes against it. Chunks of queries meet shards
of blocks: every query is stated against all rows, and a task holds one chunk and one shard.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; shorter
vectors count as filled with zeros; an empty vector scores 0 with all; a query never meets rows of its
own id (so repeated rows of an id are not each other's results, but each is a result of others); equal
ids among the results are ordered arbitrarily. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.llm.common import python_ready, stored, table

TOP = 20
SCALE = 64
EVERY = 20
#: Vectors of a block, blocks of a shard, queries of a chunk.
BLOCK = 256
SHARD = 128
CHUNK = 1024
#: Blocks that give the first bound of a query.
FIRST = 2


def finite(vector: str) -> Column:
    return F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def numbers(vector: str, scale: int = SCALE) -> Column:
    """floor(scale x component), components as doubles."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def order_key(values: str) -> Column:
    """Signed numbers of the three strongest dimensions: alike vectors sort side by side."""
    strong = F.slice(F.reverse(F.array_sort(F.transform(F.col(values), lambda x, k: F.struct(F.abs(x).alias("size"), k.alias("dim"), x.alias("x"))))), 1, 3)
    return F.transform(strong, lambda s: F.when(s["x"] < 0, -s["dim"] - 1).otherwise(s["dim"]))


def dense(rows: list, width: int = 0) -> np.ndarray:
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b: in floating point where that is exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if most < 2.0 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def build(vectors: DataFrame) -> DataFrame:
    """(block, shard, low, high, ids, values) from (id, values): the forward index (packed 64-bit
    integers, row by row) with its term extrema."""
    python_ready(vectors.sparkSession)
    keyed = vectors.withColumn("_key", order_key("values"))
    placed = keyed.repartitionByRange("_key", "id").sortWithinPartitions("_key", "id").withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, part = 0, [], [], 0

        def block() -> pa.RecordBatch:
            m = dense(rows)
            name = (part << 32) + at
            cols = [[name], [name // SHARD], [m.min(0).tolist()], [m.max(0).tolist()], [np.array(ids, np.int64).tobytes()], [m.tobytes()]]
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["block", "shard", "low", "high", "ids", "values"])

        for batch in batches:
            for i, r, p in zip(*[batch.column(c).to_pylist() for c in ("id", "values", "_part")]):
                ids.append(i)
                rows.append(r)
                part = p
                if len(ids) == BLOCK:
                    yield block()
                    at, ids, rows = at + 1, [], []
        if ids:
            yield block()

    return placed.select("id", "values", "_part").mapInArrow(run, "block long, shard long, low array<long>, high array<long>, ids binary, values binary")


def bounds(q: np.ndarray, low: list, high: list) -> np.ndarray:
    """Upper bound of the score of each query with each block. Values and extrema alike have zeros past their end."""
    width = max([q.shape[1], *map(len, low)])
    lo, hi = dense(low, width), dense(high, width)
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return exact(up, hi) + exact(down, lo)


class Best:
    """The k best (score, id) of each query of a chunk so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[q]
        s, i = np.r_[self.scores[q], scores[keep]], np.r_[self.ids[q], ids[keep]]
        order = np.lexsort((i, -s))[:self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], self.scores[q][-1])


def visit(queries: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: list[dict], k: int) -> Best:
    """Top k of every query among the blocks: rounds of each query's next best block.

    queries: ids, values, lower bounds of the k-th score.
    """
    qid, q, floor = queries
    best = Best(len(qid), k, floor.copy())
    if not blocks:
        return best
    top = bounds(q, [b["low"] for b in blocks], [b["high"] for b in blocks])
    order = np.argsort(-top, axis=1, kind="stable")
    ids = [np.frombuffer(b["ids"], np.int64) for b in blocks]
    values = [np.frombuffer(b["values"], np.int64).reshape(len(i), -1) for b, i in zip(blocks, ids)]
    active = np.arange(len(qid))
    for turn in range(len(blocks)):
        nxt = order[active, turn]
        going = top[active, nxt] >= best.floor[active]     # bounds only fall from here on
        active, nxt = active[going], nxt[going]
        if not len(active):
            break
        for b in np.unique(nxt):
            mine = active[nxt == b]
            scores = exact(q[mine], values[b])
            for row, at in zip(scores, mine):
                other = ids[b] != qid[at]
                best.add(at, row[other], ids[b][other])
    return best


LOWEST = -(1 << 62)


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, id, score): each query's k best among all rows but those with its id.

    Both frames have ``id`` and ``values`` (arrays of integers without nulls).
    """
    python_ready(vectors.sparkSession)
    index = stored(build(vectors), "topk-index")
    shards = index.select("shard").distinct()
    asked = stored(queries.withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK)), "topk-queries")
    chunks = asked.select("chunk").distinct()

    # first bounds: the best blocks by their extrema alone, then their k-th score
    grid = _grid(shards, chunks)
    extrema = index.select("shard", "block", "low", "high")

    def leaders(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, rows, _ = _taken(left)
        blocks = right.to_pylist()
        if len(ids) and blocks:
            top = bounds(dense(rows), [b["low"] for b in blocks], [b["high"] for b in blocks])
            pick = np.argsort(-top, axis=1, kind="stable")[:, :FIRST]
            names = np.array([b["block"] for b in blocks])
            each = np.repeat(np.arange(len(ids)), pick.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[each]), pa.array(names[pick.ravel()]), pa.array(top[each, pick.ravel()])], ["id", "block", "bound"])

    led = _meet(asked, extrema, grid, leaders, "id long, block long, bound long")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("bound"), "block"))
    firsts = led.distinct().withColumn("_r", rank).where(F.col("_r") <= FIRST).select("id", "block")
    pairs = firsts.join(asked.dropDuplicates(["id"]).select("id", "values"), "id").join(index.select("block", "ids", F.col("values").alias("all")), "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], []]
            for i, q, ids, all_ in zip(*[batch.column(c).to_pylist() for c in ("id", "values", "ids", "all")]):
                ids = np.frombuffer(ids, np.int64)
                s = exact(dense([q]), np.frombuffer(all_, np.int64).reshape(len(ids), -1))[0][ids != i]
                s = -np.sort(-s)[:k]
                out[0] += [i] * len(s)
                out[1] += s.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "score"])

    seen = pairs.select("id", "values", "ids", "all").mapInArrow(score, "id long, score long")
    kth = (seen.groupBy("id").agg(F.get(F.reverse(F.array_sort(F.collect_list("score"))), k - 1).alias("floor"))
           .withColumnRenamed("id", "_id"))                  # at most FIRST x k scores of a query
    armed = stored(asked.join(kth, F.col("id") == F.col("_id"), "left").select("id", "values", "chunk", F.coalesce("floor", F.lit(LOWEST)).alias("floor")), "topk-armed")

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, rows, floor = _taken(left)
        if len(ids):
            best = visit((ids, dense(rows), floor), right.to_pylist(), k)
            n = list(map(len, best.ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))],
                                             ["query_id", "id", "score"])

    found = _meet(armed, index, grid, run, "query_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _grid(shards: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of queries with every shard: as many rows as tasks, no row of data."""
    return stored(shards.crossJoin(chunks), "topk-grid")


def _meet(queries: DataFrame, blocks: DataFrame, grid: DataFrame, run, schema: str) -> DataFrame:
    """Bring each chunk of queries to each shard of blocks: one group per pair."""
    left = queries.join(grid, "chunk").groupBy("shard", "chunk")
    right = blocks.join(grid, "shard").groupBy("shard", "chunk")
    return left.cogroup(right).applyInArrow(lambda a, b: _first(run(a, b), schema), schema)


def _first(parts: Iterator[pa.RecordBatch], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    got = list(parts)
    return pa.Table.from_batches(got) if got else pa.table({n: pa.array([], pa.int64()) for n in names})


def _taken(t: pa.Table) -> tuple[np.ndarray, list, np.ndarray]:
    floor = t.column("floor").to_numpy() if "floor" in t.column_names else np.full(t.num_rows, LOWEST)
    return t.column("id").to_numpy(), t.column("values").to_pylist(), floor


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of every query."""
    vectors = (table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & finite("embedding"))
               .select(F.col("vec_id").cast("long").alias("id"), numbers("embedding").alias("values")))
    found = search(vectors, vectors.where(F.col("id") % EVERY == 0).dropDuplicates(["id"]))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: The same rows in SQL: every query with every other row.
OP4_SQL = """WITH
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 20"""
