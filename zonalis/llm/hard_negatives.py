"""Hard negatives by a vertical scan over columnar dimensions.

Rows lie in blocks, a block dimension by dimension, with the least and the greatest value of each. For an
anchor the dimensions are read in descending order of its own magnitudes. What is still unread adds at most
(at least) the sum over those dimensions of the larger (smaller) of anchor x greatest and anchor x least, so
every candidate has an upper and a lower bound after each step. A bitmap keeps the candidates whose bounds still
allow them a place; it shrinks until all dimensions of those left are read and their scores exact.

Two scans. The first finds each anchor's positives, the best rows of its own label. Each positive opens a window of
scores; the second scan finds the best rows of other labels inside each window. A candidate leaves the second
scan once it can be in no window, or once as many rows as asked for surely are in the window and above it.

On Spark: the anchors are stated against all rows, block by block. A task holds one block and anchors stream past
it, so memory is bounded by a block and only anchors, never rows, are copied. Rows are range-sorted by their
strongest dimensions, so that those of a block are alike and the bounds tight; a hash among the sort keys
splits equal rows. Labels play no part in the dealing, so a frequent label is no hot key.

Defined cases: rows with a null id or label, a null vector, or null or non-finite components take no part; shorter vectors
count as filled with zeros, however long the longest. An anchor never meets rows of its own id; of several rows
with an anchor's id the least (label, values) is the anchor. Repeated rows are results of their own, equal ids
in any order. Ties go to the smaller id. Anchors without positives, and windows without rows, give no rows; an empty table none.
Only id, label and vector are read, so other columns do not matter. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.llm.common import python_ready, stored, table
from zonalis.llm.topk import finite, numbers, order_key

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these hundredths of the positive's score.
LEAST, MOST = 50, 95
#: Rows of a block, dimensions read between two looks at the bounds, candidates few enough to finish at once.
BLOCK, STEP, FEW = 8192, 8, 32


@dataclass
class Block:
    """Rows by dimension: values[d] holds dimension d of all of them."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        self.low, self.high = self.values.min(1), self.values.max(1)
        self.most = float(np.abs(self.values).max(initial=0))

    def exact(self, q: np.ndarray) -> bool:
        """Whether floating point holds every sum of products."""
        return self.most * float(np.abs(q).max(initial=0)) * max(1, len(self.values)) < 2.0 ** 53

    def as_float(self) -> np.ndarray:
        if not hasattr(self, "_float"):
            self._float = self.values.astype(float)
        return self._float


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, keep, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the candidates that stay, scores exact.

    ``keep(lower, upper)`` tells from bounds of the scores which candidates stay. ``read``, if given, collects
    how many components were read.
    """
    n = max(len(anchor), len(block.values))
    q = np.pad(anchor, (0, n - len(anchor)))[:len(block.values)]             # the rest meets zeros
    kind = float if block.exact(q) else np.int64
    values = block.as_float() if kind is float else block.values
    q = q.astype(kind)
    order = np.argsort(-np.abs(q), kind="stable")
    ends = q * block.low, q * block.high
    up, down = np.maximum(*ends)[order], np.minimum(*ends)[order]
    rest_up, rest_down = (np.r_[np.cumsum(x[::-1])[::-1], 0] for x in (up, down))
    at = np.flatnonzero(alive)
    part = np.zeros(len(at), kind)
    done = 0
    while done < len(order) and len(at):
        step = STEP if len(at) > FEW else len(order) - done
        dims = order[done:done + step]
        part += q[dims] @ (values[dims] if len(at) == values.shape[1] else values[np.ix_(dims, at)])
        done += len(dims)
        if read is not None:
            read.append(len(dims) * len(at))
        stay = keep(part + rest_down[done], part + rest_up[done])
        if not stay.all():
            at, part = at[stay], part[stay]
    return at, part.astype(np.int64)


def kth(values: np.ndarray, k: int):
    """The k-th greatest, None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def positives(block: Block, anchor_id: int, label: int, values: np.ndarray, k: int, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the block's k best rows of the anchor's label."""
    def keep(low: np.ndarray, up: np.ndarray) -> np.ndarray:
        bar = kth(low, k)
        return np.ones(len(low), bool) if bar is None else up >= bar

    at, scores = scan(block, values, (block.labels == label) & (block.ids != anchor_id), keep, read)
    return best(block.ids[at], scores, k)


def window(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The least and the greatest score of a negative."""
    return -(-least * score // 100), most * score // 100


def negatives(block: Block, anchor_id: int, label: int, values: np.ndarray, windows: list[tuple[int, int]], k: int,
              read: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per window, (ids, scores) of the block's k best rows of other labels in it."""
    different = list(dict.fromkeys(w for w in windows if w[0] <= w[1]))

    def keep(low: np.ndarray, up: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for lo, hi in different:
            surely = low[(low >= lo) & (up <= hi)]
            bar = kth(surely, k)
            stay |= (up >= (lo if bar is None else bar)) & (low <= hi)
        return stay

    nothing = np.zeros(0, np.int64)
    at, scores = scan(block, values, (block.labels != label) & (block.ids != anchor_id), keep, read) if different else (nothing, nothing)
    ids = block.ids[at]
    found = {(lo, hi): best(ids[ok], scores[ok], k) for lo, hi in different for ok in [(scores >= lo) & (scores <= hi)]}
    return [found.get(w, (nothing, nothing)) for w in windows]


# Spark -----------------------------------------------------------------------------------------
BLOCKS = "block long, ids binary, labels binary, dims binary"


def build(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of at most ``size`` rows of (id, label, values), numbered from 0."""
    python_ready(rows.sparkSession)
    n = max(1, -(-rows.count() // size))
    keyed = rows.withColumn("_key", order_key("values")).withColumn("_salt", F.xxhash64("id", F.monotonically_increasing_id()))
    placed = keyed.repartitionByRange(n, "_key", "id", "_salt").sortWithinPartitions("_key", "id", "_salt").select("id", "label", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(some: list[tuple]) -> pa.RecordBatch:
            width = max(len(v) for _, _, v in some)
            m = np.zeros((width, len(some)), np.int64)
            for k, (_, _, v) in enumerate(some):
                m[:len(v), k] = v
            cols = [np.array([x[c] for x in some], np.int64).tobytes() for c in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (*cols, m.tobytes())], ["ids", "labels", "dims"])

        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            while len(held) >= size:
                yield out(held[:size])
                held = held[size:]
        if held:
            yield out(held)

    made = stored(placed.mapInArrow(run, "ids binary, labels binary, dims binary"), "columns")
    # a number for each of the few block rows; neither rows nor vectors pass through the window
    names = made.select(F.monotonically_increasing_id().alias("_n"))
    place = names.select("_n", (F.row_number().over(Window.orderBy("_n")) - 1).cast("long").alias("block"))
    return made.withColumn("_n", F.monotonically_increasing_id()).join(place, "_n").select("block", "ids", "labels", "dims")


def _meet(anchors: DataFrame, blocks: DataFrame, n: int, run, schema: str) -> DataFrame:
    """Let all anchors (id, label, packed, windows) pass every block: one task per block."""
    none = {"id": "long", "label": "long", "packed": "binary", "windows": "binary"}
    left = blocks.select("block", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "ids", "labels", "dims")
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias("block"), F.lit(1).alias("kind"), *none,
                           *[F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "dims")])
    # the block is the partition: AQE neither splits nor joins them, and no two share a task
    dealt = left.unionByName(right).repartitionById(n, F.col("block").cast("int")).sortWithinPartitions("block", "kind")
    names = [c.split()[0] for c in schema.split(", ")]

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    ids = np.frombuffer(r["ids"], np.int64)
                    block = Block(ids, np.frombuffer(r["labels"], np.int64), np.frombuffer(r["dims"], np.int64).reshape(-1, len(ids)))
                elif block is not None:
                    rows += run(block, r["id"], r["label"], np.frombuffer(r["packed"], np.int64), np.frombuffer(r["windows"] or b"", np.int64))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=names)

    return dealt.mapInArrow(passing, schema)


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         least: int = LEAST, most: int = MOST, size: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both frames have ``id``, ``label`` and ``values`` (arrays of integers without nulls); anchors are rows too.
    """
    blocks = stored(build(stored(rows.select("id", F.col("label").cast("long").alias("label"), "values"), "rows"), size), "blocks")
    n = blocks.count()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.array(v, np.int64).tobytes() for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.binary())], ["id", "label", "packed"])

    one = anchors.groupBy("id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "values")).alias("_a")).select("id", "_a.label", "_a.values")
    asked = stored(one.mapInArrow(packed, "id long, label long, packed binary"), "anchors")

    def first(block: Block, i: int, label: int, v: np.ndarray, _: np.ndarray) -> list[tuple]:
        return [(i, int(x), int(s)) for x, s in zip(*positives(block, i, label, v, n_positives))]

    seen = _meet(asked.withColumn("windows", F.lit(None).cast("binary")), blocks, max(1, n), first, "anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = stored(seen.withColumn("place", rank.cast("long")).where(F.col("place") <= n_positives), "positives")
    # at most n_positives windows of an anchor
    several = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("_w"))
    armed = asked.join(several.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "packed", "_w.place", "_w.positive_score")

    def with_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [np.array([p, s], np.int64).tobytes() for p, s in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(blobs, pa.binary())], ["id", "label", "packed", "windows"])

    armed = stored(armed.mapInArrow(with_windows, "id long, label long, packed binary, windows binary"), "windows")

    def second(block: Block, i: int, label: int, v: np.ndarray, told: np.ndarray) -> list[tuple]:
        places, scores = told.reshape(2, -1)
        got = negatives(block, i, label, v, [window(int(s), least, most) for s in scores], n_negatives)
        return [(i, int(p), int(x), int(s)) for p, (ids, found) in zip(places, got) for x, s in zip(ids, found)]

    near = _meet(armed, blocks, max(1, n), second, "anchor_id long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    kept = near.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return (kept.join(chosen, ["anchor_id", "place"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = (table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
            .select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), numbers("embedding", 256).alias("values")))
    return mine(rows, rows.where(F.col("id") % 50 == 0))


#: The same rows in SQL: every anchor with every other row.
OP12_SQL = """WITH
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
