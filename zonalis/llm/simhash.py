"""SimHash near-duplicates through vantage-point trees.

A fingerprint has 64 bits. Every level of a tree has a vantage point and a block of bits on which it
measures Hamming distance; a node's children are the rings of equal distance. Distances over disjoint
blocks add up to the Hamming distance, so the triangle bounds of the levels add up too: if x and y
differ in d bits, the sum over levels of |dist(x, v) - dist(y, v)| is at most d. A branch is pruned
as soon as that sum exceeds the radius.

Two trees with the bits split between them partition the fingerprints into shards (the paths of ring
numbers over ``LEVELS`` levels). Two fingerprints within radius r differ in at most r // 2 bits on
the bits of one of the trees; there, their paths differ by at most r // 2 in sum. A fingerprint
therefore goes to its own shard and to the shards that overlap its boundary on the upper side; every
pair within the radius is compared in exactly one shard of such a tree, and no pair is missed.

Only distinct fingerprints are indexed, each with its smallest id. Shards that hold very many are cut
into blocks that meet in pairs. A task returns links that connect what it found (not all pairs within
a group); components then come from star contractions. Nothing is collected to the driver.

Defined cases: null texts and texts without words have fingerprint zero; fewer words than a shingle
make one shingle of all; repeated rows and null ids keep their rows (null ids take part in no
component id); texts of any length are hashed whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations_with_replacement
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.blocks import groups, meetings, stars
from zonalis.llm.common import WORD, append, blocked_pairs, python_ready, stored, table
from zonalis.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
LEVELS = 8
#: Bits of one level's block: two trees of LEVELS levels share 64 bits.
STEP = 64 // (2 * LEVELS)

_words = re.compile(WORD).findall
_lower = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, repeats included."""
    text = text or ""
    words = _words(text.lower() if text.isascii() else text.translate(_lower))
    if not words:
        return 0
    shingles = map(" ".join, zip(*[words[k:] for k in range(size)])) if len(words) >= size else [" ".join(words)]
    h = np.fromiter([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):                      # bounded memory for very long texts
        ones += np.unpackbits(h[at:at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h))
    return int.from_bytes(bits.tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Append the fingerprint of a text column as a signed 64-bit integer."""
    return append(docs, [text], f"`{out}` long", lambda texts: [[signed(fingerprint(t)) for t in texts]])


def rings(fp: str, tree: int, vantage: tuple[int, ...]) -> list[Column]:
    """Ring numbers (distance to the level's vantage point on its block of bits) along a tree."""
    mask = (1 << STEP) - 1
    return [F.bit_count(F.shiftrightunsigned(F.col(fp), STEP * (tree * LEVELS + k)).bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(v))).cast("int")
            for k, v in enumerate(vantage)]


def vantage_points(fps: DataFrame, tree: int) -> tuple[int, ...]:
    """Per level, the more frequent bit values of the block: a corner that is far from the average
    fingerprint's opposite, so that rings spread. One aggregation over all fingerprints, 64 sums."""
    bits = range(STEP * tree * LEVELS, STEP * (tree + 1) * LEVELS)
    row = fps.agg(*[F.avg(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in bits]).first()
    return tuple(sum(((row[f"b{b}"] or 0) > 0.5) << (b % STEP) for b in bits if b // STEP == tree * LEVELS + k) for k in range(LEVELS))


def shards(fps: DataFrame, tree: int, vantage: tuple[int, ...], reach: int) -> DataFrame:
    """Deal fingerprints to the shards of a tree: their own, and those that overlap their boundary.

    Two paths within ``reach`` in sum meet at their elementwise maximum, which each reaches by upward
    moves of at most ``reach`` in sum; so a row goes to every path reached by such moves. ``moved``
    has a bit per level that was moved: a pair is due in the one shard where no level was moved by both.
    """
    moves = [pick for n in range(reach + 1) for pick in combinations_with_replacement(range(LEVELS), n)]
    # a ring number has under 16 values: a path is one hexadecimal digit per level
    path = reduce(add, [r.cast("long") * F.lit(16 ** k) for k, r in enumerate(rings("fp", tree, vantage))])
    steps = F.array(*[F.struct(F.lit(sum(16 ** k for k in pick)).cast("long").alias("by"),
                               F.lit(sum({1 << k for k in pick})).cast("int").alias("moved")) for pick in moves])
    return (fps.withColumn("_path", path).withColumn("_step", F.explode(steps))
            .select("fp", "id", (F.col("_path") + F.col("_step.by")).alias("shard"), F.col("_step.moved").alias("moved")))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) ids whose links connect exactly what pairs within the radius connect.

    ``fps``: one row per distinct fingerprint, with ``fp`` and ``id``.
    """
    python_ready(fps.sparkSession)
    reach = radius // 2
    out = None
    for tree in (0, 1):
        dealt = shards(fps, tree, vantage_points(fps, tree), reach)
        blocks = blocked_pairs(dealt, ["shard"], ["fp"])
        key = F.xxhash64("shard", "left_block", "right_block")

        # many small shards per task: sorted by shard, cut where the shard changes
        part = (blocks.select(*KEYS, "own_block", "moved", "fp", "id")
                .repartition(key).sortWithinPartitions(*KEYS))
        found = part.mapInArrow(_stars_of(radius), "a long, b long")
        out = found if out is None else out.union(found)
    return out


KEYS = ["shard", "left_block", "right_block"]


def _stars_of(radius: int) -> Callable:
    """For each stretch of shards, links that connect what their near pairs connect."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in groups(batches, KEYS):
            fp = rows.column("fp").to_numpy().view(np.uint64)
            own, left, right, moved, ids = (rows.column(c).to_numpy() for c in ("own_block", "left_block", "right_block", "moved", "id"))

            def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return ((moved[x] & moved[y]) == 0) & (np.bitwise_count(fp[x] ^ fp[y]) <= radius)

            for x, y in meetings(starts, rows.num_rows, own, left, right, near):
                a, b = stars(rows.num_rows, x, y) if len(x) else (x, y)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])
    return run


def _classes(each: DataFrame, radius: int) -> DataFrame:
    """(fp, id, component_id) per distinct fingerprint, from one (id, fp) row per document."""
    distinct = stored(each.groupBy("fp").agg(F.min("id").alias("id")), "distinct-fingerprints")
    joined = components(links(distinct.where(F.col("id").isNotNull()), radius), "a", "b")
    return (distinct.join(joined, F.col("id") == F.col("node"), "left")
            .select("fp", "id", F.coalesce("component", "id").alias("component_id")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) of every row: the smallest key reachable over near fingerprints."""
    each = stored(fingerprints(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))).select("id", "fp"), "fingerprints")
    classes = stored(_classes(each, radius).select(F.col("fp").alias("_fp"), "component_id"), "classes")
    return (each.join(classes, F.col("fp") == F.col("_fp"))          # exchanges only below it: AQE splits a hot fingerprint
            .select(F.col("id").alias(key), "fp", "component_id"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per group of near-duplicates, of those with the smallest key.

    Groups are made of fingerprints, so rows that share a key but not a text are judged apart. Of rows with
    the same key and fingerprint one stays, by a fixed order. Of rows without a key, a group without any key keeps one.
    """
    each = stored(fingerprints(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))).select("id", "fp"), "fingerprints")
    distinct = stored(each.groupBy("fp").agg(F.min("id").alias("id")), "distinct-fingerprints")
    joined = components(links(distinct.where(F.col("id").isNotNull()).select("fp", F.col("fp").alias("id")), radius), "a", "b")
    heads = (distinct.join(joined, F.col("fp") == F.col("node"), "left")
             .groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min(F.struct("id", "fp")).alias("head")))
    firsts = stored(heads.select("head.fp", "head.id"), "keepers")

    # only keys with several fingerprints need those of their rows again; stored, so that a short list moves instead of the rows
    mixed = stored(each.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
                   .where(F.col("low") != F.col("high")).select(F.col("id").alias("_mixed")), "mixed-keys")
    told = docs.where(F.col(key).isNotNull()).join(mixed, F.col(key) == F.col("_mixed"), "left")
    told = fingerprints(told.withColumn("_text", F.when(F.col("_mixed").isNotNull(), F.col(text))), "_text", "_fp")
    ids = (firsts.where(F.col("id").isNotNull()).join(mixed, F.col("id") == F.col("_mixed"), "left")
           .select(F.col("id").alias("_id"), F.when(F.col("_mixed").isNotNull(), F.col("fp")).otherwise(F.lit(fingerprint(None))).alias("_own")))
    named = told.join(ids, (F.col(key) == F.col("_id")) & (F.col("_fp") == F.col("_own")), "left_semi")
    bare = fingerprints(docs.where(F.col(key).isNull()), text, "_fp")
    alone = firsts.where(F.col("id").isNull()).select(F.col("fp").alias("_alone"))
    rest = bare.join(alone, F.col("_fp") == F.col("_alone"), "left_semi")
    return _one_row(named, [key, "_fp"], docs.columns, text).unionByName(_one_row(rest, ["_fp"], docs.columns, text))


def _one_row(rows: DataFrame, by: list[str], columns: list[str], text: str) -> DataFrame:
    """The row of each group whose hash is the smallest: the same one in every run."""
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns if c != text]))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return rows.groupBy(*by).agg(F.min_by(row, F.xxhash64(F.col(text), others)).alias("_row")).select("_row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
