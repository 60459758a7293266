"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Each source has a weight. The sources share a budget of words by weight; a target stops at a
multiple of what its source has, and what exceeds it goes to the others by weight. Within a source,
documents get hash-random keys and are range-sorted; prefix sums of their sizes give every document
its place, and the source is cut at exactly its budget: whole epochs first, then the documents that
lie before the cut, of the one at the cut only the words that fit.

Rows are sorted by (source, key) over range partitions, so a source with a third of all rows is
spread over many tasks. Prefix sums add up partition totals (one row per partition) and running
sums inside a partition: no window ever spans a source. The same helper ranks the sources, so their
number is not limited either.

Defined cases: null texts and texts without words have size 0 and are never taken; a source of size
0 has target 0; a null source is a source of its own, the last; repeated rows are documents of their
own; null ids are ordered last; an empty table gives an empty mix. Reruns agree: order depends on
ids, sizes and source only, and equal rows are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.llm.common import WORD, stored, table

#: Weights of the sources by code point of their name, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: No target exceeds this many times what its source has.
EPOCHS = 3


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def nulls_last(column: str) -> list[Column]:
    return [F.col(column).isNull(), F.col(column)]


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], purpose: str) -> DataFrame:
    """Append sums over all rows before a row in a global order (exclusive), by range partitions.

    The sorted rows are written once, each with its partition; totals by partition (as many rows as
    partitions) give the offsets, and a window inside each partition the rest.
    """
    sort = {f"_o{k}": c for k, c in enumerate(order)}
    keyed = df.withColumns(sort | {f"_v_{n}": c for n, c in sums.items()})
    parts = stored(keyed.repartitionByRange(*sort).sortWithinPartitions(*sort)
                   .withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), purpose)
    totals = parts.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    return (parts.join(F.broadcast(offsets), "_part")
            .withColumns({n: F.col(f"_off_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
            .drop(*sort, "_part", "_seq", *[f"_v_{n}" for n in sums], *[f"_off_{n}" for n in sums]))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, start, target) from one row per source with its ``source_size``.

    ``start`` is the size of all sources before. Sources are ranked by name to get their weights. With
    the sources in order of limit / weight, those whose limit lies below the share that the rest
    would get are at their limit; all others share what remains by weight. This is where resharing
    the excess again and again ends.
    """
    ranked = running_sums(sizes, nulls_last("source"), {"_rank": F.lit(1), "start": F.col("source_size")}, "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    each = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    by_limit = running_sums(each, [(F.col("_cap") / F.col("_w")), F.col("_rank")],
                            {"_caps": F.col("_cap"), "_ws": F.col("_w")}, "mix-limits")
    whole = by_limit.agg(F.sum("source_size").cast("double").alias("_all"), F.sum("_w").alias("_all_w"))
    share = (F.col("_all") - F.col("_caps")) / (F.col("_all_w") - F.col("_ws"))
    at = by_limit.crossJoin(F.broadcast(whole)).withColumn("_share", share)          # one row of totals
    free = at.where(F.col("_cap") / F.col("_w") > F.col("_share"))
    level = free.agg(F.min_by("_share", "_caps").alias("_level"))                     # of the first source below its limit
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return at.crossJoin(F.broadcast(level)).select("source", "source_size", "start", target.alias("target"))


def mix(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", seed: int = 0,
        weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Append size, source_size, target, taken, copies and cut_words to every document.

    ``taken`` words = ``copies`` times the whole document + ``cut_words`` of one more copy.
    """
    held = (docs.withColumn("_size", size).drop("size", "source_size", "target", "taken", "copies", "cut_words")
            .withColumnRenamed("_size", "size"))
    per = stored(held.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size")), "mix-sources")
    goals = targets(per, weights, epochs).withColumnRenamed("source", "_source")
    order = [*nulls_last(source), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), *nulls_last(key), F.col("size")]
    placed = running_sums(held, order, {"_before": F.col("size")}, "mix-sorted")
    joined = placed.join(goals, F.col(source).eqNullSafe(F.col("_source")))
    budget = F.floor(F.col("target"))
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - full * F.col("source_size") - (F.col("_before") - F.col("start"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long")
    whole = (part == F.col("size")) & (F.col("size") > 0)
    return (joined
            .withColumn("taken", full * F.col("size") + part)
            .withColumn("copies", F.when(F.col("size") > 0, full + whole.cast("long")).otherwise(F.lit(0)).cast("long"))
            .withColumn("cut_words", F.when(whole, F.lit(0)).otherwise(part).cast("long"))
            .drop("_source", "start", "_before"))


def rows_of(mixed: DataFrame) -> DataFrame:
    """The mix as rows: every document as often as it is taken. The document at a source's cut comes
    once more if at least half of it fits, so no text is cut."""
    n = F.col("copies") + (F.col("cut_words") * 2 >= F.col("size")).cast("long") * (F.col("cut_words") > 0).cast("long")
    return (mixed.withColumn("_n", n).where(F.col("_n") > 0)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n", "_copy"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = stored(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    return mix(sized, F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "cut_words")


#: The same rows in SQL: targets by limits in order, cuts by windows over each source.
OP10_SQL = r"""WITH
d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM p),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS n FROM w),
t AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share FROM l),
g AS (SELECT min_by(share, n) AS level FROM t WHERE cap / w > share),
s AS (SELECT t.source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM t, g),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d),
j AS (SELECT o.doc_id, o.size, s.source_size, s.target, o.source, o.before, CASE WHEN s.source_size > 0 THEN floor(floor(s.target) / s.source_size) ELSE 0 END AS epochs
  FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source),
k AS (SELECT *, greatest(0, least(size, floor(target) - epochs * source_size - before)) AS part FROM j)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken, source,
  CASE WHEN size > 0 THEN epochs + (part = size)::INT ELSE 0 END::BIGINT AS copies, CASE WHEN part = size THEN 0 ELSE part END::BIGINT AS cut_words FROM k"""
