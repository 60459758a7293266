"""Exact substring dedup by suffix arrays, built with the difference-cover method on dealt text.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier. A suffix array of
all bytes in one piece would shuffle every byte several times over; so the text is first dealt to
shards in which all equal strings meet:

1. Every window of ``LENGTH`` bytes picks an anchor, the ``GRAM``-byte gram in it with the smallest hash.
   Equal windows pick equal anchors. Neighbouring windows with the same anchor form a unit; units tile
   the windows of a document.
2. Units whose anchor gram occurs once hold no repeated window and are left. Of the rest, equal units
   (same bytes, same place of the anchor) form a class; all members but the earliest are repeats.
3. The earliest members of the classes that share a gram are dealt to one shard, and its suffix array
   is built by the difference cover modulo 3: sort the triples at two thirds of the places, name
   them, recurse on the names until they differ, sort the remaining suffixes by one byte and a rank, and merge.
   Windows whose neighbours in the array agree in ``LENGTH`` bytes are equal; all but the earliest are repeats.
4. Repeated windows come back to their documents as intervals, and their union is cut out.

Grams that a task meets very often are known to repeat and, but for one place, are spread by a salt; a gram with very many
classes is cut into blocks that meet in pairs (a window is a repeat if any pair says so). Every join
that may meet a hot key has plain exchanges on both sides, so AQE can split it.

Defined cases: null texts are empty; documents shorter than ``LENGTH`` lose nothing; order is by id
and then by start (null ids last), so rows that share an id and a start are not earlier than
each other; repeated rows get the same result; equality of units rests on two 64-bit hashes; texts of any length are handled in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.llm.blocks import groups
from zonalis.llm.common import append, blocked_pairs, python_ready, sieve, sifted, sliced, stored, table

LENGTH = 100
GRAM = 50
#: Windows that one step of the anchor search handles; bytes of one suffix array.
PIECE = 1 << 19
BATCH = 1 << 20
#: Occurrences in one batch of documents from which a gram is spread, and over how many keys.
OFTEN, SALTS = 16, 64
LAST = (1 << 63) - 1

BASE = 0x9E3779B97F4A7C15
_power = np.cumprod(np.full(PIECE + 4096, BASE, np.uint64))
_inverse = np.cumprod(np.full(PIECE + 4096, pow(BASE, -1, 1 << 64), np.uint64))
PLACE = np.uint64((1 << 20) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def units(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, unit hash, first window, place of the anchor in the unit, windows) of all units, piece by piece."""
    wide = length - gram + 1                               # grams in a window
    for base in range(0, len(text) - length + 1, PIECE):
        part = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - base), base)
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power[:n], out=sums[1:])
        g = mixed((sums[gram:] - sums[:-gram]) * _inverse[:n - gram + 1])
        m = len(g)
        # smallest (hash, place) in each stretch of `wide` grams: minima from both ends of blocks
        key = np.full(-(-m // wide) * wide, ~np.uint64(0))
        key[:m] = (g & ~PLACE) | np.arange(m, dtype=np.uint64)
        rows = key.reshape(-1, wide)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        anchor = (np.minimum(back[:m - wide + 1], ahead[wide - 1:m]) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[first, len(anchor)])
        at = anchor[first] - first
        body = (sums[first + count - 1 + length] - sums[first]) * _inverse[first]
        yield g[anchor[first]], mixed(body + mixed((at * 4096 + count).astype(np.uint64))), first + base, at, count


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    if int(s.max()) > n + 256:                             # so that products below stay within 64 bits
        s = np.unique(s, return_inverse=True)[1] + 1
    p = np.zeros(n + 4, np.int64)
    p[:n] = s
    # with n = 1 mod 3 the empty suffix at n is sampled too, so that every remaining suffix has a sampled next
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.r_[ones, twos]
    top = int(p.max()) + 1
    if top < 1 << 21:
        triple = (p[sample] * top + p[sample + 1]) * top + p[sample + 2]
    else:
        pair = np.unique(p[sample] * top + p[sample + 1], return_inverse=True)[1]
        triple = pair * top + p[sample + 2]
    order = np.argsort(triple, kind="stable")
    new = np.r_[True, triple[order][1:] != triple[order][:-1]]
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(name)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    # remaining suffixes: one symbol, then a sampled suffix
    rest = np.arange(0, n, 3)
    size = len(sample) + 2
    by_one = p[rest] * size + rank[rest + 1]
    rest = rest[np.argsort(by_one, kind="stable")]
    sampled = sample[order]
    sampled = sampled[sampled < n]
    # merge: how many sampled suffixes of either kind lie before each remaining one
    a, b = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(p[a] * size + rank[a + 1], p[rest] * size + rank[rest + 1])
    two = p[np.r_[b, rest]] * top + p[np.r_[b, rest] + 1]
    dense = np.unique(two, return_inverse=True)[1]
    before = before + np.searchsorted(dense[:len(b)] * size + rank[b + 2], dense[len(b):] * size + rank[rest + 2])
    out = np.empty(n, np.int64)
    to = before + np.arange(len(rest))
    out[to] = rest
    free = np.ones(n, bool)
    free[to] = False
    out[free] = sampled
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts in suffix order, number of their class): classes agree in ``length`` symbols."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    array = suffix_array(text.astype(np.int64) + 1)
    array = array[wanted[array]]
    padded = np.ascontiguousarray(text)
    same = np.zeros(max(0, len(array) - 1), bool)
    view = np.lib.stride_tricks.sliding_window_view(padded, length)
    for k in range(0, len(same), 100_000):
        same[k:k + 100_000] = (view[array[k:k + 100_000][:len(same) - k]] == view[array[k + 1:k + 100_001]]).all(1)
    return array, np.cumsum(np.r_[True, ~same])[:len(array)]


def _anchored(docs: DataFrame) -> DataFrame:
    """(gram, unit, doc, sub, packed) of every unit; packed: first window, place of the anchor,
    windows, whether it is known to repeat, whether it is salted."""
    names = ["gram", "unit", "doc", "sub", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
            for doc, sub, text in zip(*[batch.column(c).to_pylist() for c in ("doc", "sub", "text")]):
                for g, u, first, at, count in units(text.encode()):
                    for c, x in zip(cols, (g.view(np.int64), u.view(np.int64), np.full(len(g), doc), np.full(len(g), sub), (first << 18) | (at << 10) | (count << 2))):
                        c.append(x)
            gram, unit, doc, sub, packed = (np.concatenate(c) for c in cols)
            del cols
            # what is met often here is known to repeat; all but its first place here is salted, and that
            # one stands for it beside single places elsewhere
            _, head, where, n = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
            known = n[where] >= OFTEN
            packed |= (known << 1) | (known & (np.arange(len(gram)) != head[where]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (gram, unit, doc, sub, packed)], names)

    return docs.mapInArrow(run, "gram long, unit long, doc long, sub long, packed long")


def first_window(packed: str) -> Column:
    return F.shiftright(packed, 18)


def windows(packed: str) -> Column:
    return F.shiftright(packed, 2).bitwiseAND(F.lit(255))


KEYS = ["gram", "left_block", "right_block"]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, unit, doc, start, end): stretches of windows that occur earlier, from pieces of text by gram."""
    names = ["gram", "unit", "doc", "start", "end"]
    held: list[pa.Table] = []
    size = 0

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        pieces = rows.column("piece").to_pylist()
        gram, unit, doc, packed = (rows.column(c).to_numpy() for c in ("gram", "unit", "doc", "packed"))
        first, count = packed >> 18, (packed >> 2) & 255
        text = np.frombuffer(b"".join(pieces) + bytes(LENGTH), np.uint8)
        begin = np.cumsum([0, *map(len, pieces)])[:-1]
        row = np.repeat(np.arange(len(pieces)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = begin[row] + step
        order, cls = equal_windows(text, start)
        back = np.empty(len(text), np.int64)
        back[start] = np.arange(len(start))
        w = back[order]                                    # windows in suffix order
        docs, places = doc[row[w]], first[row[w]] + step[w]
        best = np.lexsort((places, docs, cls))
        head = best[np.r_[True, cls[best][1:] != cls[best][:-1]]] if len(best) else best
        lead = head[np.cumsum(np.r_[True, cls[1:] != cls[:-1]])[:len(cls)] - 1] if len(cls) else head
        repeat = np.zeros(len(start), bool)
        repeat[w] = (docs != docs[lead]) | (places != places[lead])
        # neighbouring repeated windows of a unit as one stretch
        hit = np.flatnonzero(repeat)
        cut = np.r_[True, (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)][:len(hit)]
        a = hit[cut]
        b = hit[np.r_[np.flatnonzero(cut)[1:], len(hit)] - 1] if len(hit) else hit
        r = row[a]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[r], unit[r], doc[r], first[r] + step[a], first[r] + step[b] + LENGTH)], names)

    for rows, _ in groups(batches, KEYS):                  # whole groups only
        held.append(rows)
        size += rows.column("piece").nbytes
        if size >= BATCH:
            yield solve(pa.concat_tables(held))
            held, size = [], 0
    if held:
        yield solve(pa.concat_tables(held))


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc, sub, start, end) byte intervals that repeat earlier text; docs: (doc, sub, text)."""
    python_ready(docs.sparkSession)
    salt = F.when(F.col("packed").bitwiseAND(F.lit(1)) == 1, F.pmod(F.xxhash64("doc", "packed"), F.lit(SALTS))).otherwise(F.lit(0))
    every = _anchored(docs).withColumn("_salt", salt)
    seen = F.count(F.lit(1)).over(Window.partitionBy("gram", "_salt"))
    again = stored(every.withColumn("_n", seen).where((F.col("_n") > 1) | (F.col("packed").bitwiseAND(F.lit(2)) != 0)).drop("_n", "_salt")
                   .withColumn("packed", F.shiftleft(F.shiftright("packed", 2), 2)), "suffix-units")
    place = F.struct(F.col("doc"), first_window("packed").alias("start"), F.col("packed"), F.col("sub"))
    classes = stored(again.groupBy("gram", "unit").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "suffix-classes")
    several = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > 1).select("gram")
    heads = classes.join(several, "gram", "left_semi").select("gram", "unit", "first.doc", "first.sub", "first.packed")
    # the bytes of the earliest members, fetched from their documents
    per_doc = heads.groupBy("doc", "sub").agg(F.collect_list(F.struct("gram", "unit", "packed")).alias("parts"))
    per_doc = stored(per_doc, "suffix-wanted")
    wanted = sifted(docs, "doc", sieve(per_doc, "doc")).where("_maybe")          # only texts that may be asked for move
    held = per_doc.join(wanted.select(F.col("doc").alias("_doc"), F.col("sub").alias("_sub"), "text"), (F.col("doc") == F.col("_doc")) & (F.col("sub") == F.col("_sub")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, parts, text in zip(*[batch.column(c).to_pylist() for c in ("doc", "parts", "text")]):
                raw = text.encode()
                for x in parts:
                    start, count = x["packed"] >> 18, (x["packed"] >> 2) & 255
                    for c, v in zip(out, (x["gram"], x["unit"], doc, x["packed"], raw[start:start + count - 1 + LENGTH])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.binary())], ["gram", "unit", "doc", "packed", "piece"])

    pieces = held.select("doc", "parts", "text").mapInArrow(fetch, "gram long, unit long, doc long, packed long, piece binary").dropDuplicates(["gram", "unit"])
    dealt = blocked_pairs(stored(pieces, "suffix-pieces"), ["gram"], ["unit"])
    sorted_ = dealt.select(*KEYS, "unit", "doc", "packed", "piece").repartition(F.xxhash64(*KEYS)).sortWithinPartitions(*KEYS)
    found = stored(sorted_.mapInArrow(_repeats, "gram long, unit long, doc long, start long, end long"), "suffix-repeats")
    # what repeats inside the earliest member of a class, for all rows that share its place
    ends = classes.select(F.col("gram").alias("_g"), F.col("unit").alias("_u"), F.col("first.doc").alias("_d"), F.col("first.start").alias("_s")).where(F.col("n") > 1)
    later = (again.join(ends, (F.col("gram") == F.col("_g")) & (F.col("unit") == F.col("_u")))
             .select("gram", "unit", "doc", "sub", first_window("packed").alias("start"), windows("packed").alias("_w"),
                     ((F.col("doc") == F.col("_d")) & (first_window("packed") == F.col("_s"))).alias("_first")))
    whole = later.where(~F.col("_first")).select("doc", "sub", "start", (F.col("start") + F.col("_w") - 1 + LENGTH).alias("end"))
    lead = classes.select(F.col("gram").alias("_g"), F.col("unit").alias("_u"), F.col("first.sub").alias("sub"))
    part = found.join(lead, (F.col("gram") == F.col("_g")) & (F.col("unit") == F.col("_u"))).select("doc", "sub", "start", "end")
    ties = later.where("_first").select(F.col("gram").alias("_g"), F.col("unit").alias("_u"), F.col("sub").alias("_sub"))
    tied = found.join(ties, (F.col("gram") == F.col("_g")) & (F.col("unit") == F.col("_u"))).select("doc", F.col("_sub").alias("sub"), "start", "end")
    return whole.union(part).union(tied)


def union_of(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Append ``removed`` (byte intervals) and ``kept`` (the remaining bytes) to every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    named = docs.select(doc.alias("doc"), F.xxhash64(body).alias("h"))
    # rows of one id with different texts are told apart by a hash; where there are none, it is left out
    mixed_ids = not named.groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").isEmpty()
    sub = F.xxhash64(body) if mixed_ids else F.lit(0).cast("long")
    found = repeated_intervals(docs.select(doc.alias("doc"), sub.alias("sub"), body.alias("text")))
    per = stored(found.groupBy(F.col("doc").alias("_doc"), F.col("sub").alias("_sub")).agg(F.collect_list(F.struct("start", "end")).alias("_spans")), "suffix-intervals")
    # documents that surely have no repeat stay where they are
    told = sifted(docs.withColumns({"_d": doc, "_s": sub}), "_d", sieve(per, "_doc"))
    some = told.where("_maybe").join(per, (F.col("_d") == F.col("_doc")) & (F.col("_s") == F.col("_sub")), "left").drop("_doc", "_sub")
    none = told.where("NOT _maybe").withColumn("_spans", F.lit(None).cast(per.schema["_spans"].dataType))
    joined = some.unionByName(none).drop("_d", "_s", "_maybe")

    def work(texts: list, spans: list) -> list:
        removed, kept = [], []
        for t, s in zip(texts, spans):
            raw, cut = (t or "").encode(), union_of([(x["start"], x["end"]) for x in s or ()])
            ends = [0, *[x for ab in cut for x in ab], len(raw)]
            removed.append([{"start": a, "end": b} for a, b in cut])
            kept.append(b"".join([raw[a:b] for a, b in zip(ends[::2], ends[1::2])]))
        return [removed, kept]

    return append(joined.withColumn("_text", F.col(text)), ["_text", "_spans"], "removed array<struct<start:long,end:long>>, kept binary", work)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return done.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
