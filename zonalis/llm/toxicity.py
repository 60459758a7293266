"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of the labelled documents (``SAMPLE`` of each label, the least by a hash of the id).
The terms of a text are its words, the ``BEGINNINGS`` of its longer words, and each of these once more for every number of
``OFTEN`` that it reaches (a cosine alone cannot tell once from often). A vector has the terms that tell the labels apart
in the sample: those in at least ``MARGIN`` more of the documents of one label than of the other, by more than
chance (G2 of at least ``SURE``), the ``TERMS`` most telling at most. Weights are (1 + ln tf) x idf, with document frequencies over all documents, scaled to length one.

The index lists, per term, the blocks of examples that hold it with the greatest weight there, and the postings of each
block. For a text the greatest weights, summed over its terms, bound the cosine of every example of a block; blocks are
scored in descending order of the bound until it falls below the k-th cosine found. So the ``NEAREST`` examples are exact.
They vote with weight 1 / (distance + ``SOFT``), each label weighted back to its share of the labelled rows. Votes become
scores by an isotonic fit on the sample, each example judged without itself; texts without any term have the rate of such examples.

On Spark: terms of the sample are counted by Spark; one narrow pass over the whole texts keeps the tf of the terms, from which
document frequencies are summed; the index (bounded by ``SAMPLE`` and ``TERMS``) is broadcast and a second narrow pass scores.

Defined cases: null and empty texts have no terms and get that rate; without labelled rows all scores are 0.5, and with one
label only all are that label. A document that is an example is scored without itself. An id with both labels counts with each;
of several rows with a sampled id the least text is the example; repeated rows are scored alike; null ids have no labels. Equal cosines
go to the smaller id (as text). Very long texts are read whole. An empty table gives no rows. Only key and text are read,
so extra columns do not matter and do not come back; a key named like a result is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import append, held_out, stored, table

SAMPLE = 2000
TERMS = 1000
MARGIN, SURE = 0.02, 15.0
BEGINNINGS, OFTEN = (4, 5, 6, 7, 8), (2, 3, 5, 8)
#: Words whose terms, and vectors whose neighbours, a Python worker keeps.
CACHE, VECTORS = 300_000, 50_000
NEAREST = 15
BLOCK = 64
SOFT = 0.05
#: Cosines are told apart to so many digits.
DIGITS = 12
CUT = 0.5
RESULTS = ("score", "predicted", "terms", "nearest")
WORD = re.compile(r"\w+")


def parts_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if k < len(word))]


class Terms(dict):
    """The numbers of the terms in a text; as a mapping, the known parts of a word (worked out when it is first met)."""

    def __init__(self, terms: Sequence[str]):
        super().__init__()
        self.number = {t: k for k, t in enumerate(terms)}
        self.parts = {t.partition("#")[0] for t in terms}

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = got = [p for p in parts_of(word) if p in self.parts]
        return got

    def counts(self, text: str | None) -> list[tuple[int, int]]:
        seen: Counter[str] = Counter()
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            for p in self[word]:
                seen[p] += n
        return sorted((self.number[t], m) for t, m in marked(seen) if t in self.number)


def marked(counts: Counter[str]) -> list[tuple[str, int]]:
    """Parts with their counts, and the marks of what is there often."""
    return [*counts.items(), *((f"{p}#{b}", 1) for p, n in counts.items() for b in OFTEN if n >= b)]


def terms_of(text: str | None) -> list[str]:
    """All terms of a text, each once."""
    seen: Counter[str] = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for p in parts_of(word):
            seen[p] += n
    return [t for t, _ in marked(seen)]


# the index -------------------------------------------------------------------------------------
@dataclass
class Index:
    """Examples in blocks, and per term: block numbers, the greatest weight in each, and postings (examples, weights)."""

    keys: list[str]
    labels: np.ndarray
    share: np.ndarray
    idf: np.ndarray
    blocks: list[np.ndarray]
    greatest: list[np.ndarray]
    postings: list[tuple[np.ndarray, np.ndarray]]
    n_blocks: int
    #: isotonic fit: votes and their scores; the score of a text without terms
    votes: np.ndarray
    scores: np.ndarray
    bare: float

    def __post_init__(self) -> None:
        self.rank = np.empty(len(self.keys), np.int64)
        self.rank[sorted(range(len(self.keys)), key=self.keys.__getitem__)] = np.arange(len(self.keys))
        self.least_rank = np.array([self.rank[b * BLOCK:(b + 1) * BLOCK].min() for b in range(self.n_blocks)], np.int64)

    def weights(self, terms: Sequence[int], times: Sequence[int]) -> np.ndarray:
        w = (1 + np.log(np.array(times, float))) * self.idf[list(terms)]
        return w / math.sqrt(float(w @ w)) if len(w) else w

    def _open(self) -> None:
        """Lay the postings out by term and block: greatest weights, and weights by place. Bounded by the terms and the sample."""
        self.most = np.zeros((len(self.idf), self.n_blocks))
        self.placed = np.zeros((len(self.idf), self.n_blocks, BLOCK))
        for t, (examples, values) in enumerate(self.postings):
            self.most[t, self.blocks[t]] = self.greatest[t]
            self.placed[t, examples // BLOCK, examples % BLOCK] = values

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("most", "placed")}

    def nearest(self, terms: Sequence[int], times: Sequence[int], skip: str | None = None, k: int = NEAREST,
                seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a common term, without those whose key is ``skip``.

        Blocks come in descending order of their bound, more and more at a time; of those that can only tie with the k-th
        cosine, just the ones with a smaller id than the k-th example's.
        """
        if not hasattr(self, "placed"):
            self._open()
        w, terms = self.weights(terms, times), list(terms)
        bound = w @ self.most[terms]
        live = np.flatnonzero(bound)
        order = live[np.argsort(-bound[live], kind="stable")]
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        at, step, slack = 0, 1, 0.6 * 10.0 ** -DIGITS
        while at < len(order):
            some = order[at:at + step]
            at, step = at + step, 2 * step
            if len(found) == k:
                if bound[some[0]] < cosines[-1] - slack:
                    break
                some = some[(bound[some] > cosines[-1] + slack) | ((bound[some] >= cosines[-1] - slack) & (self.least_rank[some] < self.rank[found[-1]]))]
                if not len(some):
                    continue
            if seen is not None:
                seen += some.tolist()
            close = np.round(np.tensordot(w, self.placed[terms][:, some], 1), DIGITS)
            row, place = np.nonzero(close if len(found) < k else close >= max(cosines[-1], 10.0 ** -DIGITS))
            ids, close = some[row] * BLOCK + place, close[row, place]
            if skip is not None:
                other = np.array([self.keys[i] != skip for i in ids], bool)
                ids, close = ids[other], close[other]
            found, cosines = np.r_[found, ids], np.r_[cosines, close]
            best = np.lexsort((self.rank[found], -cosines))[:k]
            found, cosines = found[best], cosines[best]
        return found, cosines

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float | None:
        if not len(found):
            return None
        w = self.share[self.labels[found]] / (np.maximum(0, 1 - cosines) + SOFT)
        return float(w @ self.labels[found] / w.sum())

    def score(self, vote: float | None) -> float:
        return self.bare if vote is None else float(np.interp(vote, self.votes, self.scores))


def index_of(examples: list[tuple[str, int, list[int], list[int]]], idf: np.ndarray, share: np.ndarray) -> Index:
    """From (key, label, terms, times) of every example; ``share`` weighs the labels."""
    none = np.zeros(0)
    weigh = Index([], none, share, idf, [], [], [], 0, none, none, 0.0).weights
    full = [(k, y, t, weigh(t, n)) for k, y, t, n in examples if t]
    # alike examples share a block: by strongest terms, then the label
    full.sort(key=lambda r: ([r[2][i] for i in np.argsort(-r[3], kind="stable")[:3]], r[1], r[0]))
    lists: list[list[tuple[int, float]]] = [[] for _ in idf]
    for at, (_, _, terms, w) in enumerate(full):
        for t, x in zip(terms, w):
            lists[t].append((at, x))
    postings = [(np.array([i for i, _ in x], np.int64), np.array([v for _, v in x])) for x in lists]
    begins = [np.flatnonzero(np.r_[True, i[1:] // BLOCK != i[:-1] // BLOCK]) if len(i) else np.zeros(0, np.int64) for i, _ in postings]
    index = Index([r[0] for r in full], np.array([r[1] for r in full], np.int64), share, idf, [i[b] // BLOCK for (i, _), b in zip(postings, begins)],
                  [np.maximum.reduceat(v, b) if len(b) else none for (_, v), b in zip(postings, begins)],
                  postings, -(-len(full) // BLOCK), none, none, 0.0)
    # each example judged by the others
    told = [(index.vote(*index.nearest(t, n, k)) if t else None, y) for k, y, t, n in examples]
    index.bare = rate([y for v, y in told if v is None], share)
    index.votes, index.scores = isotonic([(v, y) for v, y in told if v is not None], share)
    return index


def rate(labels: list[int], share: np.ndarray) -> float:
    """Weighted share of label 1, with one more example of the average kind."""
    w = share[labels] if labels else np.zeros(0)
    prior = float(share[1] / share.sum())
    return float((w @ np.array(labels, float) + prior * share.mean()) / (w.sum() + share.mean())) if labels else prior


def isotonic(told: list[tuple[float, int]], share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending scores at ascending votes: the rates of neighbours are pooled until they ascend."""
    pools: list[list] = []                                  # vote x weight, weight, labels
    for v, y in sorted(told):
        pools.append([v * share[y], share[y], [y]])
        while len(pools) > 1 and (rate(pools[-2][2], share) >= rate(pools[-1][2], share)
                                  or pools[-1][0] / pools[-1][1] <= pools[-2][0] / pools[-2][1]):
            a, w, labels = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + w, pools[-1][2] + labels]
    if not pools:
        return np.zeros(1), np.array([rate([], share)])
    return np.array([a / w for a, w, _ in pools]), np.array([rate(p[2], share) for p in pools])


# Spark -----------------------------------------------------------------------------------------
def examples(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, most: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(_key, _label, _text) of at most ``most`` documents per label, and how many labelled keys each label has."""
    marks = stored(labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
                   .distinct().join(docs.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi"), "labels")
    n = {r["_label"]: r["n"] for r in marks.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [marks.where(F.col("_label") == y).orderBy(F.xxhash64("_key", F.lit("toxicity")), "_key").limit(most) for y in (0, 1)]
    some = picked[0].unionByName(picked[1])                 # at most 2 x most rows
    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return stored(body.join(F.broadcast(some), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text")), "examples"), n


def telling(sample: DataFrame, most: int = TERMS) -> list[str]:
    """The terms that tell the labels apart, the most telling first."""
    terms = append(sample, ["_text"], "_terms array<string>", lambda texts: [[terms_of(t) for t in texts]])
    n = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return []
    one, zero = (F.count(F.when(F.col("_label") == y, 1)).cast("double").alias(c) for y, c in ((1, "one"), (0, "zero")))
    found = terms.select("_label", F.explode("_terms").alias("term")).groupBy("term").agg(one, zero)
    n1, n0 = float(n[1]), float(n[0])
    both = F.col("one") + F.col("zero")

    def part(seen, kind: float, all_):
        expected = all_ * kind / (n1 + n0)
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    rest1, rest0, rest = n1 - F.col("one"), n0 - F.col("zero"), (n1 + n0) - both
    g = 2 * (part(F.col("one"), n1, both) + part(F.col("zero"), n0, both) + part(rest1, n1, rest) + part(rest0, n0, rest))
    apart = F.abs(F.col("one") / n1 - F.col("zero") / n0)
    kept = found.withColumn("g", g).where((apart >= MARGIN) & (F.col("g") >= SURE)).orderBy(F.desc("g"), "term").limit(most)
    return [r["term"] for r in kept.collect()]


def counted(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Append ``_terms`` and ``_times``: the numbers of the terms in a text and how often each is there."""
    known = df.sparkSession.sparkContext.broadcast(Terms(terms))

    def work(texts: list) -> list:
        got = [known.value.counts(t) for t in texts]
        return [[[x[0] for x in g] for g in got], [[x[1] for x in g] for g in got]]

    return append(df, [text], "_terms array<int>, _times array<int>", work)


def frequencies(counts: DataFrame, n: int) -> np.ndarray:
    """In how many rows each of n terms is: summed in the tasks, then over them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["term", "n"])

    out = np.zeros(n)
    for r in counts.select("_terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The key and ``RESULTS`` of every row: score (0 to 1), predicted, the telling terms in the text, and the nearest
    examples (key as text, cosine, label).

    ``labels``: (key, label 0 or 1) of the documents to learn from.
    """
    if key in RESULTS:
        raise ValueError(f"the key cannot be named {key}")
    body = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    some, n = examples(docs, labels, text, key, label, sample)
    if len(n) < 2:
        alone = 0.5 if not n else float(next(iter(n)))
        return body.select(F.col("_key").alias(key), F.lit(alone).alias("score"), F.lit(int(alone >= CUT)).alias("predicted"),
                           F.array().cast("array<string>").alias("terms"), F.array().cast("array<struct<key:string,cosine:double,label:int>>").alias("nearest"))
    terms = telling(some)
    counts = stored(counted(body, "_text", terms).select("_key", "_terms", "_times"), "terms")
    total = counts.count()
    idf = np.log((1 + total) / (1 + frequencies(counts, len(terms)))) + 1
    rows = [(str(r["_key"]), r["_label"], r["_terms"], r["_times"]) for r in counted(some, "_text", terms).drop("_text").collect()]
    taken = Counter(y for _, y, _, _ in rows)
    share = np.array([n[y] / max(1, taken[y]) for y in (0, 1)])
    known: dict[tuple, tuple] = {}                          # per Python worker
    shared = docs.sparkSession.sparkContext.broadcast((index_of(sorted(rows), idf, share), frozenset(r[0] for r in rows), terms, known))

    def work(keys: list, which: list, times: list) -> list:
        index, own, names, known = shared.value
        out: list[list] = [[], [], [], []]
        for k, t, m in zip(keys, which, times):
            skip = str(k) if k is not None and str(k) in own else None
            at = (tuple(t), tuple(m) if len(m) > 1 else (), skip)         # a single term has weight 1 whatever its number
            got = known.get(at)
            if got is None:
                found, cosines = index.nearest(t, m, skip)
                got = index.score(index.vote(found, cosines)), found, cosines
                if len(known) >= VECTORS:
                    known.clear()
                known[at] = got
            s, found, cosines = got
            near = [{"key": index.keys[i], "cosine": c, "label": y} for i, c, y in zip(found.tolist(), cosines.tolist(), index.labels[found].tolist())]
            for column, value in zip(out, (s, int(s >= CUT), [names[i] for i in t], near)):
                column.append(value)
        return out

    told = append(counts, ["_key", "_terms", "_times"], "score double, predicted int, terms array<string>, nearest array<struct<key:string,cosine:double,label:int>>", work)
    return told.select(F.col("_key").alias(key), *RESULTS)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and the terms and examples behind it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", "toxic")
    return score(docs, marks).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "terms", "nearest")
