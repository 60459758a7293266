"""Quality scores by Bradley-Terry ranking of preference pairs.

A labelled sample gives preference pairs (a document marked good beats one marked bad). Weights are
learned by logistic loss on the difference of the two feature vectors, so the score ranks documents and
needs no intercept. The cut is a quantile of the scores of *all* documents: among the quantiles, the
one that agrees best with the sample's labels (the middle, if several do). Scores are then mapped to
0..1 so that the cut lies at ``CUT``.

Features come from the whole text alone. They are computed in one narrow pass, stored (a few numbers
per document), and serve the sample, the quantiles (a histogram of at most ``BINS`` rows) and the scores.
Only the sample (at most about ``SAMPLE`` documents of each label, by a hash of the id) reaches the driver.

Defined cases: null and empty texts have features too and get a score; with labels of one kind only
there are no pairs and all scores are 0.5; repeated rows and null ids are scored like others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import append, held_out, stored, table

SAMPLE = 5000
#: Preferences that each document of the sample takes part in, at least.
PARTNERS = 8
RIDGE = 1e-3
BINS = 4096
CUT = 0.3

FEATURES = ("log_words", "word_length", "letters", "digits", "upper", "space", "marks", "sentence_ends", "commas", "odd_words",
            "distinct_words", "distinct_lines", "line_words", "repeats", "bars", "tail")
MARKS = "#$%&*@^~_=+<>\\{}[]|/"


def features(text: str | None) -> list[float]:
    """Numbers that describe how a text is written, from all of it."""
    text = text or ""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    m = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    letters = len(LETTERS.sub("", text))
    return [
        math.log1p(m), min(30.0, (n - m + 1) / m), 1 - letters / n, sum(map(text.count, "0123456789")) / n,
        len(UPPER.findall(text)) / m, (m - 1) / n, sum(map(text.count, MARKS)) / n,
        (text.count(".") + text.count("!") + text.count("?")) / m, text.count(",") / m,
        len(ODD.findall(text)) / m, distinct / m ** 0.8, len(set(lines)) / len(lines),
        math.log1p(m / len(lines)), sum(map(str.__eq__, words, words[1:])) / m, text.count(" | ") / m,
        float(text[-1] in ".!?\"'"),
    ]


LETTERS = re.compile(r"[^\W\d_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
ODD = re.compile(r"[^\w\s]{2,}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class Ranking:
    """score = weights . (features - mean) / scale"""

    mean: list[float]
    scale: list[float]
    weights: list[float]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)

    def column(self, of: str) -> Column:
        """The score as a column, from an array column of features."""
        total = F.lit(0.0)
        for k, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights)):
            total = total + (F.element_at(of, k + 1) - F.lit(m)) * F.lit(w / s)
        return total


def bradley_terry(good: np.ndarray, bad: np.ndarray, partners: int = PARTNERS, rounds: int = 50) -> Ranking:
    """Weights that make ``good`` rows beat ``bad`` rows, by Newton steps on the pairs' logistic loss."""
    every = np.vstack([good, bad])
    mean, scale = every.mean(0), every.std(0)
    scale[scale < 1e-9] = 1.0
    a, b = (good - mean) / scale, (bad - mean) / scale
    n = max(len(a), len(b)) * partners
    k = np.arange(n)
    d = a[k % len(a)] - b[(k + k // max(len(a), len(b)) * 7919) % len(b)]      # each round of pairs is shifted
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = sigmoid(-d @ w)                                                 # chance that the preference is missed
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w)), d.T @ p / n - RIDGE * w)
        w = w + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(mean.tolist(), scale.tolist(), w.tolist())


def sample(labelled: DataFrame, label: str, key: str, per_label: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of about ``per_label`` documents marked good and as many marked bad."""
    counts = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col(label).isin(0, 1)).collect()}
    span = 1 << 30
    bound = F.when(F.col(label) == 1, min(span, span * per_label // max(1, counts.get(1, 1)))).otherwise(min(span, span * per_label // max(1, counts.get(0, 1))))
    rows = labelled.where(F.col(label).isin(0, 1) & (F.pmod(F.xxhash64(key, F.lit("quality")), F.lit(span)) < bound)).select("features", label, key).collect()
    rows.sort(key=lambda r: (str(r[key]), r["features"]))
    return tuple(np.array([r["features"] for r in rows if r[label] == x], float).reshape(-1, len(FEATURES)) for x in (1, 0))


def cut(scores: Sequence[float], counts: Sequence[int], good: np.ndarray, bad: np.ndarray) -> float:
    """The score at the quantile of all documents that tells good from bad best (means of both hit rates)."""
    order = np.argsort(scores)
    values, share = np.array(scores)[order], np.cumsum(np.array(counts)[order]) / sum(counts)
    levels = values[np.minimum(np.searchsorted(share, np.arange(0, 1, 1 / BINS)), len(values) - 1)]
    good, bad = np.sort(good), np.sort(bad)
    right = 1 - np.searchsorted(good, levels) / len(good) + np.searchsorted(bad, levels) / len(bad)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((levels[best[0]] + levels[best[-1]]) / 2)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` to every document.

    ``labels``: (key, label 0 or 1) of the documents to learn from. A key with several labels counts
    with each.
    """
    body = docs.withColumn("_text", F.col(text)).drop("features")
    kept = stored(append(body, ["_text"], "features array<double>", lambda texts: [[features(t) for t in texts]]).drop(text, "_text"), "features")
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label")).distinct()
    good, bad = sample(kept.join(marks, F.col(key) == F.col("_key")).select(F.col(key), "features", "_label"), "_label", key)
    if not len(good) or not len(bad):
        return kept.drop("features", "score", "predicted").withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1))
    ranking = bradley_terry(good, bad)
    g, b = ranking.score(good), ranking.score(bad)
    low, high = float(min(g.min(), b.min())), float(max(g.max(), b.max()))
    step = max(1e-12, (high - low) / BINS)
    raw = ranking.column("features")
    place = F.greatest(F.lit(0.0), F.least(F.lit(float(BINS - 1)), F.floor((raw - low) / step).cast("double")))
    histogram = kept.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()
    at = cut([low + r["place"] * step for r in histogram], [r["n"] for r in histogram], g, b)
    width = max(1e-9, float(np.concatenate([g, b]).std()) / 2)
    shift = math.log(CUT / (1 - CUT))
    scored = F.lit(1.0) / (F.lit(1.0) + F.exp(-((raw - F.lit(at)) / F.lit(width) + F.lit(shift))))
    return kept.withColumn("score", scored).withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop("features")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", "quality")
    return score(docs, marks).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
