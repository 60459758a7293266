"""Language identification: words first, shorter and shorter character n-grams for unseen words.

The model holds, per language, the log frequency of known words and of character n-grams. A known
word scores by its own entries. An unseen word is scored by its longest n-grams that are known; if
none is, by the next shorter ones, down to single letters; a word without any known letter says
nothing. A document's score adds up its words.

Training counts in Spark. What the model learns from is a bounded sample (about ``SAMPLE`` documents per
language, picked by a hash of their id), and it keeps at most ``WORDS`` words and
``GRAMS`` n-grams of each length, the most frequent over all languages: so the model that every task
gets has a fixed bound. Prediction covers every document and is one narrow pass.

Defined cases: a null text and a text without letters get ``und`` and score 0; a text whose words
tell nothing gets the first language by name and score 1 / languages; equal scores go to the first language by
name; with no labelled rows at all everything is ``und``. Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import append, held_out, stored, table

UNKNOWN = "und"
SAMPLE = 3000
WORDS = 40_000
GRAMS = 8_000
SIZES = (4, 3, 2, 1)
#: Distinct words whose scores a Python worker keeps.
CACHE = 250_000
#: Added to every count of a word or n-gram in a language.
SMOOTH = 0.5
#: Words after which more evidence no longer makes the posterior sharper.
EVIDENCE = 20
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


@dataclass
class Model:
    """Log frequencies per language, and the scores of words met so far (per Python worker)."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray
    seen: Seen | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": None}

    def unseen(self, word: str) -> np.ndarray:
        """Mean score of the longest known n-grams of a padded word."""
        padded = f"<{word}>"
        for n in SIZES:
            rows = [self.grams[g] for k in range(len(padded) - n + 1) if (g := padded[k:k + n]) in self.grams]
            if rows:
                return self.gram_scores[rows].mean(0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not self.langs or not words or not (words[0].isalpha() or any(map(str.isalpha, text))):
            return UNKNOWN, 0.0
        if self.seen is None or len(self.seen) > CACHE:
            self.seen = Seen(self)
        at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        total = self.seen.scores[at].sum(0)
        total = total * (min(len(words), EVIDENCE) / len(words))
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


class Seen(dict):
    """Row of ``scores`` by word: the known words first, others as they come."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model = model
        self.scores = np.vstack([model.word_scores.reshape(-1, len(model.langs)), np.zeros((CACHE // 4, len(model.langs)))])

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row >= len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
        self.scores[row] = self.model.unseen("".join(filter(str.isalpha, word))) if not word.isalpha() else self.model.unseen(word)
        self[word] = row
        return row


def sample(docs: DataFrame, lang: str, key: str, per_language: int = SAMPLE) -> DataFrame:
    """About ``per_language`` documents of each language (all, where there are fewer), picked by a hash of the key."""
    counts = docs.where(F.col(lang).isNotNull()).groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return docs.limit(0)
    span = 1 << 30
    bound = F.create_map(*[x for r in counts for x in (F.lit(r[lang]), F.lit(min(span, span * per_language // r["n"])))])
    return docs.where(F.col(lang).isNotNull() & (F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(span)) < bound[F.col(lang)]))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          per_language: int = SAMPLE) -> Model:
    """Learn from the labelled rows of ``docs`` (all others are ignored)."""
    texts = (sample(docs.select(key, lang, text), lang, key, per_language)
             .select(F.col(lang).alias("lang"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")))
    words = stored(texts.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
                   .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))

    def cuts(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        return F.when(F.length(padded) >= n, F.transform(starts, lambda k: F.substring(padded, k, F.lit(n))))

    pieces = F.flatten(F.array(*[F.coalesce(cuts(n), F.array().cast("array<string>")) for n in SIZES]))
    grams = words.select("lang", "n", F.explode(pieces).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top_words = _most(words.withColumnRenamed("word", "item"), WORDS)
    top_grams = [_most(grams.where((F.length("gram") == n) & ~F.col("gram").isin("<", ">")).withColumnRenamed("gram", "item"), GRAMS) for n in SIZES]
    langs = sorted({r["lang"] for r in words.select("lang").distinct().collect()})
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    word_rows, word_scores = _scores(top_words, langs, [totals[x] for x in langs])
    gram_rows: dict[str, int] = {}
    gram_parts = []
    for part in top_grams:                                # frequencies among n-grams of the same length
        sums = np.maximum(1, [sum(r["n"].get(x, 0) for r in part) for x in langs])
        rows, scores = _scores(part, langs, sums)
        gram_rows |= {g: k + sum(map(len, gram_parts)) for g, k in rows.items()}
        gram_parts.append(scores)
    return Model(langs, word_rows, gram_rows, word_scores, np.vstack(gram_parts) if langs else np.zeros((0, 0)))


def _most(counts: DataFrame, most: int) -> list:
    """The most frequent items, each with its count by language: at most ``most`` rows."""
    return (counts.groupBy("item").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))
            .where(F.col("all") > 1).orderBy(F.desc("all"), "item").limit(most).collect())


def _scores(rows: list, langs: Sequence[str], totals: Sequence[int]) -> tuple[dict[str, int], np.ndarray]:
    counts = np.array([[r["n"].get(x, 0) for x in langs] for r in rows], float).reshape(len(rows), len(langs))
    return {r["item"]: k for k, r in enumerate(rows)}, np.log((counts + SMOOTH) / (np.array(totals, float) + SMOOTH * max(1, len(rows))))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` (0 to 1) to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list) -> list:
        m = shared.value
        got = [m.predict(t) for t in texts]
        return [[g[0] for g in got], [g[1] for g in got]]

    return append(docs, [text], "lang_pred string, score double", work)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id")).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
