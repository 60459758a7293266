"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept and returns the
columns of documents; the last returns token ids. Null texts, repeated rows and empty tables are handled as the
operators' docstrings say. Extra columns, whatever their names, pass through all stages but the last with the values they
had; the last takes only id and text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm import bpe, language, mixing, secret_scan, simhash
from zonalis.llm.common import held_out, stored, table
from zonalis.session import work_folder

#: A document whose best language has less of the posterior than this is rejected.
LEAST_SCORE = 0.5


#: The columns of documents that stages work on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping_others(stage: Stage) -> Stage:
    """The stage with all other columns packed away under a name of their own while it runs, so that none can clash."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        away = f"_others_{uuid.uuid4().hex}"
        packed = docs.select(*[c for c in docs.columns if c in COLUMNS], F.struct(*[F.col(f"`{c}`") for c in others]).alias(away))
        return stage(spark, packed, sf_dir).select(*[F.col(away).getField(c).alias(c) if c in others else F.col(c) for c in docs.columns])

    return run


@keeping_others
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or in which no language has half of the posterior.

    Learns from the labelled rows of its input outside the held-out fold. With no such rows nothing can
    be told, and only texts without a letter go.
    """
    model = language.train(docs.where(~held_out("doc_id")).select("doc_id", "text", "lang"))
    letters = docs.where(F.col("text").rlike(r"\p{L}"))
    if not model.langs:
        return letters
    told = language.predict(letters.withColumn("_text", F.col("text")), model, "_text")
    good = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return told.where(good).select(*docs.columns)


@keeping_others
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return simhash.one_of_each(docs)


@keeping_others
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark; n_chars follows the new text."""
    found = secret_scan.scan(docs.select("doc_id", "text"), work_folder(spark, "ledger"), path="doc_id")
    clean = secret_scan.redacted(docs, found)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


@keeping_others
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their targets: documents left out go, repeated ones come as several rows."""
    return mixing.rows_of(mixing.mix(docs, mixing.word_count("text"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every row of the mix."""
    return bpe.round_trip(docs.select("doc_id", "text"), bpe.default_tokenizer(), keep_ids=True).drop("text")


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secrets),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: No SQL can express the language model or the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
