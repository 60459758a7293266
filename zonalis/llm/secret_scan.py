"""Secret scans with an incremental ledger of blobs.

Every version of every path is content-addressed. A ledger folder keeps which (blob, rule version)
pairs were scanned, with the findings. A run scans only unseen pairs, each once however many paths
or versions carry the blob, appends them to the ledger and joins the findings back to all paths.

Only narrow rows (path key, blob hash) are grouped, with a map-side partial step, so a blob that a
third of all paths share costs one row per task. Texts are joined on the path key, which spreads
evenly. A run that dies leaves no partial entries: Spark commits a written folder as a whole.

Defined cases: null texts count as empty; repeated rows give repeated result rows; null path keys
are kept; versions that differ in text are different blobs; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import append, stored, table
from zonalis.session import work_folder

SPAN = "array<struct<kind:string,start:int,end:int>>"
#: Order of kinds that begin at the same place.
KINDS = ("assign", "access", "hex", "pem", "github", "jwt")
BASE = KINDS[:3]


@dataclass(frozen=True)
class Rule:
    """One kind of secret. A text without any of the (lower-case) ``hints`` cannot match."""

    kind: str
    version: int
    pattern: str
    hints: tuple[str, ...] = ()
    ignore_case: bool = False
    value: int = 0          # group whose length counts
    least: int = 1          # characters it must have

    @property
    def key(self) -> str:
        return f"{self.kind}-{self.version}"


# The three base patterns. The others are published token formats.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("passw", "secret", "token", "api"), True, 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), least=18),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", ("private key-----",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
)


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, by start and then kind."""
    found, low = [], text.lower()
    for r in rules:
        if r.hints and not any(h in low for h in r.hints):
            continue
        for m in re.finditer(r.pattern, text, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)):
            if m.end(r.value) - m.start(r.value) >= r.least:
                found.append((r.kind, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(versions: DataFrame, ledger: str, path: str = "path", text: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The versions with ``blob`` (hash of the text) and ``spans`` (their secrets) in place of the text.

    ``ledger`` is a folder that all hosts share; it is created if missing and grows by the pairs
    that this run has scanned. Rows keep their other columns; columns named blob or spans are replaced.
    """
    spark = versions.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = versions.withColumn("blob", F.sha2(body.cast("binary"), 256))
    known = stored(keyed.drop(text, "spans"), "versions")
    mine = [r.key for r in rules]
    seen = _seen(spark, ledger)
    blobs = known.groupBy("blob").agg(F.min(F.col(path)).alias("_path"))
    scanned = seen.where(F.col("rule").isin(mine)).groupBy("blob").agg(F.collect_set("rule").alias("_rules"))
    todo = (blobs.join(scanned, "blob", "left")
            .select("blob", "_path", F.array_except(F.array(*[F.lit(k) for k in mine]), F.coalesce("_rules", F.array().cast("array<string>"))).alias("todo"))
            .where(F.size("todo") > 0))
    # one holder of each blob brings its text; repeated rows of that path count once
    holders = keyed.select(F.col(path).alias("_holder"), F.col("blob").alias("_blob"), body.alias("_text"))
    texts = holders.join(todo, F.col("_holder").eqNullSafe(F.col("_path")) & (F.col("_blob") == F.col("blob")))

    def work(texts: list, todo: list) -> list:
        return [[[(k, _named(find(t, tuple(r for r in rules if r.key == k)))) for k in ks] for t, ks in zip(texts, todo)]]

    made = append(texts.select("blob", "_text", "todo"), ["_text", "todo"],
                  f"made array<struct<rule:string,spans:{SPAN}>>", work)
    fresh = made.select("blob", F.inline("made"))
    fresh.write.mode("append").partitionBy("rule").parquet(ledger)
    # stored, so that the last join has nothing but exchanges below it and a hot blob can be split
    entries = stored(_seen(spark, ledger).where(F.col("rule").isin(mine) & (F.size("spans") > 0))
               .groupBy("blob", "rule").agg(F.first("spans").alias("spans"))          # repeated rows of a path
               .groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("_found")), "findings")
    order = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    ordered = F.transform(
        F.array_sort(F.transform("_found", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s.alias("s")))),
        lambda x: x["s"])
    return (known.join(entries, "blob", "left")
            .withColumn("spans", F.coalesce(ordered, F.array().cast(SPAN))).drop("_found"))


def _named(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def _seen(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger: (blob, rule, spans); empty if the folder is not there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if not there:
        return spark.createDataFrame([], f"blob string, spans {SPAN}, rule string")
    return spark.read.schema(f"blob string, spans {SPAN}, rule string").parquet(ledger)


def redacted(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret replaced by a mark. ``found`` is what ``scan`` returned for them.

    Findings are joined by content, so repeated keys cannot be mixed up; documents without secrets
    pass unchanged.
    """
    key_, blob, spans, masked = (f"_{n}_{uuid.uuid4().hex}" for n in ("key", "blob", "spans", "masked"))      # no column of the user's
    bad = stored(found.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias(spans))
                 .select(F.col("blob").alias(blob), spans), "bad-blobs")
    keyed = docs.withColumn(key_, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    held = keyed.join(bad, F.col(key_) == F.col(blob), "left")

    def work(texts: list, found: list) -> list:
        return [[t if not s else _masked(t, [(x["start"], x["end"]) for x in s], mark) for t, s in zip(texts, found)]]

    made = append(held, [text, spans], f"`{masked}` string", work)
    return made.select(*[F.col(masked).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def _masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and all spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, work_folder(spark, "ledger"), path="doc_id")

    def text_of(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(list(BASE)))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"),
                        text_of(F.col("spans")).alias("spans"))
