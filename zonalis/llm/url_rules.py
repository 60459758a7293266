"""URL filters: hand-written host and path rules, then association rules mined from labels.

FP-growth (Spark's own) mines combinations of URL tokens that go with a label. Rules are pruned by
support, confidence, lift and by simpler rules that are as good. A URL is matched through an inverted index from
token to rules; a rule applies when all its tokens are there. The verdict is that of the applying
rule with the highest confidence; without any, the default.

Every part of a URL makes a token: all host labels and suffixes, path segments and query keys. One count
in Spark leaves out tokens below the minimum support, which no rule can have; tokens that hold in the same
URLs are one class. A rule is a combination of classes and asks for any member of each, so the classes never
multiply. Each kept combination, of any number of classes, holds
in a share of ``MIN_SUPPORT`` of the labelled URLs, so the list that the tasks get grows with the classes of a
URL (at most C / MIN_SUPPORT rules per label if C is the mean number of their combinations in a URL) and
not with the rows. That is exponential in the frequent tokens, unlike ones, that meet in one URL, as FP-growth's
own time is. Matching is one narrow pass.

Defined cases: null URLs and URLs without ``://`` have empty host and path, no tokens and the
default verdict; repeated rows are judged alike; without labels nothing is mined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import append, stored, table

MIN_SUPPORT = 0.002
#: A combination also holds in at least this many labelled URLs.
MIN_COUNT = 5
MIN_CONFIDENCE = 0.5
#: A rule's confidence over the share of its label at large.
MIN_LIFT = 1.05
DEFAULT = "allow"
LABEL = "label="

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL, whatever their number; numbers are not told apart in paths."""
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(#.*)?", url or "")
    if not m:
        return []
    scheme, host, path, query, fragment = m.groups()
    host = host.lower()
    labels = host.split(".")
    segments = [s for s in path.split("/") if s]
    out = [f"scheme={scheme.lower()}", f"host={host}", f"top={labels[-1]}", f"sub={labels[0]}"]
    out += [f"part={label}" for label in labels if label]
    out += [f"domain={'.'.join(labels[k:])}" for k in range(max(1, len(labels) - 1))]
    if segments:
        named = [re.sub(r"\d+", "0", s) for s in segments]
        out.append("first=" + named[0])
        out += [f"segment={s}" for s in named]
        out.append("ends=" + (re.sub(r".*\.", ".", segments[-1]) if "." in segments[-1] else "/" if path.endswith("/") else "none"))
    if query:
        out += ["query=" + q.split("=")[0] for q in query.split("&") if q]
    if fragment:
        out.append("fragment")
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Mined:
    """A rule: ``alike`` holds, for each token, all tokens of its class (none: the token alone)."""
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float
    alike: tuple[tuple[str, ...], ...] = ()


def mine(labelled: DataFrame, url: str = "url", verdict: str = "verdict", least_confidence: float = MIN_CONFIDENCE) -> list[Mined]:
    """Rules from URLs with a verdict, best first. A bounded list (see above)."""
    known = labelled.where(F.col(verdict).isNotNull() & F.col(url).isNotNull()).select(F.col(url).alias("url"), F.col(verdict).alias("verdict"))
    told = append(known, ["url"], "items array<string>", lambda urls: [[tokens(u) for u in urls]])
    told = stored(told.where(F.size("items") > 0), "url-tokens")
    n = told.count()
    if not n:
        return []
    share = min(1.0, max(MIN_SUPPORT, MIN_COUNT / n))
    alike = classes(told, ceil(share * n))
    first = labelled.sparkSession.sparkContext.broadcast({t: same[0] for same in alike for t in same})
    reduced = append(told, ["items"], "items array<string>", lambda rows: [[list({first.value[t] for t in r if t in first.value}) for r in rows]])
    baskets = stored(reduced.select(F.array_append("items", F.concat(F.lit(LABEL), F.col("verdict"))).alias("items")), "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=least_confidence).fit(baskets)
    label = F.col("consequent")[0]
    rules = (model.associationRules.where(label.startswith(LABEL) & (F.col("lift") >= MIN_LIFT)
                                          & ~F.exists("antecedent", lambda t: t.startswith(LABEL)))
             .select("antecedent", label.alias("label"), "confidence", "support").collect())
    kept = pruned([Mined(tuple(sorted(r["antecedent"])), r["label"][len(LABEL):], r["confidence"], r["support"]) for r in rules])
    members = {same[0]: tuple(same) for same in alike}
    return [replace(r, alike=tuple(members[t] for t in r.tokens)) for r in kept]


def classes(told: DataFrame, least: int) -> list[list[str]]:
    """Tokens in at least ``least`` rows, those that hold in the same rows together.

    Same rows: the same number of them and the same sum of the hashes of their URLs.
    """
    held = told.select(F.xxhash64("url").cast("decimal(20,0)").alias("h"), F.explode("items").alias("token"))
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).where(F.col("n") >= least).collect()
    by: dict[tuple, list[str]] = {}
    for r in sorted(counts, key=lambda r: r["token"]):
        by.setdefault((r["n"], r["h"]), []).append(r["token"])
    return list(by.values())


def pruned(rules: list[Mined]) -> list[Mined]:
    """Without rules that have a simpler one for the same verdict and at least the same confidence."""
    sure = {(frozenset(r.tokens), r.verdict): r.confidence for r in rules}
    within: dict[tuple, float] = {}                        # best confidence of a combination and its parts

    def best(part: frozenset, verdict: str) -> float:
        key = part, verdict
        if key not in within:
            within[key] = max(sure.get(key, -1.0), simpler(part, verdict))
        return within[key]

    def simpler(whole: frozenset, verdict: str) -> float:
        return max((best(whole - {t}, verdict) for t in whole if len(whole) > 1), default=-1.0)

    return ordered([r for r in rules if simpler(frozenset(r.tokens), r.verdict) < r.confidence])


def rank(r: Mined) -> tuple:
    return -r.confidence, -r.support, r.tokens, r.verdict


def ordered(rules: list[Mined]) -> list[Mined]:
    return sorted(rules, key=rank)


class Index:
    """Rules by class of tokens. ``best`` is the first rule with a member of each of its classes in the URL, written with
    the smallest of those members; of rules alike in confidence and support the first by these tokens."""

    def __init__(self, rules: Sequence[Mined]):
        self.rules = rules
        self.holders: dict[str, list[int]] = {}              # first member of a class -> rules
        self.class_of: dict[str, str] = {}
        for k, r in enumerate(rules):
            for same in r.alike or [(t,) for t in r.tokens]:
                self.holders.setdefault(same[0], []).append(k)
                if same[0] not in self.class_of:
                    self.class_of |= dict.fromkeys(same, same[0])
        self.known: dict[tuple[str, ...], Mined | None] = {}

    def best(self, url: str | None) -> Mined | None:
        there: dict[str, str] = {}
        for t in sorted(tokens(url)):
            if t in self.class_of:
                there.setdefault(self.class_of[t], t)
        key = tuple(there.values())
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self._first(there)
        return self.known[key]

    def _first(self, there: dict[str, str]) -> Mined | None:
        hits = Counter(k for c in there for k in self.holders[c])
        fit = [self.rules[k] for k, n in hits.items() if n == len(self.rules[k].tokens)]
        named = [replace(r, tokens=tuple(sorted(there[self.class_of[t]] for t in r.tokens))) for r in fit]
        return min(named, key=rank, default=None)


def judge(urls: DataFrame, mined: Sequence[Mined], url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          default: str = DEFAULT) -> DataFrame:
    """Append host, path, rule, verdict and, where a mined rule decided, because and confidence."""
    index = urls.sparkSession.sparkContext.broadcast(list(mined))
    local: dict[str, Index] = {}

    def work(given: list) -> list:
        if "index" not in local:
            local["index"] = Index(index.value)
        best = [local["index"].best(u) for u in given]
        return [[b and b.verdict for b in best], [b and " & ".join(b.tokens) for b in best], [b and b.confidence for b in best]]

    told = append(urls.drop("host", "path", "rule", "verdict", "because", "confidence").withColumn("_url", F.col(url)), ["_url"],
                  "_verdict string, _because string, _confidence double", work)
    fixed = told.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("_rule", ruled(F.col("host"), F.col("path"), rules))
    by_rule = F.col("_rule").isNotNull()
    return (fixed.withColumn("rule", F.col("_rule.rule"))
            .withColumn("verdict", F.coalesce("_rule.verdict", "_verdict", F.lit(default)))
            .withColumn("because", F.when(~by_rule, F.col("_because"))).withColumn("confidence", F.when(~by_rule, F.col("_confidence")))
            .drop("_rule", "_verdict", "_because", "_confidence"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A page's address ends in the id of the document it shows; its labels mark the address: block if
    the document is toxic or of low quality, else allow.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shows = pages.where(F.col("url").isNotNull()).select("url", F.regexp_extract("url", r"/([0-9]{1,18})(?:[/.?#][^/]*)?$", 1).try_cast("long").alias("_doc"))
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").otherwise("allow").alias("verdict"))
    labelled = shows.join(marks, F.col("_doc") == F.col("doc_id")).select("url", "verdict")
    return judge(pages, mine(labelled)).select("page_id", "host", "path", "rule", "verdict", "because", "confidence")
