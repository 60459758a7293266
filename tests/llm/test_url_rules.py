"""Fixed rules and mined rules beside brute force."""

import re
from dataclasses import replace
from itertools import product

import pytest

from zonalis.llm import url_rules as ur


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in ur.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, default=(0, None, None))[1:]


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.b.example.org/en/123?q#f", "x://org", "x://org/", "x://xorg/",
        "http://a.com/fr/1", "http://a.com/de/", "http://a.com?x=/de/", "http://a.com#/de/", "a://b://c/d", "http://É.org/\n?", "http://host:80/p#x?y",
        "http://example.org/es", "HTTP://example.com/DE/"]


def test_fixed_rules(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(None, URLS[4], None)] * 2
    got = ur.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), []).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = host_path(r["url"])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


@pytest.mark.parametrize("url, rule, verdict", [
    ("http://a.org/x", "org/", "allow"), ("http://example.org/es/7", "example.org/es/", "block"), ("http://example.org/en/1", "example.org/en/1", "block"),
    ("https://a.b.example.org/en/123?q#f", "example.org/en/1", "block"), ("http://example.org/en/2", "org/", "allow"),
    ("http://a.com/fr/1", "com/fr/", "allow"), ("http://a.com/de/1", "com/de/", "block")])
def test_fixed_rules_as_literals(spark, url, rule, verdict):
    r = ur.judge(spark.createDataFrame([(url,)], "url string"), []).first()
    assert (r["rule"], r["verdict"]) == (rule, verdict)


def brute_mine(labelled, least):
    """Every combination of tokens, those of the same URLs taken together, counted as a set of rows; none with a part as sure."""
    rows = [(set(ur.tokens(u)), v) for u, v in labelled if u and ur.tokens(u)]
    n, where = len(rows), {}
    for k, (t, _) in enumerate(rows):
        for x in t:
            where[x] = where.get(x, 0) | 1 << k
    same = {}
    for x in sorted(where):
        same.setdefault(where[x], []).append(x)
    floor, found = max(ur.MIN_SUPPORT * n, ur.MIN_COUNT), []
    masks = {v: sum(1 << k for k, r in enumerate(rows) if r[1] == v) for v in ("allow", "block")}
    groups = [(m, tuple(x)) for m, x in same.items() if m.bit_count() >= floor]

    def grow(start, picked, held):
        for k in range(start, len(groups)):
            both, more = held & groups[k][0], [*picked, groups[k][1]]
            if both.bit_count() < floor:
                continue
            for v, m in masks.items():
                hit, share = (both & m).bit_count(), m.bit_count() / n
                if hit >= floor and hit / both.bit_count() >= least and hit / both.bit_count() / share >= ur.MIN_LIFT:
                    alike = tuple(sorted(more))
                    found.append(ur.Mined(tuple(x[0] for x in alike), v, hit / both.bit_count(), hit / n, alike))
            grow(k + 1, more, both)

    grow(0, [], (1 << n) - 1)
    return [r for r in found if not any(set(o.tokens) < set(r.tokens) and o.verdict == r.verdict and o.confidence >= r.confidence for o in found)]


def written_out(mined):
    """One rule for every choice of members of its classes."""
    return ur.ordered([replace(r, tokens=tuple(sorted(pick)), alike=()) for r in mined for pick in product(*r.alike)])


def test_mined_rules(spark):
    labelled = [(f"http://{'bad' if k % 3 == 0 else 'good'}.site{k % 4}.com/{'x' if k % 5 else 'y'}/{k}{'?ref=1' if k % 2 else ''}",
                 "block" if k % 3 == 0 and k % 7 else "allow") for k in range(240)] + [(None, "block"), ("junk", "block")]
    df = spark.createDataFrame(labelled, "url string, verdict string")
    got, want = ur.mine(df), brute_mine(labelled, ur.MIN_CONFIDENCE)
    key = lambda r: (r.alike, r.verdict, round(r.confidence, 9), round(r.support, 9))
    every = written_out(got)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) < len(every) and any(r.verdict == "block" for r in got)
    index = ur.Index(got)
    for u, _ in labelled:
        t = set(ur.tokens(u))
        best = index.best(u)
        assert (best and replace(best, alike=())) == next((r for r in every if set(r.tokens) <= t), None)
    assert ur.mine(df.limit(0)) == []


@pytest.mark.parametrize("bad, good", [
    ("http://b{k}.adult-x.example.net/{k}", "http://b{k}.plain.example.net/{k}"),
    ("http://a.com/en/casino/{k}", "http://a.com/en/news/{k}"),
    ("http://a.com/en/{k}?page=2&ref=x", "http://a.com/en/{k}?page=2&lang=x")])
def test_every_part_of_a_url_can_decide(spark, bad, good):
    labelled = [(bad.format(k=k), "block") for k in range(40)] + [(good.format(k=k), "allow") for k in range(120)]
    mined = ur.mine(spark.createDataFrame(labelled, "url string, verdict string"))
    pages = spark.createDataFrame([(bad.format(k=999),), (good.format(k=999),)], "url string")
    assert [r["verdict"] for r in ur.judge(pages, mined).collect()] == ["block", "allow"]


def test_many_tokens_that_go_together(spark):
    """40 query keys of one template are one class: no 2 ** 40 combinations, and each key decides alone."""
    query = "&".join(f"k{k}=1" for k in range(40))
    labelled = [(f"http://a.com/x{'?' + query if k % 4 == 0 else ''}", "block" if k % 4 == 0 else "allow") for k in range(80)]
    mined = ur.mine(spark.createDataFrame(labelled, "url string, verdict string"))
    blocks = [r for r in mined if r.verdict == "block"]
    assert any({"query=k7", "query=k39"} <= set(r.alike[0]) for r in blocks) and len(mined) < 10
    pages = spark.createDataFrame([("x://b.org/?k7=2",), ("x://b.org/?k39=2",), ("x://b.org/?z=2",)], "url string")
    assert [r["because"] for r in ur.judge(pages, mined, rules=()).collect()] == ["query=k7", "query=k39", None]


def test_classes_do_not_multiply(spark):
    """Three classes of 40 tokens that only decide together: one rule each way, not 64 000."""
    part = [[f"{c}{k}=1" for k in range(40)] for c in "abc"]
    met = [(), (0,), (1,), (2,), (0, 1), (0, 1), (0, 2), (0, 2), (1, 2), (1, 2), (0, 1, 2)]
    labelled = [("http://h.com/x?" + "&".join(q for c in m for q in part[c]), "block" if len(m) == 3 else "allow") for m in met for _ in range(15)]
    mined = ur.mine(spark.createDataFrame(labelled, "url string, verdict string"))
    assert len(mined) < 50
    pages = spark.createDataFrame([("x://b.org/?a3&b17&c39",), ("x://b.org/?a3&b17",)], "url string")
    assert [r["verdict"] for r in ur.judge(pages, mined, rules=()).collect()] == ["block", "allow"]


def test_rules_of_many_tokens(spark):
    """Only all five keys together tell: any four of them are mostly good."""
    met = [[k for k in range(5) if k != j] for j in range(5) for _ in range(20)] + [list(range(5))] * 8
    labelled = [("http://h.com/x?" + "&".join(f"q{k}=1" for k in m), "block" if len(m) == 5 else "allow") for m in met]
    mined = ur.mine(spark.createDataFrame(labelled, "url string, verdict string"))
    assert [r.tokens for r in mined if r.verdict == "block"] == [tuple(f"query=q{k}" for k in range(5))]


@pytest.mark.parametrize("empty", [True, False])
def test_whole_table(spark, sf, empty):
    got = ur.op8_urls(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    if empty:
        assert ur.judge(spark.createDataFrame([], "page_id long, url string"), []).count() == 0
        return
    by = {r["page_id"]: r for r in got.collect()}
    assert by.keys() == {p["page_id"] for p in pages}
    bad = {r["doc_id"]: r["toxic"] == 1 or r["quality"] == 0 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    shown = [(p["url"], re.search(r"/([0-9]{1,18})([/.?#][^/]*)?$", p["url"] or "")) for p in pages]
    labelled = [(u, "block" if bad[int(m[1])] else "allow") for u, m in shown if m and int(m[1]) in bad]
    assert labelled
    mined = written_out(brute_mine(labelled, ur.MIN_CONFIDENCE))
    for p in pages:
        host, path = host_path(p["url"])
        rule, verdict = brute_rule(host, path)
        t = set(ur.tokens(p["url"]))
        first = next((r.verdict for r in mined if set(r.tokens) <= t), "allow")
        r = by[p["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or first)
