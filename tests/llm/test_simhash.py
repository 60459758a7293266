"""Fingerprints, exact links and components beside brute force."""

import random
import re

import xxhash

from zonalis.llm import simhash as sh
from zonalis.llm.components import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs_of):
    """{node: smallest node reachable} from {node: neighbours}."""
    out = {}
    for n in sorted(pairs_of):
        todo = [n] if n not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += pairs_of[x]
    return out


def brute(fps):
    near = {k: [] for k in fps}
    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                near[a].append(b)
                near[b].append(a)
    return slow_components(near)


def test_fingerprint():
    for t in (None, "", " \n", "A b", "one TWO three four", "É a\xa0b c d", "x " * 9000, "a b c " * 7):
        assert sh.fingerprint(t) == slow_fingerprint(t)


def linked(spark, values):
    df = spark.createDataFrame([(sh.signed(v), k) for k, v in values.items()], "fp long, id long")
    got = {r["node"]: r["component"] for r in components(sh.links(df), "a", "b").collect()}
    return {k: got.get(k, k) for k in values}


def test_no_pair_is_missed(spark, monkeypatch):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    values = {}
    for s in seeds:                                        # chains of flips around each seed
        x = s
        for _ in range(12):
            for _ in range(rng.choice((1, 2, 3, 3, 4))):
                x ^= 1 << rng.randrange(64)
            values[len(values)] = x
    values = {k: v for k, v in values.items() if list(values.values()).index(v) == k}
    want = brute(values)
    assert linked(spark, values) == want and len(set(want.values())) > 62
    monkeypatch.setattr(sh, "blocked_pairs", lambda df, keys, spread: __import__("zonalis.llm.common", fromlist=["x"]).blocked_pairs(df, keys, spread, 5))
    assert linked(spark, values) == want


def test_large_group_of_near_copies(spark):
    base = 0x0123456789ABCDEF
    values = {0: base} | {1 + k: base ^ (1 << a) ^ (1 << b) for k, (a, b) in enumerate((a, b) for a in range(64) for b in range(a))}
    assert set(linked(spark, values).values()) == {0}


def test_rows(spark):
    t = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(4, t, "x"), (4, t, "x"), (2, t, None), (None, t, "y"), (7, None, "z"), (9, " ", "z"), (8, "else " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in sh.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 2), (4, 2), (2, 2), (None, 2), (7, 7), (9, 7), (8, 8)], key=str)
    assert sh.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_where_ids_repeat(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(600)]
    first = " ".join(words)
    near = next(t for t in (" ".join(words[:-1] + [f"x{k}"]) for k in range(1000))
                if 1 <= (sh.fingerprint(t) ^ sh.fingerprint(first)).bit_count() <= sh.RADIUS)
    other, third = "an unrelated text about boats and the sea", "one more about bread, salt and an oven"
    rows = [(2, first), (5, near), (5, other), (5, other), (5, third), (6, third), (7, "words of one id"), (7, "WORDS of one id"), (None, other), (None, "no id here")]
    want = {(2, first), (5, other), (5, third), (None, "no id here")}
    kept = []
    for given in (rows, rows[::-1]):
        got = [tuple(r) for r in sh.one_of_each(spark.createDataFrame(given, "doc_id long, text string").coalesce(1)).collect()]
        assert len(got) == 5 and want < set(got)
        kept.append(set(got))
    assert kept[0] == kept[1]


def test_components_of_odd_links(spark):
    links = [(1, 2), (2, 1), (3, 2), (5, 5), (None, 4), (9, 8), (10, 9), (11, 10), (12, 11), (20, 1)] + [(100, k) for k in range(101, 160)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    assert got == slow_components(near)
    assert components(df.limit(0), "a", "b").count() == 0


def test_whole_table(spark, sf):
    got = {r["doc_id"]: r for r in sh.op9_simhash(spark, sf).collect()}
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r["component_id"] for k, r in got.items()} == brute(fps)
