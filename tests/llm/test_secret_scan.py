"""Secret scans beside brute force, and what the ledger spares."""

import hashlib
import re
import uuid

from zonalis.llm import secret_scan as ss

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    """Base findings as the contract words them."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], ss.KINDS.index(x[0])))


HARD = ["token=secret: abcdefghijklmnop", "Token == 0123456789abcdef0", "AKIAAKIA" + "Z" * 12, "AKIA", "é password='" + "x" * 12,
        "API_KEY:  \"aaaaaaaaaaaa\" apikey=short", "paſſword=abcdefghijklmn", "toKen=abcdefghijklmn", "f" * 16 + " " + "0" * 15,
        "-----BEGIN RSA PRIVATE KEY-----\nAbC+/=\n-----END RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "", "passwordpassword=xxxxxxxxxxxx"]


def test_patterns():
    for t in HARD:
        assert [s for s in ss.find(t) if s[0] in ss.BASE] == brute(t), t
    assert [k for k, *_ in ss.find(HARD[9])] == ["pem"] and "github" in [k for k, *_ in ss.find(HARD[10])]


def test_ledger(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    secret = "token = 0123456789abcdef01"
    rows = [("a", 1, secret), ("b", 1, secret), ("a", 2, "clean"), ("a", 2, "clean"), (None, 1, None), (None, 2, secret + "!")]
    v = spark.createDataFrame(rows, "path string, spans long, text string")
    one = ss.scan(v, ledger, rules=ss.RULES[:1]).collect()
    assert len(one) == 6 and sorted(len(r["spans"]) for r in one) == [0, 0, 0, 1, 1, 1]
    pairs = spark.read.parquet(ledger)
    assert pairs.select("blob", "rule").distinct().count() == 4
    # a second rule meets every blob; the first one only a new blob
    more = v.union(spark.createDataFrame([("c", 1, "AKIA" + "B" * 14), ("c", 2, secret)], v.schema))
    two = ss.scan(more, ledger, rules=ss.RULES[:2]).collect()
    assert len(two) == 8 and sum(len(r["spans"]) for r in two) == 5
    assert spark.read.parquet(ledger).select("blob", "rule").distinct().count() == 10
    before = spark.read.parquet(ledger).count()
    ss.scan(more, ledger, rules=ss.RULES[:2]).collect()
    assert spark.read.parquet(ledger).count() == before      # nothing was left to scan
    assert ss.scan(v.limit(0), f"{tmp_path}/other").count() == 0


def test_redaction(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x token=0123456789abcdef01 y"), (1, "clean"), (2, None)], "doc_id long, text string")
    got = ss.redacted(docs, ss.scan(docs, f"{tmp_path}/{uuid.uuid4()}", path="doc_id"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "clean"), (1, "x [SECRET] y"), (2, None)]


def test_whole_table(spark, sf):
    got = {r["doc_id"]: r for r in ss.op3_secrets(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = brute(d["text"] or ""), got[d["doc_id"]]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, *_ in want) for x in ss.BASE]
        assert set(said.split(",")) <= set(r["spans"].split(","))
