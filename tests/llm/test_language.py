"""Held-out accuracy, backoff and the defined cases."""

import math

from zonalis.llm import language as lg

ROWS = [(k, t, n) for k, (t, n) in enumerate(
    [("the house and the garden are old", "en"), ("the river runs through the town", "en"),
     ("das Haus und der Garten sind alt", "de"), ("der Fluss geht durch die Stadt", "de")] * 5)]


def model_of(spark, rows=ROWS):
    return lg.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_words_first_then_shorter_ngrams(spark):
    m = model_of(spark)
    assert m.langs == ["de", "en"] and m.predict("the garden")[0] == "en" and m.predict("der Garten")[0] == "de"
    # an unseen word: mean of its known four-letter pieces and nothing shorter
    word = "houses"
    known = [m.gram_scores[m.grams[g]] for g in ("<hou", "hous", "ouse") if g in m.grams]
    assert known and abs(m.unseen(word) - sum(known) / len(known)).max() < 1e-12
    # no four-, three- or two-letter piece known: single letters decide
    assert not any(g in m.grams for g in ("<q", "qt", "th>") if len(g) == 4)
    one = m.unseen("xyh")
    assert one.shape == (2,) and math.isfinite(one.sum())
    # frequency of a known word, by hand
    n_en = sum(len(t.split()) for _, t, n in ROWS if n == "en")
    the = sum(t.split().count("the") for _, t, n in ROWS if n == "en")
    want = math.log((the + lg.SMOOTH) / (n_en + lg.SMOOTH * len(m.words)))
    assert abs(m.word_scores[m.words["the"]][1] - want) < 1e-12


def test_defined_cases(spark):
    m = model_of(spark)
    rows = [(1, None), (2, ""), (3, "12 -- _ ²"), (4, "文文"), (5, "the house " * 20000), (5, "the house " * 20000), (None, "der")]
    got = lg.predict(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score"), m).collect()
    by = {(r["doc_id"], (r["text"] or "")[:3]): (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == 7 and all(by[k] == ("und", 0.0) for k in [(1, ""), (2, ""), (3, "12 ")])
    assert by[4, "文文"] == ("de", 0.5) and by[5, "the"][0] == "en" and by[None, "der"][0] == "de"
    assert all(0 <= s <= 1 for _, s in by.values())
    none = model_of(spark, [(1, "x", None)])
    assert none.predict("the house") == ("und", 0.0)
    assert model_of(spark, []).predict("the") == ("und", 0.0)


def test_cache_is_bounded_and_changes_nothing(spark, monkeypatch):
    m = model_of(spark)
    texts = [f"the gard{k} houses{k % 9}" for k in range(60)]
    want = [m.predict(t) for t in texts]
    monkeypatch.setattr(lg, "CACHE", 10)
    m.seen = None
    assert [m.predict(t) for t in texts] == want


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in lg.op5_language(spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [k for k in truth if got[k]["held_out"]]
    assert got.keys() == truth.keys() and 0.1 < len(held) / len(truth) < 0.3
    assert sum(got[k]["lang_pred"] == truth[k] for k in held) / len(held) > 0.98
