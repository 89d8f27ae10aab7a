import random

import pytest

from pledgetrace.operators import evaluate as ev


def test_metrics(spark):
    ranked = spark.createDataFrame([("s", "q", "b", 1, 0.9), ("s", "q", "a", 2, 0.8), ("s", "q", "x", 3, 0.1)],
                                   "system string, query string, doc string, rank int, score double")
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "c", 1), ("q", "b", 0)], "query string, doc string, grade int")
    m = {r["k"]: r for r in ev.rank_metrics(ranked, qrels, [1, 2]).collect()}
    assert (m[2]["recall"], m[2]["mrr"], m[2]["judged"], m[2]["p1"]) == (0.5, 0.5, 1.0, 0.0)
    assert m[2]["ndcg"] == pytest.approx((7 / 1.5849625) / (7 + 1 / 1.5849625))
    assert (m[1]["recall"], m[1]["mrr"], m[1]["ndcg"]) == (0.0, 0.0, 0.0)
    # the ideal takes every grade above zero even when only high ones count as found
    high = ev.rank_metrics(ranked, qrels, [2], 2).first()
    assert high["recall"] == 1.0 and high["ndcg"] == m[2]["ndcg"]
    assert sorted(map(tuple, ev.unjudged(ranked, qrels, 3).collect())) == [("q", "x")]
    rep = {r["metric"]: r["value"] for r in ev.retrieval_report(ranked, qrels, [1, 2]).collect()}
    assert rep["recall@2"] == 0.5 and rep["p@1"] == 0.0 and rep["auroc"] == 0.0


def area(spark, pos, neg):
    rows = [(float(x), True) for x in pos] + [(float(x), False) for x in neg]
    return ev.auroc(spark.createDataFrame(rows, "score double, positive boolean")).first()["auroc"]


def test_auroc(spark):
    assert area(spark, [2, 3], [1]) == 1.0 and area(spark, [1], [1]) == 0.5
    assert area(spark, [1], []) is None
    rng = random.Random(5)
    pos, neg = ([round(rng.gauss(m, 1), 1) for _ in range(120)] for m in (0.5, 0))
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert area(spark, pos, neg) == pytest.approx(want)


def kap(spark, a, b):
    cells = spark.createDataFrame([("x", p, q, 1) for p, q in zip(a, b)], "g string, a int, b int, n bigint")
    return ev.kappa(cells, ["g"]).first()["kappa"]


def test_kappa(spark):
    assert kap(spark, [1, 0, 1, 0], [1, 0, 1, 0]) == 1.0
    assert kap(spark, [1, 1, 0, 0], [1, 0, 1, 0]) == 0.0
    assert kap(spark, [1, 1], [1, 1]) is None


def test_agreement_and_consensus(spark):
    rows = [("a", "q", "x", 2), ("a", "q", "y", 0), ("a", "q", "z", 1), ("b", "q", "x", 3),
            ("b", "q", "y", 1), ("b", "q", "w", 2), ("judge", "q", "x", 0)]
    g = spark.createDataFrame(rows, "grader string, query string, doc string, grade int")
    r = ev.agreement(g.filter("grader <> 'judge'")).first()
    assert (r["pairs"], r["exact"], r["binary"]) == (2, 0.0, 1.0)
    got = {r["doc"]: (r["grade"], r["graders"]) for r in ev.consensus(g).collect()}
    assert got == {"x": (2, 2), "y": (0, 2), "z": (1, 1), "w": (2, 1)}


def test_check_gold(spark):
    gold = [("d", "p", 1, "Plant  trees", False), ("d", "p", 1, "", False), ("d", "p", 1, "", True),
            ("d", "p", 1, "x", True), ("d", "p", 2, "Plant", False), ("d", "p", 1, None, None)]
    g = spark.createDataFrame(gold, "doc string, pdf string, page int, quote string, empty boolean")
    pages = spark.createDataFrame([("p", 1, "We Plant\ntrees here")], "pdf string, page int, text string")
    checked = ev.check_gold(g, pages)
    assert sorted((r["quote"], r["empty"]) for r in checked.filter("kept").collect()) == [("", True), ("Plant  trees", False)]
    assert tuple(ev.gold_counts(checked).first()) == ("d", 2, 4)
    assert ev.spot_check(checked, 1, ["pdf", "page", "quote"]).count() == 1


def gate(spark, old, new):
    df = lambda rows: spark.createDataFrame(rows, "doc string, split string, recall double")
    return ev.ship_gate(df(old), df(new)).first()


def test_ship_gate(spark):
    base = [("a", "train", 0.9), ("b", "holdout", 0.5)]
    assert not gate(spark, base, [("a", "train", 1.0), ("b", "holdout", 0.4)])["ship"]
    assert gate(spark, base, [("b", "holdout", 0.6)])["ship"]
    r = gate(spark, base, [("c", "holdout", 0.9)])
    assert not r["ship"] and r["differing"] == 2
    assert not gate(spark, [("a", "train", 0.9)], [("a", "train", 1.0)])["ship"]
