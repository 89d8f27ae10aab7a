from decimal import Decimal

from pledgetrace.operators import reset as rs
from pledgetrace.operators import trail as tr
from pledgetrace.operators import workspace as wk
from pledgetrace.profile import ENGLISH

EV = ("id bigint, commitment_id bigint, title string, snippet string, status_hint string, "
      "status_excerpt string, polarity string, flags array<string>")
LINK = ("id bigint, commitment_id bigint, evidence_id bigint, score double, relationship string, "
        "review_status string")
BUD = ("id bigint, evidence_id bigint, kind string, currency string, amount decimal(38,6), "
       "amount_raw string, source_url string, fiscal_year int")


def evidence(spark, *rows):
    return spark.createDataFrame([(i, 1, f"e{i}", s, h, f"x{i}", p, []) for i, s, h, p in rows], EV)


def links(spark, *ids):
    return spark.createDataFrame([(10 + i, 1, i, 1.0 / i, "direct_implementation", "accepted")
                                  for i in ids], LINK)


def budgets(spark, *rows):
    return spark.createDataFrame([(n, 1, k, "HUF", Decimal(a), f"{a} Ft", "u", 2024)
                                  for n, (k, a) in enumerate(rows)], BUD)


def row(spark, ev, ln, bu, bridge=()):
    com = spark.createDataFrame([(1, "M1", "t", None), (2, None, "u", 5.0)],
                                "id bigint, code string, title string, target_value double")
    br = spark.createDataFrame(list(bridge), "procurement_id string, evidence_id bigint")
    out = {r["commitment_id"]: r for r in tr.trail(com, ln, ev, bu, br, ENGLISH).collect()}
    # a commitment without anything is still there
    assert out[2]["gaps"] == [tr.NO_EVIDENCE, tr.NO_BUDGET] and out[2]["status"] == "unknown"
    return out[1]


def test_appropriation_is_not_spending(spark):
    ev, ln = evidence(spark, (1, "", "planned", "affirmative")), links(spark, 1)
    r = row(spark, ev, ln, budgets(spark, ("initial_appropriation", 100), ("reported_expenditure", 90)))
    assert not r["financially_executed"] and r["findings"] == [tr.ONLY_REPORTED, tr.NOT_CONFIRMED]
    bu = budgets(spark, ("initial_appropriation", 100_000_000), ("amended_appropriation", 70_000_000),
                 ("actual_expenditure", 60_000_000))
    r = row(spark, ev, ln, bu)
    assert r["financially_executed"] and r["financial_states"] == [
        "initial_appropriation", "amended_appropriation", "actual_expenditure"]
    assert r["findings"] == ["2024: 10 000 000 HUF of the appropriation was not spent "
                             "(60 000 000 of 70 000 000)."]
    signed = evidence(spark, (1, "Completion certificate signed.", "planned", "affirmative"))
    assert row(spark, signed, ln, budgets(spark))["financially_executed"]


def test_a_cancelled_contract_takes_its_evidence_along(spark):
    ev = evidence(spark, (1, "", "completed", "affirmative"), (2, "", "planned", "termination"))
    bridge = [("P", 1), ("P", 2)]
    r = row(spark, ev, links(spark, 1), budgets(spark), bridge)
    assert r["status"] == "unknown" and r["status_excerpt"] is None and r["n_regressed"] == 1
    both = row(spark, ev, links(spark, 1, 2), budgets(spark), bridge)
    # the cancelling passage itself is not flagged on reading
    assert (both["status"], both["n_regressed"]) == ("planned", 1)


def test_best_status_prefers_the_earlier_of_equals(spark):
    ev = evidence(spark, (1, "", "planned", "affirmative"), (2, "", "completed", "affirmative"),
                  (3, "", "completed", "affirmative"), (4, "", "budget_evidence", "affirmative"))
    r = row(spark, ev, links(spark, 1, 2, 3, 4), budgets(spark))
    assert (r["status"], r["status_excerpt"]) == ("completed", "x2")
    assert r["gaps"] == [tr.NO_TARGET, tr.NO_BUDGET]


def test_same_figure_counts_once(spark):
    ev, ln = evidence(spark, (1, "", "planned", "affirmative")), links(spark, 1)
    bu = budgets(spark, ("estimated_cost", 5), ("estimated_cost", 5), ("actual_expenditure", 5))
    pairs = tr.accepted_pairs(ln, ev)
    assert sorted(r["id"] for r in tr.deduped_budgets(pairs, bu).collect()) == [0, 2]


CAND = ("id bigint, document_id bigint, suggested_type string, normalized_title string, text string, "
        "source_page int, code string, review_status string")


def cand(id, title, kind="measure", status="unreviewed", page=3, code=None):
    return (id, 1, kind, title, f"{title} text", page, code, status)


def build(spark, cands, coms=(), lnk=(), ev=()):
    c = spark.createDataFrame(list(cands), CAND)
    m = spark.createDataFrame(list(coms), "id bigint, candidate_id bigint")
    l = spark.createDataFrame(list(lnk), "id bigint, commitment_id bigint, evidence_id bigint, review_status string")
    e = spark.createDataFrame([(i,) for i in ev], "id bigint")
    return wk.workspace_rows(c, m, l, e), c


def test_one_row_per_title_and_kind(spark):
    rows, _ = build(spark, [cand(1, "Fák ültetése"), cand(2, "**Fák ültetése.**", page=9), cand(3, "Napelemek")])
    assert sorted((r["id"], r["n_mentions"]) for r in rows.collect()) == [(1, 2), (3, 1)]


def test_stages(spark):
    a, r = "accepted", "rejected"
    rows, _ = build(
        spark, [cand(1, "a"), cand(2, "b", status=r), cand(3, "c", status=a), cand(4, "d", status=a),
                cand(5, "e", status=a), cand(6, "f", "indicator", a)],
        [(10 + i, i) for i in (3, 4, 5, 6)],
        [(1, 13, 1, "unreviewed"), (2, 14, 2, "accepted"), (3, 15, 99, "unreviewed")], [1, 2])
    assert {x["title"]: x["stage"] for x in rows.collect()} == {
        "a": "confirm", "b": "rejected", "c": "review", "d": "done", "e": "search", "f": "done"}
    counts = {x["stage"]: x["n"] for x in wk.stage_counts(rows).collect()}
    assert counts == {"all": 5, "confirm": 1, "search": 1, "review": 1, "done": 2, "rejected": 1}


def test_filters(spark):
    rows, c = build(spark, [cand(1, "Fák"), cand(2, "Napelem", status="rejected"), cand(3, "Esővíz", code="M1.2")])
    keep = lambda *a: sorted(r["id"] for r in wk.stage_filter(rows, c, *a).collect())
    assert keep() == [1, 3] and keep("rejected") == [2]
    assert keep("all", "all", " m1.2") == [3] and keep("all", "objective") == []


def test_shown_mention(spark):
    rows, c = build(spark, [cand(1, "a", status="accepted"), cand(2, "a")])
    pick = lambda n: spark.createDataFrame([("ameasure", n)], "group_key string, picked bigint")
    shown = lambda n: wk.shown_mention(rows, c, pick(n)).first()["shown_id"]
    assert (shown(0), shown(1), shown(99)) == (2, 1, 2)


def test_reset_keeps_what_a_person_decided(spark):
    ln = spark.createDataFrame([(1, 1, 1, "accepted"), (2, 1, 2, "unreviewed"), (3, 1, 3, "rejected")],
                               "id bigint, commitment_id bigint, evidence_id bigint, review_status string")
    ev = spark.createDataFrame([(1, "affirmative"), (2, "termination"), (3, "amendment"), (4, "affirmative")],
                               "id bigint, polarity string")
    bu = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id bigint, evidence_id bigint")
    br = spark.createDataFrame([("P", 1), ("P", 2), ("P", 3), ("Q", 4)], "procurement_id string, evidence_id bigint")
    t = {"links": ln, "evidence": ev, "budgets": bu, "artifact_evidence": br,
         "artifacts": tr.artifact_status(br, ev),
         "candidates": spark.createDataFrame([(1, "unreviewed"), (2, "unreviewed")], "id bigint, review_status string"),
         "commitments": spark.createDataFrame([(7, 1), (8, None)], "id bigint, candidate_id bigint"),
         "notes": spark.createDataFrame([("link", 1), ("link", 2), ("candidate", 2)], "subject_kind string, subject_id bigint")}
    got = {r["table"]: r["n"] for r in rs.reset_counts(t).collect()}
    # P loses its termination, falls back to the amendment; Q loses its only passage
    assert got == {"budgets": 1, "links": 1, "artifact_evidence": 2, "implementation_artifacts": 3,
                   "evidence": 2, "candidates": 1, "notes": 2}


def test_a_suggested_relationship_holds_where_none_was_set(spark):
    ln = spark.createDataFrame([(10, 1, 1, 1.0, None, "accepted", "direct_implementation"), (11, 1, 2, 0.5, "budget", "accepted", "direct_implementation")],
                               LINK + ", suggested_relationship string")
    r = row(spark, evidence(spark, (1, "", "completed", "affirmative"), (2, "", "planned", "affirmative")), ln, budgets(spark))
    assert r["status"] == "completed" and tr.NO_EVIDENCE not in r["gaps"]


def test_lines_show_the_decimals_of_the_page(spark):
    bud = BUD + ", amount_native string, amount_huf bigint"
    rows = [("initial_appropriation", "EUR", "100.50", "100.50", None), ("actual_expenditure", "EUR", "60", "60", None),
            ("initial_appropriation", "HUF", None, None, 3_000_000), ("actual_expenditure", "HUF", "1000000", "1000000", 1_000_000)]
    bu = spark.createDataFrame([(n, 1, k, c, None if a is None else Decimal(a), f"{n}", "u", 2024, t, h) for n, (k, c, a, t, h) in enumerate(rows)], bud)
    r = row(spark, evidence(spark, (1, "", "planned", "affirmative")), links(spark, 1), bu)
    assert r["findings"] == ["2024: 40.50 EUR of the appropriation was not spent (60 of 100.50).",
                             "2024: 2 000 000 HUF of the appropriation was not spent (1 000 000 of 3 000 000)."]
