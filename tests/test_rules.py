from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pledgetrace.functions import money as mn
from pledgetrace.functions import rules as rl
from pledgetrace.operators import matching as mt
from pledgetrace.profile import ENGLISH, load_profile, make_profile

# just the words the examples need
HU = make_profile({
    "code": "hu", "currency": "HUF", "decimal_comma": True, "min_amount": 1000,
    "currency_words": {"Ft": "HUF", "forint": "HUF", "EUR": "EUR", "€": "EUR"},
    "multiplier_words": {"milliárd": 1000000000, "millió": 1000000, "ezer": 1000},
    "budget_cues": {"actual_expenditure": ["zárszámadás"],
                    "initial_appropriation": ["támogatást nyert", "keretösszeg"],
                    "estimated_cost": ["becsült költség"],
                    "reported_expenditure": ["kifizetés"]},
    "termination_cues": ["felmond"], "amendment_cues": ["szerződésmódosítás"],
    "maintenance_cues": ["csőtörés", "kátyúz"], "upgrade_cues": ["vezetékcsere"],
    "jurisdiction_cues": {"public_utility_water": ["ivóvíz"],
                          "public_utility_heating": ["távhő"]},
    "procurement_id_re": r"\b(?:EKR\d{9,12}|[A-Z]{3,6}-\d\.\d\.\d-\d{2}-\d{4}-\d{5})\b",
    "parcel_re": r"(\d{3,6}(?:/\d+)?)\s*hrsz|hrsz\.?:?\s*(\d{3,6}(?:/\d+)?)",
    "status_rules": [["completed", ["elkészült", "átad"]], ["in_implementation", ["létre"]]],
})


@pytest.mark.parametrize("text, kind, huf", [
    ("A beruházás becsült költsége 120 millió Ft.", "estimated_cost", 120_000_000),
    ("A projekt 2,5 milliárd Ft vissza nem térítendő támogatást nyert.",
     "initial_appropriation", 2_500_000_000),
    ("A munkálatokra eddig 4 millió Ft kifizetésre került.", "reported_expenditure", 4_000_000),
    ("A program értéke 300 000 Ft.", None, 300_000),
    ("A keretösszeg 300.000 forint.", "initial_appropriation", 300_000),
    ("881.101 Ft kifizetésre került.", "reported_expenditure", 881_101),
    ("A keret 4,1 milliárd Ft.", None, 4_100_000_000),
    ("2024 300 000 Ft", None, 2024300000)])
def test_money_is_exact_and_its_kinds_stay_apart(one, text, kind, huf):
    [m] = one(mn.money_mentions("t", HU), t=text)
    assert (m["kind"], m["amount_huf"]) == (kind, huf)


def test_foreign_money_keeps_its_decimals(one):
    a, b = one(mn.money_mentions("t", HU), t="Ára 10,50 EUR.\nMajd €2,5 millió volt 2023-ban.")
    assert (a["currency"], a["amount_native"], a["amount_huf"]) == ("EUR", "10.50", None)
    assert (b["amount_native"], b["amount"]) == ("2500000.0", Decimal("2500000"))
    assert (b["sentence"], b["year"]) == ("Majd €2,5 millió volt 2023-ban.", 2023)
    assert one(mn.money_mentions("t", HU), t="Nincs.") == []
    assert one(mn.money_mentions("t", make_profile({})), t="5 Ft") == []


def test_relevant_money_drops_noise_and_repeats(one):
    t = "Becsült költség 5 millió Ft. Becsült költség 5 millió Ft. Becsült költség 12 Ft. 9 ezer Ft."
    got = one(mn.relevant_money(mn.money_mentions("t", HU), HU), t=t)
    assert [m["amount_native"] for m in got] == ["5000000"]


def test_ids_parcels_polarity(one):
    t = ("A Kálvária tér (36542/1 hrsz.) felújítása az EKR001234562021 eljárásban. "
         "A VEKOP-6.2.1-15-2016-00001 projekt támogatási szerződése.")
    a = one(rl.audit_passage("t", HU), t=t)
    assert a["procurement_ids"] == ["EKR001234562021", "VEKOP-6.2.1-15-2016-00001"]
    assert a["parcels"] == ["36542/1"]
    assert one(rl.parcels("t", HU), t="hrsz.: 35012/4 alatti ingatlan") == ["35012/4"]
    pol = lambda t: one(rl.polarity("t", HU), t=t)
    assert pol("A szerződést a kivitelező felmondta.") == "termination"
    assert pol("Szerződésmódosítás: a határidő 2026.") == "amendment"
    assert pol("Átadták a felújított teret.") == "affirmative"


def test_maintenance_is_suspect_and_capped(one):
    flags = lambda t: one(rl.maintenance_flags("t", HU), t=t)
    assert flags("Csőtörés javítás és kátyúzás a Práter utcában.") == ["maintenance_only_suspect"]
    assert flags("Csőtörés után a teljes vezetékcsere megtörtént.") == []
    cap = lambda rel: one(rl.cap_hint(F.lit(rel), F.array().cast("array<string>"), F.array(
        F.lit("maintenance_only_suspect"))))
    assert cap("direct_implementation")["relationship"] == "related_but_indirect"
    assert "maintenance" in cap("direct_implementation")["reasons"][0]
    assert cap("probably_unrelated")["relationship"] == "probably_unrelated"


def test_jurisdiction(one):
    j = lambda t: one(rl.jurisdiction("t", HU), t=t)
    assert j("Ivóvíz-hálózat rekonstrukciója") == "public_utility_water"
    assert j("Távhő hőközpontok") == "public_utility_heating"
    assert j("Fasor a Népszínház utcában") == "district_municipality"


@pytest.mark.parametrize("text, report, money, status", [
    ("A felújított tér 2023-ban elkészült és átadásra került.", False, False, "completed"),
    ("Nincs itt semmi releváns.", False, False, "unknown"),
    ("A klímastratégia összefoglal.", True, False, "background_only"),
    ("A költség 120 millió Ft.", True, True, "budget_evidence")])
def test_classify_status(one, text, report, money, status):
    got = one(rl.classify_status("t", F.lit(report), F.lit(money), HU), t=text)
    assert got["status"] == status and bool(got["excerpt"]) == (status == "completed")


def test_status_excerpt_is_its_sentence(one):
    got = one(rl.classify_status("t", F.lit(False), F.lit(False), ENGLISH),
              t="First.\nThe  park was opened in May. More")
    assert tuple(got) == ("completed", "The park was opened in May.")


def test_profiles_skip_unknown_keys_and_read_old_forms():
    p = load_profile('{"code":"x","currency":"HUF","currency_words":["Ft"],"old":1,'
                     '"budget_cues":{"approved_allocation":["a"]}}')
    assert p.currency_words == {"Ft": "HUF"} and list(p.budget_cues) == ["initial_appropriation"]
    with pytest.raises(ValueError, match="budget kind"):
        make_profile({"budget_cues": {"typo": []}})


def test_shared_names_and_score(one):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    f = mt.features(F.lit(0.8), (arr("rév8 zrt."), arr("rév8", "rév8 zrt. x")),
                    (arr(), arr()), (arr("2030"), arr("2030", "2024")))
    got = one(f)
    # four letters are too few to match by containment
    assert got["shared_organisations"] == ["rév8 zrt."] and got["shared_dates"] == ["2030"]
    assert one(mt.match_score(f)) == pytest.approx(0.6 * 0.8 + 0.075 + 0.05)
    hint = one(mt.suggest_relationship(f, F.lit(False)))
    assert hint["relationship"] == "direct_implementation"
    low = mt.features(F.lit(0.1), (arr(), arr()), (arr(), arr()), (arr(), arr()))
    assert one(mt.suggest_relationship(low, F.lit(True)))["relationship"] == "probably_unrelated"


def test_the_money_pattern_is_matched_once_per_text(spark):
    texts = [("It paid €2.5 million, 30 EUR and £1,000.25 in 2023.\nThe budgeted 5 k$ are left.",), ("No sum, only EUR.",)]
    m = spark.createDataFrame(texts, "t string").select(mn.money_mentions("t", ENGLISH).alias("m"))
    got = [[(x["amount_raw"], x["currency"], x["amount_native"], x["kind"], x["year"]) for x in r["m"]] for r in m.collect()]
    assert got == [[("€2.5 million", "EUR", "2500000.0", "estimated_cost", 2023), ("30 EUR", "EUR", "30", "estimated_cost", 2023),
                    ("£1,000.25", "GBP", "1000.25", "estimated_cost", 2023), ("5 k$", "USD", "5000", "estimated_cost", None)], []]
    assert m._jdf.queryExecution().optimizedPlan().toString().count("(?iuU)") == 1


def test_a_task_reads_a_bounded_part_of_a_file(spark):
    from pledgetrace.session import tune
    assert tune(spark).conf.get("spark.sql.files.maxPartitionBytes") == "16m"
