import pytest
from pyspark.sql import functions as F

from pledgetrace.functions import text as tx
from pledgetrace.functions.vectors import cosine, fit_vector

PAGE = "a fejlesztések bizonyít ékalapú \ntervezése érdekében, létr e hozza"


@pytest.mark.parametrize("page, excerpt, want", [
    (PAGE, "bizonyítékalapú tervezése", "bizonyít ékalapú \ntervezése"),
    (PAGE, "létre hozza", "létr e hozza"), (PAGE, "napelemek", None), (PAGE, "  ", None),
    ("A  fák\nültetése.", "A fák ültetése.", "A  fák\nültetése."),
    ("cost (net): 5.5 $ [x]", "(net): 5.5 $[x]", "(net): 5.5 $ [x]")])
def test_receipt_returns_the_characters_of_the_page(one, page, excerpt, want):
    assert one(tx.receipt("p", "e"), p=page, e=excerpt) == want


def test_lead_code(one):
    titles = {"M1.1.2 Távhő": "M1.1.2", "Ks1: szabályok": "Ks1", "Má-1 ÜHG": "Má-1",
              "Ms-3": "Ms-3", "2030-ra csökken": None, "Távhő fejlesztése": None,
              "A1. cél": "A1", "1.01 Carbon roadmap": "1.01", "2030 target": None,
              "1.5 million trees planted": None}
    assert {t: one(tx.lead_code("t"), t=t) for t in titles} == titles


@pytest.mark.parametrize("title, text, want", [
    ("M1.01 Carbon neutral roadmap", "t", ("Carbon neutral roadmap", None)),
    ("M1.01", "Develop pathways for the city", ("Develop pathways for the city", None)),
    ("1.01 Carbon neutral roadmap", "t", ("1.01 Carbon neutral roadmap", "1.01")),
    ("Roadmap", "t", ("Roadmap", None))])
def test_a_title_code_must_be_on_the_page(one, title, text, want):
    page = "1.01 Carbon neutral roadmap for the city. Develop pathways."
    assert tuple(one(tx.grounded_title("t", "x", "p"), t=title, x=text, p=page)) == want


LABELS = ("időtáv", "felelős", "lehetséges forrás", "forrás", "célkitűzés kódja", "mitigációs",
          "adaptációs")


@pytest.mark.parametrize("quote, want", [
    ("Időtáv 2021-2030", True), ("Felelős: Önkormányzat, helyi civil szervezetek", True),
    ("Mitigációs célkitűzés kódja Adaptációs célkitűzés kódja Ms-1.3 As-1.2", True),
    ("• Lehetséges forrás VMOP, ZIKOP, TOP Plusz", True),
    ("Zöldtető alkalmazására pilot projektet kell tervezni 2025-ig.", False),
    ("Forrásokat biztosít az önkormányzat a fák ültetésére.", False),
    ("Az önkormányzat felelős a fasorok gondozásáért és bővítéséért.", False)])
def test_fact_sheet_rows(one, quote, want):
    assert one(tx.form_row("q", LABELS), q=quote) is want
    assert one(tx.form_row("q", ()), q=quote) is False


def test_years_are_bare_and_in_order(one):
    assert one(tx.years("t"), t="2024. március 15-én, 2030-ra, 1999 és 2024, 1999és") == [
        "2024", "2030", "1999"]


def test_place_base_form(one):
    ends = ("ban", "ben", "ja")
    assert one(tx.norm_place("n", ends), n="Bérkocsis utcában") == "bérkocsis utcá"
    assert one(tx.norm_place("n", ends), n="Bérkocsis utcája") == "bérkocsis utcá"
    assert one(tx.norm_place("n", ends), n="Aja") == "aja"


def test_dedupe_names_keeps_the_first_spelling_at_the_last_place(one):
    names = F.array(*[F.lit(n) for n in ("RÉV8", "x", "rév8", "y")])
    assert one(tx.dedupe_names(names)) == ["x", "RÉV8", "y"]


def test_word_pack_covers_everything(one):
    text = " ".join(f"szó{i}" for i in range(500)) + " " + "x" * 150
    got = one(tx.word_pack("t", 100), t=text)
    assert " ".join(got) == text and all(len(p) <= 100 for p in got[:-1])
    assert one(tx.word_pack("t", 100), t="") == []


def test_display_columns(one):
    assert one(tx.display_title("t"), t="  **– Fák ültetése:** ") == "Fák ültetése"
    null = F.lit(None)
    assert one(tx.goal(null, null, null, null)) == "–"
    assert one(tx.goal(F.lit(100.0), F.lit("fa"), F.lit(2027), null)) == "100 fa by 2027"
    assert one(tx.goal(F.lit(1234567.0), null, null, F.lit("soon"))) == "1.23457e+06 by soon"
    assert one(tx.goal(F.lit(0.25), null, null, null)) == "0.25"
    assert one(tx.huf(F.lit(1234567.5))) == "1 234 568 Ft" and one(tx.huf(null)) == ""
    assert tuple(one(tx.page_link(F.lit("u#a"), F.lit(3)))) == ("Strategy · page 3", "u#page=3")
    assert tuple(one(tx.page_link(null, F.lit(3)))) == ("Source · page 3", None)
    assert tuple(one(tx.code_hint(F.lit("M1.2.3"), {"M": "measure"}))) == ("measure", 3)
    assert one(tx.code_hint(F.lit("X1"), {"M": "measure"})) is None


def test_halves_need_two_lines(one):
    assert one(tx.halves("t"), t="a\nb\nc\n") == ["a", "b\nc"]
    assert one(tx.halves("t"), t="a") is None


def test_casefold_and_norm(one):
    assert one(tx.norm("t"), t="Straße_1,  ÉG!") == "strasse_1 ég"


def test_vectors(one, spark):
    assert one(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    v = F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))
    assert one(fit_vector(v, 4)) == [1.0, 2.0, 0.0, 0.0]
    with pytest.raises(Exception, match="holds 1"):
        one(fit_vector(v, 1))
