"""Passages that are matched: which pages a query may see, and what is kept between runs."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pledgetrace.functions.tokens import HashedVectors, split_terms
from pledgetrace.operators import evidence as ev
from pledgetrace.operators import retrieval as rt
from pledgetrace.operators import scoring as sc
from pledgetrace.operators import sourcing as so
from pledgetrace.operators.index import index_pages, passages_of_pages
from pledgetrace.profile import ENGLISH


def pages_of(spark, texts):
    rows = [(i, f"https://s{i}.example.org/p", "abcdefghijklmnopqrstuvwxyz"[i % 26] * 5 + f" page {i}", t, 2024) for i, t in texts.items()]
    return spark.createDataFrame(rows, "page_id bigint, url string, title string, text string, published_year int")


def queries_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "query_id bigint, chunk string")


def counting(folder: Path):
    """A provider that leaves a file for each call, with the number of texts."""
    class Counting(HashedVectors):
        model = "counting"

        def __call__(self, texts):
            import uuid
            (folder / uuid.uuid4().hex).write_text(str(len(texts)))
            return super().__call__(texts)
    return Counting


def embedded(folder: Path) -> int:
    files = list(folder.iterdir())
    total = sum(int(f.read_text()) for f in files)
    for f in files:
        f.unlink()
    return total


def test_only_new_and_changed_pages_are_embedded(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    provider, store = counting(calls), str(tmp_path / "store")
    texts = {i: f"street trees number{i} planted " * 200 for i in range(20)} | {30: " "}
    run = lambda model="counting": sorted(map(tuple, index_pages(
        pages_of(spark, texts), store, model=model, provider=provider, buckets=8).drop("vector").collect()))
    first = run()
    assert embedded(calls) == len(first) > 40
    assert run() == first and embedded(calls) == 0
    files = {f: f.stat().st_mtime_ns for f in Path(store).rglob("*.parquet")}
    texts[7] = texts[7] + " changed"
    second = run()
    assert embedded(calls) == sum(r[0] == 7 for r in second)
    assert [r for r in second if r[0] != 7] == [r for r in first if r[0] != 7]
    # buckets without a changed page keep their files
    assert len({f.parent for f in files if not f.exists()}) == 1
    # another model has vectors of its own and leaves these
    assert [r[:2] for r in run("other")] == [r[:2] for r in second] and embedded(calls) == len(second)
    assert run() == second and embedded(calls) == 0


def test_ranking_from_the_store(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    provider, store = counting(calls), str(tmp_path / "store")
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(rng.choices(words, k=600)) for i in range(30)}
    queries = queries_of(spark, {q: " ".join(rng.choices(words, k=5)) for q in range(6)})
    key = lambda df: sorted((r["query_id"], r["page_id"], r["chunk_index"], r["doc_rank"], r["chunk"]) for r in df.collect())
    plain = key(ev.rank_documents(queries, pages_of(spark, texts), ENGLISH))
    kept = lambda: key(ev.rank_documents(queries, pages_of(spark, texts), ENGLISH, provider=provider, store=store))
    assert kept() == plain and embedded(calls) > 30
    assert kept() == plain and embedded(calls) == 6  # the queries alone


@pytest.mark.parametrize("per_pass", [4096, 5])
def test_a_query_sees_its_own_pages_only(spark, monkeypatch, per_pass):
    monkeypatch.setattr(rt, "QUERY_PASS", per_pass)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choices(words, k=30)) for i in range(60)}
    asked = {q: " ".join(rng.choices(words, k=6)) for q in range(23)}
    group_of = {q: rng.sample("abcd", rng.randint(0, 2)) for q in asked}
    members = {g: rng.sample(sorted(texts), 12) for g in "abc"}
    eligible = rt.Eligible(
        spark.createDataFrame([(q, g) for q in asked for g in group_of[q]], "query_id bigint, group string"),
        spark.createDataFrame([(g, p) for g in members for p in members[g]] * 2, "group string, page_id bigint"))
    allowed = {q: {p for g in group_of[q] for p in members.get(g, ())} for q in asked}
    h = HashedVectors()
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    ids = sorted(texts)
    sim = np.round(unit(h(list(asked.values()))) @ unit(h([texts[i] for i in ids])).T, 9)
    passages = pages_of(spark, texts).repartition(3)
    q = queries_of(spark, asked)
    dense = rt.match_dense(q, passages.withColumnRenamed("text", "chunk"), ["page_id"], 7, vector=None, text="chunk", eligible=eligible)
    want = {(a, p) for a in asked for p in sorted(allowed[a], key=lambda p: (-sim[a, ids.index(p)], p))[:7]}
    assert {(r["query_id"], r["page_id"]) for r in dense.collect()} == want
    hits = {a: {p: sum(t in set(split_terms(asked[a])) for t in split_terms(texts[p])) for p in allowed[a]} for a in asked}
    lexical = rt.match_lexical(q, passages.withColumnRenamed("text", "chunk"), ["page_id"], 4, text="chunk", eligible=eligible)
    want = {(a, p, hits[a][p]) for a in asked for p in sorted((p for p in hits[a] if hits[a][p]), key=lambda p: (-hits[a][p], p))[:4]}
    assert {(r["query_id"], r["page_id"], r["hits"]) for r in lexical.collect()} == want
    best = ev.rank_documents(q, pages_of(spark, texts), ENGLISH, eligible=eligible).collect()
    assert best and all(r["page_id"] in allowed[r["query_id"]] for r in best)


def test_owners_pages_come_from_the_registry(spark):
    com = spark.createDataFrame([(1, "Mains", "M1", "water"), (2, "Heating", None, "heat"), (3, "Trees", None, "city")],
                                "id bigint, title string, code string, jurisdiction string")
    kind = "id bigint, url string, publisher string, title string, sort_order int, jurisdiction string"
    sources = spark.createDataFrame([(1, "https://w.example.org/a", "Water", "t", 0, "water"),
                                     (2, "https://h.example.org/b", "Heat", "t", 0, "heat"),
                                     (3, "https://g.example.org/c#x", "City", "t", 0, None)], kind)
    hits = spark.createDataFrame([(0, "mains", "https://w.example.org/found"), (1, "heating", "https://w.example.org/not-theirs")],
                                 "pos int, query_substring string, url string")
    pages = spark.createDataFrame([(10, "https://w.example.org/a"), (11, "https://h.example.org/b"), (12, "https://g.example.org/c"),
                                   (13, "https://w.example.org/found"), (14, "https://w.example.org/not-theirs")],
                                  "page_id bigint, url string")
    got = so.eligible_pages(com, sources, hits, pages, [])
    pairs = got.queries.join(got.pages, "group").select("query_id", "page_id").distinct().collect()
    assert sorted(map(tuple, pairs)) == [(1, 10), (1, 12), (1, 13), (2, 11), (2, 12), (3, 12)]
    urls = so.collected_urls(com, sources, hits, []).select("commitment_id", "url").collect()
    at = {r["url"]: r["page_id"] for r in pages.collect()}
    assert sorted((c, at[u]) for c, u in urls) == sorted(map(tuple, pairs))


def test_many_queries_read_each_passage_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=20))) for i in range(400)], "id bigint, text string").repartition(4)
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(3000)], "query_id bigint, text string")
    provider = counting(calls)
    got = rt.match_hybrid(queries, docs, ["id"], 2, text="text", provider=provider)
    assert got.count() == 6000
    assert embedded(calls) == 3000 + 400


def test_a_second_pass_does_not_embed_again(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    monkeypatch.setattr(rt, "QUERY_PASS", 4)
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5}") for i in range(50)], "id bigint, text string")
    queries = spark.createDataFrame([(i, f"a{i % 7} b{i % 3}") for i in range(20)], "query_id bigint, text string")
    got = rt.match_hybrid(queries, docs, ["id"], 3, text="text", provider=counting(calls))
    assert got.groupBy("query_id").count().count() == 20
    assert embedded(calls) == 20 + 50


def test_reranker_that_fails_keeps_the_retrieval_order(spark):
    texts = {i: f"trees park{i} " * (i + 1) for i in range(6)}
    queries = queries_of(spark, {0: "trees park", 1: "broken trees park"})

    class Down:
        def __call__(self, queries, passages):
            if any("broken" in q for q in queries):
                raise ConnectionError("429")
            return [float(len(p)) for p in passages]

    plain = ev.rank_documents(queries, pages_of(spark, texts), ENGLISH).collect()
    got = ev.rank_documents(queries, pages_of(spark, texts), ENGLISH, scorer=Down).collect()
    order = lambda rows, q: [r["page_id"] for r in sorted(rows, key=lambda r: r["doc_rank"]) if r["query_id"] == q]
    assert order(got, 1) == order(plain, 1) and order(got, 0) == [5, 4, 3, 2, 1, 0]
    assert {r["query_id"]: r["rerank_failed"] for r in got} == {0: False, 1: True}


def test_lists_end_early_without_losing_a_row():
    rng = random.Random(9)
    for _ in range(30):
        lists = [rng.choices(range(25), [1 + (i % 5) ** 4 for i in range(25)], k=rng.randint(0, 60)) for _ in range(70)]
        asked = [sorted(set(rng.choices(range(40), k=rng.randint(0, 8)))) for _ in range(9)]
        import pandas as pd
        data = sc.lay_out(pd.DataFrame({"q": range(9), "t": [np.array(a, np.int64) for a in asked]}), "q", None, "t")
        [block] = sc.blocks(data)
        postings = sc.Postings([np.array(x, np.int64) for x in lists], data["vocabulary"])
        want = np.array([[sum(t in a for t in x) for a in asked] for x in lists], float)
        assert (block.hits(postings) == want).all()
        floor = np.array([rng.choice([-np.inf, 1, 5, 10, 30]) for _ in asked])
        got = block.hits(postings, floor)
        assert (got <= want).all() and (got[want >= floor] == want[want >= floor]).all()
        every = np.array([[all(t in x for t in a) for a in asked] for x in lists])
        assert (block.hits(postings, None, True) == np.where(every, want, 0)).all()


def test_buckets_find_most_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64))
    vectors = centres[rng.integers(0, 40, 2000)] + 0.35 * rng.standard_normal((2000, 64))
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, vector array<double>").repartition(4)
    queries = docs.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]): r["similarity"] for r in rt.match_dense(queries, docs, ["id"], 10).collect()}
    near = {(r["query_id"], r["id"]): r["similarity"] for r in rt.match_dense(queries, docs, ["id"], 10, buckets=sc.Buckets()).collect()}
    assert len(set(exact) & set(near)) >= 0.9 * len(exact)
    assert all(exact[p] == s for p, s in near.items() if p in exact)


def test_a_cancellation_found_later_caps_an_earlier_link(spark):
    pages = lambda *rows: spark.createDataFrame(list(rows), "page_id bigint, url string, title string, text string, published_on date")
    com = lambda i, title: spark.createDataFrame([(i, title, title, None, None, title)], "query_id bigint, title string, summary string, "
                                                 "code string, deadline_year int, chunk string")
    from datetime import date
    framework = (1, "https://www.city.org/files/plan.pdf", "plan.pdf", "Water mains renewed in 45 streets under contract CF-2024-000123. "
                 "The contract value was £2.5 million in 2024.", date(2024, 3, 1))
    cancelled = (2, "https://city.org/end", "End", "Water mains: the contract CF-2024-000123 was cancelled by the council.", date(2024, 9, 1))
    sources = spark.createDataFrame([(1, "https://city.org/", "City", "Home", 0, None), (2, "https://www.city.org/files/plan.pdf", "City", "Mains plan", 1, None)],
                                    "id bigint, url string, publisher string, title string, sort_order int, jurisdiction string")
    first = ev.find_evidence(com(1, "Water mains"), pages(framework), ENGLISH, sources=sources)
    [row] = first["evidence"].collect()
    assert (row["title"], row["publisher"], row["published_on"], row["published_year"]) == ("Mains plan", "City", date(2024, 3, 1), 2024)
    [link] = first["links"].collect()
    assert not any("cancelled" in r for r in link["reasons"])
    stored = first["evidence"].select("id", "commitment_id", "url")
    second = ev.find_evidence(com(2, "Water mains B"), pages(cancelled), ENGLISH, sources=sources, stored=stored,
                              contracts=first["artifact_evidence"])
    [new] = second["evidence"].collect()
    assert new["id"] == row["id"] + 1 and new["polarity"] == "termination"
    [state] = second["artifacts"].collect()
    assert (state["status"], state["status_evidence_id"]) == ("terminated", new["id"])
    # the earlier passage is told about, and its link, if nobody has decided on it, is judged again
    assert [r["evidence_id"] for r in second["changed"].collect()] == [row["id"]]
    again = lambda status: ev.judged_again(spark.createDataFrame(
        [(9, row["id"], "direct_implementation", ["close"], status)], "id bigint, evidence_id bigint, suggested_relationship string, reasons array<string>, review_status string"),
        first["evidence"], second["changed"], second["artifact_evidence"]).collect()
    [capped] = again("unreviewed")
    assert capped["suggested_relationship"] != "direct_implementation" and len(capped["reasons"]) > 1
    assert again("accepted") == []
    # found again by a later run, the first passage is suggested with the warning
    third = ev.find_evidence(com(1, "Water mains"), pages(framework), ENGLISH, stored=stored, budgets=first["budgets"],
                             contracts=first["artifact_evidence"].unionByName(second["artifact_evidence"]))
    [link] = third["links"].collect()
    assert link["evidence_id"] == row["id"] and any("amended or cancelled" in r for r in link["reasons"])


def test_passages_of_pages_by_url_and_content_key(spark):
    pages = pages_of(spark, {1: "one", 2: "two", 3: "three", 4: None})
    stored = spark.createDataFrame(
        [(1, "k-one", 0, "a", "mine"), (1, "k-old", 0, "b", "mine"), (2, "k-two", 0, "c", None), (2, "k-two", 1, "d", None), (9, "k-one", 0, "e", "x"),
         (3, "k-three", 0, "f", None), (3, None, 1, "g", None)], "page_id bigint, embed_model string, chunk_index int, chunk string, title string")
    key = F.concat(F.lit("k-"), "text")
    urls = pages.filter("page_id < 3").select("url")
    urls = urls.unionByName(urls).unionByName(spark.createDataFrame([(None,)], "url string"))

    def chunks(*args):
        return sorted(r["chunk"] for r in passages_of_pages(stored, pages, *args).collect())

    assert chunks() == list("abcdfg") and chunks(urls) == list("abcd")
    assert chunks(None, key) == list("acdf") and chunks(urls, key) == list("acd")
    assert chunks(urls.limit(0), key) == []
    assert {r["title"] for r in passages_of_pages(stored, pages, urls, key).collect()} == {
        r["title"] for r in pages.filter("page_id < 3").collect()}
