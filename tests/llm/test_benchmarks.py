import random

from pledgetrace.llm import benchmarks as b

VOCABULARY = [f"w{i}" for i in range(3000)]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def brute(docs, items):
    out = set()
    for d, t in docs:
        have = b.shingle_set((t or "").encode())
        for i, u in items:
            want = b.shingle_set((u or "").encode())
            if want and len(want & have) >= b.CONTAINMENT * len(want):
                out.add((d, i, len(want & have), len(want)))
    return out


def planted(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([5, 6, 9, 12, 14, 20, 33, 40, 59, 80, 150, 300])]
    docs = []
    for k in range(60):
        text = words(rng, rng.choice([30, 400, 3000]))
        own = items[k % len(items)][1].split()
        if k % 3:
            own = own[:]
            if k % 3 == 2:
                own[len(own) - 1] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = own
        docs.append((k, ("  ".join(text)).upper() if k % 4 == 0 else ", ".join(text)))
    return docs, items


def test_against_brute_force(spark, docs_of):
    docs, items = planted(3)
    docs += [(90, ""), (91, None), (92, items[2][1]), (92, items[2][1]), (None, items[7][1]), (93, "one two three four")]
    items += [(70, None), (71, ""), (72, "one two three four"), (73, items[4][1]), (None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:4] for r in b.contained_items(docs_of(docs), bench, ["doc_id"]).collect()]
    assert set(got) == brute(docs, items)
    assert got.count((92, 2, 5, 5)) == 2
    clean = b.clean_documents(docs_of(docs), bench)
    assert clean.columns == docs_of([]).columns
    assert sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(
        repr(i) for i, t in docs if not brute([(i, t)], items))


def test_passes_and_empty_tables(spark, docs_of, monkeypatch):
    docs, items = planted(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(b, "PASS_BYTES", 900)
    got = {tuple(r)[:4] for r in b.contained_items(docs_of(docs), bench, ["doc_id"]).collect()}
    assert got == brute(docs, items)
    assert b.contained_items(docs_of([]), bench, ["doc_id"]).collect() == []
    assert b.contained_items(docs_of(docs), bench.limit(0), ["doc_id"]).collect() == []
    assert b.clean_documents(docs_of(docs), bench.limit(0)).count() == len(docs)
