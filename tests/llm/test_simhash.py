import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from pledgetrace.llm import simhash as s
from pledgetrace.llm.components import components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [x for x in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in low).split(" ") if x]
    if not words:
        return 0
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(values, near):
    root = list(range(len(values)))
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


TEXTS = [(4, "Same text here now"), (2, "same text  HERE now"), (9, ""), (7, None), (8, " \t\n"), (11, "one"), (12, "one two"),
         (13, "É Ünï cödé\x0bwörds here"), (14, "w " * 5000), (15, "w w w"), (None, "same text here now"), (16, "other words altogether today")]


def test_components_against_brute_force(docs_of):
    got = {r["doc_id"]: r for r in s.simhash_components(docs_of(TEXTS)).collect() if r["doc_id"] is not None}
    rows = [(i, plain_fingerprint(t)) for i, t in TEXTS if i is not None]
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in rows)
    root = classes([f for _, f in rows], lambda a, b: (a ^ b).bit_count() <= 2)
    for at, (i, _) in enumerate(rows):
        assert got[i]["component_id"] == min(rows[k][0] for k in range(len(rows)) if root[k] == root[at])


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_links_against_brute_force(spark, monkeypatch, budget):
    monkeypatch.setattr(s, "NODE_LIMIT", 7)  # crowded nodes are cut into chunks
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base)
    for v in base[:8]:  # crowds that agree in most bits, and chains
        for _ in range(25):
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values | {0, 1, 2**64 - 1})
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fingerprint long")
    root = classes(values, lambda a, b: (a ^ b).bit_count() <= budget)
    got = {r["node"] % 2**64: r["component"] % 2**64 for r in components(s.trie_links(df, budget)).collect()}
    label = [got.get(v, v) for v in values]
    for i, j in combinations(range(len(values)), 2):
        assert (root[i] == root[j]) == (label[i] == label[j])


def test_front_blocks_do_not_change_pairs(monkeypatch):
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 300).astype(np.uint64))
    want = {(i, j) for i, j in combinations(range(len(h)), 2) if (int(h[i]) ^ int(h[j])).bit_count() <= 2}
    monkeypatch.setattr(s, "FRONT", 50)
    got = {tuple(sorted(p)) for a, b in s.near_pairs(h, np.array([[0, len(h), 0, len(h)]]), 63, 2) for p in zip(a.tolist(), b.tolist())}
    assert got == want


def test_empty_table_and_survivors(docs_of):
    assert s.simhash_components(docs_of([])).collect() == []
    df = docs_of([*TEXTS, (16, "other words altogether today"), (17, "other words altogether today")])
    out = s.one_per_component(df)
    assert out.columns == df.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(16) == 1 and 17 not in ids and 2 in ids and 4 not in ids and None in ids
    assert s.one_per_component(docs_of([])).collect() == []


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 501: 500}
