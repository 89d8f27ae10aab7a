import random

from pledgetrace.operators import matching as mt


def alike(a, b):
    digits = lambda s: sorted(w for w in s if w.isdigit())
    return bool(a and b) and digits(a) == digits(b) and len(a & b) / len(a | b) >= 0.8


def titled(seed, n):
    """Word sets of 1 to 40 words, changed copies and numbers among them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["2030", "2031"]
    rows = []
    for _ in range(n):
        if rows and rng.random() < 0.7:
            s = set(rng.choice(rows))
            for _ in range(rng.randint(0, 3)):
                (s.add if rng.random() < 0.5 else s.discard)(rng.choice(words))
        else:
            s = set(rng.sample(words, rng.randint(1, 40)))
        rows.append(s)
    return rows


def test_near_titles_against_all_pairs(spark):
    rows = titled(4, 250) + [set(), {"w1"}, {"w1"}, {"2030"}, {"2031"}]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(rows)] + [(999, None)], "doc int, ws array<string>")
    sets = {}
    for i, s in enumerate(rows):
        if s:
            sets.setdefault(frozenset(s), i)
    ids = {i: s for s, i in sets.items()}
    want = {(i, j) for i in ids for j in ids if i < j and alike(ids[i], ids[j])}
    assert len(want) > 50
    got = mt.near_titles(df, "doc", "ws").collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    classes = {r["doc"]: r for r in mt.title_classes(df, "doc", "ws").collect()}
    assert set(classes) == {i for i, s in enumerate(rows) if s}
    for i, r in classes.items():
        own = sets[frozenset(rows[i])]
        near = [x for p in want if own in p for x in p if x != own]
        assert (r["title_id"], r["n_same"], r["n_near"], r["near_id"]) == (
            own, sum(s == rows[i] for s in rows), len(near), min([own, *near]))


def test_no_titles(spark):
    df = spark.createDataFrame([], "doc int, ws array<string>")
    assert mt.title_classes(df, "doc", "ws").count() == mt.near_titles(df, "doc", "ws").count() == 0


def test_sizes_in_reach_are_in_neighbouring_blocks():
    import math
    block = lambda n: math.floor(math.log(n) / math.log(1.25) + 1e-9)
    assert all(block(n * 5 // 4) - block(n) <= 1 for n in range(1, 200_000))
