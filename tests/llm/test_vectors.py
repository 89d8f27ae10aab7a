import math

import numpy as np

from pledgetrace.llm import vectors as v


def brute(rows, cosine=0.9):
    units = {}
    for at, (_, x) in enumerate(rows):
        if x and all(c is not None and math.isfinite(c) for c in x) and any(x):
            u = np.array(x, float) / np.abs(x).max()
            units[at] = u / np.linalg.norm(u)
    links = [0] * len(rows)
    root = list(range(len(rows)))
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in units:
        for j in units:
            if i < j and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for at, (i, _) in enumerate(rows):
        if i is not None:
            least[top(at)] = min(i, least.get(top(at), i))
    return sorted((repr(i), links[at], repr(least.get(top(at)))) for at, (i, _) in enumerate(rows))


def check(spark, rows):
    df = spark.createDataFrame([(i, x, "l") for i, x in rows], "vec_id long, embedding array<double>, label string")
    got = v.cosine_links(df, deviations=None).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], repr(r["component_id"])) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def cloud(seed, n, dim, crowd):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    c = rng.normal(size=(4, dim))
    near = c[rng.integers(0, 4, crowd)] + rng.normal(size=(crowd, dim)) * 0.28
    return [(k, r.tolist()) for k, r in enumerate(np.concatenate([x, near]))]


def test_all_links_are_found(spark, monkeypatch):
    monkeypatch.setattr(v, "PER_LIST", 20)
    monkeypatch.setattr(v, "BLOCK", 16)  # full lists are cut into blocks
    monkeypatch.setattr(v, "SEARCHES", 40)
    rows = cloud(1, 150, 12, 250)
    rows += [(1000 + i, rows[3][1]) for i in range(5)] + [(2000, [3 * c for c in rows[160][1]])]
    check(spark, rows)


def test_few_dimensions_where_lists_touch(spark, monkeypatch):
    monkeypatch.setattr(v, "PER_LIST", 10)
    rng = np.random.default_rng(3)
    check(spark, [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(160, 3)))])


def test_recall_of_the_usual_reach(spark, monkeypatch):
    monkeypatch.setattr(v, "PER_LIST", 25)
    rows = cloud(5, 300, 24, 300)
    rows += [(700 + i, (np.array(x) + np.random.default_rng(i).normal(size=24) * 0.45).tolist()) for i, (_, x) in enumerate(rows[:200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = {r["vec_id"]: r["n_links"] for r in v.cosine_links(df).collect()}, {int(i): n for i, n, _ in brute(rows)}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.95 * sum(want.values()) > 1000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
                  (8, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.1]), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-200, 0.0]),
                  (12, [1e200, 1e199]), (13, [-0.0, 2.0]), (14, [0.0, 2.0])])
    check(spark, [(1, None)])
    assert v.cosine_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
