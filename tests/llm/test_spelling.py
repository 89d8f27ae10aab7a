"""Words one edit apart against plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pledgetrace.llm.spelling import _codes, letter_counts, near_words, run_counts, variants

CAPS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if x != w and one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 10 * n else None
        out[w] = [n, len(near), form, counts[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return out


def result(spark, counts, crowd):
    words = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, half string, size int")
    rows = variants(words, crowd=crowd).collect()
    assert len(rows) == len(counts)
    return {r["word"]: [r["n"], r["n_near"], r["form"], r["form_n"], r["root"]] for r in rows}


@pytest.mark.parametrize("crowd", [3, 40, 2048])
def test_random_words(spark, crowd):
    rng = random.Random(crowd)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(500)}
    words |= {"b" * 300, "b" * 299, "b" * 301, "b" * 150 + "a" + "b" * 149, "x😀yzzzz", "x😁yzzzz", "xyzzzz", "a", "b", "ab"}
    counts = {w: rng.choice([1, 2, 3, 9, 10, 31, 100, 1000, 99999]) for w in words}
    assert result(spark, counts, crowd) == plain(counts)


def test_long_chain_of_forms(spark):
    word, counts = "abcdefghijklmnopqrst", {}
    for k in range(18):
        counts[word[:k] + "z" * (20 - k)] = 10 ** k
    got = result(spark, counts, 2048)
    assert {r[4] for r in got.values()} == {max(counts, key=counts.get)}
    assert got == plain(counts)


def test_equal_counts_take_the_first_word(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaaac": 10, "baaaaaa": 10}
    assert result(spark, counts, 2048)["aaaaaaa"] == [1, 3, "aaaaaab", 10, "aaaaaab"]


def test_no_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert variants(none).collect() == [] and near_words(none).collect() == []
    assert near_words(spark.createDataFrame([(None, 3), ("ab", 1)], "word string, n long")).collect() == [("ab", 1, 0, None, None)]


def test_counts_of_letters():
    codes = _codes(np.array(["abba", "é"], dtype="U5"))
    assert letter_counts(codes).sum(axis=1).tolist() == [4, 1]


def test_runs_of_whole_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgÀéZ×") for _ in range(rng.randint(5, 9)))
    vocabulary = [word() for _ in range(80)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=200)) + ",1Straßenbahn-straßenbahn") for i in range(40)]
    rows += [(1, rows[0][1]), (None, "Straßenbahn" * 3), (7, None), (8, ""), (9, "x" * 100_000 + " " + "x" * 100_000), (10, "Ōōōōōōōōō")]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(CAPS)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, run string, h int")
    assert {r["word"]: r["n"] for r in run_counts(docs).collect()} == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
