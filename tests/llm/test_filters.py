"""Filter interaction audit against a plain walk over documents and orders."""

import re
from itertools import permutations

import pytest

from pledgetrace.llm import filters
from pledgetrace.llm.filters import audit, cells, failing

KINDS = "doc_id long, text string, lang string, part string, failed string, same string"
LABELS = "doc_id long, quality int, toxic int, good string"


def failed_by_hand(rows):
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        letters = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        letters += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        letters += "E" * any(doc_id is not None and d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        out.append((doc_id, lang or "", letters))
    return out


def by_hand(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    marked = failed_by_hand(rows)
    out = {}
    for part in {p for _, p, _ in marked}:
        docs = [(d, f) for d, p, f in marked if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for i, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                out[part, order, i + 1] = [
                    len(left), len(gone), sum(c in f and any(b in f for b in order[:i]) for _, f in docs),
                    sum(f == c for _, f in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for c in "ABCDE":
            mine = [k for k in out if k[0] == part and k[1][k[2] - 1] == c]
            share = sum(out[k][1] for k in mine)
            for k in mine:
                out[k].append(share)
    return out


def table(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, p, "x", "y", "z") for d, t, p in rows], KINDS)
    return docs, spark.createDataFrame([(d, q, t, "n") for d, q, t in labels], LABELS)


def test_all_orders_of_mixed_documents(spark):
    many = " ".join(f"w{i}" for i in range(120))
    rows = [(1, many, "en"), (2, many, "en"), (3, many, "de"), (4, many + " #", "en"), (5, "a " * 150, "en"),
            (6, "SHOUT " * 3, None), (7, None, "en"), (8, "", "de"), (8, "", "de"), (None, many, "en"), (0, "A|B", ""),
            (9, " ".join(f"W{i}$" for i in range(20_000)), "de"), (10, "ÄÖÜ ÀÉ", "en"), (11, "x y z", "fr")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (8, 1, 1), (9, None, 1), (99, 1, 1), (None, 1, 1)]
    docs, of = table(spark, rows, labels)
    marked = failing(docs)
    assert sorted(map(str, marked.select("doc_id", "part", "failed").collect())) == sorted(
        f"Row(doc_id={d}, part={p!r}, failed={f!r})" for d, p, f in failed_by_hand(rows))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in audit(cells(marked, of)).collect()}
    want = by_hand(rows, labels)
    assert len(got) == 4 * 600 and got == want


def test_no_documents(spark):
    docs, labels = table(spark, [], [])
    assert audit(cells(failing(docs), labels)).collect() == []


@pytest.mark.parametrize("letters", ["A", "XYZ"])
def test_fewer_filters(spark, letters):
    one = spark.createDataFrame([("p", letters[:2], 3, 2, 1)], "part string, failed string, docs long, good long, toxic long")
    rows = audit(one, letters).collect()
    orders = sorted({r["filter_order"] for r in rows})
    assert orders == ["".join(p) for p in permutations(letters)]
    assert all(r["kept"] + r["removed"] == 3 for r in rows if r["step"] == 1)
    assert sum(r["removed"] for r in rows) == 3 * len(orders)


def test_merging_has_one_row_for_each_part_and_failed_set(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = cells(failing(docs), spark.read.parquet(f"{data}/labels.parquet"))
    assert out.count() == out.select("part", "failed").distinct().count() <= 32 * docs.select("lang").distinct().count()
    assert out.agg({"docs": "sum"}).first()[0] == docs.count()
    assert filters.LETTERS == "ABCDE"
