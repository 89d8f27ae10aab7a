import numpy as np
import pytest
from pyspark.sql import functions as F

from pledgetrace.llm import queries, quality, toxicity

GOOD = ["The river runs through the old town and meets the sea near the harbour wall.",
        "Every spring the council repairs the bridges and plants new trees along the road."]
BAD = ["BUY!!! NOW!!! CHEAP!!! DEALS!!!", "### $$$ %%% ### $$$ %%%", "click | click | click | click"]


def labelled(kind):
    rows = [(i, (GOOD if i % 3 else BAD)[i % 2] + f" {i * 7919 % 97} " + (GOOD if i % 3 else BAD)[(i + 1) % 2], int(i % 3 > 0))
            for i in range(kind)]
    return rows


def test_quality_learns_and_defines_edges(spark, docs_of):
    rows = labelled(90)
    docs = docs_of([(i, t) for i, t, _ in rows] + [(900, ""), (901, None), (902, "é" * 70000), (None, GOOD[0])])
    labels = spark.createDataFrame([(i, l, 0) for i, _, l in rows] + [(None, 1, 0), (900, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_on_labels(docs, labels, quality.learnable())
    got = quality.quality_scores(docs, model, ["doc_id", "source"]).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert np.mean([(score[i] >= 0.5) == l for i, _, l in rows]) > 0.95
    assert score[900] == score[901] == model.empty
    kept = quality.good_documents(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] >= 0.5}


def test_quality_without_labels(spark, docs_of):
    docs = docs_of([(1, "text"), (1, "text")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_on_labels(docs, none, quality.learnable())
    assert [r["score"] for r in quality.quality_scores(docs, model, ["doc_id"]).collect()] == [0.5, 0.5]
    assert quality.quality_scores(docs_of([]), model, ["doc_id"]).collect() == []


def sample(spark, rows):
    return spark.createDataFrame(rows, "text string, label int")


def test_swaps_take_the_weight_off_groups(spark, docs_of):
    # the labelled insults happen to name one group, most neutral texts do not
    rows = [(f"the muslims are idiots said number {i}", 1) for i in range(40)] + \
           [(f"those fools and idiots again number {i}", 1) for i in range(40)] + \
           [(f"a quiet walk by the lake number {i}", 0) for i in range(80)]
    neutral = docs_of([(1, "muslims gather by the lake"), (2, "people gather by the lake"), (3, "the muslims are idiots"), (4, None), (5, "")])
    def scores(weight):
        model = toxicity.fit_toxicity(sample(spark, rows), 0.5, swap_weight=weight, least_texts=3)
        return {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(neutral, model, ["doc_id"]).collect()}
    free, held = scores(0.0), scores(toxicity.SWAP_WEIGHT)
    assert free[1] - free[2] > 0.1  # without swaps the mention alone counts
    assert abs(held[1] - held[2]) < 0.02 and held[1] < 0.5 < held[3]
    assert held[4] == held[5]


def test_toxicity_edges(spark, docs_of):
    model = toxicity.fit_toxicity(sample(spark, [("a", 1)]), 0.5)
    assert [r["score"] for r in toxicity.toxicity_scores(docs_of([(1, "a"), (None, None)]), model, ["doc_id"]).collect()] == [0.5, 0.5]
    assert toxicity.toxicity_scores(docs_of([]), model, ["doc_id"]).collect() == []
    pairs = toxicity.swapped_sentences(b"Women met. The women and men left!\nNobody", toxicity.GROUPS)
    assert all(a != b and b"women" in a or b"men" in a for a, b in pairs) and len(pairs) <= toxicity.PAIRS
    assert (b"women met", b"people met") in pairs


@pytest.mark.parametrize("name, label, mod, held", [("op1_toxicity", "toxic", 5, 0), ("op3_quality", "quality", 3, 1)])
def test_held_out_accuracy(spark, name, label, mod, held):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    row = got.join(marks, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a")).first()
    assert row["a"] > 0.9
    assert got.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == held) != F.col("held_out")).count() == 0


def test_swaps_reach_the_end_of_long_texts(spark, docs_of):
    head = "Women and men met. " * 12
    pairs = toxicity.swapped_sentences((head + "Then muslims came.").encode(), toxicity.GROUPS)
    assert any(b"muslims" in a and b"muslims" not in b for a, b in pairs)
    rows = [(head + f"the muslims are idiots said number {i}", 1) for i in range(40)] + \
           [(head + f"those fools and idiots again number {i}", 1) for i in range(40)] + \
           [(head + f"a quiet walk by the lake number {i}", 0) for i in range(80)]
    neutral = docs_of([(1, "muslims gather by the lake"), (2, "people gather by the lake")])
    def gap(weight):
        model = toxicity.fit_toxicity(sample(spark, rows), 0.5, swap_weight=weight, least_texts=3)
        score = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(neutral, model, ["doc_id"]).collect()}
        return abs(score[1] - score[2])
    assert gap(0.0) > 0.1 and gap(toxicity.SWAP_WEIGHT) < gap(0.0) / 4


def test_an_id_repeated_many_times_is_sampled_once(spark):
    from pledgetrace.llm import toxicity as tx

    rows = [(i, f"text {i}", "x") for i in range(1, 60)] + [(7, f"again {i % 5}", "x") for i in range(4000)] + [(None, "none", "x"), (8, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    marks = [(i, i % 2) for i in range(1, 60)] + [(7, 0), (7, 1), (None, 1), (99, 1), (5, None)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    sample, share = tx.labelled_sample(docs, labels, tx.learnable())
    import zlib
    ids = {i for i, _ in marks if i and i < 60 and zlib.crc32(str(i).encode()) % 5}
    got = sample.collect()
    assert len(got) == len(ids) and share == sum(i % 2 and i != 7 for i in ids) / len(ids)
    assert sorted(map(tuple, got)) == sorted(map(tuple, tx.labelled_sample(docs.repartition(7), labels, tx.learnable())[0].collect()))
    again = {"text 7", *(f"again {k}" for k in range(5))}
    assert [r["label"] for r in got if r["text"] in again] == [0] * (7 in ids)
