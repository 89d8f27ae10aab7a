"""Extra columns whose names the operators use for themselves."""

import pytest
from pyspark.sql import functions as F

from pledgetrace.llm import benchmarks, digests, filters, hosts, keys, licenses, pieces, simhash, spelling, tables
from pledgetrace.llm.queries import QUERIES  # noqa: F401

NAMES = ("license matched_words begin ids n_ids lossless _key _text _ids item_id shared containment fingerprint edited_fingerprint component "
         "component_id node part label h r n same first word spans _spans _walk bucket head score verdict rule host path suffix domain").split()
TEXT = "Released under the MIT License. the quick brown fox jumps over the lazy dog password=abcdefgh"


@pytest.fixture
def docs(spark):
    rows = spark.createDataFrame([(1, TEXT, "en"), (2, "other words are here", "de"), (3, None, None)], "doc_id long, text string, lang string")
    return rows.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


def own(rows, but=()):
    """Kept columns still hold what they held."""
    rows = rows.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"own {n}" for n in NAMES if n not in but)
    return rows


def test_columns_added_to_texts(docs):
    keep = [c for c in docs.columns if c != "text"]
    new = ("license", "matched_words", "begin")
    assert {r["license"] for r in own(licenses.license_spans(docs, keep), new)} and "own license" not in [
        r["license"] for r in licenses.license_spans(docs, keep).collect()]
    vocabulary = pieces.load_vocabulary()
    coded = pieces.encoded(docs, keep, vocabulary)
    assert all(r["lossless"] for r in own(coded, ("ids", "n_ids", "lossless")))
    back = pieces.decoded(coded.withColumn("text", F.lit("own")), [*keep, "text"], vocabulary)
    assert {r["doc_id"]: r["text"] for r in own(back, ("ids", "n_ids", "lossless"))}[1] == TEXT
    assert pieces.encoded(docs, [], vocabulary).columns == ["ids", "n_ids", "lossless"]
    prints = simhash.fingerprints(docs, keep)
    assert len(own(prints, ("fingerprint",))) == 3
    ends = tables.with_columns(docs, "text", lambda c: {"_text": c}, "_text string", keep)
    assert {r["doc_id"]: r["_text"] for r in own(ends, ("_text",))}[1] == TEXT


def test_benchmark_items(spark, docs):
    items = spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    keep = [c for c in docs.columns if c != "text"]
    (r,) = own(benchmarks.contained_items(docs, items, keep), ("item_id", "shared", "containment"))
    assert (r["doc_id"], r["item_id"], r["containment"]) == (1, 7, 1.0)
    kept = benchmarks.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in own(kept)) == [2, 3]


def test_documents_kept_or_rewritten(docs):
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in own(kept)) == [1, 2, 3]
    new = keys.redacted(docs)
    assert new.columns == docs.columns and {r["doc_id"]: r["text"] for r in own(new)}[1].endswith("[assign]")
    assert own(keys.secret_spans(docs, [n for n in docs.columns if n != "spans"]), ("spans",))


def test_operators_with_columns_of_their_own(docs):
    assert filters.failing(docs).count() == 3
    assert spelling.run_counts(docs, often=1).count() > 0
    rarity = digests.Rarity(digests.entropy_counts(docs))
    assert len(own(digests.fingerprints(docs, rarity, docs.columns), ("fingerprint",))) == 3
    assert digests.edit_report(docs, rarity).count() == 3
    pages = docs.withColumn("page_id", F.col("doc_id")).withColumn("url", F.lit("http://a.org/x"))
    assert hosts.url_verdicts(pages, pages.withColumn("good", F.lit(1))).count() == 3
