import pytest
from pyspark.sql import functions as F

from pledgetrace.operators import merge as mg
from pledgetrace.profile import ENGLISH

EV = "id bigint, commitment_id bigint, url string, title string, snippet string"
LINK = ("id bigint, commitment_id bigint, evidence_id bigint, score double, suggested_relationship string, "
        "relationship string, review_status string")


def test_reviewed_rows_are_final(spark):
    stored = spark.createDataFrame([(1, 1, "a", "t", "old"), (2, 1, "b", "t", "old")], EV)
    run = spark.createDataFrame([(1, "a", "T", "new"), (1, "b", "T", "new"), (1, "c", "T", "new")],
                                "commitment_id bigint, url string, title string, snippet string")
    links = spark.createDataFrame([(5, 1, 1, 0.5, "budget", None, "accepted"),
                                   (6, 1, 2, 0.5, "budget", None, "unreviewed")], LINK)
    got = sorted(map(tuple, mg.merge_evidence(stored, run, links).collect()))
    assert got == [(1, 1, "a", "t", "old"), (2, 1, "b", "t", "new"), (3, 1, "c", "T", "new")]
    rescored = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.9)],
                                     "commitment_id bigint, evidence_id bigint, score double")
    got = {r["evidence_id"]: (r["id"], r["score"], r["review_status"])
           for r in mg.merge_links(links, rescored).collect()}
    assert got == {1: (5, 0.5, "accepted"), 2: (6, 0.9, "unreviewed"), 3: (7, 0.9, "unreviewed")}


def test_money_is_stored_once_and_never_on_reviewed_evidence(spark):
    cols = "id bigint, evidence_id bigint, kind string, amount_raw string, fiscal_year int, description string, currency string"
    b = lambda *rows: spark.createDataFrame([(i, e, "k", raw, y, "d", "HUF") for i, e, raw, y in rows], cols)
    links = spark.createDataFrame([(1, 1, 9, 0.1, None, None, "rejected")], LINK)
    stored = b((1, 1, "5", None))
    run = b((0, 1, "5", None), (0, 1, "5", 2024), (0, 1, "5", 2024), (0, 9, "7", None))
    got = mg.merge_budgets(stored, run, links).collect()
    assert sorted((r["id"], r["evidence_id"], r["fiscal_year"] or 0) for r in got) == [(1, 1, 0), (2, 1, 2024)]


def test_new_ids_are_consecutive(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    ids = sorted(r["id"] for r in mg.with_new_ids(rows, ["k"], 10).collect())
    assert ids == list(range(11, 5011))


def test_a_source_keeps_its_owner(spark):
    cols = "id bigint, url string, title string, publisher string, sort_order int, jurisdiction string"
    s = spark.createDataFrame([(1, "a", "t", "p", 0, "national_government")], cols)
    run = spark.createDataFrame([("a", "T", "P", 1, None)], "url string, title string, publisher string, sort_order int, jurisdiction string")
    assert tuple(mg.merge_sources(s, run).first()) == (1, "a", "T", "P", 1, "national_government")


CAND = ("id bigint, document_id bigint, suggested_type string, normalized_title string, text string, code string, "
        "source_page int, source_excerpt string, excerpt_on_page boolean, review_status string")


def test_accepting_needs_receipts_for_the_whole_batch(spark):
    from pledgetrace.schemas import COMMITMENTS
    c = spark.createDataFrame([(1, 1, "measure", "T", "x", None, 1, "q", True, "unreviewed"),
                               (2, 1, "measure", "T", "x", None, 1, " ", True, "unreviewed")], CAND)
    empty = spark.createDataFrame([], COMMITMENTS)
    d = lambda *ids: spark.createDataFrame([(i, None, "New") for i in ids], "candidate_id bigint, kind string, title string")
    with pytest.raises(ValueError, match="candidate 2"):
        mg.accept_candidates(c, empty, d(1, 2), ENGLISH)
    with pytest.raises(ValueError, match="candidate 9"):
        mg.accept_candidates(c, empty, d(9), ENGLISH)
    cands, com = mg.accept_candidates(c, empty, d(1), ENGLISH)
    [m] = com.collect()
    assert (m["id"], m["candidate_id"], m["title"], m["kind"]) == (1, 1, "New", "measure")
    assert {r["id"]: r["review_status"] for r in cands.collect()} == {1: "accepted", 2: "unreviewed"}
    # a second accept changes nothing
    assert mg.accept_candidates(cands, com, d(1), ENGLISH)[1].count() == 1


def test_last_decision_counts(spark):
    links = spark.createDataFrame([(1, 1, 1, 0.1, "budget", None, "unreviewed"),
                                   (2, 1, 2, 0.1, "budget", "supporting", "accepted")], LINK)
    d = spark.createDataFrame([(1, "rejected", None, 1), (1, "accepted", None, 2), (2, "rejected", None, 3),
                               (7, "accepted", None, 1)], "link_id bigint, decision string, relationship string, o int")
    got = sorted((r["id"], r["review_status"], r["relationship"]) for r in mg.decide_links(links, d, "o").collect())
    assert got == [(1, "accepted", "budget"), (2, "rejected", None)]


def test_chunks_are_replaced_together(spark):
    cols = "page_id bigint, embed_model string, chunk_index int"
    old = spark.createDataFrame([(1, "m", 0), (1, "m", 1), (2, "m", 0)], cols)
    new = spark.createDataFrame([(1, "m", 0)], cols)
    assert sorted(map(tuple, mg.replace_chunks(old, new).collect())) == [(1, "m", 0), (2, "m", 0)]


def test_a_task_reads_a_bounded_part_of_a_shuffle(spark):
    """M6: tasks hold what they read, so their share does not grow with the shuffle."""
    from pledgetrace.session import tune
    tune(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        # about 70 MB in the shuffle, on four cores
        rows = spark.range(1_000_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
        assert rows.repartition("id").rdd.getNumPartitions() >= 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
