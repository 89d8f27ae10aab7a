import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pledgetrace.operators.trail import artifact_status
from pledgetrace.session import shared_dir
from pledgetrace.streaming import decisions as st


def files(spark, name, frames):
    path = shared_dir(spark, name)
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    return path


def test_last_decision_wins_however_late(spark):
    rows = [[(1, "accepted", 5, 1), (2, "rejected", 1, 2)], [(1, "rejected", 3, 3), (2, "accepted", 1, 4)]]
    schema = "link_id bigint, decision string, s bigint, event_id bigint"
    frames = [spark.createDataFrame(r, schema).select("link_id", "decision", F.timestamp_seconds("s").alias("ts"), "event_id") for r in rows]
    stream = st.read_files(spark, files(spark, "d", frames), st.DECISIONS)
    root = shared_dir(spark, "out")
    changes = st.read_changes(st.current_decisions(stream, root), root, st.DECISIONS, spark)
    got = {r["link_id"]: r["decision"] for r in st.last_decisions(changes).collect()}
    assert got == {1: "accepted", 2: "accepted"}


def test_contract_states_equal_the_batch_rule(spark):
    rows = [("P", 3, "amendment"), ("P", 2, "termination"), ("Q", 4, "affirmative"), ("P", 1, "termination"), ("Q", 9, "amendment")]
    schema = "procurement_id string, evidence_id bigint, polarity string"
    frames = [spark.createDataFrame([r], schema) for r in rows]
    stream = st.read_files(spark, files(spark, "b", frames), schema)
    root = shared_dir(spark, "states")
    changes = st.read_changes(st.artifact_states(stream, root), root, st.STATES, spark)
    got = sorted(map(tuple, st.as_artifacts(st.worst_states(changes)).collect()))
    every = spark.createDataFrame(rows, schema)
    want = artifact_status(every.select("procurement_id", "evidence_id"), every.select(F.col("evidence_id").alias("id"), "polarity").distinct())
    assert got == sorted(map(tuple, want.collect())) == [("P", "terminated", 1), ("Q", "amended", 9)]


def test_runs_respect_reviews(spark):
    run = "commitment_id bigint, url string, title string, snippet string, seq int"
    stored = "id bigint, commitment_id bigint, url string, title string, snippet string"
    frames = [spark.createDataFrame(r, run) for r in ([(1, "a", "t1", "s1", 1), (1, "b", "t1", "s1", 1)], [(1, "a", "t2", "s2", 2), (1, "a", "t2", "s3", 3)])]
    stream = st.read_files(spark, files(spark, "r", frames), run)
    links = spark.createDataFrame([], "evidence_id bigint, review_status string")
    root = shared_dir(spark, "ev")
    out = st.run_available(st.evidence_runs(stream, root, stored, links, "seq"), root, stored, spark)
    got = {r["url"]: (r["title"], r["snippet"]) for r in out.collect()}
    assert got == {"a": ("t1", "s3"), "b": ("t1", "s1")}
    assert sorted(r["id"] for r in out.collect()) == [1, 2]


def test_a_second_start_goes_on(spark):
    run = "commitment_id bigint, url string, title string, snippet string, seq int"
    stored = "id bigint, commitment_id bigint, url string, title string, snippet string"
    links = spark.createDataFrame([], "evidence_id bigint, review_status string")
    path = files(spark, "r2", [spark.createDataFrame([(1, "a", "t", "s", 1)], run)])
    root = shared_dir(spark, "ev2")
    start = lambda: st.run_available(st.evidence_runs(st.read_files(spark, path, run), root, stored, links, "seq"), root, stored, spark)
    assert [r["url"] for r in start().collect()] == ["a"]
    assert [r["url"] for r in start().collect()] == ["a"]  # nothing new
    spark.createDataFrame([(1, "b", "t", "s", 1)], run).coalesce(1).write.mode("append").parquet(path)
    assert sorted((r["id"], r["url"]) for r in start().collect()) == [(1, "a"), (2, "b")]
    assert st.run_available(st.evidence_runs(st.read_files(spark, files(spark, "none", [spark.createDataFrame([], run)]), run),
                                             shared_dir(spark, "ev3"), stored, links, "seq"), "/tmp/none-here", stored, spark).collect() == []


def test_changes_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(st, "COMPACT_FROM", 2)
    schema = "procurement_id string, evidence_id bigint, polarity string"
    path = files(spark, "b2", [spark.createDataFrame([r], schema) for r in [("P", 3, "amendment"), ("P", 2, "termination")]])
    root = shared_dir(spark, "states2")
    start = lambda: st.read_changes(st.artifact_states(st.read_files(spark, path, schema), root), root, st.STATES, spark, st.worst_states)
    assert start().count() == 1 and st._numbers(spark, root, "base=") == [1]
    spark.createDataFrame([("P", 1, "termination"), ("Q", 5, "affirmative")], schema).coalesce(1).write.mode("append").parquet(path)
    assert sorted(map(tuple, st.worst_states(start()).collect())) == [("P", 2, 1), ("Q", 0, 5)]


FOUND = ("commitment_id bigint, url string, title string, snippet string, score double, "
         "money array<struct<kind:string,amount_raw:string,fiscal_year:int,description:string,currency:string>>, seq int, at timestamp")
KEPT = "id bigint, commitment_id bigint, url string, title string, snippet string"


def found(spark, rows):
    """(commitment, url, snippet, score, amounts, seq) as a run."""
    import datetime
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, u, "t", s, x, [("k", a, 2024, "d", "GBP") for a in m], n, at) for c, u, s, x, m, n in rows], FOUND)


def start(spark, path, root, **more):
    stream = st.read_files(spark, path, FOUND)
    return st.run_available(st.evidence_runs(stream, root, KEPT, None, "seq", **more), root, KEPT, spark)


def test_links_and_figures_go_with_the_evidence(spark):
    path, root = files(spark, "r5", [found(spark, [(1, "a", "s1", 1.0, ["5"], 1), (1, "b", "s1", 2.0, [], 1)])]), shared_dir(spark, "ev5")
    first = {r["url"]: r["id"] for r in start(spark, path, root).collect()}
    store = st.EvidenceStore(spark, root, KEPT)
    # a person accepts a, then another run finds both again and a third page
    reviewed = store.read("links").withColumn("review_status", F.when(F.col("evidence_id") == first["a"], "accepted").otherwise("unreviewed"))
    store.write("links", reviewed)
    found(spark, [(1, "a", "s2", 8.0, ["6"], 2), (1, "b", "s2", 9.0, ["7", "7"], 2), (2, "c", "s2", 3.0, ["8"], 2)]).coalesce(1).write.mode("append").parquet(path)
    got = {r["url"]: (r["id"], r["snippet"]) for r in start(spark, path, root).collect()}
    assert got["a"] == (first["a"], "s1") and got["b"] == (first["b"], "s2") and got["c"] == (3, "s2")
    links = {r["evidence_id"]: (r["score"], r["review_status"]) for r in store.read("links").collect()}
    assert links == {first["a"]: (1.0, "accepted"), first["b"]: (9.0, "unreviewed"), 3: (3.0, "unreviewed")}
    money = sorted((r["evidence_id"], r["amount_raw"]) for r in store.read("budgets").collect())
    assert money == sorted([(first["a"], "5"), (first["b"], "7"), (3, "8")])


def test_untouched_buckets_keep_their_files(spark):
    from pathlib import Path
    rows = [(c, "u", "s", 1.0, ["5"], 1) for c in range(30)]
    path, root = files(spark, "r6", [found(spark, rows)]), shared_dir(spark, "ev6")
    before = start(spark, path, root, buckets=8).count()
    names = {f: f.stat().st_mtime_ns for f in Path(root).rglob("bucket=*/*.parquet")}
    found(spark, [(3, "u", "new", 2.0, ["6"], 2)]).coalesce(1).write.mode("append").parquet(path)
    after = start(spark, path, root, buckets=8)
    assert after.count() == before == 30 and after.filter("snippet = 'new'").count() == 1
    assert len({f.parent.name for f in names if not f.exists()}) == 1
    assert {f.parent.parent.name for f in names if not f.exists()} == {"evidence", "links", "budgets"}


def test_a_batch_that_runs_twice_changes_nothing(spark):
    root = shared_dir(spark, "ev7")
    store = st.EvidenceStore(spark, root, KEPT)
    batch = found(spark, [(c, u, "s", 1.0, ["5", "6"], 1) for c in range(5) for u in "ab"])
    state = lambda: [sorted(map(str, store.read(n).collect())) for n in ("evidence", "links", "budgets")]
    store.merge(batch, "seq")
    once = state()
    store.merge(batch, "seq")
    assert state() == once and [len(x) for x in once] == [10, 10, 20]


def test_rows_delivered_twice_within_the_watermark(spark):
    rows = [(1, "a", "s1", 1.0, [], 1), (1, "a", "s1 again", 1.0, [], 1), (1, "a", "s2", 1.0, [], 2)]
    path, root = files(spark, "r8", [found(spark, [r]) for r in rows]), shared_dir(spark, "ev8")
    assert [r["snippet"] for r in start(spark, path, root, seen="at").collect()] == ["s2"]


def test_contract_states_are_read_from_as_many_files_as_there_are_cores(spark, monkeypatch):
    from pledgetrace.plans import streams
    seen = []
    monkeypatch.setattr(streams.st, "read_files", lambda _, path, schema, **more: seen.append((path, more)) or 1 / 0)
    try:
        streams.st3(spark, "/root/testdata/sf0.001")
    except ZeroDivisionError:
        pass
    [(path, more)] = seen
    n = spark.sparkContext.defaultParallelism
    assert more["per_trigger"] == n and len(spark.read.parquet(path).inputFiles()) > n


def test_a_run_writes_its_buckets_once(spark, monkeypatch):
    names, real = [], st.stage
    monkeypatch.setattr(st, "stage", lambda df, name: names.append(name) or real(df, name))
    store = st.EvidenceStore(spark, shared_dir(spark, "ev9"), KEPT)
    for n in (1, 2):
        store.merge(found(spark, [(c, "u", f"s{n}", float(n), ["5", str(n)], n) for c in range(5)]), "seq")
    assert names == ["batch", "batch"]
    assert {r["snippet"] for r in store.read("evidence").collect()} == {"s2"}
    assert [r["score"] for r in store.read("links").collect()] == [2.0] * 5
    figures = [(r["evidence_id"], r["amount_raw"]) for r in store.read("budgets").collect()]
    # in the first run both figures of a page are new, in the second one of them
    assert len(figures) == len(set(figures)) == 15


def test_vectors_of_odd_texts_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "A b  b\nc"), (2, ""), (3, " \t\n"), (4, None), (5, "x\x0by z\xa0z\x85 \u2003q\x1c"), (6, "İÇ ΟΔΟΣ ΣΑΣ"),
            (7, "p q q"), (7, "q r"), (7, ""), (None, "n m"), (None, "m"), (8, "\x0b"), (9, "lone"), (9, None), (10, "a\x00b a")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["F1_embed"]).fetchall()
    got = entry.queries()["F1_embed"](spark, str(tmp_path)).select("doc_id", "dims", "total", "top").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(got) == 8 and (7, 384, 5.0, 3.0) in got
