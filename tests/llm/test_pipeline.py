import corpus_pipeline
import __spark_entry__ as entry

from pledgetrace.llm import benchmarks, keys, quality, simhash
from test_simhash import classes, plain_fingerprint


def test_stages_in_order_against_plain_versions(spark, data):
    docs = corpus_pipeline.table(spark, data, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, data), name)
        if name != "pieces":
            assert now.columns == docs.columns
        out[name] = now
    score = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, quality.fit_on_labels(
        docs, corpus_pipeline.table(spark, data, "labels"), quality.learnable()), ["doc_id"]).collect()}
    rows = [(i, t) for i, t in rows if score[i] >= 0.5]
    prints = [plain_fingerprint(t) for _, t in rows]
    root = classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    kept = {min(rows[j][0] for j in range(len(rows)) if root[j] == root[k]) for k in range(len(rows))}
    rows = [(i, t) for i, t in rows if i in kept]
    assert sorted(r["doc_id"] for r in out["simhash"].collect()) == sorted(i for i, _ in rows)
    items = [(r["text"] or "").encode() for r in corpus_pipeline.table(spark, data, "benchmark").collect()]
    want = [benchmarks.shingle_set(x) for x in items]
    def clean(t):
        have = benchmarks.shingle_set(t.encode())
        return not any(w and len(w & have) >= 0.8 * len(w) for w in want)
    rows = [(i, t) for i, t in rows if clean(t)]
    assert sorted(r["doc_id"] for r in out["decontaminate"].collect()) == sorted(i for i, _ in rows)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out["secrets"].collect()}
    assert set(texts) == {i for i, _ in rows} and all(n == len(t) for t, n in texts.values())
    changed = {i for i, t in rows if texts[i][0] != t}
    spans = {r["doc_id"] for r in keys.secret_spans(out["decontaminate"], ["doc_id"]).collect() if r["spans"]}
    assert changed == spans
    last = out["pieces"].collect()
    assert {r["doc_id"] for r in last} == set(texts) and all(r["lossless"] for r in last)


def test_empty_documents(spark, data):
    now = corpus_pipeline.table(spark, data, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, data), "empty")
    assert now.count() == 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
