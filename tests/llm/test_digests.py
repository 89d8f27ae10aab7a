"""Fingerprints against a plain version that looks at one window after the other."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pledgetrace.llm import digests as dg
from pledgetrace.llm.tables import text_bytes

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghijklmnoprstuvé") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def model(texts):
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    counts = np.zeros(dg.STEPS + 1, np.int64)
    for a, b in zip(offsets, offsets[1:]):
        counts += np.bincount(dg.entropy_steps(data[a:b]), minlength=dg.STEPS + 1)
    return counts


def picked_by_hand(text, rarity):
    """Byte windows of the selected places, in order, each once."""
    raw = text.encode()
    ranks = []
    for i in range(len(raw) - dg.WINDOW + 1):
        f = lambda c: round(c * math.log2(c) * dg._UNIT)
        most = f(dg.WINDOW)
        spent = sum(f(c) for c in Counter(raw[i:i + dg.WINDOW]).values())
        ranks.append(int(rarity.rank[(most - spent) * dg.STEPS // most]))
    wins = Counter()
    for lo in range(-dg.SPAN + 1, len(ranks)):
        run = [i for i in range(max(lo, 0), min(lo + dg.SPAN, len(ranks))) if ranks[i] >= 0]
        if run:
            wins[min(run, key=lambda i: (ranks[i], i))] += 1
    out = []
    for i in sorted(i for i, n in wins.items() if n >= dg.WINS):
        if raw[i:i + dg.WINDOW] not in out:
            out.append(raw[i:i + dg.WINDOW])
    return out


@pytest.mark.parametrize("cut", [64, 1 << 17])
def test_selected_windows(monkeypatch, cut):
    monkeypatch.setattr(dg, "SLICE", cut)
    texts = [prose(60, 1), "", "short", prose(90, 2), "a" * 200, prose(3, 4) + "x" * 50 + prose(30, 5), "é" * 6, None, prose(60, 1)]
    rarity = dg.Rarity(model(texts))
    h, bounds = dg.features(*text_bytes(pa.array(texts, pa.large_string())), rarity)
    hashes = {}
    for text, a, b in zip(texts, bounds, bounds[1:]):
        want = picked_by_hand(text or "", rarity)
        # one hash for one window, over all texts
        assert b - a == (len(want) or bool(text))
        for raw, x in zip(want, h[a:b].tolist()):
            assert hashes.setdefault(raw, x) == x
    assert len(set(hashes.values())) == len(hashes) > 50
    assert h[bounds[0]:bounds[1]].tolist() == h[bounds[8]:bounds[9]].tolist()


def test_chain_and_its_text():
    h = np.array([random.Random(7).getrandbits(64) for _ in range(1)] * 3 + list(range(1, 400)), np.uint64)
    filters, counts = dg.chain(h)
    assert counts.tolist() == [160, 160, 82]
    for i, f in enumerate(filters):
        bits = {int(x) >> (12 * k) & (dg.BITS - 1) for x in h[160 * i:160 * (i + 1)] for k in range(dg.HASHES)}
        assert set(np.flatnonzero(np.unpackbits(f)).tolist()) == bits
    again = dg.read(dg.written(filters, counts))
    assert (again[0] == filters).all() and (again[1] == counts).all()
    assert dg.likeness((filters, counts), again) == 1.0
    none = dg.read("")
    assert dg.written(*none) == "" and dg.likeness(none, none) == 1.0 and dg.likeness(none, again) == dg.likeness(again, none) == 0.0


def report(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bucket string, foreign int")
    counts = dg.entropy_counts(docs)
    return counts, dg.edit_report(docs, dg.Rarity(counts)).collect()


def test_every_document_and_the_next(spark):
    texts = [prose(RNG.randint(1, 200), i) for i in range(150)]
    rows = list(enumerate(texts, 10)) + [(500, None), (501, ""), (502, "x"), (503, texts[0]), (504, "long " * 100_000), (505, prose(20_000, 9))]
    counts, got = report(spark, RNG.sample(rows, len(rows)))
    assert counts.tolist() == model([t or "" for _, t in rows]).tolist()
    rarity = dg.Rarity(counts)
    rows = [(i, t or "") for i, t in sorted(rows)]
    prints = dg._prints([t for _, t in rows], rarity)
    got = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        changed = t[:len(t) - n] + following[:n]
        [p] = dg._prints([changed], rarity)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == dg.written(*prints[k]) and r["edited_fingerprint"] == dg.written(*p)
        assert r["near_edited"] == pytest.approx(dg.likeness(prints[k], p))
        assert r["near_next"] == pytest.approx(dg.likeness(prints[k], prints[(k + 1) % len(rows)]))
    assert got[10]["fingerprint"] == got[503]["fingerprint"]
    long = [got[i] for i, t in rows if len(t) > 400 and i != 504]
    assert min(r["near_edited"] for r in long) > 0.6 and max(r["near_next"] for r in long) < 0.4


def test_few_documents(spark):
    assert report(spark, [])[1] == []
    [only] = report(spark, [(4, prose(50, 1))])[1]
    assert only["near_next"] == 1.0
    rows = report(spark, [(None, prose(50, 1)), (1, prose(50, 2)), (1, prose(50, 2)), (1, prose(40, 3))])[1]
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "1", "None"]
    assert sum(r["near_next"] == 1.0 for r in rows) == 1


def test_fingerprints_of_any_table(spark, docs_of):
    docs = docs_of([(1, prose(80, 1)), (2, None), (3, prose(80, 1))])
    out = {r["doc_id"]: r["fingerprint"] for r in dg.fingerprints(docs, dg.Rarity(dg.entropy_counts(docs)), ["doc_id", "score"]).collect()}
    assert out[1] == out[3] != "" and out[2] == ""
