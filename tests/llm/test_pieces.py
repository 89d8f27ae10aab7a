import random
from pathlib import Path

import numpy as np
import pytest

from pledgetrace.llm import pieces as p

pytestmark = pytest.mark.skipif(not Path(p.VOCABULARY).exists(), reason="no vocabulary here")
TEXTS = ["", "a", " ", "     ", "  Hello  world\n\nfoo  bar  é∑𝔘 ", "x" * 300, "thethethe" * 40, "日本語 テスト\ttab", "a\x00b",
         "Ünïcödé ñ" * 9, "\U0010ffff x", "the end", " lead", "trail ", "internationalisation of counter-revolutionaries"]


@pytest.fixture(scope="module")
def vocabulary():
    return p.load_vocabulary()


def encode(coder, texts):
    ids, bounds = coder.encode(texts, np.arange(len(texts), dtype=np.uint64))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_without_dropout_it_equals_the_library(vocabulary):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=p.VOCABULARY)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdefg théé \n") for _ in range(rng.randint(0, 90))) for _ in range(200)]
    assert encode(p.Encoder(vocabulary, 0.0, 1), texts) == library.encode(texts)


def merged_one_by_one(coder, text, key):
    """The rule as it stands: the best live candidate is merged until none is left."""
    out, chars = [], ["▁", *[("▁" if c == " " else "\0" if c == "▁" else c) for c in text]] if text else []
    units, at = [], 0
    for i, c in enumerate(chars):
        known = coder.of_char[ord(c)] >= 0 and c != "\0"
        before = chars[i - 1] if i else None
        if i == 0 or not known or not units[-1][1] or (c == "▁" and before != "▁"):
            units.append(([], known))
        units[-1][0].append(c)
    for ordinal, (unit, known) in enumerate(units):
        if not known:
            raw = ("▁" if unit[0] == "\0" else unit[0]).encode()
            if unit[0] == "\0" and "\0" in text:
                raw = b"\0"
            out += [coder.v.byte_base + x for x in raw]
            continue
        with np.errstate(over="ignore"):
            k = p.mixed(np.array([key], np.uint64) * p._K[0] + np.uint64(coder.seed) * p._K[3] + np.array([ordinal], np.uint64) * p._K[1])
        ids, cut = [int(coder.of_char[ord(c)]) for c in unit], list(range(len(unit) + 1))
        while True:
            n = len(ids) - 1
            if n < 1:
                break
            found = [int(coder.candidates(np.array([ids[i]], np.int32), np.array([ids[i + 1]], np.int32), k, np.array([cut[i]]),
                                          np.array([cut[i + 1]]), np.array([cut[i + 2]]))[0]) for i in range(n)]
            rank, i = min((int(coder.v.rank[m]), i) for i, m in enumerate(found))
            if rank == p.NEVER:
                break
            ids[i:i + 2], cut[i + 1:i + 2] = [found[i]], []
        out += ids
    return out


@pytest.mark.parametrize("wide", [3, 48])
def test_dropout_equals_the_rule(vocabulary, monkeypatch, wide):
    monkeypatch.setattr(p, "WIDE", wide)
    coder = p.Encoder(vocabulary, 0.3, 9)
    texts = [t for t in TEXTS if "\0" not in t][:14] + ["a ▁ b▁", "antidisestablishmentarianism itself"]
    assert encode(coder, texts) == [merged_one_by_one(coder, t, i) for i, t in enumerate(texts)]


def test_seeds_vary_and_all_decode(vocabulary):
    texts = TEXTS + ["lit ▁ eral▁", "▁", "\U0010ffff▁ x"]
    seen = set()
    for seed in range(4):
        ids = encode(p.Encoder(vocabulary, 0.2, seed), texts)
        assert [p.decode(x, vocabulary.raw) for x in ids] == texts
        seen.add(repr(ids))
    assert len(seen) == 4
    chars = encode(p.Encoder(vocabulary, 1.0, 1), ["the end"])[0]
    assert [vocabulary.raw[i].decode() for i in chars] == [" ", *"the end"]


def test_on_tables(spark, docs_of, vocabulary, monkeypatch):
    monkeypatch.setattr(p, "CHARS", 50)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "the end"), (3, "the end"), (None, None), (50, "word " * 3000)]
    out = p.encoded(docs_of(rows), ["doc_id", "source"], vocabulary)
    got = out.collect()
    assert len(got) == len(rows) and all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in got)
    twice = [r["ids"] for r in got if r["doc_id"] == 3 and r["n_ids"] > 1]
    back = {r["doc_id"]: r["text"] for r in p.decoded(out.filter("doc_id <> 3"), ["doc_id"], vocabulary).collect()}
    assert back == {i: t or "" for i, t in rows if i not in (3, None)} and twice[-1] == twice[-2]
    assert p.encoded(docs_of([]), ["doc_id"], vocabulary).collect() == []
