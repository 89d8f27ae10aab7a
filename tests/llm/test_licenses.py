from pledgetrace.llm import licenses as l

MIT = l.TEMPLATES["MIT"]


def found(spark, docs, **more):
    return sorted((r["doc_id"] or -1, r["license"], r["begin"], r["end"], r["matched_words"]) for r in l.license_spans(docs, ["doc_id", "source"], **more).collect())


def test_notices_and_spans(spark, docs_of):
    head = "Çà et là 123. "
    texts = [(1, head + "Released under the MIT License. More text."), (2, "licensed UNDER the apache-license version 2.0"),
             (3, head + MIT + " tail"), (4, "nothing to see here at all"), (5, None), (6, ""), (7, "Released under")]
    rows = found(spark, docs_of(texts))
    assert [(i, name) for i, name, *_ in rows] == [(1, "MIT-notice"), (2, "Apache-2.0-notice"), (3, "MIT")]
    text = dict(texts)
    assert text[1][rows[0][2]:rows[0][3]] == "Released under the MIT License"
    assert text[3][rows[2][2]:rows[2][3]] == MIT.rstrip(".") and rows[2][4] == len(l._read([MIT.encode()])[4])


def test_changed_words_within_the_band(spark, docs_of):
    w = MIT.split()
    changed = w[:20] + ["inserted", "words"] + w[20:40] + w[43:]
    for i in range(5, len(changed), 12):
        changed[i] = "zzz"
    (row,) = found(spark, docs_of([(1, "before " + " ".join(changed) + " after")]))
    assert row[1] == "MIT" and row[2] == 7 and 0.8 <= row[4] / len(w) < 1
    assert found(spark, docs_of([(1, " ".join(w[: len(w) // 2]))])) == []  # half of it does not cover it


def test_repeats_ties_and_empty(spark, docs_of):
    notice = "Released under the MIT License. "
    rows = found(spark, docs_of([(1, notice * 2), (1, notice * 2), (None, notice), (2, "x " * 30000 + notice)]))
    assert [r[0] for r in rows] == [-1, 1, 1, 1, 1, 2]
    assert found(spark, docs_of([])) == []
    two = {"b": "alpha beta gamma delta", "a": "alpha beta gamma delta", "none": ""}
    assert [r[1] for r in found(spark, docs_of([(1, "alpha beta gamma delta")]), templates=two)] == ["a"]


def plain_spans(doc, templates, coverage=l.COVERAGE):
    """(name, matched, begin, end) by words: every begin at a word of the template and every end in the
    whole document, with a plain table of the longest common subsequence."""
    rows = []
    for name, template in templates.items():
        m, found = len(template), []
        spare = max(2, m // 8)
        for a in (i for i, w in enumerate(doc) if w in template):
            best, per_end = [0] * (m + 1), []
            for w in doc[a:a + m + spare]:
                last = 0
                for j, t in enumerate(template, 1):
                    last, best[j] = best[j], max(best[j], best[j - 1], last + 1 if t == w else 0)
                per_end.append(best[-1])
            ok = [(-n, size) for size, n in enumerate(per_end, 1) if n and n >= coverage * m and size - n <= spare]
            if ok:
                found.append((min(ok)[0], min(ok)[1], a))
        used = set()
        for n, size, a in sorted(found):
            if not used & set(range(a, a + size)):
                used |= set(range(a, a + size))
                rows.append((n, n / m, name, a, a + size))
    used, out = set(), []
    for n, _, name, a, b in sorted(rows):
        if not used & set(range(a, b)):
            used |= set(range(a, b))
            out.append((name, -n, a, b))
    return sorted(out, key=lambda r: r[2])


SHORT = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.",
         "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc": "Licensed under CC BY-NC 4.0.",
         "public": "This is free and unencumbered software released into the public domain.", "two": "MIT License",
         "mpl": l.TEMPLATES["MPL-2.0"], "long": l.TEMPLATES["BSD-opening"]}


def test_spans_against_plain_search_over_whole_documents():
    import random
    rng = random.Random(4)
    read = lambda text: l._read([text.encode()])[4].tolist()
    texts = ["Released under MIT License.", "Released under an MIT License.", "released by the new MIT license"]
    for _ in range(250):
        words = []
        for _ in range(rng.randint(1, 3)):
            part = rng.choice(list(SHORT.values())).split()
            for _ in range(rng.randint(0, 2 + len(part) // 4)):
                at = rng.randrange(len(part))
                part[at:at + rng.randint(0, 1)] = rng.choice([[], ["zzz"], ["an", "the"], [part[at], part[at]]])
                part = part or ["zzz"]
            words += part + rng.choice([[], [], ["pre"] * rng.randint(1, 9)])
        texts.append(" ".join(words))
    vocabulary = " ".join(SHORT.values()).split()
    texts += [" ".join(rng.choices(vocabulary, k=60)) for _ in range(60)]
    texts += [" ".join(rng.choices("released under the mit license".split(), k=30)) for _ in range(60)]
    got = [[] for _ in texts]
    for i, name, n, _, a, b in l.matches([t.encode() for t in texts], l.Templates(SHORT)):
        got[i].append((name, n, a, b))
    rows = 0
    for text, have in zip(texts, got):
        _, _, starts, ends, h = l._read([text.encode()])
        want = plain_spans(h.tolist(), {k: read(v) for k, v in SHORT.items()})
        rows += len(want)
        assert have == [(name, n, starts[a], ends[b - 1]) for name, n, a, b in want], text
    assert got[0] and got[1] and rows > 300


def test_templates_of_few_letters_against_plain_search():
    import random
    rng = random.Random(8)
    for _ in range(150):
        templates = {f"t{i}": " ".join(rng.choices("abcde", k=rng.randint(1, 24))) for i in range(3)}
        text = " ".join(rng.choices("abcdef", k=rng.randint(0, 50)))
        if rng.random() < 0.6:
            w = rng.choice(list(templates.values())).split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = rng.choice([[], ["f"], ["a", "f"]])
                w = w or ["f"]
            text += " " + " ".join(w) + " " + text
        coverage = rng.choice([0.6, 0.8, 1.0])
        read = lambda t: l._read([t.encode()])[4].tolist()
        _, _, starts, ends, h = l._read([text.encode()])
        want = [(n, m, starts[a], ends[b - 1]) for n, m, a, b in plain_spans(h.tolist(), {k: read(v) for k, v in templates.items()}, coverage)]
        assert [r[1:3] + r[4:] for r in l.matches([text.encode()], l.Templates(templates, coverage=coverage))] == want


def test_words_of_a_notice_far_apart_are_no_notice(spark, docs_of):
    texts = ["He was released from prison under a new agreement with the court and the city of MIT got a license",
             "You are licensed by the state. Under the law, CC reports by 4 members, 0 against.",
             " ".join(w + " zzz" for w in MIT.split())]
    assert found(spark, docs_of(list(enumerate(texts)))) == []
    assert [r[1] for r in found(spark, docs_of([(1, "Released under MIT License.")]))] == ["MIT-notice"]


def test_shuffled_license_words_in_linear_time():
    import random
    import time
    rng = random.Random(6)
    vocabulary = " ".join(l.TEMPLATES.values()).split()
    text = " ".join(rng.choices(vocabulary, k=75_000)).encode()
    templates = l.Templates(l.TEMPLATES, l.REQUIRED, l.BARRED)
    assert len(text) > 400_000
    began = time.process_time()
    rows = l.matches([text], templates)
    spent = time.process_time() - began
    print(spent, len(rows))
    assert spent < 15


def test_clashing_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License", "x", 3, 2.0)], "doc_id long, text string, license string, begin int, coverage double")
    [row] = l.license_spans(docs, docs.columns).collect()
    assert row["license"] == "MIT-notice" and row["begin"] == 0 and row["coverage"] == 1.0 and row["text"].startswith("Rel")


def test_siblings_get_their_own_names(spark, docs_of):
    gpl2 = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.")
    lgpl = gpl2.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1")
    cases = {
        gpl2: "GPL-2.0-opening", lgpl: "LGPL-2.1-opening", gpl2.replace("General", "Affero General").replace("version 2", "version 3"): "AGPL-3.0-opening",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-notice",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0-notice",
        "Licensed under CC BY 4.0.": "CC-BY-4.0-notice", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0-notice",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice", "Licensed under CC BY-NC-ND 3.0.": "CC-BY-NC-ND-3.0-notice",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0-opening",
        "This work is licensed under a Creative Commons Attribution (CC BY) 4.0 International License.": "CC-BY-4.0-opening",
        "This work is licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License.": None,
        "Licensed under CC BY-XX 5.0.": None, "Released under the BSD License.": None,
        "and released to the public under the conditions of the license": None,
    }
    names = {i: None for i in range(len(cases))} | {r[0]: r[1] for r in found(spark, docs_of(list(enumerate(cases, 1))))}
    assert {text: names.get(i) for i, text in enumerate(cases, 1)} == cases


def test_whole_notices_to_their_ends(spark, docs_of):
    names = sorted(l.TEMPLATES)
    rows = found(spark, docs_of([(i, "before it " + l.TEMPLATES[n] + " Behind") for i, n in enumerate(names, 1)]))
    assert [(r[0], r[1]) for r in rows] == list(enumerate(names, 1))
    assert all(l.TEMPLATES[n].rstrip("./>") == ("before it " + l.TEMPLATES[n])[b:e].rstrip("./>") for (_, n, b, e, _) in rows)
    for name, last in (("MIT", "DEALINGS IN THE SOFTWARE"), ("Apache-2.0", "limitations under the License"),
                       ("BSD-3-Clause", "POSSIBILITY OF SUCH DAMAGE"), ("GPL-3.0", "gnu.org/licenses/"), ("ISC", "PERFORMANCE OF THIS SOFTWARE")):
        assert last in l.TEMPLATES[name][-60:]


def test_required_and_barred_words(spark, docs_of):
    texts = [(1, "one two three four five"), (2, "one two zzz four five"), (3, "one two bad three four five"), (4, "two three four five")]
    rows = found(spark, docs_of(texts), templates={"t": "one two three four five"}, required={"t": "three"}, barred={"t": "bad four"})
    assert [(r[0], r[4]) for r in rows] == [(1, 5), (4, 4)]
