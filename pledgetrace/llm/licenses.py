"""License notices: winnowed fingerprints of the templates pick candidates, banded alignment measures them.

Templates and documents are read as words (runs of letters, digits and non-ASCII characters, A-Z
lower-cased). A stretch of a document is a notice if its longest common subsequence with a template
has enough of the template's words (``coverage``) and if it holds at most ``spare`` other words, an
eighth of the template and two at least. Words of the template that are missing and words put in
move an alignment off its diagonal by at most that much, so it lies in a band.

Such an alignment is cut by missing and foreign words into a bounded number of runs of words that
follow each other in both. From that bound each template has the length of its shingles (one or two
words) and its winnowing window (one or two shingles), so that runs of that many words leave shared
fingerprints, and the least number of them. An inverted index of all templates' fingerprints gives
the diagonals on which a document has that many; only there words are aligned, from every word that
may begin a notice. Nothing that is a notice by the definition above is lost on the way.

Licenses of one family differ by a word or a number. A template may name words of its own that an
alignment must match, and words that end a stretch where the template does not have them itself.

Defined cases. A null text counts as empty. A template without words matches nothing. Repeated
rows are reported each. A stretch begins at a word of the template; from each such word the one with
the most matched words counts, the shortest of equals; of stretches of a template that overlap the one with more matched words stands,
then the shorter, then the earlier one. Of templates that match overlapping places the one with more
matched words stands, of equals the one that covers more of itself, then the first by name. An empty
table gives no rows. Other columns are ignored."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .notices import BARRED, REQUIRED, TEMPLATES
from .tables import declared, small_batches, text_bytes, unused
from .words import NOT_ALNUM, Lookup, runs, shingles, words

COVERAGE = 0.8
#: words that a stretch may hold besides matched ones: a share of the template, and the least number
SPARE, LEAST_SPARE = 8, 2
#: (words of a shingle, shingles of a window), the sparsest first, and the fingerprints that make a sparse one worthwhile
SHAPES, WORTHWHILE = ((2, 2), (2, 1), (1, 1)), 4
_OUT = -(1 << 20)


def _read(texts: list[bytes]):
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return offsets, *words(np.frombuffer(b"".join(texts), np.uint8), offsets, NOT_ALNUM)


def fingerprints(first: np.ndarray, h: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, hashes) of the winnowed shingles of each text: of every ``window`` shingles
    in a row the least one, the last of equals."""
    at, bounds = runs(first, size)
    g, _ = shingles(first, h, size)
    if window == 1 or not len(g):
        return at, g
    kept = np.zeros(len(g), bool)
    ends = bounds[1:][np.diff(bounds) > 0]
    inner = np.ones(len(g), bool)
    inner[ends - 1] = False
    left = np.flatnonzero(inner)
    kept[np.where(g[left] < g[left + 1], left, left + 1)] = True
    kept[ends[np.diff(bounds)[np.diff(bounds) > 0] == 1] - 1] = True
    return at[kept], g[kept]


class Templates:
    """Words of each template as numbers, what an alignment with it may lack, and the inverted index.

    ``required``: words, as a text, of a template that an alignment must match, each at its first
    place behind the one before. ``barred``: words over which it must not go; those that the
    template has are not meant."""

    def __init__(self, texts: dict[str, str], required: dict[str, str] | None = None,
                 barred: dict[str, str] | None = None, coverage: float = COVERAGE) -> None:
        self.names = sorted(texts)
        _, first, _, _, h = _read([texts[n].encode() for n in self.names])
        hashes = [h[first[i]:first[i + 1]] for i in range(len(self.names))]
        self.must, bars = [], []
        for own, name in zip(hashes, self.names):
            must = np.zeros(len(own), bool)
            at = 0
            for w in _read([(required or {}).get(name, "").encode()])[4]:
                at += int(np.flatnonzero(own[at:] == w)[0])
                must[at] = True
                at += 1
            self.must.append(must)
            bars.append(np.setdiff1d(_read([(barred or {}).get(name, "").encode()])[4], own))
        keys = np.unique(np.concatenate([h, *bars])) if len(self.names) else np.zeros(0, np.uint64)
        self.lookup = Lookup(keys)
        self.words = [np.searchsorted(keys, own) for own in hashes]
        self.bars = [np.searchsorted(keys, bar) for bar in bars]
        self.needed = [np.unique(own[must]) for own, must in zip(self.words, self.must)]
        self.size = np.array([len(own) for own in self.words], np.int64)
        self.need = np.array([next((n for n in range(1, m + 1) if n >= coverage * m), m + 1) for m in self.size], np.int64)
        self.spare = np.maximum(LEAST_SPARE, self.size // SPARE)
        # an alignment's diagonals: one lower for each missing word, one higher for each word put in
        self.band = np.maximum(self.size - self.need, 0) + self.spare + 1
        self.least = np.zeros(len(self.names), np.int64)
        shape = [self._shape(t) for t in range(len(self.names))]
        self.index = []
        for k, (size, window) in enumerate(SHAPES):
            at, g = fingerprints(first, h, size, window)
            t = np.searchsorted(first, at, "right") - 1
            mine = np.array([shape[x] == k for x in t], bool) if len(t) else np.zeros(0, bool)
            order = np.argsort(g[mine], kind="stable")
            unique, begin = np.unique(g[mine][order], return_index=True)
            self.index.append((size, window, Lookup(unique), np.append(begin, mine.sum()).astype(np.int64),
                               t[mine][order], (at - first[t])[mine][order]))

    def _shape(self, t: int) -> int:
        """Which of SHAPES a template has; sets the least number of fingerprints it shares."""
        need, parts = int(self.need[t]), int(self.band[t])
        for k, (size, window) in enumerate(SHAPES):
            # a run of n words has at least (n - size - window + 2) / window selected shingles
            least = -(-(need - (size + window - 2) * parts) // window)
            if least >= (WORTHWHILE if window > 1 else 1):
                break
        self.least[t] = max(least, 1)
        return k

    def candidates(self, first: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, template, begin, end): stretches of words that hold all notices."""
        found = [np.zeros((3, 0), np.int64)]
        for size, window, lookup, begin, templates, places in self.index:
            at, g = fingerprints(first, h, size, window)
            hit, key = lookup.hits(g)
            many = begin[key + 1] - begin[key]
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[key], many)
            place = np.repeat(at[hit], many)
            t = templates[entry]
            text = np.searchsorted(first, place, "right") - 1
            found.append(np.stack([text, t, (place - first[text] - places[entry]) // self.band[t]]))
        text, t, bucket = np.concatenate(found, axis=1)
        if not len(text):
            return
        low, wide = int(bucket.min()), int(bucket.max() - bucket.min()) + 3
        key, count = np.unique((text * len(self.names) + t) * wide + bucket - low + 1, return_counts=True)
        near = np.diff(key) == 1
        # the diagonals of an alignment lie in two buckets that follow each other
        both = count.copy()
        both[1:] = np.maximum(both[1:], count[1:] + count[:-1] * near)
        both[:-1] = np.maximum(both[:-1], count[:-1] + count[1:] * near)
        pair, bucket = np.divmod(key, wide)
        text, t = np.divmod(pair, len(self.names))
        ok = (both >= self.least[t]) & (self.need[t] <= self.size[t])
        text, t, bucket = text[ok], t[ok], bucket[ok] + low - 1
        if not len(text):
            return
        new = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(t) != 0) | (np.diff(bucket) > 3)))
        for a, b in zip(new, np.append(new[1:], len(text)) - 1):
            i, k = int(text[a]), int(t[a])
            yield (i, k, max(int((bucket[a] - 1) * self.band[k]), 0) + int(first[i]),
                   min(int((bucket[b] + 2) * self.band[k] + self.size[k]) + int(first[i]), int(first[i + 1])))


def from_begins(doc: np.ndarray, begins: np.ndarray, template: np.ndarray, need: int, spare: int,
                must: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matched words, length) of the best stretch from each begin, zero where there is none: the
    longest common subsequence in a band, one template word after the other, for all begins at once."""
    m = len(template)
    lack = m - need
    padded = np.concatenate([np.full(lack + 1, -1), doc, np.full(m + spare + 2, -1)])
    offset = np.arange(lack + spare + 1)
    # best[:, k]: matched words of so many template words and as many document words, less lack, plus k
    best = np.where(offset >= lack, 0, _OUT)[None].repeat(len(begins), axis=0)
    base = begins[:, None] + offset[None] + 1
    for i, w in enumerate(template.tolist()):
        now = np.where(padded[base + i] == w, best + 1, _OUT)
        if must is None or not must[i]:
            now[:, :-1] = np.maximum(now[:, :-1], best[:, 1:])
        best = np.maximum.accumulate(now, axis=1)
    length = m - lack + offset
    best[(best < need) | (length[None] - best > spare)] = 0
    pick = best.argmax(axis=1)
    n = best[np.arange(len(begins)), pick]
    return n, length[pick]


def alignments(doc: np.ndarray, template: np.ndarray, need: int, spare: int, must: np.ndarray | None = None,
               bars: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(matched words, first, last place) of the stretches of doc that do not overlap."""
    cuts = np.flatnonzero(np.isin(doc, bars)) if bars is not None and len(bars) else np.zeros(0, np.int64)
    needed = np.unique(template[must]) if must is not None else np.zeros(0, np.int64)
    found = []
    for left, right in zip(np.append(0, cuts + 1), np.append(cuts, len(doc))):
        part = doc[left:right]
        if len(part) < need or not np.isin(needed, part).all():
            continue
        own = np.isin(part, template)
        total = np.append(0, np.cumsum(own))
        ends = np.minimum(np.arange(len(part)) + len(template) + spare, len(part))
        begins = np.flatnonzero(own & (total[ends] - total[:-1] >= need))
        for lo in range(0, len(begins), 4096):
            some = begins[lo:lo + 4096]
            n, length = from_begins(part, some, template, need, spare, must)
            ok = n > 0
            found.append(np.stack([n[ok], some[ok] + left, some[ok] + left + length[ok] - 1]))
    if not found:
        return []
    n, a, e = np.concatenate(found, axis=1)
    used, out = np.zeros(len(doc), bool), []
    for i in np.lexsort((a, e - a, -n)):
        if not used[a[i]:e[i] + 1].any():
            used[a[i]:e[i] + 1] = True
            out.append((int(n[i]), int(a[i]), int(e[i])))
    return out


def matches(texts: list[bytes], templates: Templates) -> list[tuple]:
    """(text, name, matched, template words, begin, end) with character places, end exclusive."""
    offsets, first, starts, ends, h = _read(texts)
    known, key = templates.lookup.hits(h)
    ids = np.full(len(h), -1, np.int64)
    ids[known] = key
    found = defaultdict(list)
    for text, t, left, right in templates.candidates(first, h):
        template = templates.words[t]
        for n, a, b in alignments(ids[left:right], template, int(templates.need[t]), int(templates.spare[t]),
                                  templates.must[t], templates.bars[t]):
            found[text].append((-n, -n / len(template), templates.names[t], a + left, b + left, len(template)))
    out = []
    for text in sorted(found):
        kept: list[tuple] = []
        used = np.zeros(first[text + 1] - first[text], bool)
        for row in sorted(found[text]):
            place = used[row[3] - first[text]:row[4] - first[text] + 1]
            if not place.any():
                place[:] = True
                kept.append(row)
        raw = texts[text]
        for n, _, name, a, b, size in sorted(kept, key=lambda r: r[3]):
            a, b = int(starts[a] - offsets[text]), int(ends[b] - offsets[text])
            begin = len(raw[:a].decode("utf-8"))
            out.append((text, name, -n, size, begin, begin + len(raw[a:b].decode("utf-8"))))
    return out


def license_spans(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None,
                  coverage: float = COVERAGE, required: dict[str, str] | None = None,
                  barred: dict[str, str] | None = None) -> DataFrame:
    """(keep…, license, matched_words, license_words, coverage, begin, end) for each notice; kept
    columns of these names give way."""
    small_batches(docs.sparkSession)
    index = (Templates(TEMPLATES, REQUIRED, BARRED, coverage) if templates is None
             else Templates(templates, required, barred, coverage))
    keep = [k for k in keep if k not in ("license", "matched_words", "license_words", "coverage", "begin", "end")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            rows = matches([data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], index)
            cols = list(zip(*rows)) or [()] * 6
            out = {n: batch.column(i).take(pa.array(cols[0], pa.int64())) for i, n in enumerate(keep)}
            out["license"] = pa.array(cols[1], pa.string())
            for name, values in zip(("matched_words", "license_words", "begin", "end"), cols[2:]):
                out[name] = pa.array(values, pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(*keep, F.col("text").alias(unused(docs, "_text"))).mapInArrow(task, ", ".join([
        *declared(docs, keep), "license string, matched_words bigint, license_words bigint, begin bigint, end bigint"]))
    return rows.withColumn("coverage", F.col("matched_words") / F.col("license_words"))
