"""Toxicity by a linear classifier that may not care which group a sentence names.

Features are the words of a text and the beginnings of its words, present or not. A logistic
model is fitted on a bounded sample of labelled texts. Every sentence of the sample that names a
group is copied with another group, or a neutral noun, in its place; the squared changes of the
linear score over these pairs are added to the loss, so that no weight rests on the mention.

Defined cases. A null text counts as empty and scores the base rate of the model. Rows with a null
label or id are never learned from. Repeated rows score alike. Without labels of both kinds every
score is 0.5. An empty table gives no rows. Other columns of the input are ignored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .tables import fold, small_batches, text_bytes, with_columns
from .words import NOT_ALNUM, Lookup, mixed, words

#: labelled texts of either kind that the model is fitted on, those of least hash
POSITIVES, NEGATIVES = 3000, 6000
#: features kept at most, texts that must have one, and by how many standard errors the log odds
#: of the kinds differ at least
FEATURES, LEAST_TEXTS, SURELY = 4096, 8, 3.0
PREFIXES = (4, 5, 6)
SWAP_WEIGHT, RIDGE, STEPS = 20.0, 5e-5, 30
#: sentence pairs that a labelled text counts for at most; of one with more, all are used and weigh less
PAIRS = 24
#: bytes of sentences read at a time
PAIR_BYTES = 1 << 20

#: groups of interchangeable words; the first of each is neutral
GROUPS = (
    ("people", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("person", "christian", "muslim", "jew", "hindu", "buddhist", "atheist", "catholic"),
    ("people", "women", "men", "girls", "boys"), ("person", "woman", "man", "girl", "boy"),
    ("people", "gays", "lesbians", "homosexuals", "heterosexuals", "transsexuals"),
    ("some", "gay", "lesbian", "homosexual", "heterosexual", "bisexual", "transgender", "queer", "straight"),
    ("some", "black", "white", "asian", "african", "latino", "arab", "jewish", "european", "american"),
    ("people", "immigrants", "refugees", "foreigners", "blacks", "whites", "asians", "africans", "arabs"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwule", "lesben"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "homosexuels"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "homosexuales"),
)


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # uint64
    weights: np.ndarray
    offset: float


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, features): a row per kind of feature, a column per word; those of words shorter
    than a prefix repeat the feature of the word."""
    first, starts, ends, whole, *heads = words(data, offsets, NOT_ALNUM, PREFIXES)
    size = ends - starts
    rows = [mixed(whole)]
    for k, h in zip(PREFIXES, heads):
        rows.append(np.where(size >= k, mixed(h + np.uint64(k)), rows[0]))
    return first, np.stack(rows)


def present(first: np.ndarray, features: np.ndarray, known: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place of a known feature) of a batch, sorted."""
    n = len(first) - 1
    word_text = np.repeat(np.arange(n), np.diff(first))
    pairs = []
    for row in features:
        at, place = known.hits(row)
        pairs.append(word_text[at] * len(known.keys) + place)
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return pairs // max(1, len(known.keys)), pairs % max(1, len(known.keys))


def swapped_sentences(text: bytes, groups: tuple[tuple[str, ...], ...]) -> list[tuple[bytes, bytes]]:
    """(sentence, sentence with one group in place of another) of the whole text."""
    out = []
    names: dict[bytes, list[tuple[bytes, ...]]] = {}
    for g in groups:
        raw = tuple(w.encode() for w in g)
        for w in raw[1:]:
            names.setdefault(w, []).append(raw)
    for sentence in re.split(rb"[.!?\n]+", text.lower()):
        found = [w for w in re.findall(rb"[a-z0-9\x80-\xff]+", sentence) if w in names]
        for at, word in enumerate(dict.fromkeys(found)):
            pattern = rb"(?<![a-z0-9\x80-\xff])" + re.escape(word) + rb"(?![a-z0-9\x80-\xff])"
            for group in names[word]:
                others = [w for w in group if w != word]
                turn = (len(sentence) + at) % len(others)
                for other in dict.fromkeys((others[0], others[turn], others[(turn + 1) % len(others)])):
                    out.append((sentence, re.sub(pattern, other, sentence)))
    return out


def _of_texts(texts: list[bytes], known: Lookup) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return present(*feature_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets), known)


def _moves(both: list[tuple[bytes, bytes]], known: Lookup) -> Counter:
    """How often which features are lost and gained (the gained ones as -1 - place) by the pairs;
    pairs that change none are left out."""
    out: Counter = Counter()
    size = np.cumsum([len(a) + len(b) for a, b in both]) // PAIR_BYTES
    cuts = np.flatnonzero(np.diff(size)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(both)]):
        of, at = _of_texts([t for pair in both[start:end] for t in pair], known)
        sides = np.searchsorted(of, np.arange(2 * (end - start) + 1))
        for k in range(end - start):
            a, b = (at[sides[2 * k + s]:sides[2 * k + s + 1]] for s in (0, 1))
            out[(*np.setdiff1d(a, b).tolist(), *(-1 - np.setdiff1d(b, a)).tolist())] += 1
    del out[()]
    return out


def fit_toxicity(sample: DataFrame, positive_share: float, groups=GROUPS, swap_weight: float = SWAP_WEIGHT,
                 least_texts: int = LEAST_TEXTS) -> ToxicityModel:
    """Fit on ``sample`` (text, label 0/1), which the caller has bounded.

    Features are counted where the rows are. Only the kept ones, and which of them each sampled
    text has, reach the driver."""
    small_batches(sample.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            label = np.asarray(batch.column(1)).astype(np.int64)
            first, features = feature_hashes(data, offsets)
            of = np.tile(np.repeat(np.arange(len(label)), np.diff(first)), len(features))
            flat = features.ravel()
            order = np.lexsort((flat, of))
            flat, of = flat[order], of[order]
            new = np.concatenate([[True], (np.diff(of) != 0) | (flat[1:] != flat[:-1])]) if len(flat) else flat > 0
            keys, place = np.unique(flat[new], return_inverse=True)
            toxic = np.bincount(place, weights=label[of[new]], minlength=len(keys)).astype(np.int64)
            n = np.bincount(place, minlength=len(keys))
            yield pa.RecordBatch.from_pydict({"feature": pa.array(keys.view(np.int64)),
                                              "pos": pa.array(toxic), "neg": pa.array(n - toxic)})

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    p, q = F.col("pos") + 0.5, F.col("neg") + 0.5
    surely = F.abs(F.log(p / (n1 + 1 - p)) - F.log(q / (n0 + 1 - q))) / F.sqrt(1 / p + 1 / q)
    rows = (sample.select(F.coalesce("text", F.lit("")), "label").mapInArrow(counted, "feature bigint, pos bigint, neg bigint")
            .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .filter(F.col("pos") + F.col("neg") >= least_texts)
            .select("feature", surely.alias("s")).filter(F.col("s") >= SURELY).orderBy(F.desc("s"), "feature").limit(FEATURES).collect())
    # the words that name groups, and their neutral stand-ins, are always features
    named = np.unique(_named_features(groups))
    kept = np.unique(np.concatenate([np.array([r["feature"] for r in rows], np.int64).view(np.uint64), named]))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(kept)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            text, place = present(*feature_hashes(data, offsets), known)
            cuts = np.searchsorted(text, np.arange(len(offsets)))
            pairs: list[list[tuple[int, ...]]] = []
            weights: list[list[float]] = []
            for i in range(len(offsets) - 1):
                both = swapped_sentences(data[offsets[i]:offsets[i + 1]].tobytes(), groups)
                moves = _moves(both, known)
                pairs.append(list(moves))
                weights.append([times * min(1.0, PAIRS / len(both)) for times in moves.values()])
            yield pa.RecordBatch.from_pydict({
                "label": batch.column(1).cast(pa.int32()),
                "has": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(place.astype(np.int32))),
                "pairs": pa.array(pairs, pa.list_(pa.list_(pa.int32()))), "weights": pa.array(weights, pa.list_(pa.float64()))})

    held = sample.select(F.coalesce("text", F.lit("")), "label").mapInArrow(
        marked, "label int, has array<int>, pairs array<array<int>>, weights array<double>").toArrow()
    y = np.asarray(held["label"].combine_chunks()).astype(float)
    has = held["has"].combine_chunks()
    swaps = [pair for row in held["pairs"].to_pylist() for pair in row]
    heavy = np.asarray(held["weights"].combine_chunks().flatten())
    weights, offset = descend(np.asarray(has.flatten()), np.asarray(has.offsets), y, swaps, heavy, len(kept), swap_weight)
    share = min(max(positive_share, 1e-3), 1 - 1e-3)
    offset += math.log(share / (1 - share)) - math.log(y.sum() / (len(y) - y.sum()))
    live = np.flatnonzero(np.abs(weights) > 1e-3)
    return ToxicityModel(kept[live], weights[live], offset)


def _named_features(groups) -> np.ndarray:
    texts = [w.encode() for g in groups for w in g]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return feature_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)[1].ravel()


def descend(place: np.ndarray, bounds: np.ndarray, y: np.ndarray, swaps: list[list[int]],
            heavy: np.ndarray, n: int, swap_weight: float) -> tuple[np.ndarray, float]:
    """Least mean log loss + ridge + swap_weight * mean squared change over the swaps,
    each as heavy as ``heavy`` says.

    Newton steps, each solved by conjugate gradients and halved until the loss falls; the
    last of the n + 1 unknowns is the offset."""
    text = np.repeat(np.arange(len(y)), np.diff(bounds))
    pair = np.repeat(np.arange(len(swaps)), [len(s) for s in swaps])
    moved = np.array([m for s in swaps for m in s], np.int64)
    sign, moved = np.where(moved < 0, -1.0, 1.0), np.where(moved < 0, -1 - moved, moved)
    pull = 2 * swap_weight * heavy / (heavy.sum() or 1.0)

    def linear(v):
        return np.bincount(text, weights=v[place], minlength=len(y)) + v[n]

    def back(g):
        return np.append(np.bincount(place, weights=g[text], minlength=n), g.sum())

    def change(v):
        return np.bincount(pair, weights=sign * v[moved], minlength=len(swaps))

    def penalty(v):
        out = RIDGE * v
        out[n] = 0.0
        if len(swaps):
            out[:n] += np.bincount(moved, weights=sign * (pull * change(v))[pair], minlength=n)
        return out

    def loss(v):
        z = linear(v)
        return np.mean(np.logaddexp(0, z) - y * z) + 0.5 * v @ penalty(v)

    w = np.zeros(n + 1)
    now = loss(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(linear(w), -30, 30)))
        grad = back(p - y) / len(y) + penalty(w)
        curve = p * (1 - p) / len(y)
        step, rest = np.zeros(n + 1), -grad
        way, size = rest.copy(), rest @ rest
        for _ in range(60):
            if size < 1e-18:
                break
            bent = back(curve * linear(way)) + penalty(way) + 1e-9 * way
            far = size / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            size, was = rest @ rest, size
            way = rest + size / was * way
        length = 1.0
        while length > 1e-4 and loss(w + length * step) > now:
            length /= 2
        if length <= 1e-4:
            break
        w = w + length * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return w[:n], float(w[n])


def toxicity_scores(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: toxic likelier) of each whole text."""
    small_batches(docs.sparkSession)
    features, weights, offset = model.features, model.weights, model.offset

    def of(column: pa.Array) -> dict[str, pa.Array]:
        z = np.full(len(column), offset)
        if len(features):
            known = Lookup(features)
            data, offsets = text_bytes(column)
            doc, place = present(*feature_hashes(data, offsets), known)
            z += np.bincount(doc, weights=weights[place], minlength=len(column))
        return {"score": pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))}

    return with_columns(docs, text, of, "score double", keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: F.Column) -> tuple[DataFrame, float]:
    """Bounded sample (text, label) of the labelled documents, and the share of label 1. Of several
    labels of an id the least counts, of several texts of an id the one of least hash, so that the
    sample has one row for an id however often it is repeated."""
    marks = (labels.select("doc_id", F.col("toxic").alias("label")).filter(learn & F.col("label").isNotNull())
             .groupBy("doc_id").agg(F.min("label").alias("label"))
             .join(docs.select("doc_id"), "doc_id", "left_semi"))
    share = marks.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    ids = [marks.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
           for kind, n in ((1, POSITIVES), (0, NEGATIVES))]
    # at most POSITIVES + NEGATIVES rows
    chosen = F.broadcast(stage(ids[0].union(ids[1]), "labelled"))
    text = F.coalesce("text", F.lit(""))
    # an id's rows are reduced where they are, before they meet
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", text.alias("text"), F.col("label").cast("int").alias("label"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r"))
    return stage(one.select("r.text", "r.label"), "sample"), share


def learnable() -> F.Column:
    """Rows whose crc32 of the id is not 0 modulo 5; the others are held out."""
    return fold("doc_id", 5) != 0
