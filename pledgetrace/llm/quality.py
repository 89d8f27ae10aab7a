"""Document quality by compression: a text of a kind compresses best with that kind's dictionary.

Two zstandard dictionaries are built from good and bad labelled text. A text is compressed in
blocks with each. The difference of the two sizes over their sum, and the log of the share of its
bytes that the good dictionary leaves (repetition leaves few), go into a logistic curve, fitted on
labelled texts the dictionaries have not seen, whose value is the score.

Defined cases. A null text counts as empty and scores the share of good labels among those the
curve is fitted on, as no bytes speak for either side. Rows with a null label or id are never
learned from. Repeated rows score alike. Without labels of both kinds every score is 0.5. An empty
table gives no rows. Other columns of the input are ignored."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .tables import filtered, fold, small_batches, with_columns

#: labelled texts per kind: the first so many for the dictionaries, the rest for the curve
DICTIONARY_TEXTS, CURVE_TEXTS = 1500, 1500
#: bytes of a labelled text that may reach the driver, in blocks spread over the whole of it
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
BLOCK = 512
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the two figures and the offset
    empty: float


def blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


class Sizes:
    """Compressed sizes of whole texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.coders = []
        for raw in (good, bad):
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(
                dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))

    def figures(self, text: bytes) -> tuple[float, float]:
        """(bad - good) / (bad + good), above 0 if the good dictionary fits better, and
        log(good / length), of a text that is not empty."""
        parts = blocks(text)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.coders)
        return (bad - good) / (bad + good), math.log(good / len(text))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of the columns of ``x``, lightly smoothed (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (p - y) + 1e-3 * w)
        w -= np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_quality(labelled: DataFrame, share: float, text: str = "text", label: str = "label") -> QualityModel:
    """Fit on a sample of (text, label 0/1), per kind at most DICTIONARY_TEXTS + CURVE_TEXTS rows;
    of longer texts SAMPLE_BYTES in evenly spread blocks. ``share`` is that of label 1 among all."""
    held = labelled.filter(F.col(label).isNotNull() & (F.length(text) > 0))
    raw = F.encode(text, "UTF-8")
    n, take = F.ceil(F.octet_length(text) / BLOCK), SAMPLE_BYTES // BLOCK
    spread = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(take)) - 1), lambda i: F.substring(
        raw, F.floor(i * n / F.least(n, F.lit(take))).cast("int") * BLOCK + 1, F.lit(BLOCK)))
    kinds = []
    for kind in (1, 0):
        rows = held.filter(F.col(label) == kind).select(F.xxhash64(text).alias("_h"), spread.alias("p")).orderBy(
            "_h").limit(DICTIONARY_TEXTS + CURVE_TEXTS).collect()
        kinds.append([[bytes(b) for b in r["p"]] for r in rows])
    if not all(kinds):
        return QualityModel(b"", b"", (0.0, 0.0, 0.0), 0.5)
    made, curve = [], []
    for rows in kinds:
        cut = max(1, len(rows) * DICTIONARY_TEXTS // (DICTIONARY_TEXTS + CURVE_TEXTS))
        made.append(dictionary([b for r in rows[:cut] for b in r]))
        curve.append(rows[cut:] or rows)
    sizes = Sizes(*made)
    x = [np.array([(*sizes.figures(b"".join(r)), 1.0) for r in rows]) for rows in curve]
    weights = logistic(np.concatenate(x), np.repeat([1.0, 0.0], [len(x[0]), len(x[1])]))
    # kinds are sampled alike: the offset is moved to the share of good labels among all
    share = min(max(share, 0.01), 0.99)
    weights[-1] += math.log(share / (1 - share)) - math.log(len(x[0]) / len(x[1]))
    return QualityModel(made[0], made[1], tuple(map(float, weights)), share)


def dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary, or the plain text itself where there is too little to train on."""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, parts)) // 4))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY_BYTES]


def quality_scores(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: good likelier) of each whole text."""
    small_batches(docs.sparkSession)

    return with_columns(docs, text, lambda column: {"score": pa.array(model_scores(column, model))}, "score double", keep)


def model_scores(column: pa.Array, model: QualityModel) -> np.ndarray:
    if not model.good:
        return np.full(len(column), 0.5)
    sizes = Sizes(model.good, model.bad)
    out = np.full(len(column), model.empty)
    for i, t in enumerate(column.cast(pa.binary()).to_pylist()):
        if t:
            z = sum(w * x for w, x in zip(model.weights, (*sizes.figures(t), 1.0)))
            out[i] = 1 / (1 + math.exp(-min(max(z, -500), 500)))
    return out


def good_documents(docs: DataFrame, model: QualityModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score at least ``least``."""
    small_batches(docs.sparkSession)
    return filtered(docs, text, lambda column: model_scores(column, model) >= least)


def fit_on_labels(docs: DataFrame, labels: DataFrame, learn: F.Column) -> QualityModel:
    """Fit on a bounded sample of the documents with a quality label that satisfy ``learn`` (over
    doc_id). Ids are chosen first, so that only sampled texts are read for the fit."""
    marks = (labels.select("doc_id", F.col("quality").alias("label")).filter(learn & F.col("label").isNotNull())
             .join(docs.select("doc_id"), "doc_id", "left_semi"))
    share = marks.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    ids = [marks.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(
        DICTIONARY_TEXTS + CURVE_TEXTS) for kind in (1, 0)]
    # at most 2 * (DICTIONARY_TEXTS + CURVE_TEXTS) rows
    chosen = F.broadcast(stage(ids[0].union(ids[1]).dropDuplicates(["doc_id"]), "labelled"))
    return fit_quality(docs.select("doc_id", "text").join(chosen, "doc_id"), share)


def learnable() -> F.Column:
    """Rows whose crc32 of the id is 0 or 2 modulo 3; the others are held out."""
    return fold("doc_id", 3) != 1
