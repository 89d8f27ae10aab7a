"""Document fingerprints: improbable byte windows in chained Bloom filters.

Every window of ``WINDOW`` bytes has an entropy. How often each entropy occurs in a corpus ranks the
windows: the rarer the entropy, the better. A window is selected if it is the best one in at least
``WINS`` of the ``SPAN`` runs of ``SPAN`` neighbours that hold it; windows of little entropy never
are. The selected windows are hashed into Bloom filters of ``BITS`` bits, ``FEATURES`` to a filter in
the order of the text, and a fingerprint is the chain of its filters.

Two fingerprints are compared filter by filter: bits in common, less what two random filters of that
many bits share, over the most they could share. Each filter of the one with fewer windows takes
its best partner, weighted by its windows. So a text is like another that holds it.

Whether a window is selected depends on the bytes around it alone; texts are worked through in
slices with margins, and memory stays bounded whatever the length of a text.

Defined cases. A null text counts as empty and has the empty fingerprint. A text with no selected
window, such as one shorter than a window, is one feature as a whole. Two empty fingerprints have
likeness 1, one of two 0. Equal texts have equal fingerprints. Repeated rows are rows of their own.
Documents are in the order of doc_id, nulls first, repeated ids in the order of a hash of their
texts; the last one is followed by the first, an only one by itself. An empty table gives no rows.
Other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import plan_bytes
from .tables import declared, small_batches, text_bytes, unused
from .words import mixed

WINDOW, SPAN, WINS = 12, 12, 4
BITS, FEATURES, HASHES = 2048, 160, 5
#: entropies are counted in this many steps; below the least share of the highest one they are weak
STEPS, WEAK = 1000, 0.4
#: chance overlap: standard deviations above the expected one that still count as none
CHANCE = 3.0
SLICE = 1 << 17
_NONE = np.iinfo(np.int64).max
_UNIT = 1 << 16


def _gains(window: int) -> np.ndarray:
    """What one more of c equal bytes adds to the sum of c log c, in whole units."""
    c = np.arange(1, window + 2, dtype=np.float64)
    f = np.concatenate([[0], np.round(c * np.log2(c) * _UNIT)]).astype(np.int64)
    return f[1:] - f[:-1]


def entropy_steps(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Step of the entropy of each window of ``data``, 0 to STEPS, in whole numbers throughout."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.int64)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, window):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    gains = _gains(window)
    change = gains[behind]
    change[window:] -= gains[ahead[:-window]]
    most = int(gains[:window].sum())
    return (most - np.cumsum(change)[window - 1:]) * STEPS // most


class Rarity:
    """Rank of each entropy step, the rarest first; weak steps have none."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW) -> None:
        self.window = window
        self.rank = np.full(STEPS + 1, -1, np.int64)
        strong = np.arange(int(WEAK * STEPS), STEPS + 1)
        order = np.argsort(counts[strong], kind="stable")
        self.rank[strong[order]] = np.arange(len(strong))


def _selected(data: np.ndarray, valid: np.ndarray, rarity: Rarity) -> np.ndarray:
    """Places of the selected windows of ``data`` among those that are ``valid``."""
    rank = rarity.rank[entropy_steps(data, rarity.window)]
    n = len(rank)
    size = n + 2 * (SPAN - 1)
    best = np.full(size, _NONE)
    at = np.arange(n) + SPAN - 1
    best[SPAN - 1:SPAN - 1 + n] = np.where(valid[:n] & (rank >= 0), rank * size + at, _NONE)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    wins = np.bincount(best[best < _NONE] % size, minlength=size)[SPAN - 1:SPAN - 1 + n]
    return np.flatnonzero(wins >= WINS)


def features(data: np.ndarray, offsets: np.ndarray, rarity: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 bounds): the selected windows of each text, in order, each once."""
    w, total = rarity.window, len(data)
    size = np.diff(offsets)
    # a window is inside a text if it begins at least w bytes before its end
    valid = np.zeros(total + 1, np.int8)
    fits = size >= w
    np.add.at(valid, offsets[:-1][fits], 1)
    np.add.at(valid, offsets[1:][fits] - w + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    places = []
    for lo in range(0, max(total - w + 1, 0), SLICE):
        hi = min(lo + SLICE, total - w + 1)
        a, b = max(lo - SPAN, 0), min(hi + SPAN, total - w + 1)
        found = _selected(data[a:b + w - 1], valid[a:b], rarity) + a
        places.append(found[(found >= lo) & (found < hi)])
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    h = np.zeros(len(place), np.uint64)
    for k in range(w):
        h = h * np.uint64(0x100000001B3) + data[place + k]
    h = mixed(h)
    text = np.searchsorted(offsets, place, "right") - 1
    order = np.lexsort((place, h, text))
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    kept = np.sort(order[first])
    h, text = h[kept], text[kept]
    whole = np.setdiff1d(np.flatnonzero(size > 0), text)
    if len(whole):
        own = [int.from_bytes(hashlib.blake2b(data[offsets[i]:offsets[i + 1]].tobytes(), digest_size=8).digest(), "little")
               for i in whole]
        h, text = np.concatenate([h, np.array(own, np.uint64)]), np.concatenate([text, whole])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    return h, np.searchsorted(text, np.arange(len(size) + 1))


def chain(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filters as rows of bytes, features of each) of one text."""
    n = -(-len(hashes) // FEATURES)
    bits = np.zeros((n, BITS), np.uint8)
    row = np.arange(len(hashes)) // FEATURES
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(12 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1), np.bincount(row, minlength=n)


def written(filters: np.ndarray, counts: np.ndarray) -> str:
    """A fingerprint as text: per filter its number of features and its bits."""
    return ",".join(f"{c}:{base64.b64encode(f.tobytes()).decode()}" for f, c in zip(filters, counts))


def read(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [p.split(":") for p in text.split(",")] if text else []
    return (np.array([list(base64.b64decode(b)) for _, b in parts], np.uint8).reshape(len(parts), BITS // 8),
            np.array([int(c) for c, _ in parts], np.int64))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1 of two chains, from the side of the one with fewer features."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if a[1].sum() > b[1].sum():
        a, b = b, a
    x = np.unpackbits(a[0], axis=1).astype(np.float32)
    set_x = x.sum(axis=1)
    best = np.zeros(len(x))
    for lo in range(0, len(b[0]), 1024):
        y = np.unpackbits(b[0][lo:lo + 1024], axis=1).astype(np.float32)
        set_y = y.sum(axis=1)
        for at in range(0, len(x), 1024):
            part = slice(at, at + 1024)
            both = x[part] @ y.T
            chance = set_x[part, None] * set_y[None] / BITS
            noise = CHANCE * np.sqrt(chance * (1 - set_x[part, None] / BITS) * (1 - set_y[None] / BITS))
            most = np.minimum(set_x[part, None], set_y[None])
            share = np.where(both > chance + noise, (both - chance) / np.maximum(most - chance, 1), 0)
            best[part] = np.maximum(best[part], share.max(axis=1))
    return float(min(1.0, (best * a[1]).sum() / a[1].sum()))


def entropy_counts(docs: DataFrame, text: str = "text", window: int = WINDOW) -> np.ndarray:
    """How many windows of all texts have each entropy step; the driver gets STEPS sums."""
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            inside = np.ones(len(data), bool)
            for k in range(1, window):
                end = offsets[1:] - k
                inside[end[(end >= 0) & (end < len(data))]] = False
            for lo in range(0, max(len(data) - window + 1, 0), SLICE):
                steps = entropy_steps(data[lo:lo + SLICE + window - 1], window)
                total += np.bincount(steps[inside[lo:lo + len(steps)]], minlength=STEPS + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"step": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(task, "step bigint, n bigint")
    counts = np.zeros(STEPS + 1, np.int64)
    for step, n in rows.groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[step] = n
    return counts


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the beginning of the one that follows."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _bucket(key: Column, bounds: list) -> Column:
    """Number of bounds that are not above the key, by halving; nulls are in the first bucket."""
    if not bounds:
        return F.lit(0)
    half = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    padded = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(F.array(*[F.lit(h) for h in half]), F.lit(0), lambda at, h: F.when(
        (at + h <= len(bounds)) & (F.get(padded, at + h - 1) <= key), at + h).otherwise(at))


def in_order(docs: DataFrame, per_bucket: int = 4 << 20, most: int = 1 << 16) -> DataFrame:
    """(bucket, doc_id, text, foreign): documents in buckets that are ranges of doc_id, each with the
    first document of the next bucket as a foreign row behind it.

    Texts are moved once. What the driver gets is one id for each of at most ``most`` buckets."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    want = min(most, max(4 * spark.sparkContext.defaultParallelism, plan_bytes(docs) // per_bucket))
    at = [float(i) for i in np.linspace(0, 1, want + 1)[1:-1]]
    bounds = docs.agg(F.percentile_approx("doc_id", at, 100 * want)).first()[0] or []
    bucket = _bucket(F.col("doc_id"), sorted(set(bounds)))
    least = docs.groupBy(bucket.alias("bucket")).agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least"))
    firsts = sorted((r["bucket"], r["least"]["doc_id"]) for r in least.collect())
    kind = docs.schema["doc_id"].dataType.simpleString()
    before = [(firsts[i - 1][0], key) for i, (_, key) in enumerate(firsts)]
    # one row per bucket
    heads = F.broadcast(spark.createDataFrame(before, f"bucket int, first {kind}"))
    order = F.xxhash64("text")
    foreign = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("bucket", "doc_id").agg(
        F.min(F.struct(order.alias("h"), "text")).alias("head")).select("bucket", "doc_id", "head.text", F.lit(True).alias("foreign"))
    own = docs.select(bucket.cast("int").alias("bucket"), "doc_id", "text", F.lit(False).alias("foreign"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return own.unionByName(foreign).repartition(parts, "bucket").sortWithinPartitions("bucket", "foreign", "doc_id", order)


def fingerprints(docs: DataFrame, rarity: Rarity, keep: list[str], text: str = "text") -> DataFrame:
    """(keep…, fingerprint) of every text, in batches where the rows are."""
    small_batches(docs.sparkSession)
    keep = [k for k in keep if k != "fingerprint"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bound = features(*text_bytes(batch.column(len(keep))), rarity)
            prints = [written(*chain(h[a:b])) for a, b in zip(bound, bound[1:])]
            yield pa.RecordBatch.from_pydict({k: batch.column(i) for i, k in enumerate(keep)} | {"fingerprint": pa.array(prints, pa.string())})

    return docs.select(*keep, F.col(text).alias(unused(docs, "_text"))).mapInArrow(task, ", ".join([*declared(docs, keep), "fingerprint string"]))


def _prints(texts: list[str], rarity: Rarity) -> list[tuple[np.ndarray, np.ndarray]]:
    h, bound = features(*text_bytes(pa.array(texts, pa.large_string())), rarity)
    return [chain(h[a:b]) for a, b in zip(bound, bound[1:])]


def edit_report(docs: DataFrame, rarity: Rarity) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    every document against its edited text and the document that follows."""
    small_batches(docs.sparkSession)
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = list(zip(batch.column("bucket").to_pylist(), batch.column("doc_id"), texts,
                            batch.column("foreign").to_pylist(), _prints(texts, rarity)))
            rows = rows if last is None else [last, *rows]
            last = rows[-1]
            # a foreign row ends its bucket and is followed by none
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3]]
            changed = [edited(a[2], b[2]) for a, b in pairs]
            again = _prints(changed, rarity)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([a[1].as_py() for a, _ in pairs], batch.schema.field("doc_id").type),
                "n_chars": pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                "fingerprint": pa.array([written(*a[4]) for a, _ in pairs], pa.string()),
                "edited_fingerprint": pa.array([written(*p) for p in again], pa.string()),
                "near_edited": pa.array([likeness(a[4], p) for (a, _), p in zip(pairs, again)], pa.float64()),
                "near_next": pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64())})

    return in_order(docs).mapInArrow(task, schema)
