"""SentencePiece encoding of the merge (BPE) type with seeded merge-dropout, and decoding.

Text is encoded as the library encodes it: a leading blank is added, blanks become U+2581, every
character starts as a symbol, and the adjacent pair whose joined piece ranks best, the leftmost of
equals, is merged until no pair is left; characters without a piece become their bytes. With
dropout each candidate merge is first hashed under a key of the seed, the document, the unit's
place in it and the candidate's place in the unit; below the rate the candidate is skipped for
good. So a text has other segmentations under other seeds, each of which decodes to it.

No piece has a blank behind another character, so merges stay within units: a run of blanks with
the characters up to the next one. Units of all texts of a batch are merged side by side.

Defined cases. A null text counts as empty and has no ids. U+2581 itself is encoded as bytes, so
that it is not taken for a blank. Null keys count as key 0; keys that are no
integers are hashed. Repeated rows of one key are encoded
alike, those of other keys differ. An empty table gives no rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import declared, small_batches, unused
from .words import mixed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
#: stands for U+2581 in a text; above all code points
LITERAL = 0x110000
DROPOUT, SEED = 0.1, 17
#: characters of texts, and units, taken at a time; longer units are merged one by one
CHARS, UNITS, WIDE = 400_000, 32_768, 48
NEVER = np.int32(2**31 - 1)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id as bytes, ranks (lower merges first), merges, and the first byte piece."""

    raw: list[bytes]
    rank: np.ndarray  # int32 per id, and NEVER behind the last
    single: np.ndarray  # code points with a piece, sorted
    single_id: np.ndarray
    pair: np.ndarray  # left * size + right, sorted
    merged: np.ndarray
    byte_base: int

    @property
    def size(self) -> int:
        return len(self.raw)


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    if any("▁" in p.lstrip("▁") for p in plain):
        raise ValueError("pieces with a blank behind another character are not supported")
    base = next(i for i in range(n) if model.is_byte(i))
    raw = [b""] * n
    for p, i in plain.items():
        raw[i] = p.replace("▁", " ").encode()
    for b in range(256):
        raw[base + b] = bytes([b])
    scores = np.array([model.get_score(i) for i in range(n)])
    rank = np.append(np.unique(-scores, return_inverse=True)[1], NEVER).astype(np.int32)
    pairs = [(plain[p[:k]] * n + plain[p[k:]], i) for p, i in plain.items() for k in range(1, len(p))
             if p[:k] in plain and p[k:] in plain]
    pair, merged = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
    single = sorted((ord(p), i) for p, i in plain.items() if len(p) == 1)
    return Vocabulary(raw, rank, np.array([c for c, _ in single]), np.array([i for _, i in single], np.int32),
                      pair.copy(), merged.astype(np.int32), base)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int) -> None:
        self.v, self.seed = vocabulary, seed
        self.floor = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        self.of_char = np.full(LITERAL + 1, -1, np.int32)
        self.of_char[vocabulary.single] = vocabulary.single_id

    def candidates(self, left, right, key, a, b, c) -> np.ndarray:
        """Merged ids of pairs of symbols over places [a, b) and [b, c) of a unit; ``size`` for
        pairs that no piece joins or that the hash skips."""
        v = self.v
        pair = left.astype(np.int64) * v.size + right
        at = np.minimum(np.searchsorted(v.pair, pair), len(v.pair) - 1)
        out = np.where((v.pair[at] == pair) & (left >= 0) & (right >= 0), v.merged[at], np.int32(v.size))
        if self.floor:
            live = np.flatnonzero(out < v.size)
            drawn = mixed(key[live] + a[live].astype(np.uint64) * _K[0] + b[live].astype(np.uint64) * _K[1]
                          + c[live].astype(np.uint64) * _K[2])
            out[live[drawn < self.floor]] = v.size
        return out

    def rows(self, symbols: np.ndarray, length: np.ndarray, key: np.ndarray):
        """Merge all rows of a padded matrix side by side: (symbols, lengths) in the same order."""
        v, (n, width) = self.v, symbols.shape
        out, size = np.full((n, width), -1, np.int32), length.copy()
        row = np.arange(n)
        bound = np.broadcast_to(np.arange(width + 1, dtype=np.int32), (n, width + 1))
        inside = np.arange(width - 1) < (length - 1)[:, None]
        joined = np.full((n, width - 1), v.size, np.int32)
        r, c = np.nonzero(inside)
        joined[r, c] = self.candidates(symbols[r, c], symbols[r, c + 1], key[r], bound[r, c], bound[r, c + 1], bound[r, c + 2])
        rank = v.rank[joined]
        while len(row):
            at = rank.argmin(axis=1)
            every = np.arange(len(row))
            over = rank[every, at] == NEVER
            if over.any():
                done = row[over]
                out[done[:, None], np.arange(symbols.shape[1])] = symbols[over]
                go = ~over
                row, at, symbols, bound, joined, rank, key = (x[go] for x in (row, at, symbols, bound, joined, rank, key))
                if not len(row):
                    break
            width = size[row].max()
            every = np.arange(len(row))
            new = joined[every, at]
            size[row] -= 1
            place = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, place + (place > at[:, None]), 1)
            symbols[every, at] = new
            place = np.arange(width)
            bound = np.take_along_axis(bound, place + (place > at[:, None]), 1)
            place = np.arange(width - 2)
            shift = place + (place >= at[:, None])
            joined, rank = np.take_along_axis(joined, shift, 1), np.take_along_axis(rank, shift, 1)
            if width == 2:
                out[row, 0] = symbols[:, 0]
                break
            for side in (-1, 0):  # the pairs left and right of the new symbol
                k = at + side
                ok = np.flatnonzero((k >= 0) & (k < size[row] - 1))
                k = k[ok]
                joined[ok, k] = self.candidates(symbols[ok, k], symbols[ok, k + 1], key[ok], bound[ok, k], bound[ok, k + 1], bound[ok, k + 2])
                rank[ok, k] = v.rank[joined[ok, k]]
        return out, size

    def long(self, symbols: np.ndarray, key: np.uint64) -> np.ndarray:
        """The same for one long unit, with an agenda of candidates (rank, place)."""
        n = len(symbols)
        ids, bound = symbols.tolist(), list(range(n + 1))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end, agenda = list(range(1, n + 1)), []

        def offer(i: list[int]) -> None:
            i = [x for x in i if x >= 0 and after[x] < n]
            if not i:
                return
            j = [after[x] for x in i]
            found = self.candidates(np.array([ids[x] for x in i], np.int32), np.array([ids[x] for x in j], np.int32),
                                    np.full(len(i), key), np.array([bound[x] for x in i]), np.array([end[x] for x in i]),
                                    np.array([end[x] for x in j]))
            for x, y, m in zip(i, j, found.tolist()):
                if m < self.v.size:
                    heapq.heappush(agenda, (int(self.v.rank[m]), x, ids[x], ids[y], end[x], end[y], m))

        offer(list(range(n - 1)))
        while agenda:
            _, x, left, right, middle, last, m = heapq.heappop(agenda)
            y = after[x]
            if ids[x] != left or end[x] != middle or y >= n or ids[y] != right or end[y] != last:
                continue  # one of the two is gone
            ids[x], ids[y], end[x], after[x] = m, -2, last, after[y]
            if after[y] < n:
                before[after[y]] = x
            offer([before[x], x])
        return np.array([i for i in ids if i != -2], np.int32)

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the n + 1 bounds of the texts)."""
        v, total = self.v, len(texts)
        joined = "".join(["▁" + t.replace(" ", "▁") if t else "" for t in texts])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([1 + len(t) if t else 0 for t in texts])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for i in (i for i, t in enumerate(texts) if "▁" in t):
            own = np.frombuffer(texts[i].encode("utf-32-le"), np.uint32)
            chars[starts[i] + 1 + np.flatnonzero(own == BLANK)] = LITERAL
        text_of = np.repeat(np.arange(total), ends - starts)
        symbol = self.of_char[chars]
        blank = chars == BLANK
        head = np.ones(len(chars), bool)
        head[1:] = (text_of[1:] != text_of[:-1]) | (blank[1:] & ~blank[:-1]) | (symbol[1:] < 0) | (symbol[:-1] < 0)
        unit = np.flatnonzero(head)
        length = np.diff(np.append(unit, len(chars)))
        of = text_of[unit]
        first = np.searchsorted(of, np.arange(total))
        with np.errstate(over="ignore"):
            key = mixed(keys.astype(np.uint64)[of] * _K[0] + np.uint64(self.seed) * _K[3] + (np.arange(len(unit)) - first[of]).astype(np.uint64) * _K[1])
        count = np.ones(len(unit), np.int64)
        unknown = symbol[unit] < 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(length, kind="stable")
        order = order[~unknown[order]]
        ones = order[:np.searchsorted(length[order], 2)]
        wide = np.searchsorted(length[order], WIDE + 1)
        at = len(ones)
        while at < wide:
            top = length[order[at]] + 3  # units of about the same length side by side
            end = min(at + UNITS, int(np.searchsorted(length[order], top, "right")), wide)
            own = order[at:end]
            width = int(length[own].max())
            place = unit[own][:, None] + np.arange(width)
            inside = np.arange(width) < length[own][:, None]
            matrix = np.where(inside, symbol[np.minimum(place, len(symbol) - 1)], np.int32(-1))
            ids, size = self.rows(matrix, length[own].astype(np.int64), key[own])
            count[own] = size
            parts.append((own, ids, size))
            at = end
        for u in order[wide:]:
            ids = self.long(symbol[unit[u]:unit[u] + length[u]], key[u])
            count[u] = len(ids)
            parts.append((np.array([u]), ids[None, :], np.array([len(ids)])))
        raw = {u: (b"\xe2\x96\x81" if chars[unit[u]] == LITERAL else chr(int(chars[unit[u]])).encode()) for u in np.flatnonzero(unknown).tolist()}
        for u, b in raw.items():
            count[u] = len(b)
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], np.int32)
        out[begin[ones]] = symbol[unit[ones]]
        for own, ids, size in parts:
            inside = np.arange(ids.shape[1]) < size[:, None]
            to = begin[own][:, None] + np.arange(ids.shape[1])
            out[to[inside]] = ids[inside]
        for u, b in raw.items():
            out[begin[u]:begin[u] + len(b)] = np.frombuffer(b, np.uint8).astype(np.int32) + v.byte_base
        return out, begin[np.append(first, len(unit))]


def decode(ids: list[int], raw: list[bytes]) -> str:
    """The text of a sequence of ids."""
    return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


def slices(lengths: list[int], most: int = CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text is a range of its own."""
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


def encoded(docs: DataFrame, keep: list[str], vocabulary: Vocabulary, key: str = "doc_id", text: str = "text",
            dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``keep`` columns, ``ids``, ``n_ids`` and ``lossless`` (the ids decode to the text); kept
    columns of these names give way."""
    small_batches(docs.sparkSession)
    keep = [k for k in keep if k not in ("ids", "n_ids", "lossless")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(vocabulary, dropout, seed)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            keys = np.asarray(batch.column(batch.num_columns - 2).fill_null(0)).astype(np.int64).view(np.uint64)
            for a, b in slices([len(t) for t in texts]):
                ids, bounds = coder.encode(texts[a:b], keys[a:b])
                flat, cut = ids.tolist(), bounds.tolist()
                same = [decode(flat[cut[i]:cut[i + 1]], vocabulary.raw) == texts[a + i] for i in range(b - a)]
                out = {name: batch.column(i).slice(a, b - a) for i, name in enumerate(keep)}
                out["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                out["n_ids"] = pa.array(np.diff(bounds))
                out["lossless"] = pa.array(same)
                yield pa.RecordBatch.from_pydict(out)

    number = docs.select(*keep, (F.col(key) if docs.schema[key].dataType.typeName() in ("long", "integer")
                                 else F.xxhash64(key)).cast("long").alias(unused(docs, "_key")),
                         F.col(text).alias(unused(docs, "_text")))
    return number.mapInArrow(task, ", ".join([*declared(docs, keep), "ids array<int>, n_ids bigint, lossless boolean"]))


def decoded(rows: DataFrame, keep: list[str], vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``keep`` columns and the ``text`` of each list of ids; null lists have null texts. A kept
    column of this name gives way."""
    keep = [k for k in keep if k != "text"]
    raw = vocabulary.raw

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, raw) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_pydict({n: batch.column(i) for i, n in enumerate(keep)} | {"text": pa.array(texts, pa.string())})

    return rows.select(*keep, F.col(ids).alias(unused(rows, "_ids"))).mapInArrow(task, ", ".join([*declared(rows, keep), "text string"]))
