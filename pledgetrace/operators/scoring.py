"""What a scoring task does: passages of a batch against the queries of a pass.

The queries of a pass come as plain arrays. Term ids are hashes that Spark made from the words, so
no text is split here. A batch becomes an inverted index of the terms that queries ask for: per
term a list of passages with counts, and the largest count. A query's lists are read best bound
first; where what is left cannot lift any passage to the query's floor, reading ends."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd

SCORE_DIGITS = 9  # ties are decided by key, so equal texts must have equal scores
#: queries multiplied at a time, and list entries read at a time
BLOCK, ENTRIES = 1024, 1 << 22


class Buckets(NamedTuple):
    """Random hyperplanes: ``tables`` codes of ``bits`` signs; a query also looks one bit beside."""

    tables: int = 16
    bits: int = 8
    seed: int = 7


def unit_rows(vectors: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one, which of them are not zero); a missing vector is zero."""
    width = next((len(v) for v in vectors if v is not None), 0)
    raw = np.zeros((len(vectors), width))
    for row, v in zip(raw, vectors):
        if v is not None:
            row[:] = v
    norm = np.linalg.norm(raw, axis=1)
    return raw / np.where(norm > 0, norm, 1.0)[:, None], norm > 0


def lay_out(pdf: pd.DataFrame, key: str, vectors: Sequence | None, terms: str | None) -> dict:
    """A pass of queries as plain arrays, which any task can read."""
    out: dict = {"ids": pdf[key].tolist(), "unit": None, "live": None}
    if vectors is not None and len(pdf):
        out["unit"], out["live"] = unit_rows(vectors)
    lists = [np.asarray(t, np.int64) for t in pdf[terms]] if terms else [np.zeros(0, np.int64)] * len(pdf)
    size = np.array([len(t) for t in lists], np.int64)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    out["vocabulary"], out["term"] = np.unique(flat, return_inverse=True)
    out["query"] = np.repeat(np.arange(len(lists)), size)
    out["wanted"] = size
    return out


class Postings:
    """Inverted index of a batch: per term that occurs, the passages that have it and how often."""

    def __init__(self, lists: Sequence, vocabulary: np.ndarray) -> None:
        self.n = len(lists)
        arrays = [np.zeros(0, np.int64) if t is None else np.asarray(t, np.int64) for t in lists]
        flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        row = np.repeat(np.arange(self.n), [len(a) for a in arrays])
        at = np.minimum(np.searchsorted(vocabulary, flat), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
        pair, self.count = np.unique(at[known] * max(self.n, 1) + row[known], return_counts=True)
        term, self.row = np.divmod(pair, max(self.n, 1))
        self.terms, self.begin = np.unique(term, return_index=True)
        self.end = np.append(self.begin[1:], len(term)).astype(np.int64)
        self.most = np.maximum.reduceat(self.count, self.begin) if len(term) else np.zeros(0, np.int64)

    def lists(self, query: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of the pairs whose term occurs in the batch."""
        at = np.minimum(np.searchsorted(self.terms, term), max(len(self.terms) - 1, 0))
        here = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        return query[here], at[here]

    def add(self, out: np.ndarray, query: np.ndarray, lists: np.ndarray, ones: bool = False) -> None:
        """Adds the counts (or ones) of some lists to out[query, passage]."""
        size = self.end[lists] - self.begin[lists]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(lists):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENTRIES, "right")))
            part, many = lists[lo:hi], size[lo:hi]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begin[part], many)
            place = np.repeat(query[lo:hi], many) * self.n + self.row[at]
            out += np.bincount(place, None if ones else self.count[at], out.size).reshape(out.shape)
            lo = hi


class Block:
    """A block of the pass: queries lo to hi."""

    def __init__(self, data: dict, lo: int, hi: int) -> None:
        self.lo, self.hi, self.ids = lo, hi, data["ids"][lo:hi]
        self.unit = None if data["unit"] is None else data["unit"][lo:hi]
        self.live = np.ones(hi - lo, bool) if data["live"] is None else data["live"][lo:hi]
        a, b = np.searchsorted(data["query"], [lo, hi])
        self.query, self.term, self.wanted = data["query"][a:b] - lo, data["term"][a:b], data["wanted"][lo:hi]

    def similarity(self, unit: np.ndarray) -> np.ndarray:
        """passage x query"""
        if not unit.shape[1]:
            return np.zeros((len(unit), len(self.ids)))
        return np.round(unit @ self.unit.T, SCORE_DIGITS)

    def near(self, unit: np.ndarray, buckets: Buckets) -> np.ndarray:
        """As ``similarity`` for passages that share a bucket with the query, else -inf."""
        out = np.full((len(unit), len(self.ids)), -np.inf)
        if not unit.shape[1]:
            return out
        planes = np.random.default_rng(buckets.seed).standard_normal((unit.shape[1], buckets.tables * buckets.bits))
        weight = 1 << np.arange(buckets.bits)
        code = lambda m: ((m @ planes > 0).reshape(len(m), buckets.tables, buckets.bits) * weight).sum(axis=2)
        ours, asked = code(unit), code(self.unit)
        flips = np.concatenate([[0], weight])
        for t in range(buckets.tables):
            order = np.argsort(ours[:, t], kind="stable")
            probe = (asked[:, t, None] ^ flips[None]).ravel()
            lo, hi = (np.searchsorted(ours[order, t], probe, side) for side in ("left", "right"))
            many = hi - lo
            row = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
            out[row, np.repeat(np.repeat(np.arange(len(self.ids)), len(flips)), many)] = 0
        row, query = np.nonzero(out == 0)
        for at in range(0, len(row), 1 << 16):
            r, q = row[at:at + (1 << 16)], query[at:at + (1 << 16)]
            out[r, q] = np.round(np.einsum("ij,ij->i", unit[r], self.unit[q]), SCORE_DIGITS)
        return out

    def hits(self, postings: Postings, floor: np.ndarray | None = None, need_all: bool = False) -> np.ndarray:
        """passage x query: occurrences of the query's terms; zero where terms are missing and all
        are required. Entries that cannot reach the query's ``floor`` may be lower or zero."""
        out = np.zeros((len(self.ids), postings.n))
        query, lists = postings.lists(self.query, self.term)
        if not len(query) or not postings.n:
            return out.T
        most = postings.most[lists]
        if floor is None:
            postings.add(out, query, lists)
        else:
            order = np.lexsort((most, query))
            query, lists, most = query[order], lists[order], most[order]
            total = np.bincount(query, most, len(self.ids))
            first = np.searchsorted(query, np.arange(len(self.ids)))
            running = np.cumsum(most) - np.append(0, np.cumsum(most))[first][query]
            # these lists alone reach no floor; they are read for passages that others bring near it
            small = running < floor[query]
            alive = total >= floor
            now = ~small & alive[query]
            postings.add(out, query[now], lists[now])
            rest = np.bincount(query, most * small, len(self.ids))
            alive &= (out.max(axis=1) + rest >= floor) & (out.max(axis=1) > 0)
            later = small & alive[query]
            postings.add(out, query[later], lists[later])
            out[~alive] = 0
        if need_all:
            present = np.zeros_like(out)
            postings.add(present, query, lists, ones=True)
            out[present < self.wanted[:, None]] = 0
        return out.T


def blocks(data: dict) -> list[Block]:
    return [Block(data, lo, min(lo + BLOCK, len(data["ids"]))) for lo in range(0, len(data["ids"]), BLOCK)]


def unpacked(masks: Sequence, queries: int) -> np.ndarray:
    """passage x query from bitmaps, the first query in the lowest bit of the first byte."""
    size = -(-queries // 8)
    raw = np.frombuffer(b"".join(bytes(m[:size]).ljust(size, b"\0") for m in masks), np.uint8).reshape(len(masks), size)
    return np.unpackbits(raw, axis=1, count=queries, bitorder="little").view(bool)
