"""Small helpers that run inside Arrow tasks: tokens, hashed vectors, running top-k."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd

from .vectors import HASH_DIM

_TERM = re.compile(r"\w+")


def split_terms(text: str) -> list[str]:
    """Lowercased words, the same tokens as functions.text.terms."""
    return _TERM.findall(text.lower())


class HashedVectors:
    """Token-count vectors of HASH_DIM buckets; token -> bucket is remembered per task."""

    model = "hashing"
    #: tokens remembered, some 10 MB
    remembered = 100_000

    def __init__(self) -> None:
        self._seen: dict[str, int] = {}

    def _bucket(self, token: str) -> int:
        b = self._seen.get(token)
        if b is None:
            b = int(hashlib.md5(token.encode()).hexdigest(), 16) % HASH_DIM
            if len(self._seen) < self.remembered:
                self._seen[token] = b
        return b

    def words(self, text: str) -> list[str]:
        return text.lower().split()

    def sparse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, count) of texts whose words are lower-cased already and parted by one space."""
        at = [[self._bucket(t) for t in text.split(" ")] for text in texts]
        row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        flat = np.fromiter((b for a in at for b in a), np.int64, len(row))
        pair, count = np.unique(row * HASH_DIM + flat, return_counts=True)
        return pair // HASH_DIM, pair % HASH_DIM, count

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), HASH_DIM))
        for row, text in zip(out, texts):
            at = [self._bucket(t) for t in self.words(text)]
            if at:
                row += np.bincount(at, minlength=HASH_DIM)
        return out


class PlainWords(HashedVectors):
    """The same over the words of plain SQL: only ASCII whitespace parts them, and each letter is lower-cased
    by itself."""

    model = "hashing-plain"

    def words(self, text: str) -> list[str]:
        for old, new in ("\t ", "\n ", "\f ", "\r ", "İi", "Σσ"):
            text = text.replace(old, new)
        return [w for w in text.lower().split(" ") if w]


class TopRows:
    """Best ``k`` rows per query over the batches of one task, ties by key columns.

    Holds a few times k rows per query, whatever the size of the partition. Once a query has k
    rows, its worst one is a floor that later batches have to reach."""

    def __init__(self, k: int, keys: list[str], queries: int) -> None:
        self.k, self.keys, self._kept = k, keys, []
        self._floor = np.full(queries, -np.inf)
        self._held, self._limit = 0, max(50_000, 3 * k * queries)

    @property
    def floor(self) -> np.ndarray:
        """Score below which a row cannot be among a query's best any more."""
        return self._floor

    def add(self, keys: pd.DataFrame, scores: np.ndarray, valid: np.ndarray | None = None,
            **extra: np.ndarray) -> None:
        """Offer a batch: ``scores`` and the extra matrices are row x query; only entries that
        are ``valid`` count."""
        if valid is not None:
            scores = np.where(valid, scores, -np.inf)
        edge = self._floor
        if len(scores) > self.k:
            at = len(scores) - self.k
            edge = np.maximum(edge, np.partition(scores, at, axis=0)[at])
        row, query = np.nonzero((scores >= edge) & (scores > -np.inf))
        if not len(row):
            return
        part = keys.iloc[row].reset_index(drop=True)
        part["_query"], part["_score"] = query, scores[row, query]
        for name, matrix in extra.items():
            part[name] = matrix[row, query]
        self._kept.append(part)
        self._held += len(part)
        if self._held > self._limit:
            self._trim()

    def _trim(self) -> None:
        if not self._kept:
            return
        rows = pd.concat(self._kept, ignore_index=True)
        rows = rows.sort_values(["_query", "_score", *self.keys],
                                ascending=[True, False, *[True] * len(self.keys)],
                                kind="mergesort")
        rows = rows[rows.groupby("_query").cumcount() < self.k]
        full = rows.groupby("_query")["_score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]["min"]
        self._floor[full.index.to_numpy()] = full.to_numpy()
        self._kept, self._held = [rows], len(rows)

    def rows(self) -> pd.DataFrame | None:
        self._trim()
        return self._kept[0] if self._kept else None
