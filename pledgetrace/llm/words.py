"""Words of many texts at once as 64-bit hashes, with numpy over their UTF-8 bytes.

A word is a run of bytes that are not separators; A-Z are lower-cased. Its hash depends on its
bytes alone, so the bytes may be cut at any separator, and memory stays bounded for any text."""

from __future__ import annotations

import numpy as np

SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
#: also ASCII punctuation and control characters: letters, digits and all non-ASCII are words
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())
SLICE = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(_M1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(_M2)
    return h ^ (h >> np.uint64(31))


def byte_kinds(separators: bytes) -> np.ndarray:
    """0 for separators, else 1 + the lower-cased byte (as uint16)."""
    kind = np.arange(1, 257, dtype=np.uint16)
    kind[65:91] += 32
    kind[list(separators)] = 0
    return kind


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _cuts(data: np.ndarray, sep: np.ndarray) -> list[int]:
    """Slice ends of about SLICE bytes, each just behind a separator (or the end)."""
    cuts, at, n = [], 0, len(data)
    while n - at > SLICE:
        end = at + SLICE
        while end < n:
            found = np.flatnonzero(sep[data[max(at, end - 4096):end]])
            if len(found):
                end = max(at, end - 4096) + int(found[-1]) + 1
                break
            end += 4096
        at = min(end, n)
        cuts.append(at)
    if at < n:
        cuts.append(n)
    return cuts


def words(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES, prefixes: tuple[int, ...] = ()):
    """(first, starts, ends, hashes[, prefix hashes…]) of all words.

    Words first[i]..first[i + 1] belong to text i; starts and ends are byte positions in
    ``data``. For each k of ``prefixes`` a list of hashes of the first k bytes follows (of the
    whole word where it is shorter, so that it equals the hash of the word)."""
    kind = byte_kinds(separators)
    sep = kind == 0
    firsts = np.unique(offsets[:-1])
    out: list[list[np.ndarray]] = [[] for _ in range(3 + len(prefixes))]
    at = 0
    for end in _cuts(data, sep):
        part = kind[data[at:end]]
        inside = part > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        own = firsts[np.searchsorted(firsts, at):np.searchsorted(firsts, end)] - at
        begins[own] = inside[own]
        start = np.flatnonzero(begins)
        if len(start):
            rank = np.cumsum(inside)
            first = rank[start] - 1
            size = np.diff(np.append(first, rank[-1]))
            place = np.arange(rank[-1]) - np.repeat(first, size)
            term = part[inside].astype(np.uint64) * powers(int(size.max()))[place]
            out[0].append(start + at)
            out[1].append(start + size + at)
            out[2].append(mixed(np.add.reduceat(term, first)))
            for i, k in enumerate(prefixes):
                out[3 + i].append(mixed(np.add.reduceat(np.where(place < k, term, np.uint64(0)), first)))
        at = end
    starts = np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64)
    ends = np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64)
    hashes = [np.concatenate(o) if o else np.zeros(0, np.uint64) for o in out[2:]]
    return np.searchsorted(starts, offsets), starts, ends, *hashes


def runs(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which runs of n words begin, and the n + 1 bounds of each text's runs."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], count) + np.repeat(first[:-1], count), bounds


def shingles(first: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, in order, and each text's bounds among them."""
    at, bounds = runs(first, n)
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    whole = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        whole = whole * np.uint64(_P) + hashes[k:len(hashes) - n + 1 + k]
    return mixed(whole[at]), bounds


class Lookup:
    """64-bit keys to their places 0..n - 1; -1 for others. Two array reads for most misses."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.asarray(keys, np.uint64)
        self.order = np.argsort(self.keys, kind="stable")
        self.sorted = self.keys[self.order]
        bits = max(12, int(len(self.keys)).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``h`` that are keys, the places of those keys)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        same = self.sorted[near] == h[at]
        return at[same], self.order[near[same]]
