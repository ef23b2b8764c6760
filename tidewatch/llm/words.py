"""Words of whole Arrow string columns as numpy arrays: places and 64-bit hashes.

A word is a run of kept bytes of the UTF-8 text after lowering A-Z; it never crosses a
text's end. The hash is a polynomial over per-byte random values modulo 2**64, taken from
prefix sums, so that no Python object is made per word. Texts are worked on in pieces of
a quarter of a megabyte that end between words, whatever their length.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes that belong to a word: all but ASCII white space ...
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ... or small letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= PIECE + 1:
            _powers[name] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[places[0]:places[-1]], places - places[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about `limit` bytes of text, one row at least."""
    data, places = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(places, places[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), data[places[at]:places[end]], places[at:end + 1] - places[at]
        at = end


def cut(data: np.ndarray, places: np.ndarray, breaks: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cut a single long text behind bytes of `breaks` into parts of about `limit` bytes; several texts stay as they are."""
    if len(places) != 2 or len(data) <= limit:
        yield data, places
        return
    at = 0
    while at < len(data):
        to = min(at + limit, len(data))
        while to < len(data):
            gap = np.flatnonzero(breaks[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
                break
            to = min(to + limit, len(data))
        yield data[at:to], np.array([0, to - at])
        at = to


@dataclass
class Words:
    hash: np.ndarray
    start: np.ndarray
    length: np.ndarray
    ending: np.ndarray  # last three bytes as a number
    bounds: np.ndarray  # of each text's words, n + 1

    @property
    def text(self) -> np.ndarray:
        """Number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(data: np.ndarray, places: np.ndarray, kept: np.ndarray, lower: bool = True) -> Words:
    parts: list[tuple[np.ndarray, ...]] = []
    at, end = 0, len(data)
    while at < end:
        to = min(at + PIECE, end)
        if to < end:
            gap = np.flatnonzero(~kept[LOWER[data[at:to]] if lower else data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:  # a word longer than a piece: up to where its text ends
                to = int(places[np.searchsorted(places, to)])
        x = LOWER[data[at:to]] if lower else data[at:to]
        inside = kept[x]
        first = places[np.searchsorted(places, at):np.searchsorted(places, to)] - at
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[first] = False
        after[first[first > 0] - 1] = False
        s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_VALUES[x] * _power("up", _BASE, len(x)), out=total[1:])
        n = e - s
        h = (total[e] - total[s]) * _power("down", pow(_BASE, -1, 2**64), len(x))[s]
        tail = x[e - 1].astype(np.int64)
        tail += np.where(n > 1, x[np.maximum(e - 2, 0)].astype(np.int64) << 8, 0)
        tail += np.where(n > 2, x[np.maximum(e - 3, 0)].astype(np.int64) << 16, 0)
        parts.append((mixed(h + n.astype(np.uint64) * _MIX), s + at, n, tail))
        at = to
    if parts:
        h, s, n, tail = (np.concatenate(x) for x in zip(*parts))
    else:
        h, s, n, tail = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return Words(h, s, n, tail, np.searchsorted(s, places) if len(s) else np.zeros(len(places), np.int64))


def grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether all k stand in its text."""
    h, n = found.hash, len(found.hash)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(min(k, n)):
        out[:n - j] += h[j:] * np.uint64(factor)
        factor = factor * 0xC2B2AE3D27D4EB4F % 2**64
    left = np.repeat(found.bounds[1:], np.diff(found.bounds)) - np.arange(n)
    return mixed(out), left >= k


class Tally:
    """Counts of 64-bit codes, merged now and then so that memory stays bounded by the distinct ones of a task."""

    def __init__(self, limit: int = 1 << 20):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, limit

    def add(self, codes: np.ndarray) -> None:
        codes, n = np.unique(codes, return_counts=True)
        self.parts.append((codes, n.astype(np.int64)))
        self.size += len(codes)
        if self.size > self.limit:
            self.merge()
            self.limit = max(self.limit, 2 * self.size)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            codes = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
            n = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], n[order]
            at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
            self.parts = [(codes[at], np.add.reduceat(n, at) if len(at) else n)]
        self.size = len(self.parts[0][0])
        return self.parts[0]


def word_counts(data: np.ndarray, places: np.ndarray, kept: np.ndarray, lower: bool = True) -> np.ndarray:
    """Words of each text, without hashing them."""
    inside = kept[LOWER[data] if lower else data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = places[:-1][places[:-1] < len(data)]
    begins[first] = inside[first]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=total[1:])
    return np.diff(total[places])


def word_hashes(data: np.ndarray, places: np.ndarray, kept: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and bounds of `words` alone, at eight bytes a word even for a very long text."""
    if len(places) != 2:
        found = words(data, places, kept, lower)
        return found.hash, found.bounds
    hashes = np.concatenate([words(d, p, kept, lower).hash for d, p in cut(data, places, ~kept)])
    return hashes, np.array([0, len(hashes)])
