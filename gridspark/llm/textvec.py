"""Scans of whole Arrow batches on their UTF-8 bytes: word bounds, rolling hashes and counts without a Python step per word.

Every break character of the word rules here is ASCII, so bytes of multi-byte characters are plain word bytes and the
scan never has to decode. Batches are cut at row bounds into slices of a few MB; one longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_P), -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)
SLICE_BYTES = 2 << 20


def byte_class(*bounds: tuple[int, int]) -> np.ndarray:
    """True for bytes inside any of the closed ranges."""
    out = np.zeros(256, bool)
    for a, b in bounds:
        out[a:b + 1] = True
    return out


SPACE_WORDS = ~byte_class((0x20, 0x20), (0x09, 0x0D))                     # [^\x20\x09-\x0D]+
ALNUM_WORDS = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))       # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_P, _INV)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Texts:
    """The texts of one slice; a null is an empty text."""

    data: np.ndarray        # bytes of all texts, one after the other
    offsets: np.ndarray     # where each text starts, and the end

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, where, raw = column.buffers()
        offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The row that holds each byte position."""
        return np.searchsorted(self.offsets[1:], at, side="right")

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
        up, down = _pow(len(self.data))
        data = _LOWER[self.data] if lower else self.data
        total = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:len(data)])])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * _STEP)

    def words(self, members: np.ndarray, lower: bool = False) -> Words:
        data = _LOWER[self.data] if lower else self.data
        inside = members[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        firsts = self.offsets[:-1][self.sizes > 0]
        before[firsts] = False
        after[firsts[firsts > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        return Words(self, start, end, self.owner(start), lower)


@dataclass
class Words:
    texts: Texts
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    lower: bool

    @cached_property
    def hash(self) -> np.ndarray:
        return self.texts.hashes(self.start, self.end, self.lower)

    @cached_property
    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.texts)).astype(np.int64)

    @cached_property
    def first(self) -> np.ndarray:
        """Index of each row's first word."""
        return np.cumsum(self.per_row) - self.per_row

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starting words and hashes of every run of k words inside one row."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1:])
        out = np.zeros(len(at), U)
        for i in range(k):
            out = (out ^ self.hash[at + i]) * _P + U(i + 1)
        return at, mix(out)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each starts and ends there: a run of words is one byte range."""
        length = self.end - self.start
        end = np.cumsum(length + 1) - 1
        out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
        word = np.ones(len(out), bool)
        word[end] = False
        edge = np.zeros(len(self.texts.data) + 1, np.int8)
        edge[self.start] += 1
        edge[self.end] -= 1
        raw = self.texts.data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
        out[word] = _LOWER[raw] if self.lower else raw
        return out.tobytes(), end - length, end

    def text(self, i: int) -> bytes:
        raw = self.texts.data[self.start[i]:self.end[i]]
        return (_LOWER[raw] if self.lower else raw).tobytes()


def gram_hash(words: list[bytes]) -> int:
    """What Words.grams gives a run of exactly these words."""
    found = Texts.of(pa.array([b" ".join(words).decode()])).words(SPACE_WORDS)
    return int(found.grams(len(words))[1][0])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
