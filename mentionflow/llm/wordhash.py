"""Words of whole Arrow texts and hashes of runs of words, computed on the UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so words can be cut from the bytes.
A word's hash is a sum of numbers, one for each byte and its place in the word, all bits of them
mixed: a plain polynomial modulo 2**64 would give words that alternate in a certain way the same hash under
any key. The hash of a run of words is a polynomial over word hashes, mixed at the end; runs are short.
Two keys with separate constants give 128 bits where a run is identified by its hash alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are processed in slices of about so many bytes (one text at least), to bound memory.
SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _constants(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    odd = rng.integers(2**61, 2**63, 2, dtype=np.uint64) | np.uint64(5)
    return table, odd[0], odd[1]


KEYS = (_constants(20_011), _constants(40_031))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the entropy of a polynomial hash, whose low bits are weak, over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of some texts: ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, key: int) -> np.ndarray:
        table, step, _ = KEYS[key]
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        begin = np.zeros(n, np.int64)
        begin[self.start] = self.start
        place = (np.arange(n) - np.maximum.accumulate(begin)).astype(np.uint64)  # of a byte in its word
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(table[self.data] + place * step), out=sums[1:])
        length = (self.end - self.start).astype(np.uint64)
        return mix(sums[self.end] - sums[self.start] + length)

    def runs(self, size: int, key: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index of the start, hash) of each run of ``size`` words within one text."""
        words = self.hashes(key)
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        multiplier = KEYS[key][2]
        total = words[:n].copy()
        for j in range(1, size):
            total *= multiplier
            total += words[j : n + j]
        text = np.repeat(np.arange(len(self.first) - 1), self.counts)
        at = np.flatnonzero(text[:n] == text[size - 1 :])
        return at, mix(total[at])


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Null texts have no words; ``lower`` folds A-Z."""
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if texts.null_count:  # the bytes below a null need not be empty
        lengths = np.where(np.asarray(texts.is_valid()), np.diff(offsets), 0)
        raw = np.concatenate([raw[a : a + n] for a, n in zip(offsets[:-1], lengths, strict=True)])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    if lower:
        raw = _LOWER[raw]
    inside = ~_SEPARATOR[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] |= inside[cuts]  # a text begins
    ends[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(begins)
    return Words(raw, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``size`` bytes of text."""
    if not batch.num_rows:
        return
    texts = batch[column].cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    piece = (offsets[:-1] - offsets[0]) // size
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(piece)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))
