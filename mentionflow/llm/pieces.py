"""Pieces of texts that byte-level tokenizers encode alike alone and in their text, and a table of their ids.

Words of such tokenizers are runs of letters, of digits or of other characters, each with a blank before it, or
runs of white space, whose last character stands alone where something else follows. So a text may be cut before
white space that something else follows, and between ASCII characters of two such kinds, but for an
apostrophe and a letter behind it, and inside special tokens. A piece of ASCII characters is then one word.
Texts repeat their pieces, so each distinct one is encoded once and its ids are kept in a bounded
table; all of it stays in Arrow arrays, and texts get their ids by a take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are cut in slices of about so many bytes: larger ones repeat more of their pieces.
SLICE_BYTES = 2 << 20
ID_BYTES = 4

# Kinds of ASCII characters; control characters and what is not ASCII are none of them
_LETTER, _DIGIT, _OTHER, _SPACE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_APOSTROPHE = 0x27
# Bytes that begin a character which is no white space, whatever follows them
_BEGINS = np.zeros(256, bool)
_BEGINS[0x21:0x7F] = _BEGINS[0xC3:0xE0] = _BEGINS[0xE4:0xF5] = True


class Cuts:
    """Where texts may be cut, given the special tokens, which hold no white space."""

    def __init__(self, marks: Iterable[str] = ()) -> None:
        marks = [mark.encode() for mark in marks if mark]
        kind, firsts = _KIND, [mark[0] for mark in marks]
        pairs = (kind[:, None] != kind[None]) & (kind[:, None] > 0) & (kind[None] > 0)  # [a, b]: cut between
        pairs[0x20] = False
        pairs[_APOSTROPHE, kind == _LETTER] = False
        pairs[np.ix_(kind == _SPACE, firsts)] = False  # white space before a special token ends its text
        self.odd = (kind == 0) | (np.arange(256) == _APOSTROPHE)  # a piece with such a byte may be several words
        self.odd[firsts] = True
        for a, b in ((a, b) for mark in marks for a, b in zip(mark[:-1], mark[1:], strict=True)):
            if pairs[a, b]:
                pairs[a, b] = False
                self.odd[a if kind[a] > kind[b] else b] = True
        begins = _BEGINS.copy()
        begins[firsts] = False
        # by two bytes as a little-endian number: cut between them, before the first
        self.between = np.ascontiguousarray(pairs.T).reshape(-1)
        self.before = np.ascontiguousarray((begins[:, None] & (kind == _SPACE)[None])).reshape(-1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where the texts are cut, their own ends included."""
        at = np.zeros(len(data) + 1, bool)
        for odd in (0, 1):
            twos = data[odd : odd + (len(data) - odd & ~1)].view("<u2")
            at[odd : odd + 2 * len(twos) : 2] |= self.before[twos]
        at[offsets[1:] - 1] = False  # what follows is another text
        for odd in (0, 1):
            twos = data[odd : odd + (len(data) - odd & ~1)].view("<u2")
            at[odd + 1 : odd + 1 + 2 * len(twos) : 2] |= self.between[twos]
        at[offsets] = True
        return np.flatnonzero(at)

    def joinable_first(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """An order of pieces in which those come first that may follow any other."""
        data, offsets = parts_of(pieces)
        return np.argsort(~self._begin(data, offsets), kind="stable")

    def joints(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which pieces, if they follow the one before in one text, would be cut from it, and it be as it was alone:
        of white space that ends a text the last character doesn't stand alone."""
        found = self._begin(data, offsets)
        last = data[offsets[1:-1] - 1]
        found[1:] |= self.between[last | data[offsets[1:-1]].astype(np.uint16) << 8] & (_KIND[last] != _SPACE)
        found[0] = False
        return found

    def _begin(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        second = np.minimum(offsets[:-1] + 1, len(data) - 1)
        return self.before[data[offsets[:-1]] | data[second].astype(np.uint16) << 8] & (np.diff(offsets) > 1)


def parts_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, place where each begins and the last one ends)"""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def packed_array(ids: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Rows of ``sizes`` ids each, packed as little-endian unsigned 32-bit integers."""
    ends = np.concatenate([[0], ID_BYTES * np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


class PieceTable:
    """Encodes texts of one worker. ``encode`` gives the packed ids of distinct pieces; without ``cuts``
    whole texts are pieces. Pieces and ids are kept until there are too many, then only those of the last slice."""

    def __init__(self, encode: Callable[[pa.LargeStringArray], pa.LargeBinaryArray], cuts: Cuts | None) -> None:
        self.encode_new, self.cuts = encode, cuts
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def held(self) -> int:
        """Bytes of the pieces kept and of their ids."""
        return sum(int(offsets[-1]) for _, offsets in (parts_of(self.pieces), parts_of(self.ids)))

    def encode(self, texts: pa.Array, most_pieces: int, most_bytes: int) -> pa.LargeBinaryArray:
        """Packed ids of each text; a null text has none."""
        data, offsets = parts_of(texts.fill_null("").cast(pa.large_string()))
        places = np.unique(offsets) if self.cuts is None else self.cuts(data, offsets)
        count, known = len(places) - 1, len(self.pieces)
        cut = pa.LargeStringArray.from_buffers(count, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data))
        both = pa.concat_arrays([self.pieces, cut]).dictionary_encode()
        self.pieces = both.dictionary
        if len(self.pieces) > known:
            self.ids = pa.concat_arrays([self.ids, self.encode_new(self.pieces.slice(known))])
        used = both.indices.slice(known)
        ids, ends = parts_of(self.ids.take(used))
        first = np.searchsorted(places, offsets)
        if len(self.pieces) > most_pieces or self.held() > most_bytes:
            kept = pc.unique(used)
            self.pieces, self.ids = self.pieces.take(kept), self.ids.take(kept)
            if len(kept) > most_pieces or self.held() > most_bytes:
                self._forget()
        starts = np.ascontiguousarray(ends[first], np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(starts), pa.py_buffer(ids)])
