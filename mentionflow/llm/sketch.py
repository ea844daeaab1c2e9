"""A count-min sketch of hashes whose counters saturate at two: once, and twice or more.

Tasks list the counters they hit, cut into segments of bits; segments are merged by a shuffle, so
no task or group holds a whole sketch while it is built. The merged sketch answers "may this hash
occur twice?": never no for one that does. Its size follows the number of hashes up to ``most``
bits; beyond that it only rejects less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionflow.llm.wordhash import mix

ROWS = 2
SEGMENT_BITS = 1 << 22
BITS_PER_HASH = 4
MOST_BITS = 1 << 29
PENDING = 2 << 20  # counters listed by a task before they are handed on
_ROW_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Shape:
    """Segments per row of the sketch."""

    segments: int

    @staticmethod
    def of(hashes: int, most: int = MOST_BITS) -> Shape:
        bits = min(most, BITS_PER_HASH * max(1, hashes))
        return Shape(max(1, -(-bits // (ROWS * SEGMENT_BITS))))

    def counters(self, hashes: np.ndarray, row: int) -> np.ndarray:
        spread = mix(hashes ^ _ROW_SALTS[row]) >> np.uint64(32)
        return ((spread * np.uint64(self.segments * SEGMENT_BITS)) >> np.uint64(32)).astype(np.uint32)


def _packed(places: np.ndarray) -> bytes:
    """Sorted places of a segment as gaps: low bytes, then the rest, which is mostly zero."""
    gaps = np.diff(places, prepend=0)
    low, high = (gaps & 255).astype(np.uint8), (gaps >> 8).astype(np.uint16)
    return len(places).to_bytes(4, "little") + low.tobytes() + pa.compress(high.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    low = np.frombuffer(packed, np.uint8, n, 4)
    high = np.frombuffer(pa.decompress(packed[4 + n :], 2 * n, codec="zstd", asbytes=True), np.uint16)
    return np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 8))


def _plane(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, SEGMENT_BITS // 8, codec="zstd", asbytes=True), np.uint8)


_ROWS_SCHEMA = "segment int, once binary, twice binary"
_ROWS_ARROW = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _listed(pending: list[np.ndarray], shape: Shape) -> Iterator[pa.RecordBatch]:
    hashes = np.concatenate(pending) if pending else np.zeros(0, np.uint64)
    for row in range(ROWS):
        places, counts = np.unique(shape.counters(hashes, row), return_counts=True)
        within = (places % np.uint32(SEGMENT_BITS)).astype(np.int64)
        cuts = np.searchsorted(places, np.arange(shape.segments + 1, dtype=np.int64) * SEGMENT_BITS)
        for s in range(shape.segments):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                twice = within[a:b][counts[a:b] > 1]
                values = [[row * shape.segments + s], [_packed(within[a:b])], [_packed(twice)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _ROWS_ARROW.types, strict=True)], schema=_ROWS_ARROW)


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    counters, segment = np.zeros(SEGMENT_BITS, np.uint8), None
    for batch in batches:
        for s, once, twice in zip(*(batch[c].to_pylist() for c in ("segment", "once", "twice")), strict=True):
            segment, places = s, _unpacked(once)
            counters[places] = np.minimum(counters[places] + 1, 2)
            counters[_unpacked(twice)] = 2
    if segment is not None:
        packed = pa.compress(np.packbits(counters >= least).tobytes(), codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], ["segment", "twice"])


def repeated_bits(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], shape: Shape, least: int = 2) -> np.ndarray:
    """The bits of counters that reached two, or ``least``, over all hashes that ``hashes_of`` gives for ``df``.

    The result, at most MOST_BITS bits, is gathered on the driver to be broadcast."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, n = [], 0
        for batch in batches:
            for hashes in hashes_of(batch):
                pending.append(hashes)
                n += len(hashes)
                if n >= PENDING:
                    yield from _listed(pending, shape)
                    pending, n = [], 0
        yield from _listed(pending, shape)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merged(batches, least)

    rows = df.mapInArrow(task, _ROWS_SCHEMA)
    merged = rows.groupBy("segment").applyInArrow(merge, "segment int, twice binary")
    bits = np.zeros(ROWS * shape.segments * SEGMENT_BITS // 8, np.uint8)
    size = SEGMENT_BITS // 8
    for row in merged.toLocalIterator():
        bits[row["segment"] * size : (row["segment"] + 1) * size] = _plane(bytes(row["twice"]))
    return bits


def may_repeat(bits: np.ndarray, shape: Shape, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether it may occur twice or more."""
    result = np.ones(len(hashes), bool)
    for row in range(ROWS):
        at = shape.counters(hashes, row).astype(np.uint64) + np.uint64(row * shape.segments * SEGMENT_BITS)
        result &= (bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    return result


def text_bytes(df: DataFrame, text: str) -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0)


COUNTERS = 1 << 21  # of each row of hashed counts
COUNT_SEGMENT = 1 << 16


def _count_places(hashes: np.ndarray, row: int) -> np.ndarray:
    return (mix(hashes ^ _ROW_SALTS[row]) >> np.uint64(64 - 21)).astype(np.int64)


def hashed_counts(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """A count-min sketch of fixed size, ROWS x COUNTERS, over all hashes; gathered on the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, COUNTERS), np.int64)
        for batch in batches:
            for hashes in hashes_of(batch):
                for row in range(ROWS):
                    places, counts = np.unique(_count_places(hashes, row), return_counts=True)
                    total[row, places] += counts
        parts = total.reshape(-1, COUNT_SEGMENT)
        for segment in np.flatnonzero(parts.any(axis=1)):
            packed = pa.compress(parts[segment].tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], ["segment", "counts"])

    def unpack(packed: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(packed, COUNT_SEGMENT * 8, codec="zstd", asbytes=True), np.int64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, segment = np.zeros(COUNT_SEGMENT, np.int64), None
        for batch in batches:
            for segment, packed in zip(batch["segment"].to_pylist(), batch["counts"].to_pylist(), strict=True):  # noqa: B007
                total += unpack(packed)
        if segment is not None:
            packed = pa.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], ["segment", "counts"])

    rows = df.mapInArrow(task, "segment int, counts binary")
    result = np.zeros(ROWS * COUNTERS, np.int32)
    for row in rows.groupBy("segment").applyInArrow(merge, "segment int, counts binary").toLocalIterator():
        part = pa.decompress(bytes(row["counts"]), COUNT_SEGMENT * 4, codec="zstd", asbytes=True)
        result[row["segment"] * COUNT_SEGMENT : (row["segment"] + 1) * COUNT_SEGMENT] = np.frombuffer(part, np.int32)
    return result.reshape(ROWS, COUNTERS)


def estimated(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Counts of hashes, never too low."""
    return np.minimum(*(counts[row][_count_places(hashes, row)] for row in range(ROWS))).astype(np.int64)
