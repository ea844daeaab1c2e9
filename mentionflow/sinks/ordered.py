"""Long lines in a global order, and rows with long texts that are read again, both packed.

Texts are stored and shuffled in blocks of many rows, compressed together, as they are much larger than all
else and a shuffle's own codec sees little of them at a time. The order is that of a key of bytes. A pass
over the lines samples keys and adds up sizes, so that a partition gets a range of keys with about as many bytes
of text as any other; lines of a range are packed, dealt to its partition, unpacked and sorted there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 8 << 20  # of rows that are stored
PACK_BYTES = 48 << 20  # of lines that a task holds before it packs them for all partitions
PART_BYTES = 64 << 20  # of lines in a partition
SAMPLED_KEYS = 100  # of a task

# Ascending, but for the scores: they go down, with NULL last.
KEYS = ("window_start", "section", "level", "polarity", "id", "copy")
_KEY = np.dtype([("start", ">u8"), ("section", "u1"), ("level", "u1"), ("score", ">u8"), ("has_id", "u1"), ("id", ">u8"), ("copy", ">u4")])
_SIGN = np.uint64(1 << 63)
_PACKED = "part int, data binary"


def _squeezed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _expanded(data: bytes, columns: Sequence[int] | None = None) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcReadOptions(included_fields=None if columns is None else list(columns))
    yield from pa.ipc.open_stream(data, options=options)


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` as blocks of bytes, without a shuffle; ``unpacked`` gives them back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * BLOCK_BYTES // max(1, batch.nbytes))
            for a in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_arrays([pa.array([_squeezed(batch.slice(a, step))], pa.binary())], ["data"])

    return rows.mapInArrow(task, "data binary")


def unpacked(blocks: DataFrame, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of blocks, or some columns of them; others are not expanded."""
    names = schema.names if columns is None else [c for c in schema.names if c in columns]
    places = [schema.names.index(c) for c in names]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"]:
                yield from _expanded(data.as_buffer(), places)

    return blocks.select("data").mapInArrow(task, T.StructType([schema[c] for c in names]))


def _signed(values: pa.Array) -> np.ndarray:
    """Longs as unsigned numbers in the same order."""
    return np.asarray(values.fill_null(0)).astype(np.int64).view(np.uint64) ^ _SIGN


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The key of each line as bytes."""
    found = np.zeros(batch.num_rows, _KEY)
    found["start"] = _signed(batch["window_start"].cast(pa.int64()))
    found["section"], found["level"] = np.asarray(batch["section"]), np.asarray(batch["level"])
    bits = (np.asarray(batch["polarity"].fill_null(0.0)).astype(np.float64) + 0.0).view(np.uint64)  # no negative zero
    rising = np.where(bits & _SIGN, ~bits, bits | _SIGN)
    found["score"] = np.where(np.asarray(batch["polarity"].is_valid()), ~rising, ~np.uint64(0))
    found["has_id"] = np.asarray(batch["id"].is_valid())
    found["id"] = np.where(found["has_id"] > 0, _signed(batch["id"]), np.uint64(0))
    found["copy"] = np.asarray(batch["copy"])
    return found.view(f"S{_KEY.itemsize}")


def _binary(keys: np.ndarray) -> pa.Array:
    ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.itemsize
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys))])


def _bounds(lines: DataFrame) -> np.ndarray:
    """Keys at which the partitions begin, but for the first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, size = np.random.default_rng(TaskContext.get().partitionId()), 0
        keys, draws = np.zeros(0, f"S{_KEY.itemsize}"), np.zeros(0)
        for batch in batches:
            size += int(np.asarray(batch["size"].fill_null(0)).sum()) + _KEY.itemsize * batch.num_rows
            keys, draws = np.concatenate([keys, _keys(batch)]), np.concatenate([draws, rng.random(batch.num_rows)])
            least = np.argsort(draws)[:SAMPLED_KEYS]
            keys, draws = keys[least], draws[least]
        if len(keys):
            yield pa.RecordBatch.from_arrays([_binary(keys), pa.array(np.full(len(keys), size / len(keys)))], ["key", "weight"])

    found = lines.select(*KEYS, F.octet_length("value").alias("size")).mapInArrow(task, "key binary, weight double").toArrow()
    keys = np.array(found["key"].to_pylist(), f"S{_KEY.itemsize}")
    order = np.argsort(keys)
    ends = np.cumsum(found["weight"].to_numpy()[order])
    parts = max(1, -(-int(ends[-1] if len(ends) else 0) // PART_BYTES))
    at = np.searchsorted(ends, [ends[-1] * n / parts for n in range(1, parts)])
    return np.unique(keys[order][at]) if parts > 1 else keys[:0]


def in_order(lines: DataFrame) -> DataFrame:
    """The ``value`` of lines with ``KEYS``, in their order over all partitions. Runs a job to see how they lie."""
    bounds = _bounds(lines)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(pending: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(pending).combine_chunks()
            part = np.searchsorted(bounds, np.concatenate([_keys(b) for b in pending]), side="right")
            order = np.argsort(part, kind="stable")
            keys = pa.concat_arrays([_binary(_keys(b)) for b in pending]).take(pa.array(order))
            rows = pa.RecordBatch.from_arrays([keys, table["value"].chunk(0).take(pa.array(order))], ["key", "value"])
            parts, firsts = np.unique(part[order], return_index=True)
            ends = [*firsts[1:].tolist(), len(order)]
            data = [_squeezed(rows.slice(a, b - a)) for a, b in zip(firsts.tolist(), ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

        pending, size = [], 0
        for batch in batches:
            if batch.num_rows:
                pending.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield dealt(pending)
                pending, size = [], 0
        if pending:
            yield dealt(pending)

    blocks = lines.select(*KEYS, "value").mapInArrow(pack, _PACKED).repartitionById(len(bounds) + 1, F.col("part"))
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.StringType())])
    return unpacked(blocks, schema).sortWithinPartitions("key").select("value")
