"""Which sets may have a partner, at any size of the corpus and without a sketch of all its hashes.

In one order of all hashes, two linked sets share at least min(m, m') of them within their prefixes of
``size - least overlap + m``. Here the order is that of the hashes themselves, and m is a fifth of a set. Tasks list
the prefixes of many documents at once, cut into buckets by a further hash, as gaps between sorted marks
and the places of their documents. A bucket tells which marks are in two documents or more and counts them per
document; a document with fewer than its least partner's m is in no link. A mark is a part of a hash, so
some documents pass by mistake, and none is lost.

A mark that several documents of one list have goes out once, so a very common one costs a row of each list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mentionflow.llm.sketch import PENDING
from mentionflow.llm.wordhash import mix, slices

MARK_BITS = 40
BUCKET_MARKS = 2 << 20
MOST_DOCS = 60_000  # of a list; places are 16 bits
_SHARED = 0xFFFF  # in place of a document: the mark is in several of the list
_SALT = np.uint64(0x94D049BB133111EB)
_DOC = np.dtype([(c, "<i8") for c in ("h1", "h2", "id", "has_id", "n", "k1", "k2", "count")])
_LISTS = "bucket long, list long, data binary"
_LISTS_ARROW = pa.schema([("bucket", pa.int64()), ("list", pa.int64()), ("data", pa.binary())])
_TOLD = "list long, docs binary, counts binary"
_TOLD_ARROW = pa.schema([("list", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])
JUDGED = "h1 long, h2 long, id long, n long, k1 long, k2 long, may boolean"

Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]  # of texts: (offsets, sorted distinct hashes)


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Hashes that a set of n shares with any partner, which is also the size of the least one."""
    return -(-percent * n // 100)


def _matches(n: np.ndarray, percent: int) -> np.ndarray:
    return np.maximum(1, np.minimum(_least(n, percent), n // 5))


def _squeezed(values: np.ndarray) -> bytes:
    return values.nbytes.to_bytes(4, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _expanded(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True), kind)


def _packed(marks: np.ndarray, places: np.ndarray) -> bytes:
    """Sorted marks as gaps, and the place of the document of each."""
    gaps = np.diff(marks, prepend=np.uint64(0))
    low, high = (gaps & np.uint64(0xFFFF)).astype("<u2"), (gaps >> np.uint64(16)).astype("<u4")
    return len(marks).to_bytes(4, "little") + low.tobytes() + places.tobytes() + _squeezed(high)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    low, places = np.frombuffer(data, "<u2", n, 4), np.frombuffer(data, "<u2", n, 4 + 2 * n)
    high = _expanded(data[4 + 4 * n :], "<u4")
    return np.cumsum(low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(16)), dtype=np.uint64), places


def _listed(docs: np.ndarray, tokens: np.ndarray, percent: int, buckets: int, name: int) -> pa.RecordBatch:
    """The lists of the prefixes of ``docs``, and a row with the documents themselves."""
    n = docs["n"]
    length = np.where(n > 0, n - _least(n, percent) + _matches(n, percent), 0)
    within = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(length, n)
    places = np.repeat(np.arange(len(n)), length)
    marks = mix(tokens[within] ^ _SALT) >> np.uint64(64 - MARK_BITS)
    order = np.argsort(marks)
    marks, places = marks[order], places[order]
    begins = np.flatnonzero(np.diff(marks, prepend=marks[:1] + np.uint64(1)))
    runs = np.diff(begins, append=len(marks))
    docs["count"] = np.bincount(places[np.repeat(runs > 1, runs)], minlength=len(n))
    marks, places = marks[begins], np.where(runs > 1, _SHARED, places[begins]).astype("<u2")
    cuts = np.searchsorted(marks, np.array([(b << MARK_BITS) // buckets for b in range(buckets + 1)], np.uint64))
    some = np.flatnonzero(np.diff(cuts))
    data = [_packed(marks[cuts[b] : cuts[b + 1]], places[cuts[b] : cuts[b + 1]]) for b in some]
    rows = [[*some.tolist(), -1 - name], [name] * (len(some) + 1), [*data, docs.tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _LISTS_ARROW.types, strict=True)], schema=_LISTS_ARROW)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each list of a bucket, how many marks of each document are in others as well."""
    names, marks, places = [], [], []
    for batch in batches:
        for bucket, name, data in zip(*(batch[c].to_pylist() for c in _LISTS_ARROW.names), strict=True):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, data, None), _TOLD_ARROW.types, strict=True)], schema=_TOLD_ARROW)
            else:
                own, at = _unpacked(data)
                names.append(name)
                marks.append(own)
                places.append(at)
    if not names:
        return
    sizes = [len(own) for own in marks]
    every, known = np.concatenate(marks), np.concatenate(places)
    marks.clear()
    order = np.argsort(every, kind="stable")
    every = every[order]
    begins = np.flatnonzero(np.diff(every, prepend=every[:1] + np.uint64(1)))
    runs = np.diff(begins, append=len(every))
    several = (runs > 1) | np.maximum.reduceat(known[order] == _SHARED, begins)
    shared = np.zeros(len(every), bool)
    shared[order] = np.repeat(several, runs)
    shared &= known != _SHARED
    rows, end = [], 0
    for name, size, at in zip(names, sizes, places, strict=True):
        found = at[shared[end : end + size]]
        end += size
        if len(found):
            rows.append((name, None, _squeezed(np.bincount(found).astype("<u2"))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TOLD_ARROW.types, strict=True)], schema=_TOLD_ARROW)


def judged(docs: DataFrame, wanted: Callable[[pa.RecordBatch], np.ndarray], sets: Sets, keys: Callable, percent: int, hashes: int) -> DataFrame:
    """A row of ``JUDGED`` per wanted row of ``docs`` (id, text, h1, h2, own): size and keys of its set, and whether it may link.

    ``hashes``: about how many there are; the number of buckets follows it."""
    share = 100 - percent + 20  # of a set in its prefix
    buckets = max(1, -(-hashes * min(100, share) // (100 * BUCKET_MARKS)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held, count, made = [], 0, 0, 0

        def listed() -> pa.RecordBatch:
            found = [np.concatenate(x) for x in zip(*pending, strict=True)]
            return _listed(*found, percent, buckets, TaskContext.get().partitionId() << 32 | made)

        for batch in batches:
            for part in slices(batch.filter(pa.array(wanted(batch))), "text"):
                offsets, tokens = sets(part["text"])
                rows = np.zeros(part.num_rows, _DOC)
                rows["n"] = np.diff(offsets)
                rows["k1"], rows["k2"] = keys(offsets, tokens)
                rows["has_id"] = np.asarray(part["id"].is_valid())
                for c in ("id", "h1", "h2"):
                    rows[c] = np.asarray(part[c].fill_null(0))
                for a in range(0, len(rows), MOST_DOCS):
                    some = rows[a : a + MOST_DOCS]
                    if pending and (held + len(tokens) > PENDING or count + len(some) > MOST_DOCS):
                        yield listed()
                        pending, held, count, made = [], 0, 0, made + 1
                    pending.append((some, tokens[offsets[a] : offsets[min(a + MOST_DOCS, len(rows))]]))
                    held, count = held + len(pending[-1][1]), count + len(some)
        if pending:
            yield listed()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _told(batches)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts = None, np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data, found in zip(batch["docs"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                if found is None:
                    rows = np.frombuffer(data, _DOC)
                else:
                    more = _expanded(found, "<u2")
                    counts[: len(more)] += more
        n = rows["n"]
        may = (n > 0) & (rows["count"] + counts[: len(n)] >= _matches(_least(n, percent), percent))
        ids = pa.array(np.ascontiguousarray(rows["id"]), mask=rows["has_id"] == 0)
        columns = [ids if c == "id" else pa.array(np.ascontiguousarray(rows[c])) for c in ("h1", "h2", "id", "n", "k1", "k2")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(may)], ["h1", "h2", "id", "n", "k1", "k2", "may"])

    lists = docs.mapInArrow(task, _LISTS).groupBy("bucket").applyInArrow(told, _TOLD)
    return lists.groupBy("list").applyInArrow(judge, JUDGED)
