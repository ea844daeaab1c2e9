"""Substring dedup: runs of words that start earlier elsewhere are cut out.

A window is ``window`` consecutive words of one document. A word goes if a window covers it whose
words also start earlier: in a smaller doc_id, or earlier in the same document.

1. A count-min sketch over all windows, merged from the tasks' parts, says which windows may be
   repeated. It overestimates counts, so it loses none.
2. Only windows estimated as repeated are grouped exactly, by 96 bits of hash, in segments of hashes of bounded size. Within a task the
   earliest of equal windows stands for them; the others are cut at once, as an earlier start is
   known. So a passage found in a third of all documents sends one row per task.
3. Cut starts are gathered per document, and texts are rewritten.

Defined results: null and empty texts have no words and keep an empty text; null ids count as one
id below all others; rows that repeat an id are one document seen again, so equal windows at equal
starts of one id don't cut each other; other columns pass through, and an input column that has the
name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionflow.llm import sketch
from mentionflow.llm.wordhash import mix, slices, words_of

WINDOW = 20
PENDING = 3 << 18  # candidate windows held by a task before they are reduced
BELOW_ALL = -(1 << 63)

SEGMENT_WINDOWS = 1 << 20  # of all windows; few of them are candidates

# A row is a block of candidate windows of one segment of hashes, or the cut starts of a document.
_FOUND = "segment int, windows binary, d long, tag int, starts array<int>"
_FOUND_ARROW = pa.schema([
    ("segment", pa.int32()), ("windows", pa.binary()), ("d", pa.int64()), ("tag", pa.int32()), ("starts", pa.list_(pa.int32())),
])
_CUT = "d long, tag int, start int, starts array<int>"
_CUT_ARROW = pa.schema([("d", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("starts", pa.list_(pa.int32()))])
# Of a window: 64 bits of hash, 32 more, and where it is.
_COLUMNS = (np.uint64, np.uint32, np.int64, np.int32, np.int32)

Windows = tuple[np.ndarray, ...]  # h1, h2, d, tag, start


def _packed(windows: Windows) -> bytes:
    """Windows sorted by hash, in few bytes: differences of hashes, and equal bytes side by side."""
    h1, *rest = windows
    planes = [np.diff(h1, prepend=np.uint64(0)), *rest]
    raw = b"".join(np.ascontiguousarray(x.astype(t).view(np.uint8).reshape(len(h1), -1).T).tobytes() for x, t in zip(planes, _COLUMNS, strict=True))
    return len(h1).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> Windows:
    n, widths = int.from_bytes(packed[:4], "little"), [np.dtype(t).itemsize for t in _COLUMNS]
    raw = np.frombuffer(pa.decompress(packed[4:], n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, width in zip(_COLUMNS, widths, strict=True):
        planes = raw[at : at + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return np.cumsum(out[0], dtype=np.uint64), *out[1:]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _sorted(windows: list[Windows]) -> tuple[Windows, np.ndarray, np.ndarray, np.ndarray]:
    """(windows in order, whether a hash begins, whether a row isn't repeated, whether it is earliest)"""
    h1, h2, d, tag, start = (np.concatenate(x) for x in zip(*windows, strict=True))
    order = np.lexsort((tag, start, d, h2, h1))
    h1, h2, d, tag, start = (x[order] for x in (h1, h2, d, tag, start))
    new_window, new_row = _heads(h1, h2), _heads(h1, h2, d, tag, start)
    lead = np.flatnonzero(new_window)[np.cumsum(new_window) - 1]
    return (h1, h2, d, tag, start), new_window, new_row, (d == d[lead]) & (start == start[lead])


def _reduced(pending: list[Windows], segments: int) -> Iterator[pa.RecordBatch]:
    """The earliest start of each window; then, per document, the starts that are cut."""
    if not pending:
        return
    windows, _, new_row, earliest = _sorted(pending)
    first = tuple(x[earliest & new_row] for x in windows)
    segment = ((first[0] >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    heads = np.append(np.flatnonzero(_heads(segment)), len(segment))
    blocks = [_packed(tuple(x[a:b] for x in first)) for a, b in zip(heads[:-1], heads[1:], strict=True)]
    none = [pa.nulls(len(blocks), t) for t in _FOUND_ARROW.types[2:]]
    yield pa.RecordBatch.from_arrays([pa.array(segment[heads[:-1]].astype(np.int32)), pa.array(blocks, pa.binary()), *none], schema=_FOUND_ARROW)

    cut = np.flatnonzero(~earliest & new_row)
    if not len(cut):
        return
    _, _, d, tag, start = windows
    cut = cut[np.lexsort((start[cut], tag[cut], d[cut]))]
    d, tag, start = d[cut], tag[cut], start[cut]
    heads = np.flatnonzero(_heads(d, tag))
    starts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(d)).astype(np.int32)), pa.array(start))
    spread = (mix(d[heads].view(np.uint64)) % np.uint64(segments)).astype(np.int32)  # any segment will do
    arrays = [pa.array(spread), pa.nulls(len(heads), pa.binary()), pa.array(d[heads]), pa.array(tag[heads]), starts]
    yield pa.RecordBatch.from_arrays(arrays, schema=_FOUND_ARROW)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one segment: the starts of windows that start earlier elsewhere, and cut starts as they are."""
    windows = []
    for batch in batches:
        cut = batch.filter(batch["windows"].is_null())
        yield pa.RecordBatch.from_arrays([cut["d"], cut["tag"], pa.nulls(len(cut), pa.int32()), cut["starts"]], schema=_CUT_ARROW)
        windows += [_unpacked(x) for x in batch["windows"].drop_null().to_pylist()]
    if windows:
        (_, _, d, tag, start), _, new_row, earliest = _sorted(windows)
        cut = new_row & ~earliest
        arrays = [pa.array(x[cut]) for x in (d, tag, start)] + [pa.nulls(int(cut.sum()), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, schema=_CUT_ARROW)


def _cut_starts(df: DataFrame, window: int) -> DataFrame:
    """(d, tag, start or starts) of windows that are cut; ``df``: d, tag, text."""
    spark = df.sparkSession
    total = sketch.text_bytes(df, "text") // 6
    shape, segments = sketch.Shape.of(total), max(1, -(-total // SEGMENT_WINDOWS))

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(batch, "text"):
            yield words_of(part["text"]).runs(window, 0)[1]

    bits = spark.sparkContext.broadcast(sketch.repeated_bits(df.select("text"), hashes_of, shape))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part["text"])
                at, h1 = words.runs(window, 0)
                some = sketch.may_repeat(bits.value, shape, h1)
                if not some.any():
                    continue
                h2 = (words.runs(window, 1)[1][some] >> np.uint64(32)).astype(np.uint32)
                at, h1 = at[some], h1[some]
                row = np.searchsorted(words.first, at, side="right") - 1
                d, tag = (np.asarray(part[c])[row] for c in ("d", "tag"))
                pending.append((h1, h2, d, tag, (at - words.first[row]).astype(np.int32)))
                n += len(at)
                if n >= PENDING:
                    yield from _reduced(pending, segments)
                    pending, n = [], 0
        yield from _reduced(pending, segments)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _later(batches)

    return df.mapInArrow(task, _FOUND).groupBy("segment").applyInArrow(later, _CUT)


def _tagged(keyed: DataFrame) -> DataFrame:
    """``keyed`` with 31 bits of the text's hash as ``tag``, which tells apart the texts of an id
    that is repeated with several; 0 if there is no such id."""
    several = keyed.groupBy("d").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a < b").limit(1).count()
    tag = F.col("t").bitwiseAND(F.lit((1 << 31) - 1)) if several else F.lit(0)
    return keyed.withColumn("tag", tag.cast("int")).drop("t")


def deduplicated(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, into: str = "dedup", keep: list[str] | None = None
) -> DataFrame:
    """``df`` (or its columns ``keep``) with a struct column: n_words, n_removed and the kept text,
    its words joined by one space."""
    names = [c for c in (df.columns if keep is None else keep) if c != into]
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row") if set(names) - {text} else F.lit(None).alias("row"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(BELOW_ALL)).alias("d"),
        F.xxhash64(F.col(f"`{text}`")).alias("t"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    keyed = _tagged(keyed)
    # dealt out as single rows, before they are gathered: partial lists would be larger
    cut = _cut_starts(keyed.select("d", "tag", "text"), window).repartition("d", "tag")
    gathered = cut.groupBy("d", "tag").agg(
        F.array_distinct(F.concat(F.collect_list("start"), F.flatten(F.collect_list("starts")))).alias("starts")
    )
    joined = keyed.join(gathered, ["d", "tag"], "left").select("row", "text", "starts")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, removed, kept = [], [], []
                for raw, starts in zip(part["text"].cast(pa.binary()).to_pylist(), part["starts"].to_pylist(), strict=True):
                    words = (raw or b"").split()  # bytes split at exactly the separators of words
                    counts.append(len(words))
                    if starts:
                        gone = np.zeros(len(words) + 1, np.int32)
                        np.add.at(gone, starts, 1)
                        np.add.at(gone, np.minimum(np.array(starts) + window, len(words)), -1)
                        stay = np.cumsum(gone[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                result = pa.StructArray.from_arrays(
                    [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["n_words", "n_removed", "kept"],
                )
                columns = ([part["row"]] if with_row else []) + ([part["text"]] if text in names else []) + [result]
                yield pa.RecordBatch.from_arrays(columns, schema_names)

    with_row = bool(set(names) - {text})
    schema_names = (["row"] if with_row else []) + (["text"] if text in names else []) + ["result"]
    outcome = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    types = {"row": joined.schema["row"].dataType, "text": T.StringType(), "result": outcome}
    schema = T.StructType([T.StructField(n, types[n]) for n in schema_names])
    rows = joined.mapInArrow(task, schema)
    back = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return rows.select(*back, F.col("result").alias(into))
