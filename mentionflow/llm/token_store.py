"""Token ids of a corpus as binary files: compressed blocks in the order of the documents.

1. Documents are range-partitioned by id and sorted; a partition becomes a file, a shard. Texts are
   cut into pieces, most of them one word (``pieces``), and each distinct piece of a slice is encoded once by the
   tokenizers library; pieces seen before come from a bounded table.
2. The ids of a shard, an end id behind each document, are cut into blocks of fixed length that are
   coded on their own (``range_coder``). A block names its shard and number and the documents it
   holds ids of, so that it can be read alone, and carries checksums of its bytes and of its ids.
3. Spark's text writer makes the files, with a record separator that no block contains: a block is
   masked by the first byte under which it doesn't. So files can be split, in any file system, and lost
   tasks leave nothing behind.
4. Reading gives a row per block and document. CRC-32 is linear, so a document's is the exclusive or
   of its pieces' checksums, each moved by the number of bytes behind it: pieces are never gathered.

Defined results: null and empty texts are the end id alone; null document ids come first; equal ids are
documents of their own, ordered by a hash of their texts; other columns don't matter; an empty
table gives no blocks and no rows. A damaged or repeated block is an error, and one that is missing before
others of its shard.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mentionflow.llm import range_coder
from mentionflow.llm.pieces import ID_BYTES, SLICE_BYTES, Cuts, PieceTable, packed_array, parts_of
from mentionflow.llm.wordhash import slices
from mentionflow.session import checkpointed

SEPARATOR = "\x1e#TidEnd"  # all letters differ, so it can't begin within itself
MAGIC = b"TIDS"
CACHED_PIECES = 300_000
CACHED_SIZE = 16 << 20  # likewise: bytes of pieces and ids, as a text that can't be cut is one piece
JOINED_PIECES = 256  # pieces of a text for the library
END_ID = 2
# magic, crc of what follows, shard, block, ids, alphabet, documents, place of the first id in its document, crc of ids
_HEAD = struct.Struct("<4sIIQIIIQI")


class PieceEncoder:
    """Encodes texts of one worker with the tokenizers library."""

    def __init__(self, spec: str) -> None:
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        cut = json.loads(spec)
        words = cut["pre_tokenizer"] or {}
        # byte-level words never go on behind a blank that follows them, so a text may be cut there
        self.cuttable = (
            cut["normalizer"] is None and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in cut["added_tokens"])
        )
        self.table = PieceTable(self._pieces, Cuts(t["content"] for t in cut["added_tokens"]) if self.cuttable else None)
        self.lengths = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)  # bytes of each id; its letters stand for bytes
        for token, n in self.tokenizer.get_vocab().items():
            if n < len(self.lengths):
                self.lengths[n] = len(token)
        for n, token in self.tokenizer.get_added_tokens_decoder().items():
            if n < len(self.lengths):
                self.lengths[n] = len(token.content.encode())

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's)"""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum()), sizes

    def _pieces(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Packed ids of distinct pieces. A call of the library costs more than a word, so pieces that could be
        cut apart again are joined, and the lengths of the tokens tell whose they are."""
        if self.table.cuts is None or not len(pieces):
            return packed_array(*self._library(pieces.to_pylist()))
        order = self.table.cuts.joinable_first(pieces)
        data, ends = parts_of(pieces.take(pa.array(order)))
        starts = ends[:-1][~self.table.cuts.joints(data, ends)]
        starts = np.unique(np.concatenate([starts, ends[:-1:JOINED_PIECES], ends[-1:]])).astype(np.int64)
        joined = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
        ids, _ = self._library(joined.to_pylist())
        behind = np.cumsum(self.lengths.take(ids, mode="clip"))
        last = np.searchsorted(behind, ends[1:])
        if not len(ids) or behind[-1] != ends[-1] or not np.array_equal(behind[last], ends[1:]):  # not all bytes have ids
            return packed_array(*self._library(pieces.to_pylist()))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return packed_array(ids, np.diff(last + 1, prepend=0)).take(pa.array(back))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's)"""
        ids, offsets = parts_of(self.table.encode(texts, CACHED_PIECES, CACHED_SIZE))
        return ids.view("<u4"), np.diff(offsets) // ID_BYTES


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(spec: str) -> PieceEncoder:
    """One encoder per Python worker, as workers outlive tasks."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = PieceEncoder(spec)
    return _ENCODERS[spec]


# --- blocks ------------------------------------------------------------------------------------------


def _masked(block: bytes) -> bytes:
    separator = SEPARATOR.encode()
    for mask in range(256):
        record = bytes([mask]) + (np.frombuffer(block, np.uint8) ^ mask).tobytes()
        if separator not in record:
            return record
    raise ValueError("no mask hides the separator")


def _unmasked(record: bytes) -> bytes:
    return (np.frombuffer(record, np.uint8, offset=1) ^ record[0]).tobytes()


def _block(shard: int, number: int, ids: np.ndarray, alphabet: int, docs: list[tuple[int | None, int]], skipped: int, code: bytes) -> bytes:
    """``docs``: (id, number of ids) of the documents; ``skipped`` ids of the first lie in earlier blocks."""
    names = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes()
    sizes = np.array([n if d is not None else -n for d, n in docs], "<i8").tobytes()  # negative without id
    head = (shard, number, len(ids), alphabet, len(docs), skipped, zlib.crc32(ids.astype("<u4").tobytes()))
    rest = _HEAD.pack(MAGIC, 0, *head)[8:] + names + sizes + code
    return _masked(MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest)


class _Block:
    def __init__(self, record: bytes) -> None:
        raw = _unmasked(record)
        if len(raw) < _HEAD.size or raw[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        _, crc, self.shard, self.number, self.n, self.alphabet, docs, self.skipped, self.crc = _HEAD.unpack_from(raw)
        if zlib.crc32(raw[8:]) != crc:
            raise ValueError(f"block {self.number} of shard {self.shard} is damaged")
        at = _HEAD.size
        self.names = np.frombuffer(raw, "<i8", docs, at).tolist()
        self.sizes = np.frombuffer(raw, "<i8", docs, at + 8 * docs).tolist()
        self.code = raw[at + 16 * docs :]


def _blocks(shard: int, parts: Iterator[tuple[list, np.ndarray, np.ndarray]], alphabet: int, block_ids: int, lanes: int) -> Iterator[bytes]:
    """Records of a shard; ``parts`` are (document ids, ids, numbers of ids)."""
    docs: list[tuple[int | None, int]] = []  # those that aren't through
    skipped, number = 0, 0
    pending: list[np.ndarray] = []
    held = 0

    def frame(ids: np.ndarray) -> Iterator[bytes]:
        nonlocal docs, skipped, number
        blocks = [ids[at : at + block_ids] for at in range(0, len(ids), block_ids)]
        at = 0
        for block, code in zip(blocks, range_coder.coded(blocks, alphabet), strict=True):
            room, inside, before = len(block), [], skipped
            while room:
                left = docs[at][1] - skipped
                inside.append(docs[at])
                if left > room:
                    skipped, room = skipped + room, 0
                else:
                    skipped, room, at = 0, room - left, at + 1
            yield _block(shard, number, block, alphabet, inside, before, code)
            number += 1
        docs = docs[at:]

    for names, ids, sizes in parts:
        docs += zip(names, sizes.tolist(), strict=True)
        pending.append(ids)
        held += len(ids)
        while held >= block_ids * lanes:
            joined = np.concatenate(pending)
            yield from frame(joined[: block_ids * lanes])
            pending, held = [joined[block_ids * lanes :]], held - block_ids * lanes
    if held:
        yield from frame(np.concatenate(pending))


def write(
    docs: DataFrame, path: str, tokenizer_path: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    block_ids: int = range_coder.BLOCK_IDS, lanes: int = range_coder.LANES,
) -> None:
    """Writes the token ids of ``text``, each document's followed by ``end_id``, in ascending order of ``id``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    size = max(Tokenizer.from_str(spec).get_vocab_size(), end_id + 1)
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary, of fixed size

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, sizes = encoder.encode(part["text"])
                yield part["id"].to_pylist(), np.insert(ids, np.cumsum(sizes), end_id).astype(np.uint32), sizes + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held = [], 0
        for record in _blocks(TaskContext.get().partitionId(), parts(batches), size, block_ids, lanes):
            records.append(record)
            held += len(record)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])
                records, held = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["id", "tie", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    records = placed.mapInArrow(task, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


# --- reading -----------------------------------------------------------------------------------------


def _product(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; bit 31 is the constant term."""
    total = 0
    for place in range(31, -1, -1):
        if a >> place & 1:
            total ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return total


@lru_cache(maxsize=4096)
def _moves(n: int) -> int:
    """The polynomial that moves a checksum by ``n`` zero bytes."""
    total, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            total = _product(total, square)
        square, n = _product(square, square), n >> 1
    return total


def moved_crc(crc: int, n: int) -> int:
    """What a checksum contributes to that of its bytes followed by ``n`` others."""
    return _product(_moves(n), crc) if n else crc


_READ = (
    "shard int, block long, at long, doc_id long, n_tokens long, skipped long, n long, crc long, ids binary"
)
_READ_ARROW = pa.schema([
    ("shard", pa.int32()), *[(c, pa.int64()) for c in ("block", "at", "doc_id", "n_tokens", "skipped", "n", "crc")], ("ids", pa.binary()),
])


def _rows(blocks: list[_Block], with_ids: bool) -> pa.RecordBatch:
    rows = []
    by_alphabet: dict[int, list[_Block]] = {}
    for block in blocks:
        by_alphabet.setdefault(block.alphabet, []).append(block)
    for alphabet, alike in by_alphabet.items():
        for block, ids in zip(alike, range_coder.decoded([b.code for b in alike], [b.n for b in alike], alphabet), strict=True):
            raw = ids.astype("<u4").tobytes()
            if zlib.crc32(raw) != block.crc:
                raise ValueError(f"block {block.number} of shard {block.shard} doesn't give its ids")
            at, skipped = 0, block.skipped
            for name, size in zip(block.names, block.sizes, strict=True):
                n = min(abs(size) - skipped, block.n - at)
                piece = raw[4 * at : 4 * (at + n)]
                crc = moved_crc(zlib.crc32(piece), 4 * (abs(size) - skipped - n))
                rows.append((
                    block.shard, block.number, at, name if size > 0 else None, abs(size), skipped, n, crc, piece if with_ids else None
                ))
                at, skipped = at + n, 0
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ_ARROW, strict=True)], schema=_READ_ARROW)


def read(spark: SparkSession, path: str, ids: bool = True, lanes: int = range_coder.LANES) -> DataFrame:
    """A row per block and document in it: place in the block, the document's number of ids and of those
    in earlier blocks, the ids here (packed, four bytes each) and what they contribute to its CRC-32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Block] = []
        for record in chain.from_iterable(batch["record"] for batch in batches):
            held.append(_Block(record.as_py()))
            if len(held) >= lanes:
                yield _rows(held, ids)
                held = []
        if held:
            yield _rows(held, ids)

    records = spark.read.option("lineSep", SEPARATOR).text(path)
    found = records.select(F.col("value").cast("binary").alias("record")).mapInArrow(task, _READ)
    return found if ids else found.drop("ids")


def documents(found: DataFrame, block_ids: int = range_coder.BLOCK_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of what ``read`` gives: ``start`` counts the ids
    of all documents before it."""
    begin = F.col("block") * block_ids + F.col("at") - F.col("skipped")
    docs = found.groupBy("shard", begin.alias("begin")).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sum("n").alias("n"), F.bit_xor("crc").alias("ids_crc32")
    )
    docs = checkpointed(docs)
    sizes = docs.groupBy("shard").agg(F.sum("n").alias("size"), F.max(F.col("begin") + F.col("n_tokens")).alias("ends"))
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    sizes = sizes.withColumn("base", F.coalesce(before, F.lit(0)))
    whole = (F.col("n") == F.col("n_tokens")) & (F.col("size") == F.col("ends"))
    missing = F.raise_error(F.lit("a block of token ids is missing or repeated"))
    return docs.join(sizes, "shard").select(
        "doc_id", F.when(whole, F.col("base") + F.col("begin")).otherwise(missing.cast("long")).alias("start"), "n_tokens", "ids_crc32"
    )
