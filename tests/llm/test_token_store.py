import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mentionflow.llm import range_coder, token_store
from mentionflow.llm.queries import QUERIES, tokenizer_path
from mentionflow.llm.tables import table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def brute(library, rows, end_id=2):
    """(doc_id, start, n_tokens, crc) in ascending order of ids, null first."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_blocks_of_any_ids_come_back():
    rng = np.random.default_rng(5)
    blocks = [
        np.zeros(0, np.uint32), np.array([7], np.uint32), np.zeros(700, np.uint32), rng.integers(0, 50_000, 999).astype(np.uint32),
        np.tile(np.arange(30, dtype=np.uint32), 40), rng.integers(0, 3, 2500).astype(np.uint32), np.array([49_999] * 3, np.uint32),
    ]
    for alphabet in (50_000, 1 << 24):
        codes = range_coder.coded(blocks, alphabet)
        back = range_coder.decoded(codes, [len(b) for b in blocks], alphabet)
        assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
        assert range_coder.coded(blocks[::-1], alphabet) == codes[::-1]  # blocks don't depend on each other
    assert len(codes[2]) < 60 and len(codes[4]) < 4 * len(blocks[4]) / 8  # what repeats is learnt
    assert range_coder.coded([], 9) == [] and range_coder.decoded([], [], 9) == []
    with pytest.raises(ValueError, match="alphabet"):
        range_coder.coded([np.array([9], np.uint32)], 9)


def test_unlikely_ids_after_a_sure_prediction():
    block = np.array(([5] * 2000 + [40_000 + 7]) * 2 + [1, 5, 5], np.uint32)
    codes = range_coder.coded([block] * 3, 50_257)
    assert all(np.array_equal(b, block) for b in range_coder.decoded(codes, [len(block)] * 3, 50_257))


def test_pieces_give_the_ids_of_whole_texts(library):
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = token_store.PieceEncoder(f.read())
    assert encoder.cuttable
    rng = random.Random(8)
    letters = [" ", "  ", "\n", "\t", " ", "　", " ", "a", "b", "é", "'s", "1", ".", "<|endoftext|>", "中", "\x1c", "\x7f", "\x85", "ß "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(20_000)]
    texts += [f"a{chr(c)}1 {chr(c)} b {chr(c)}" for c in range(0, 0x110000, 11) if not 0xD800 <= c <= 0xDFFF]
    texts += [None, "", "x" * 20_000]
    ids, sizes = encoder.encode(pa.array(texts))
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_small_caches_give_the_same(library, monkeypatch):
    monkeypatch.setattr(token_store, "CACHED_PIECES", 3)
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = token_store.PieceEncoder(f.read())
    for i in range(20):
        text = f"some words {i} and others {i % 3}"
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_moved_checksums():
    for a, b in ((b"abc", b"d" * 1000), (b"", b"x"), (b"xyz" * 99, b"")):
        assert token_store.moved_crc(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("block_ids, lanes", [(2048, 2048), (7, 5)])
def test_odd_rows(spark, library, tmp_path, block_ids, lanes):
    rows = [(3, "the house"), (1, None), (2, ""), (None, "no id"), (-5, "long text " * 3000), (3, "the house"), (3, "a mouse"), (None, None)]
    df = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, shard int, record string")
    path = str(tmp_path / "out")
    token_store.write(df.repartition(3), path, tokenizer_path(), block_ids=block_ids, lanes=lanes)
    found = token_store.read(spark, path, lanes=lanes)
    got = sorted(map(tuple, token_store.documents(found, block_ids).collect()), key=lambda r: r[1])
    expected = brute(library, rows)
    assert [r[0] for r in got] == [r[0] for r in expected]  # ascending, null first
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] or 0, r[2], r[3]) for r in expected)
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    pieces = sorted(found.filter("doc_id = -5").collect(), key=lambda r: r.skipped)
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
    assert ids == [*library.encode("long text " * 3000, add_special_tokens=False).ids, 2]


def test_many_files_in_order(spark, library, tmp_path):
    rows = [(i * 37 % 1000 - 300, f"text number {i} " * (i % 40)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write(df, str(tmp_path / "out"), tokenizer_path(), block_ids=64, lanes=32)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    got = token_store.documents(token_store.read(spark, str(tmp_path / "out"), ids=False), 64)
    assert sorted(map(tuple, got.collect())) == sorted(brute(library, rows))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_store.write(df, str(tmp_path / "out"), tokenizer_path())
    assert token_store.documents(token_store.read(spark, str(tmp_path / "out"))).count() == 0


def test_masks_hide_the_separator_and_damage_is_seen():
    separator = token_store.SEPARATOR.encode()
    code = separator * 3 + bytes(range(256))
    record = token_store._block(4, 9, np.arange(5, dtype=np.uint32), 50_257, [(None, 3), (8, 9)], 1, code)
    assert separator not in record
    block = token_store._Block(record)
    assert (block.shard, block.number, block.n, block.skipped, block.names, block.sizes, block.code) == (4, 9, 5, 1, [0, 8], [-3, 9], code)
    broken = bytearray(record)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_store._Block(bytes(broken))
    with pytest.raises(ValueError, match="not a block"):
        token_store._Block(b"\0short")


def test_query_equals_the_library(spark, library, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op11_token_store"](spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(library, rows))


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_together(library):
    """A call of the library costs more than a word; before, each of 3,000 was a text of its own."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        encoder = token_store.PieceEncoder(f.read())
    encoder.tokenizer = Counting(encoder.tokenizer)
    rng = random.Random(15)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(3, 9))) for _ in range(30)) for _ in range(100)]
    ids, sizes = encoder.encode(pa.array(texts))
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
    assert encoder.tokenizer.texts < 150


def test_bytes_without_ids_are_left_out_by_the_library():
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "normalizer": None, "post_processor": None, "decoder": None, "added_tokens": [],
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False,
                  "byte_fallback": False, "vocab": {"a": 0, "b": 1, "Ġ": 2, "ab": 3, "Ġa": 4}, "merges": [["a", "b"], ["Ġ", "a"]]},
    }
    library, encoder = Tokenizer.from_str(json.dumps(spec)), token_store.PieceEncoder(json.dumps(spec))
    for texts in (["ab ab a", "b ba"], ["abc cab", "c", "cc c", "a cb"], ["c"], [""]):
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, sizes = encoder.encode(pa.array(texts))
        assert encoder.cuttable and sizes.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
