import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mentionflow.llm import bpe, token_store
from mentionflow.llm.pieces import Cuts, PieceTable, packed_array, parts_of
from mentionflow.llm.queries import tokenizer_path


def cut(texts, marks=()):
    data, offsets = parts_of(pa.array(texts, pa.large_string()))
    places = Cuts(marks)(data, offsets)
    return [data[a:b].tobytes().decode() for a, b in zip(places[:-1], places[1:], strict=True)]


def test_texts_are_cut_into_words():
    assert cut(["The cat, 12x; it's  here.\n\n\tNext  "]) == ["The", " cat", ",", " 12", "x", ";", " it", "'s", " ", " here", ".", "\n\n", "\t", "Next", "  "]
    assert cut(["a  ", "b", "", "\n\n", "c"]) == ["a", "  ", "b", "\n\n", "c"]  # another text isn't what follows
    assert cut(["a　\n b\x1c1é.2"]) == ["a　\n", " b\x1c1é.", "2"]
    assert cut(["x\n\n<|end|>y"], ["<|end|>"]) == ["x", "\n\n<|end|>", "y"]


@pytest.mark.parametrize("marks", [["<|endoftext|>"], ["[INST]", "x1bx", "abxx1"], ["..xb", "1.é'<"], ["a b"], []])
def test_special_tokens_of_any_kind(marks, tmp_path):
    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    spec["added_tokens"] = [{"id": 50_256 + n, "content": mark, **flags} for n, mark in enumerate(marks)]
    path = tmp_path / "spec.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    library = Tokenizer.from_file(str(path))
    rng = random.Random(14)
    letters = [" ", "\n", "\n\n", "\t", "a", "b", "x", "1", ".", "'s", "'", "é", "　", "<", "|", *marks, *marks]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(8000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, sizes = token_store.PieceEncoder(path.read_text(encoding="utf-8")).encode(pa.array(texts))
    assert sizes.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]
    encoder = bpe.Encoder(bpe.Vocabulary(str(path)))
    assert [np.frombuffer(p, "<u4").tolist() for p in encoder.encode(texts)] == expected


def test_the_table_is_bounded_in_number_and_size():
    seen = []

    def lengths(pieces):
        seen.extend(pieces.to_pylist())
        _, offsets = parts_of(pieces)
        return packed_array((offsets[1:] - offsets[:-1]).astype("u4"), (offsets[1:] > offsets[:-1]).astype(int))

    table = PieceTable(lengths, Cuts())
    for i in range(50):
        got = table.encode(pa.array([f"{'a' * (i + 1)} b", None, "b", ""]), 10, 200).to_pylist()
        assert [len(g) // 4 for g in got] == [2, 0, 1, 0] and got[0][:4] == (i + 1).to_bytes(4, "little")
        assert len(table.pieces) <= 10 and table.held() <= 200 and len(table.pieces) == len(table.ids)
    assert seen.count(" b") < 20 and seen.count("b") < 20  # kept while they are used
    table.encode(pa.array(["c" * 1000]), 10, 200)
    assert not len(table.pieces)
