"""Spelling variants: words within one inserted, deleted or replaced letter, and the form each stands for.

1. Runs of letters are cut from whole texts and counted within tasks, then by a shuffle of counts.
2. Two words within one edit agree before and behind it. So a word is listed under its halves: with
   the edit in [a, b) of the shorter word, both have the same ``a`` first and ``s - b`` last letters.
   A key that too many words share is listed under both halves of its edit range instead, down to
   single letters, where a key has few words by itself. No word meets all others.
3. Keys are hashed into blocks of bounded size. A block holds a bit-sliced position index: a bitset
   over its words per (position, letter). All words of a length run through it letter by letter:
   word-parallel recurrences keep the set of words matched without error and, with shifted
   positions for an extra letter, the sets matched with exactly one. The error is only admitted
   where the first difference lies in [a, b), so a pair is found in one block, and all letters are
   compared, so the hash decides nothing.
4. Per block and word the number of near words and the best one travel on, never the pairs.
5. Forms are followed to their ends by pointer jumping: a form is ten times as common as its word,
   so a path has at most 19 steps.

Defined results: a null or empty text has no words; a null id counts as an empty id; rows that
repeat count again; other columns don't matter; an empty table gives no rows. Of equally common
near words the first in code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionflow.llm.wordhash import slices
from mentionflow.session import checkpointed

MIN_LETTERS = 7
MIN_COUNT = 2
FORM_RATIO = 10
SLIP_EVERY = 31
PENDING_WORDS = 300_000  # distinct words counted by a task before they are handed on
BLOCK_ROWS = 16_384
KEY_WORDS = 8_192  # a key of one free letter has no more: 90 replaced letters, 90 x 90 with one more
MATRIX_WORDS = 1 << 20  # 64-bit words of a recurrence's set matrix

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def folded(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass")


def _runs(least: int) -> re.Pattern:
    return re.compile(f"[a-zÀ-ÿ]{{{least},}}")


def slipped(run: str, prefix: int) -> str:
    """The run, with one letter lost where the checksum of its place says so. ``prefix`` is the crc32 of ``<id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n) of all words of at least ``least_letters`` letters."""

    def batch(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = _runs(least_letters).findall, {}
        for rows in batches:
            for part in slices(rows, "text"):
                for name, body in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    if not body:
                        continue
                    prefix = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for run, k in Counter(find(folded(body))).items():
                        word = slipped(run, prefix)
                        if len(word) >= least_letters:
                            counts[word] = counts.get(word, 0) + k
                if len(counts) > PENDING_WORDS:
                    yield batch(counts)
                    counts = {}
        yield batch(counts)

    rows = docs.select(F.col(f"`{id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- blocks of words that may be near -------------------------------------------------------------


def _listed(ranges: DataFrame) -> DataFrame:
    """Rows (word, n, s, a, b) with the hash of what lies before and behind the edit range [a, b) of
    the shorter word's ``s`` letters."""
    before = F.expr("substring(word, 1, a)")
    behind = F.expr("if(s > b, right(word, s - b), '')")
    return ranges.withColumn("key", F.xxhash64(F.col("s"), F.col("a"), F.col("b"), before, behind))


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of each row's edit range."""
    middle = F.expr("(a + b) div 2").cast("int")
    parts = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    rows = rows.withColumn("part", F.explode(parts))
    return _listed(rows.select("word", "n", "s", F.col("part.a").alias("a"), F.col("part.b").alias("b")))


def blocks(words: DataFrame, key_words: int = KEY_WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (word, n, s, a, b, block): a word as the shorter and as the longer one of a pair."""
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("s"))
    rows = checkpointed(_halves(sized.filter("s > 0").select("word", "n", "s", F.lit(0).alias("a"), F.col("s").alias("b"))))
    total, done = rows.count(), []
    while True:
        crowded = rows.filter("b - a > 1").groupBy("key").count().filter(F.col("count") > key_words).select("key")
        crowded = checkpointed(crowded)
        if not crowded.head(1):
            break
        marked = checkpointed(rows.join(crowded.withColumn("crowded", F.lit(True)), "key", "left"))
        done.append(marked.filter("crowded is null or b - a <= 1").drop("crowded"))
        rows = checkpointed(_halves(marked.filter("crowded and b - a > 1")))
        total += rows.count()
    for part in done:
        rows = rows.unionByName(part)
    n_blocks = max(1, -(-total // block_rows))
    return rows.withColumn("block", F.pmod("key", F.lit(n_blocks)).cast("int")).drop("key")


class PositionIndex:
    """Bitsets over words of one length, one per (position, letter)."""

    def __init__(self, letters: np.ndarray) -> None:
        """``letters``: a row of code points per word."""
        n, self.length = letters.shape
        self.words = n
        self.width = -(-n // 64)
        self.alphabet, codes = np.unique(letters, return_inverse=True)
        codes = codes.reshape(letters.shape)
        size = len(self.alphabet)
        # the last letter of the table stands for letters that no word has
        self.sets = np.zeros((self.length, size + 1, self.width), np.uint64)
        at = np.arange(n)
        bit = np.uint64(1) << (at & 63).astype(np.uint64)
        for position in range(self.length):
            np.bitwise_or.at(self.sets[position], (codes[:, position], at >> 6), bit)
        self.all = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(self.all, at >> 6, bit)

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """Letters as places in the index's alphabet."""
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at, len(self.alphabet))


def _members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) of each bit of a matrix of sets."""
    row, word = np.nonzero(sets)
    bits = np.unpackbits(np.ascontiguousarray(sets[row, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, bit = np.nonzero(bits)
    return row[hit], word[hit] * 64 + bit


def replaced(index: PositionIndex, letters: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) where exactly one letter differs, at a position in [a, b)."""
    codes = index.codes(letters)
    none = np.repeat(index.all[None], len(letters), axis=0)
    one = np.zeros_like(none)
    for i in range(index.length):
        same = index.sets[i][codes[:, i]]
        one &= same
        if a <= i < b:
            one |= none & ~same
        none &= same
    return _members(one)


def extended(index: PositionIndex, letters: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) where the word is the query with one letter more and the first difference,
    seen in the query, lies in [a, b), or behind its last letter if ``b`` is its length."""
    codes, size = index.codes(letters), letters.shape[1]
    none = np.repeat(index.all[None], len(letters), axis=0)
    one = np.zeros_like(none)
    for i in range(size):
        same, shifted = index.sets[i][codes[:, i]], index.sets[i + 1][codes[:, i]]
        if a <= i < b:
            one |= none & ~same
        one &= shifted
        none &= same
    if b == size:
        one |= none
    return _members(one)


def _matrix(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _in_pieces(find, index: PositionIndex, letters: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, MATRIX_WORDS // index.width)
    for at in range(0, len(letters), step):
        query, word = find(index, letters[at : at + step], a, b)
        yield query + at, word


_NEAR = "word string, n_near long, best_n long, best string"


def _near(block: pa.Table) -> pa.Table:
    """(word, near words in this block, the most common of them) for words that have any."""
    words, counts = block["word"].to_pylist(), block["n"].to_pylist()
    groups: dict[tuple[int, int, int], tuple[list[int], list[int]]] = {}
    for row, (word, s, a, b) in enumerate(zip(words, *(block[c].to_pylist() for c in "sab"), strict=True)):
        groups.setdefault((s, a, b), ([], []))[len(word) - s].append(row)
    found: dict[str, tuple[int, int, str]] = {}

    def link(x: int, y: int) -> None:
        mine = (-counts[y], words[y])
        seen = found.get(words[x])
        found[words[x]] = (1, *mine) if seen is None else (seen[0] + 1, *min(mine, seen[1:]))

    for (s, a, b), (short, long) in groups.items():
        if not short or len(short) + len(long) < 2:
            continue
        letters = _matrix([words[r] for r in short], s)
        if len(short) > 1:
            for query, word in _in_pieces(replaced, PositionIndex(letters), letters, a, b):
                for q, w in zip(query.tolist(), word.tolist(), strict=True):
                    link(short[q], short[w])
        if long:
            index = PositionIndex(_matrix([words[r] for r in long], s + 1))
            for query, word in _in_pieces(extended, index, letters, a, b):
                for q, w in zip(query.tolist(), word.tolist(), strict=True):
                    link(short[q], long[w])
                    link(long[w], short[q])
    rows = [(word, k, -n, best) for word, (k, n, best) in found.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _NEAR.split(", ")])


def near_words(words: DataFrame, key_words: int = KEY_WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, n_near, best_n, best) of each word of ``words`` (word, n; distinct) that has near words."""
    found = blocks(words, key_words, block_rows).groupBy("block").applyInArrow(_near, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    rows = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return rows.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): pointers are doubled until none moves."""
    paths = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        paths = checkpointed(paths.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not paths.filter("moved").head(1):
            return paths.select("word", "root")
        paths = paths.select("word", "root")


def grouped(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least_letters: int = MIN_LETTERS,
    least_count: int = MIN_COUNT, ratio: int = FORM_RATIO,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least ``least_letters`` letters that
    occurs at least ``least_count`` times. The form is the most common near word, if it is at least
    ``ratio`` (2 or more) times as common; the root is the end of a word's path of forms."""
    words = checkpointed(word_counts(docs, id, text, least_letters).filter(F.col("n") >= least_count))
    rows = words.join(near_words(words), "word", "left")
    chosen = F.col("best_n") >= ratio * F.col("n")
    rows = checkpointed(rows.select(
        "word", F.when(chosen, F.col("best")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best_n")).alias("form_n"),
    ))
    roots = _followed(rows.filter("form is not null").select("word", "form"))
    rows = rows.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
