"""Text scores on the scale 0 (strongly negative) to 4 (strongly positive).

A scorer is a function from a text Column to a DOUBLE Column. The default one looks words
up in a lexicon, all texts of an Arrow batch together; ``model_scorer`` plugs in any Python model.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionflow.functions.text import clean, lower_words, sentences

Scorer = Callable[[Column], Column]

NEUTRAL = 2

# A short general lexicon; a job passes its own for any real use.
DEFAULT_WEIGHTS = {
    "amazing": 2, "awesome": 2, "beautiful": 1, "best": 2, "better": 1, "excellent": 2,
    "fantastic": 2, "good": 1, "great": 2, "happy": 1, "helpful": 1, "love": 2, "loved": 2,
    "nice": 1, "thank": 1, "thanks": 1, "win": 1, "wow": 1,
    "awful": -2, "bad": -1, "broken": -1, "cancelled": -1, "delay": -1, "delayed": -1,
    "hate": -2, "horrible": -2, "late": -1, "lost": -1, "never": -1, "poor": -1,
    "poorly": -1, "rude": -2, "sad": -1, "stuck": -1, "terrible": -2, "worst": -2,
    "wrong": -1,
}


def clamp_class(total_weight: Column) -> Column:
    """Sentence class 0 to 4 from the summed weights of its words."""
    return F.greatest(F.lit(0), F.least(F.lit(4), F.lit(NEUTRAL) + total_weight)).cast("int")


def word_class(words: Column, weights: Mapping[str, int]) -> Column:
    """Class of a sentence from its words; a sentence without known words is neutral.

    Unknown words go first, by one set test each. Words of equal weight form one set, so the
    cost of a word does not grow with the lexicon.
    """
    by_weight: dict[int, list[str]] = {}
    for word, weight in sorted(weights.items()):
        if weight:
            by_weight.setdefault(weight, []).append(word)
    if not by_weight:
        return clamp_class(F.lit(0))

    def weight_of(word: Column) -> Column:
        value = F.lit(0)
        for weight, same in by_weight.items():
            value = F.when(word.isin(same), weight).otherwise(value)
        return value

    known = F.filter(words, lambda w: w.isin([w for same in by_weight.values() for w in same]))
    return clamp_class(F.aggregate(known, F.lit(0), lambda acc, w: acc + weight_of(w)))


def sentence_classes(text: Column, weights: Mapping[str, int]) -> Column:
    """Classes of the sentences of a text, in order."""
    return F.transform(sentences(F.lower(text)), lambda s: word_class(lower_words(s), weights))


def mean_class(text: Column, classes: Column) -> Column:
    """Mean class: 0.0 for an empty text, NULL for a text without sentences.

    One fold keeps sum and count, as naming ``classes`` twice would compute them twice.
    """
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("n"))
    mean = F.aggregate(
        classes,
        start,
        lambda acc, c: F.struct((acc["total"] + c).alias("total"), (acc["n"] + 1).alias("n")),
        lambda acc: F.try_divide(acc["total"].cast("double"), acc["n"].cast("double")),
    )
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(mean)


def most_extreme(classes: Column) -> Column:
    """The class furthest from neutral, the first one on a tie; NULL if there is none."""
    return F.aggregate(
        classes,
        F.lit(None).cast("int"),
        lambda best, c: F.when(
            best.isNull() | (F.abs(F.lit(NEUTRAL) - c) > F.abs(F.lit(NEUTRAL) - best)), c
        ).otherwise(best),
    )


def _bytes(letters: bytes) -> np.ndarray:
    """Which bytes are one of these."""
    return np.isin(np.arange(256), list(letters))


SLICE_BYTES = 8 << 20
_WORD = _bytes(b"abcdefghijklmnopqrstuvwxyz'")
_END = _bytes(b".!?")
_VISIBLE = ~_END & ~_bytes(b" \t\n\x0b\f\r")


class _Lexicon:
    """Scores lower-cased texts, many at a time: their bytes are seen as one array."""

    def __init__(self, weights: Mapping[str, int]) -> None:
        known = {word.encode(): weight for word, weight in weights.items() if weight and re.fullmatch("[a-z']+", word)}
        self.words = pa.array(list(known), pa.large_binary())
        self.weights = np.array(list(known.values()), np.float64)
        longest = max(map(len, known), default=0)
        self.shapes = np.zeros((256, longest + 2), bool)  # first byte and length of known words; longer ones share the last
        for word in known:
            self.shapes[word[0], len(word)] = True

    def means(self, texts: pa.Array) -> pa.Array:
        """The score of each text, NULL for one without sentences."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        means, at = [np.zeros(0)], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            bounds = offsets[at : end + 1]
            size = int(bounds[-1] - bounds[0])
            data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(bounds[0])) if size else np.zeros(0, np.uint8)
            means.append(self._means(data, bounds - bounds[0]))
            at = end
        joined = np.concatenate(means)
        return pa.array(joined, pa.float64(), mask=np.isnan(joined) | texts.is_null().to_numpy(zero_copy_only=False))

    def _means(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        if not len(data):
            return np.full(n, np.nan)
        begun = _END[data]
        begun[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begun)  # of sentences: where a text begins, and at each end
        some = np.logical_or.reduceat(self._visible(data), starts)
        at, weight = self._known(data, bounds)
        sums = np.bincount(np.searchsorted(starts, at, "right") - 1, weight, len(starts))
        classes = np.clip(NEUTRAL + sums, 0, 4)[some]
        of = (np.searchsorted(bounds, starts, "right") - 1)[some]
        with np.errstate(invalid="ignore"):
            return np.bincount(of, classes, n) / np.bincount(of, minlength=n)

    def _visible(self, data: np.ndarray) -> np.ndarray:
        """Which bytes make a sentence more than blank: those that ``clean`` makes a space don't."""
        visible = _VISIBLE[data]
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        for first, second, third, length in ((0xEF, 0xB8, (0x8F, 0x8F), 3), (0xF0, 0x9F, (0x80, 0x9F), 4)):
            at = np.flatnonzero(data == first)
            at = at[(padded[at + 1] == second) & (padded[at + 2] >= third[0]) & (padded[at + 2] <= third[1])]
            for place in range(length):
                visible[at + place] = False
        return visible

    def _known(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, weight) of the known words; a word is a whole run of letters within a text."""
        letter = _WORD[data]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        begins, ends = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        begins[edges] = letter[edges]
        ends[:-1] &= ~letter[1:]
        ends[edges - 1] = letter[edges - 1]
        at = np.flatnonzero(begins)
        lengths = np.flatnonzero(ends) + 1 - at
        maybe = self.shapes[data[at], np.minimum(lengths, self.shapes.shape[1] - 1)]
        at, lengths = at[maybe], lengths[maybe]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        letters = data[np.repeat(at - offsets[:-1], lengths) + np.arange(offsets[-1])]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
        found = pc.index_in(words, self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        return at[found >= 0], self.weights[found[found >= 0]]


def lexicon_scorer(weights: Mapping[str, int] = DEFAULT_WEIGHTS) -> Scorer:
    """The mean of the ``sentence_classes`` of a text."""
    weights = dict(weights)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = _Lexicon(weights)
        for lowered in batches:
            yield lexicon.means(lowered)

    return lambda text: F.when(F.length(text) == 0, F.lit(0.0)).otherwise(score(F.lower(clean(text))))


_MODELS: dict[str, Callable] = {}


def _model_of_worker(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of that name, loaded on first use; Python workers outlive tasks."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def model_scorer(load: Callable[[], Callable[[pd.Series], pd.Series]]) -> Scorer:
    """A scorer around a Python model; ``load`` runs once per Python worker.

    The model gets batches of cleaned texts, none of them empty, and returns a score for each.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            some = batch[batch.str.len() > 0]
            scores = pd.Series(0.0, index=batch.index).mask(batch.isna())
            if len(some):
                scores[some.index] = _model_of_worker(name, load)(some).astype("float64")
            yield scores

    return lambda text: F.when(F.length(text) == 0, F.lit(0.0)).otherwise(score(clean(text)))
