"""Language identification by interpolated Kneser-Ney character models, one per language.

1. Character n-grams of the highest order are counted over all learned documents: within tasks by
   hash, then by a shuffle of (language, n-gram). Lower orders need no counts of their own, as
   Kneser-Ney takes from the n-grams how many different letters come before a shorter one.
2. A model keeps every n-gram. The log-probability of an n-gram is a sum over its suffixes and their
   contexts: what a context leaves to the order below, and what a seen n-gram gains over that. These
   terms are rows, computed by joins, of a number that the corpus sets.
3. They are written to the shared folder as segments by the leading bits of their hashes: sorted arrays
   of hashes, and for each the weights of the languages that have it. The session hands the files to
   every executor, where workers map them, so pages are shared and read as needed: one path at any size.
   A worker holds the sums of the n-grams it met lately, HELD numbers at most.
4. A text's cross-entropy per letter is summed over its n-grams; the lowest wins. A share of the
   learned documents is not counted but calibrates: the scale that turns differences of entropy
   into a probability, and per language the entropy above which a text is marked as rejected.

A text is reduced to lower-case letters, with one space for anything between. Defined results: a
text that is null or without a letter is ``und`` with score 0, and so is everything if nothing was
learned; more than MAX_LANGUAGES languages are an error; ties go to the language that is first in order; a null id counts as the empty text; rows
that are repeated count repeatedly; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionflow.llm.wordhash import mix, slices
from mentionflow.session import checkpointed, scratch_path

ORDER = 4
MAX_LANGUAGES = 500
FOLDS = 5  # fold 0 is held out
SCALES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
REJECT_SHARE = 0.999
UNKNOWN = "und"
PENDING = 400_000  # distinct n-grams held by a task
SEGMENT_ROWS = 1 << 20  # weights in a segment of the model, about
HELD = 1 << 22  # log-probabilities that a worker holds,
RUN = 1 << 21  # and those of n-grams scored at once
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CONTEXT = np.uint64(0xA24BAED4963EE407)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))


def letters(text: Column) -> Column:
    """Lower-case letters, one space for anything else; empty if there is no letter."""
    clean = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}]+", " "))
    return F.when(text.rlike("\\p{L}"), clean).otherwise("")


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, end of each text); each text is led by ORDER - 1 spaces and ends in one."""
    pad = " " * (ORDER - 1)
    codes = np.frombuffer("".join(f"{pad}{t} " for t in texts).encode("utf-32-le"), np.uint32)
    return codes, np.cumsum([len(t) + ORDER for t in texts])


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that starts at each place."""
    n = len(codes) - order + 1
    total = codes[:n].astype(np.uint64) + np.uint64(order)
    for j in range(1, order):
        total *= _STEP
        total += codes[j : n + j]
    return mix(total)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[np.ndarray, np.ndarray, list[str]]] = {}  # of a language: sorted hashes, counts, n-grams

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (_, counts, grams) in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])
        known.clear()

    for batch in batches:
        for part in slices(batch, "letters"):
            langs = np.array(part["lang"].to_pylist(), object)
            texts = part["letters"].to_pylist()
            for lang in dict.fromkeys(langs):
                codes, ends = codes_of([texts[i] for i in np.flatnonzero(langs == lang)])
                found = hashes(codes, ORDER)
                crossing = np.zeros(len(codes), bool)
                for back in range(1, ORDER):
                    crossing[ends - back] = True
                at = np.flatnonzero(~crossing[: len(found)])
                values, counts = np.unique(found[at], return_counts=True)
                have, had, grams = known.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64), []))
                place = np.searchsorted(have, values)
                old = (place < len(have)) & (have[np.minimum(place, len(have) - 1)] == values) if len(have) else np.zeros(len(values), bool)
                had[place[old]] += counts[old]
                fresh = values[~old]
                if len(fresh):
                    spot = np.searchsorted(fresh, found[at])
                    new = fresh[np.minimum(spot, len(fresh) - 1)] == found[at]
                    first = np.zeros(len(fresh), np.int64)
                    first[spot[new]] = at[new]  # any place of the n-gram will do
                    names = [codes[i : i + ORDER].tobytes().decode("utf-32-le") for i in first]
                    order = np.argsort(merged := np.concatenate([have, fresh]), kind="stable")
                    all_names = grams + names
                    known[lang] = merged[order], np.concatenate([had, counts[~old]])[order], [all_names[i] for i in order]
        if sum(len(k[0]) for k in known.values()) > PENDING:
            yield from flush()
    yield from flush()


def _starts(keys: np.ndarray) -> tuple[int, np.ndarray]:
    bits = max(1, int(len(keys)).bit_length())
    return bits, np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))


def lookup(keys: np.ndarray, starts: tuple[int, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted keys, -1 if it is not there; its top bits tell where to start."""
    if not len(keys):
        return np.full(len(wanted), -1)
    bits, table = starts
    at = table[(wanted >> np.uint64(64 - bits)).astype(np.int64)]
    last = len(keys) - 1
    todo = np.arange(len(wanted))
    while len(todo):
        here = np.minimum(at[todo], last)
        on = (keys[here] < wanted[todo]) & (at[todo] < last)
        todo = todo[on]
        at[todo] += 1
    at = np.minimum(at, last)
    return np.where(keys[at] == wanted, at, -1)


def hashes_at(codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    total = codes[at].astype(np.uint64) + np.uint64(order)
    for j in range(1, order):
        total *= _STEP
        total += codes[at + j]
    return mix(total)


def keys_at(codes: np.ndarray, at: np.ndarray, length: int, context: bool) -> np.ndarray:
    """Key of the n-gram, or of the context, of some length that starts at each place."""
    found = hashes_at(codes, at, length) if length else np.zeros(len(at), np.uint64)
    return found ^ _CONTEXT if context else found


# --- the model: terms as rows, then sorted arrays in files ---------------------------------------------


@dataclass
class Model:
    languages: list[str]
    files: tuple[str, ...]  # names of the files, as the session hands them to executors
    bits: int  # leading bits of a key that tell its segment
    scale: float = 8.0
    limits: tuple[float, ...] = ()


def _terms(counts: DataFrame) -> DataFrame:
    """(lang, gram, length, context, weight) of the model, from all counts: lang, gram, n.

    The log-probability of an n-gram in a language is the sum of the weights of its suffixes and of
    their contexts: what a context leaves to the order below, and what a seen n-gram gains over that."""
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.substring("gram", 2, order).alias("gram")
        tables[order] = checkpointed(tables[order + 1].groupBy("lang", shorter).agg(F.count("*").alias("n")))
    floor = -float(np.log(tables[1].select("gram").distinct().count() + 1.0))  # of a letter never seen
    below, parts = None, []
    for order in range(1, ORDER + 1):
        ones = tables[order].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
        discount = F.when((F.col("once") > 0) & (F.col("twice") > 0), F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.75)
        rows = tables[order].join(F.broadcast(ones.select("lang", discount.alias("discount"))), "lang")  # a row per language
        rows = rows.withColumn("context", F.substring("gram", 1, order - 1)).withColumn("suffix", F.substring("gram", 2, order - 1))
        contexts = rows.groupBy("lang", "context", "discount").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        left = F.log(F.col("discount") * F.col("kinds") / F.col("total"))
        contexts = contexts.select("lang", "context", "total", left.alias("left"))
        rows = rows.join(contexts, ["lang", "context"])
        if below is None:
            rows = rows.withColumn("lower", F.lit(floor))
        else:
            rows = rows.join(below.select("lang", F.col("gram").alias("suffix"), F.col("logp").alias("lower")), ["lang", "suffix"])
        own = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        rows = rows.withColumn("logp", F.log(own + F.exp(F.col("left") + F.col("lower"))))
        gain = F.col("logp") - F.col("left") - F.col("lower")
        below = checkpointed(rows.select("lang", "gram", "logp", gain.alias("weight")))
        parts.append(below.select("lang", "gram", F.lit(order).alias("length"), F.lit(False).alias("context"), "weight"))
        weight = F.col("left") + (floor if order == 1 else 0.0)  # every position has the empty context
        parts.append(contexts.select("lang", F.col("context").alias("gram"), F.lit(order - 1).alias("length"), F.lit(True).alias("context"), weight.alias("weight")))
    terms = parts[0]
    for part in parts[1:]:
        terms = terms.union(part)
    return checkpointed(terms)


def _keyed(batches: Iterator[pa.RecordBatch], languages: list[str], bits: int) -> Iterator[pa.RecordBatch]:
    """(segment, key, lang, weight) of terms; a segment holds the keys of some leading bits."""
    index = {x: i for i, x in enumerate(languages)}
    for batch in batches:
        grams = np.array(batch["gram"].to_pylist(), object)
        length, context = np.asarray(batch["length"]), np.asarray(batch["context"])
        keys = np.zeros(len(grams), np.uint64)
        for n, of_context in {(int(n), bool(c)) for n, c in zip(length, context, strict=True)}:
            mine = np.flatnonzero((length == n) & (context == of_context))
            codes = np.frombuffer("".join(grams[mine]).encode("utf-32-le"), np.uint32)
            keys[mine] = keys_at(codes, np.arange(len(mine)) * n, n, of_context)
        langs = pa.array([index[x] for x in batch["lang"].to_pylist()], pa.int32())
        segment = pa.array(_segment(keys, bits).astype(np.int32))
        yield pa.RecordBatch.from_arrays([segment, pa.array(keys.view(np.int64)), langs, batch["weight"]], ["segment", "key", "lang", "weight"])


def _segment(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _packed(table: pa.Table) -> pa.Table:
    """One segment as bytes: three numbers (segment, keys, weights), keys, end of each key's weights,
    weights, languages; padded so that the next segment is aligned after the line feed of a text file."""
    keys, langs = np.asarray(table["key"]).view(np.uint64), np.asarray(table["lang"], np.int32)
    by = np.lexsort((langs, keys))
    unique, sizes = np.unique(keys, return_counts=True)
    head = np.array([table["segment"][0].as_py(), len(unique), len(keys)], np.int64)
    arrays = [head, unique, np.cumsum(sizes).astype(np.int64), np.asarray(table["weight"], np.float64)[by], langs[by]]
    data = b"".join(x.tobytes() for x in arrays)
    return pa.table({"data": pa.array([data + b" " * ((7 - len(data)) % 8)], pa.binary())})


def _written(terms: DataFrame, languages: list[str]) -> Model:
    """The model's sorted arrays in files of the shared folder, which executors fetch and map.

    The files stay, as a task on a new executor fetches them again."""
    spark = terms.sparkSession
    bits = max(0, int(terms.count() - 1) // SEGMENT_ROWS).bit_length()
    keyed = terms.mapInArrow(lambda batches: _keyed(batches, languages, bits), "segment int, key long, lang int, weight double")
    path = scratch_path(spark, "languages")
    packed = keyed.groupBy("segment").applyInArrow(_packed, "data binary")
    packed.select(F.col("data").cast("string").alias("value")).write.option("compression", "none").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    files = sorted(r["path"] for r in files.collect() if r["length"])  # a row per file
    for file in files:
        spark.sparkContext.addFile(file)
    return Model(languages, tuple(file.rsplit("/", 1)[1] for file in files), bits)


# --- scoring -------------------------------------------------------------------------------------------


class Scorer:
    """Log-probabilities from mapped segments; those of n-grams met lately are held as whole rows."""

    def __init__(self, paths: list[str], bits: int, languages: int) -> None:
        self.bits, self.languages = bits, languages
        self.segments: dict[int, tuple[np.ndarray, ...]] = {}
        for path in paths:
            data, at = np.memmap(path, np.uint8, "r"), 0
            while at < len(data):
                segment, n, weights = (int(x) for x in data[at : at + 24].view(np.int64))
                at += 24
                arrays = []
                for kind, size in ((np.uint64, n), (np.int64, n), (np.float64, weights), (np.int32, weights)):
                    end = at + size * np.dtype(kind).itemsize
                    arrays.append(np.asarray(data[at:end].view(kind)))
                    at = end
                at += (7 - at) % 8 + 1
                self.segments[segment] = tuple(arrays)
        self._hold(np.zeros(0, np.uint64), np.zeros((0, languages)))

    def _hold(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.keys, self.rows, self.starts = keys, rows, _starts(keys)

    def _add(self, out: np.ndarray, keys: np.ndarray) -> None:
        segment = _segment(keys, self.bits)
        by = np.argsort(segment, kind="stable")
        cuts = np.flatnonzero(np.diff(segment[by], prepend=-1, append=-1))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            mine = by[low:high]
            found = self.segments.get(int(segment[mine[0]]))
            if found is None:
                continue
            known, ends, weights, langs = found
            place = np.searchsorted(known, keys[mine])
            hit = known[np.minimum(place, len(known) - 1)] == keys[mine]
            row, place = mine[hit], place[hit]
            first = np.where(place > 0, ends[place - 1], 0)
            sizes = ends[place] - first
            each = np.repeat(np.arange(len(row)), sizes)
            spot = np.arange(len(each)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
            out[row[each], langs[spot]] += weights[spot]  # a language has one weight of a key

    def computed(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities of the n-grams that start at these places, a column per language."""
        out = np.zeros((len(at), self.languages))
        for order in range(1, ORDER + 1):
            start = at + (ORDER - order)
            self._add(out, keys_at(codes, start, order - 1, True))
            self._add(out, keys_at(codes, start, order, False))
        return out

    def logs(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same, held for the next time."""
        wanted = hashes_at(codes, at, ORDER)
        place = lookup(self.keys, self.starts, wanted)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            fresh, first = np.unique(wanted[missing], return_index=True)
            keys, rows = self.keys, self.rows
            if (len(keys) + len(fresh)) * self.languages > HELD:  # only what is needed now stays
                used = np.unique(place[place >= 0])
                keys, rows = keys[used], rows[used]
            spots = np.searchsorted(keys, fresh)
            self._hold(np.insert(keys, spots, fresh), np.insert(rows, spots, self.computed(codes, at[missing[first]]), axis=0))
            place = lookup(self.keys, self.starts, wanted)
        return self.rows[place]

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per letter, in nats: a row per text, a column per language."""
        codes, ends = codes_of(texts)
        lengths = np.diff(ends, prepend=0) - (ORDER - 1)
        most = max(1, RUN // self.languages)
        sums, run, size = np.zeros((len(texts), self.languages)), [], 0

        def add() -> None:
            text, start, sizes = (np.array(x) for x in zip(*run, strict=True))
            offsets = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) + np.repeat(start - offsets, sizes)
            np.add.at(sums, text, np.add.reduceat(self.logs(codes, at), offsets, axis=0))

        for i, (end, length) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
            for done in range(0, length, most):  # long texts in pieces, cut from their start
                piece = min(most, length - done)
                if size + piece > most:
                    add()
                    run, size = [], 0
                run.append((i, end - length - (ORDER - 1) + done, piece))
                size += piece
        if run:
            add()
        # rounded, as a limit is the entropy of some text
        return np.round(-sums / lengths[:, None], 9)


@lru_cache(maxsize=1)
def _scorer(files: tuple[str, ...], bits: int, languages: int) -> Scorer:
    return Scorer([SparkFiles.get(f) for f in files], bits, languages)


def _learned(docs: DataFrame) -> Model | None:
    """A model from ``docs``: lang, letters."""
    rows = docs.mapInArrow(_counted, "lang string, gram string, n long")
    counts = checkpointed(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return _written(_terms(counts), languages) if languages else None


def _scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs`` with lang_pred, score, entropy and rejected; ``letters`` is read, ``keep`` is kept."""
    made = ["lang_pred", "score", "entropy", "rejected", "nll"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model.files, model.bits, len(model.languages))
        names, limits = np.array(model.languages, object), np.array(model.limits)
        for batch in batches:
            for part in slices(batch, "letters"):
                texts = part["letters"].to_pylist()
                some = np.array([i for i, t in enumerate(texts) if t], int)
                n = len(texts)
                pred, score, entropy, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
                nll: list = [None] * n
                if len(some):
                    found = scorer.entropies([texts[i] for i in some])
                    best = np.argmin(found, axis=1)
                    above = found - found.min(axis=1, keepdims=True)
                    pred[some], entropy[some] = names[best], found.min(axis=1)
                    score[some] = 1 / np.exp(-model.scale * above).sum(axis=1)
                    if len(limits):
                        rejected[some] = entropy[some] > limits[best]
                    if "lang" in part.schema.names:
                        index = {x: j for j, x in enumerate(model.languages)}
                        true = np.array([index.get(x, -1) for x in part["lang"].to_pylist()])[some]
                        for i, row, j in zip(some, above, true, strict=True):
                            if j >= 0:
                                nll[i] = [float(s * row[j] + np.log(np.exp(-s * row).sum())) for s in SCALES]
                arrays = [part[c] for c in keep] + [
                    pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected),
                    pa.array(nll, pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, keep + made)

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(task, f"{fields}, lang_pred string, score double, entropy double, rejected boolean, nll array<double>")


def _calibrated(docs: DataFrame, model: Model) -> Model:
    """``model`` with its scale and limits, from ``docs``: lang, letters."""
    rows = checkpointed(_scored(docs.filter("letters <> ''"), model, ["lang"]).filter("nll is not null"))
    means = rows.agg(*[F.avg(F.col("nll")[i]).alias(f"s{i}") for i in range(len(SCALES))]).first()
    if means[0] is None:
        return model
    scale = SCALES[int(np.argmin(np.array(means, float)))]
    limits = dict(rows.filter("lang = lang_pred").groupBy("lang").agg(F.percentile_approx("entropy", REJECT_SHARE, 10_000)).collect())
    return replace(model, scale=scale, limits=tuple(float(limits.get(x, np.inf)) for x in model.languages))


def identified(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row per row of ``df``: doc_id, held_out, lang_pred, score, entropy and rejected.

    Learns from rows with a language outside fold 0; a twenty-fifth of the rows calibrates."""
    rows = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{text}`").cast("string").alias("text"), fold(F.col(f"`{doc_id}`")).alias("crc"),
    )
    calibrates = (F.col("crc") % FOLDS == 1) & (F.floor(F.col("crc") / FOLDS) % FOLDS == 0)
    learned = rows.filter((F.col("crc") % FOLDS != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    pick = lambda part: part.select("lang", letters(F.col("text")).alias("letters")).filter("letters <> ''")
    model = _learned(pick(learned.filter(~calibrates)))
    held_out = F.col("crc") % FOLDS == 0
    if model is None:
        return rows.select(
            "doc_id", held_out.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("rejected"),
        )
    model = _calibrated(pick(learned.filter(calibrates)), model)
    # text alone goes to the model
    texts = rows.select("doc_id", held_out.alias("held_out"), F.coalesce(letters(F.col("text")), F.lit("")).alias("letters"))
    return _scored(texts, model, ["doc_id", "held_out"]).drop("nll")
