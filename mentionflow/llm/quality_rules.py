"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are ``[^\\x20\\x09-\\x0D]+``. Everything is computed inside a row with array functions, so
there is no shuffle, no user function, and a document of any length is one pass over its words
(the search for repeated windows sorts only documents that have one).

A feature is null, and no rule on it fails, where it says nothing about the text: stop words are known
for languages in Latin script, so a text whose word characters are for the most part letters of other
scripts has no ``stop_word_ratio``; one in a script written without blanks has no ``mean_word_length``.

Defined results: a null or empty text has no words and fails ``n_words``; null ids, repeated rows
and other columns pass through; an input column that has the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8

# Frequent function words of the languages the corpus is expected in.
STOP_WORDS = (
    "the of and to in is was for that with on as are this it by be at or an from "
    "le la les de des du un une et est que qui dans pour par sur au en ne pas "
    "der die das und ist von mit den dem ein eine zu auf für im nicht "
    "el los las del y se por con para una su no es lo "
    "il di che non della i gli o os da do em um uma het een van op te"
).split()

SEPARATORS = "\\x20\\x09-\\x0D"
TRIMMED = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WIDE_SYMBOLS = "[#*$%&|<>!{}\\[\\]=~^_@\\\\]"
MARKS = ".,;:!?()\"'«»“”"
OTHER_SCRIPTS = "[\\p{L}\\p{M}&&[^\\p{IsLatin}]]"
WITHOUT_BLANKS = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"


@dataclass(frozen=True)
class Rule:
    """A document passes if its feature lies between ``least`` and ``most``, both included, or is null."""

    feature: str
    least: float | None = None
    most: float | None = None


# The base rules are counts against counts, compared in whole numbers.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

RULES = (
    Rule("mean_word_length", 2.0, 15.0),
    Rule("symbol_ratio", most=0.15),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
    Rule("words_per_line", least=2.0),
)


def words_of(text: Column) -> Column:
    """The words of ``text``; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(TRIMMED))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SEPARATORS}]+"))


def _repeated_positions(words: Column, runs: Column) -> Column:
    """Sorted starts of windows found twice or more; ``runs``: (hash, start) of all windows, sorted.

    Equal windows have equal hashes and so are neighbours; words are compared before one counts."""

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, WINDOW) == F.slice(words, b["i"] + 1, WINDOW))

    def repeated(run: Column, at: Column) -> Column:
        before = (at > 0) & same(run, F.get(runs, at - 1))
        return F.coalesce(before, F.lit(False)) | F.coalesce(same(run, F.get(runs, at + 1)), F.lit(False))

    return F.sort_array(F.transform(F.filter(runs, repeated), lambda run: run["i"]))


def _covered(starts: Column) -> Column:
    """How many words the windows at these sorted starts cover."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda seen, at: F.struct(at.alias("last"), (seen["n"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("n")),
        lambda seen: seen["n"],
    )


def compiled(rules: Sequence[Rule]) -> Column:
    """Names of the features that break a rule, over the columns of ``_ratios``."""
    failed = []
    for rule in rules:
        value, breaks = F.col(f"__r.{rule.feature}"), F.lit(False)
        if rule.least is not None:
            breaks = breaks | (value < rule.least)
        if rule.most is not None:
            breaks = breaks | (value > rule.most)
        failed.append(F.when(breaks, F.lit(rule.feature)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def quality_scored(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, into: str = "quality") -> DataFrame:
    """``df`` with a struct column: the counts, ``base_failed``, ``failed`` (features) and ``kept``."""
    names = [c for c in df.columns if c != into]
    given = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(given, content.alias("__text"), words_of(F.col(f"`{text}`")).alias("__words"))

    words, body = F.col("__words"), F.col("__text")
    n_words = F.size(words)
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(TRIMMED)) != "")
    runs = F.when(
        n_words >= WINDOW,
        F.transform(F.sequence(F.lit(1), n_words - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    beyond_ascii = F.octet_length(body) > F.length(body)
    counted = lambda letters: F.when(beyond_ascii, F.regexp_count(body, F.lit(letters))).otherwise(0).cast("long")
    stop = F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(MARKS))).isin(STOP_WORDS))
    rows = rows.select(
        "__row", "__words",
        n_words.cast("long").alias("__n"),
        F.length(F.array_join(words, "")).cast("long").alias("__chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("__symbols"),
        F.regexp_count(body, F.lit(WIDE_SYMBOLS)).cast("long").alias("__wide"),
        F.size(stop).cast("long").alias("__stop"),
        counted(OTHER_SCRIPTS).alias("__other"),
        counted(WITHOUT_BLANKS).alias("__joined"),
        lines.alias("__lines"),
        runs.alias("__runs"),
    )

    hashes = F.col("__runs")
    several = F.size(hashes) > F.size(F.array_distinct(hashes))
    paired = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.select(
        "__row", "__words", "__n", "__chars", "__symbols", "__wide", "__stop", "__other", "__joined",
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup"),
        F.when(several, F.sort_array(paired)).alias("__sorted"),
    )

    positions = _repeated_positions(words, F.col("__sorted"))
    repeat = F.when(F.col("__sorted").isNull(), F.lit(0).cast("long")).otherwise(_covered(positions))
    at_least_one = F.greatest(F.col("__n"), F.lit(1))
    mostly = lambda count: 2 * F.col(count) > F.col("__chars")
    ratios = F.struct(
        F.when(~mostly("__joined"), F.col("__chars") / at_least_one).alias("mean_word_length"),
        (F.col("__wide") / at_least_one).alias("symbol_ratio"),
        F.when(~mostly("__other"), F.col("__stop") / at_least_one).alias("stop_word_ratio"),
        (F.col("__dup") / F.greatest(F.col("__n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("__n") / F.greatest(F.col("__n_lines"), F.lit(1))).alias("words_per_line"),
    )
    rows = rows.select("__row", "__n", "__chars", "__symbols", "__dup", repeat.alias("__repeat"), ratios.alias("__r"))

    base = (F.col("__n") < MIN_WORDS) | (100 * F.col("__repeat") > MAX_REPEAT_PERCENT * F.col("__n"))
    rows = rows.withColumn("__failed", compiled(rules))
    result = F.struct(
        F.col("__n").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"), F.col("__repeat").alias("n_repeat_words"),
        base.alias("base_failed"), F.col("__failed").alias("failed"),
        (~base & (F.size("__failed") == 0)).alias("kept"),
    )
    # A filter on the result must not be moved below the steps above: it would take all of them with
    # it, one inside the other. The number of a partition is no constant to the optimizer, so it stays.
    result = F.when(F.spark_partition_id() >= 0, result)
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in names], result.alias(into))


def quality_kept(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, with the columns of ``df``."""
    return quality_scored(df, text, rules, into="__quality").filter("__quality.kept").drop("__quality")
