"""Scoring posts and collecting them per mention or per category."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionflow.functions.labels import bucket
from mentionflow.functions.scoring import Scorer, clamp_class, lexicon_scorer
from mentionflow.functions.text import clean, sentences, tokens
from mentionflow.operators.collect import MAX_RECORDS, sliding_collect
from mentionflow.operators.lookup import LITERAL_ROWS, bounded_values, lookup_join
from mentionflow.operators.posts import emitted_post, with_hits
from mentionflow.operators.windows import SLIDE, WINDOW


def score_text(df: DataFrame, text: str = "text", scorer: Scorer | None = None, name: str = "polarity") -> DataFrame:
    """``df`` with the score of a text column."""
    return df.withColumn(name, (scorer or lexicon_scorer())(F.col(text)))


def lexicon_weights(lexicon: DataFrame, max_rows: int = LITERAL_ROWS) -> Mapping[str, int] | None:
    """A (word, weight) table as a mapping, or None if it has more than ``max_rows`` words."""
    entries = bounded_values(lexicon.select(F.struct("word", "weight").alias("e")), "e", max_rows)
    return None if entries is None else {e["word"]: e["weight"] for e in entries}


def score_by_lexicon_table(
    df: DataFrame, lexicon: DataFrame, id_col: str = "id", text: str = "text", max_literals: int = LITERAL_ROWS, **bounds: int
) -> DataFrame:
    """(id, score), a row per row of ``df``, with a lexicon of any size.

    A lexicon of up to ``max_literals`` words becomes part of the plan, and a text is scored within its
    row. With a larger one words are joined: texts are not shuffled, but words, and per text its id, a
    hash of the text and sentence numbers, are. Rows with the same id and text are scored together and come back as often as they are
    there. A word that is listed twice counts with its least weight.
    """
    once = lexicon.groupBy("word").agg(F.min("weight").alias("weight"))
    weights = lexicon_weights(once, max_literals)
    if weights is not None:
        return df.select(F.col(id_col), lexicon_scorer(weights)(F.col(text)).alias("score"))
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    parts = rows.select(
        "_id", "_hash", (F.length("_text") == 0).alias("_empty"), F.posexplode_outer(sentences(F.col("_text"))).alias("_at", "_part")
    )
    words = parts.select("_id", "_hash", "_empty", "_at", F.posexplode_outer(tokens(F.col("_part"))).alias("_n", "_word"))
    weighted = lookup_join(words, once, F.col("_word"), "word", "left", F.struct("_id", "_hash", "_at"), **bounds)
    # copies of a text give every word as often as there are copies
    copies = F.count_if(F.coalesce("_n", F.lit(0)) == 0).alias("_copies")
    sums = weighted.groupBy("_id", "_hash", "_empty", "_at").agg(copies, F.sum(F.coalesce("weight", F.lit(0))).alias("_sum"))
    classes = sums.withColumn("_class", F.when(F.col("_at").isNotNull(), clamp_class(F.col("_sum") / F.col("_copies"))))
    means = classes.groupBy("_id", "_hash", "_empty").agg(F.avg("_class").alias("_mean"), F.max("_copies").alias("_copies"))
    score = F.when(F.col("_empty"), F.lit(0.0)).otherwise(F.col("_mean"))
    each = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    return means.select(F.col("_id").alias(id_col), score.alias("score"), each).drop("_copy")


def sentence_rows(df: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """One row per sentence of the cleaned text, with its position from 0."""
    return df.select(id_col, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, clean(F.col(text)))


def scored_posts(posts: DataFrame, scorer: Scorer | None = None, strict_reference: bool = False) -> DataFrame:
    """Posts with ``polarity`` (the score) and ``cat`` (its symbol)."""
    scored = score_text(posts, scorer=scorer)
    return scored.withColumn("cat", bucket(F.col("polarity"), strict_reference=strict_reference))


def scored_mentions(
    posts: DataFrame,
    keys: DataFrame,
    scorer: Scorer | None = None,
    strict_reference: bool = False,
    max_literal_keys: int | None = None,
    lookup: Mapping[str, int] | None = None,
) -> DataFrame:
    """(mention, id, created_at, text, cat, polarity), one row per post and matching handle.

    Posts without a matching handle are dropped before scoring, and a post is scored before
    it is copied to its handles.
    """
    needed = posts.select("id", "created_at", "text", "mentions")
    matching = with_hits(needed, keys, max_literal_keys, lookup)
    scored = scored_posts(matching, scorer, strict_reference)
    return scored.select(
        F.explode("hits").alias("mention"), "id", "created_at", "text", "cat", "polarity"
    )


def sentiment_groups(
    mentions: DataFrame,
    window: str = WINDOW,
    slide: str = SLIDE,
    max_records: int = MAX_RECORDS,
    **options: int,
) -> DataFrame:
    """The set of scored records of each window and mention, as bounded arrays."""
    record = F.struct(emitted_post().alias("tweet"), "mention", "cat", "polarity")
    return sliding_collect(
        mentions, record, "mention", window, slide, distinct=True, max_records=max_records, **options
    )


def category_groups(
    scored: DataFrame,
    window: str = WINDOW,
    slide: str = SLIDE,
    max_records: int = MAX_RECORDS,
    **options: int,
) -> DataFrame:
    """The (polarity, text) pairs of each window and category, repeats kept.

    Sizes are counted over all categories together, so nothing is scored for them.
    """
    record = F.struct("polarity", "id", "text")
    return sliding_collect(
        scored, record, "cat", window, slide, distinct=False, size_by=(), max_records=max_records, **options
    )
