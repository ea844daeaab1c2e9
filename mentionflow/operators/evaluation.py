"""Accuracy of scores against labels. Input: ``polarity`` (a symbol) and ``sentiment``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionflow.functions.labels import CUTOFF, predicted_negative, predicted_positive


def scores_of(scored: DataFrame, symbol: str) -> DataFrame:
    """The scores of one label."""
    return scored.where(F.col("polarity") == symbol).select("sentiment")


def label_spread(scored: DataFrame) -> DataFrame:
    """Mean score per label, with one sample standard deviation below and above."""
    score = F.nanvl("sentiment", F.lit(None).cast("double"))
    stats = scored.groupBy("polarity").agg(F.avg(score).alias("m"), F.stddev_samp(score).alias("s"))
    return stats.select(
        "polarity",
        (F.col("m") - F.col("s")).alias("low"),
        F.col("m").alias("mean"),
        (F.col("m") + F.col("s")).alias("high"),
    )


def _counters(actual: Column, predicted: Column, name: str) -> list[Column]:
    return [
        F.count_if(actual).alias(f"{name}_true"),
        F.count_if(predicted).alias(f"{name}_predicted"),
        F.count_if(actual & predicted).alias(f"{name}_correct"),
    ]


def precision_recall(scored: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row with precision and recall of both classes, from one pass.

    A class that is never predicted has no precision: NULL, not an error.
    """
    score, label = F.col("sentiment"), F.col("polarity")
    counters = scored.agg(
        *_counters(label == "+", predicted_positive(score, cutoff), "pos"),
        *_counters(label == "-", predicted_negative(score, cutoff), "neg"),
    )

    def rates(name: str) -> list[Column]:
        correct = F.col(f"{name}_correct").cast("double")
        return [
            F.try_divide(correct, F.col(f"{name}_predicted").cast("double")).alias(f"{name}_precision"),
            F.try_divide(correct, F.col(f"{name}_true").cast("double")).alias(f"{name}_recall"),
        ]

    return counters.select(*counters.columns, *rates("pos"), *rates("neg"))


def f1_macro(scored: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """F1 of both classes and their mean as a percentage."""

    def f1(name: str) -> Column:
        p, r = F.col(f"{name}_precision"), F.col(f"{name}_recall")
        return F.try_divide(2 * p * r, p + r)

    rates = precision_recall(scored, cutoff)
    scores = rates.select(f1("pos").alias("f1_pos"), f1("neg").alias("f1_neg"))
    return scores.withColumn("score", (F.col("f1_pos") + F.col("f1_neg")) / 2 * 100)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))
